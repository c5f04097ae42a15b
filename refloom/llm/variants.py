"""Problem 4: variant spellings of known persons and organisations, linked by a trie join."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from refloom.llm.lookalikes import TO_LATIN, plain
from refloom.operators.packed_values import PARTICLES, name_lists
from refloom.session import cut, width

SHARD = 2_000  # words of one length that one task looks up in a trie
SLIPS = 0.04  # share of uses of a surname that are misspelt
STROKES = str.maketrans({"ø": "o", "ł": "l", "ß": "ss", "æ": "ae", "œ": "oe", "đ": "d", "ð": "d", "þ": "th", "ı": "i"})
ACCENT = re.compile(r"\{?\\([\"'`^~=.]|[uvHcdb](?=[\s{]))\s*\{?\\?([A-Za-z])\}?\}?")
WORDS = re.compile(r"[^\W_]+")
APOSTROPHES = re.compile(r"['’‘`]")
ABBREVIATED = re.compile(r"\barb\.?-gr\b")
PIECES = re.compile(r"\S+|\s+")
MACROS = {"\\aa": "å", "\\AA": "Å", "\\o": "ø", "\\O": "Ø", "\\l": "ł", "\\L": "Ł", "\\ss": "ß", "\\ae": "æ", "\\AE": "Æ"}


@lru_cache(1 << 17)
def fold_word(word: str) -> str:
    if word.isascii() and "\\" not in word:
        return word.casefold()
    t = ACCENT.sub(r"\2", plain(word))
    for m, c in MACROS.items():
        if m in t:
            t = re.sub(r"\{?" + re.escape(m) + r"(?![A-Za-z])\s*\}?", c, t)
    t = "".join(TO_LATIN.get(c, c) for c in t).casefold().translate(STROKES)
    return "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c))


def fold(text: str) -> str:
    """A name in small letters without accents, look-alikes, macros and invisible characters."""
    if "\\" in text:
        return fold_word(text)  # a macro may go on behind a space
    return "".join(map(fold_word, PIECES.findall(text)))


def tokens(folded: str) -> list[str]:
    """Words of a folded name; apostrophes belong to the word, hyphens part words."""
    if "arb" in folded:
        folded = ABBREVIATED.sub("arbgr", folded)
    return WORDS.findall(APOSTROPHES.sub("", folded))


def bound(length: int) -> int:
    """Edits that a word of this length may differ by."""
    return 0 if length < 4 else 1 if length < 8 else 2


DIGRAPH = re.compile(r"([aou])e(?=[^\Waeiouy])")


@lru_cache(1 << 17)
def digraphs(word: str) -> str:
    """The word with ae, oe, ue as a, o, u, so that both ways to write an umlaut agree."""
    return DIGRAPH.sub(r"\1", word)


def distance(a: str, b: str, most: int) -> int:
    """Edits from one word to another (insert, delete, replace, swap of neighbours), or ``most`` + 1 if more.

    Without what both begin and end with, and along the diagonals that ``most`` edits can reach.
    """
    if a == b:
        return 0
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return most + 1
    k = 0
    while k < n and k < m and a[k] == b[k]:
        k += 1
    while n > k and m > k and a[n - 1] == b[m - 1]:
        n -= 1
        m -= 1
    a, b, n, m = a[k:n], b[k:m], n - k, m - k
    if not n or not m:
        return min(max(n, m), most + 1)
    far = most + 1
    before: list[int] = []
    row = [min(j, far) for j in range(m + 1)]
    for i in range(1, n + 1):
        c = a[i - 1]
        lo, hi = max(1, i - most), min(m, i + most)
        new = [far] * (m + 1)
        if lo == 1:
            new[0] = min(i, far)
        least = new[0]
        for j in range(lo, hi + 1):
            d = b[j - 1]
            x = row[j - 1] + (c != d)
            if row[j] < x:
                x = row[j] + 1
            if new[j - 1] < x:
                x = new[j - 1] + 1
            if i > 1 and j > 1 and c == b[j - 2] and a[i - 2] == d and before[j - 2] < x:
                x = before[j - 2] + 1
            if x < far:
                new[j] = x
                if x < least:
                    least = x
        if least > most:
            return far
        before, row = row, new
    return row[m]


class Trie:
    """Words as a tree of letters; ``near`` walks it with the rows of a Levenshtein automaton and leaves a branch when no row entry is within the bound."""

    def __init__(self, words: list[str]):
        self.root: dict = {}
        for w in words:
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node[""] = w

    def near(self, query: str, most: int) -> list[tuple[str, int]]:
        out: list[tuple[str, int]] = []
        first = list(range(len(query) + 1))
        stack = [(self.root, "", first, first)]
        while stack:
            node, last, row, before = stack.pop()
            for c, child in node.items():
                if c == "":
                    if row[-1] <= most:
                        out.append((child, row[-1]))
                    continue
                new = [row[0] + 1]
                for j, d in enumerate(query, 1):
                    x = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d))
                    if j > 1 and last == d and c == query[j - 2] and before is not first:
                        x = min(x, before[j - 2] + 1)
                    elif j > 1 and last == d and c == query[j - 2] and row is not first:
                        x = min(x, j - 2 + 1)
                    new.append(x)
                if min(new) <= most:
                    stack.append((child, c, new, row))
        return out


def trie_join(words: DataFrame, known: DataFrame) -> DataFrame:
    """``word, known, d``: all pairs of words within ``bound`` of the longer one's length.

    Known words are sharded by length into tries; a word visits the shards of
    the lengths its bound allows. A shard is salted by the number of words of
    its length, with its trie built in each part, so that a length that a third
    of all words have is spread over as many tasks as it needs.
    """
    reach = F.when(F.length("known") + 2 < 8, 1).otherwise(2)
    homes = known.where("length(known) > 0").distinct().withColumn("len", F.explode(F.sequence(F.greatest(F.lit(1), F.length("known") - reach), F.length("known") + reach)))
    asks = words.where("length(word) > 0").withColumn("len", F.length("word"))
    # a row for each length
    salts = asks.groupBy("len").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("salts"))
    homes = homes.join(salts, "len").select("known", "len", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    asks = asks.join(salts, "len").select("word", "len", F.pmod(F.xxhash64("word"), F.col("salts")).cast("int").alias("salt"))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows: list = []
        if len(left) and len(right):
            trie = Trie(right["known"].tolist())
            for w in left["word"]:
                b = bound(len(w))
                rows += [(w, k, d) for k, d in trie.near(w, b) if d <= min(b, bound(len(k)))]
        return pd.DataFrame(rows, columns=["word", "known", "d"])

    # few bytes and much work: by a fixed number of partitions, which are not joined into fewer
    asks, homes = (x.repartition(width(x), "len", "salt") for x in (asks, homes))
    return asks.groupBy("len", "salt").cogroup(homes.groupBy("len", "salt")).applyInPandas(run, "word string, known string, d int")


class Person:
    """A registered person: surname words without particles, and given names."""

    def __init__(self, name: str):
        s, _, g = fold(name).partition(",")
        self.surname = [t for t in tokens(s) if t not in PARTICLES] or tokens(s)
        self.given = tokens(g)


def given_fits(word: str, full: str, short: dict[str, set[str]] | None = None) -> bool:
    """Whether a word can stand for a given name: itself, its initial, its beginning, a learned short form, or a misspelling of one of them."""
    if len(word) == 1:
        return full.startswith(word)
    own = (short or {}).get(full, ())
    if word == full or word in own or digraphs(word) == digraphs(full):
        return True
    if len(word) >= 4 and full.startswith(word) and len(word) < len(full) - 1:
        return True
    most = 1 if len(full) < 8 else 2
    return len(word) > 3 and any(distance(word, x, most if x == full else 1) <= (most if x == full else 1) for x in (full, *own) if len(x) > 3)


def shared(a: str, b: str) -> int:
    """Length of the longest run of letters that two words share."""
    return next((n for n in range(min(len(a), len(b)), 0, -1) if any(a[i : i + n] in b for i in range(len(a) - n + 1))), 0)


def person_fits(name: str, registered: str, allowed: set[str], frequent: frozenset[str] | set[str] = frozenset(), short: dict[str, set[str]] | None = None, any_given: list | None = None) -> bool:
    """Whether a written name can be the registered person, in any order of its words.

    One word (or run) must be the surname, misspelt only if that spelling is
    rare beside the right one (``allowed``), or if it is not (``frequent``) and
    all given names stand there in full; all others must fit the given names in their
    order, particles aside. A middle name may be missing; one the person does
    not have excludes them.
    """
    p = Person(registered)
    f = fold(name)
    words = tokens(re.sub(r"\b([^\W\d_])\.(?=[^\W\d_])", r"\1. ", f))
    n = len(p.surname)
    comma = len(tokens(f.partition(",")[0])) if "," in f else 0
    for i in range(len(words) - n + 1):
        run = list(zip(words[i : i + n], p.surname, strict=True))
        rare = all(surname_fits(w, s, allowed) for w, s in run)
        if not rare and not all(surname_fits(w, s, allowed | frequent) for w, s in run):
            continue
        if comma and i + n > comma:
            continue  # the surname stands before the comma
        rest = words[:i] + words[i + n :]
        # particles and their misspellings stand right before the surname
        left = [w for w in words[:i] if w not in PARTICLES]
        right = [w for w in words[i + n :] if w not in PARTICLES]
        if comma or not right:
            left = [w for w in left if not (len(w) > 1 and registered_particle(w, registered) and not any(given_fits(w, g, short) for g in p.given))]
        given = left + right
        if not given or len(given) > len(p.given) or len(rest) < 1:
            continue
        if not rare and [digraphs(w) for w in given if len(w) > 1] != [digraphs(g) for g in p.given]:
            continue
        if any_given is not None:
            if rare and len(given[0]) > 1 and all(given_fits(w, g) for w, g in zip(given[1:], p.given[1:], strict=False)):
                any_given.append(given[0])
            continue
        if all(given_fits(w, g, short) for w, g in zip(given, p.given, strict=False)):
            return True
    return False


def registered_particle(word: str, registered: str) -> bool:
    """Whether a short word is a misspelt particle of the registered name."""
    own = [t for t in tokens(fold(registered.partition(",")[0])) if t in PARTICLES]
    return any(distance(word, t, 1) <= 1 for t in own)


def surname_fits(word: str, surname: str, allowed: set[str]) -> bool:
    if word == surname or digraphs(word) == digraphs(surname):
        return True
    b = min(bound(len(word)), bound(len(surname)))
    return bool(b) and word in allowed and distance(word, surname, b) <= b


def organisation(name: str) -> tuple[list[str], set[str], str]:
    """Content words, small words, and the initials of the capitalised words of a registered organisation's name."""
    own = re.findall(r"[^\W\d_]+", plain(name))
    small = {t for w in own if w[0].islower() for t in tokens(fold(w))}
    return [w for w in tokens(fold(name)) if w not in small], small, "".join(fold(w[0]) for w in own if w[0].isupper())


def abbreviates(w: str, full: str) -> bool:
    """Whether a short word stands for a longer one: the same first letter, and its letters in order ("ztr", "inst", "ag")."""
    if not 1 < len(w) <= 5 or len(w) + 2 > len(full) or w[0] != full[0]:
        return False
    rest = iter(full)
    return all(c in rest for c in w)


def org_fits(name: str, registered: str) -> bool:
    """Whether a written name can be the registered organisation.

    Each content word must have its partner (misspelt, abbreviated, or a place
    with -er), in any order, and nothing but small words may be left; or the
    name is the acronym of the registered name beside the place, its first or last word.
    """
    have, small, initials = organisation(registered)
    ws = tokens(fold(name).replace("arbgr", "arb gr"))
    if not have:
        return False
    if len(ws) == 2:
        slip = 1 if len(initials) > 4 else 0
        for a, b in (ws, ws[::-1]):
            if distance(a, initials, slip) <= slip and (word_fits(b, have[-1]) or word_fits(b, have[0])):
                return True
    left = list(ws)
    for h in have:
        hit = next((w for w in left if w == h), None) or next((w for w in left if word_fits(w, h)), None) or next((w for w in left if abbreviates(w, h)), None)
        if hit is None:
            return False
        left.remove(hit)
    return all(len(w) <= 3 or digraphs(w) in {digraphs(x) for x in small} or len(w) <= 4 and any(distance(w, x, 1) <= 1 for x in small) for w in left)


def word_fits(w: str, full: str) -> bool:
    if w == full or digraphs(w) == digraphs(full) or (w.endswith("er") and w[:-2] == full):
        return True
    b = min(2, bound(len(full)), max(1, bound(len(w))))
    return len(w) > 3 and min(distance(w, full, b), distance(w.removesuffix("er"), full, b)) <= b


def short_forms(pairs: DataFrame) -> DataFrame:
    """``given, short``: short forms of given names, learned from names with registered surnames.

    A word that stands in place of a given name beside several surnames of
    persons who bear it, and hardly beside other registered surnames, is a
    short form of it: at least half of the registered surnames it is met with
    must have a bearer of the name, and no other name may have far more of
    them. One surname is enough if the two words share three letters in a row
    (two, if the short form has no more than three). Where the word fits the
    name of another bearer of the surname, it tells nothing of the first.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = set()
            for v, n, r in zip(b["value"], b["name"], b["allowed"], strict=True):
                p = Person(n)
                seen: list[str] = []
                if p.given:
                    person_fits(v, n, set(r), any_given=seen)
                rows |= {(p.given[0], w, " ".join(p.surname), shared(w, p.given[0]) >= (3 if len(w) > 3 else 2)) for w in seen}
            if rows:
                got = pd.DataFrame(list(rows), columns=["given", "short", "surname", "alike"])
                yield got.assign(fits=[given_fits(w, g) for w, g in zip(got["short"], got["given"], strict=True)])

    seen = pairs.where("kind = 'person'").mapInPandas(run, "given string, short string, surname string, alike boolean, fits boolean").distinct()
    seen = seen.groupBy("surname", "short").agg(F.max("fits").alias("fits"), F.collect_set(F.struct("given", "alike")).alias("g")).where("NOT fits").select("surname", "short", F.inline("g"))
    n = seen.groupBy("given", "short").agg(F.countDistinct("surname").alias("n"), F.first("alike").alias("alike"))
    total = seen.groupBy("short").agg(F.countDistinct("surname").alias("total")).join(n.groupBy("short").agg(F.max("n").alias("most")), "short")
    good = (F.col("n") >= 0.5 * F.col("total")) & (F.col("n") >= 0.75 * F.col("most")) & ((F.col("n") >= 2) | F.col("alike"))
    return n.join(total, "short").where(good).select("given", "short")


def links(name_rows: DataFrame, registry: DataFrame) -> DataFrame:
    """``vid, entity_id`` for each distinct name (by its 64-bit hash) and each entity it can stand for.

    ``name_rows``: a column ``value``. Names are folded and cut into words; the
    trie join gives each word its registered neighbours; each (name, entity)
    that shares a neighbour of the entity's anchor (a person's surname, the
    rarest word of an organisation) is checked word by word. Null names and
    names without letters match nothing.
    """
    distinct = name_rows.select("value").where("value IS NOT NULL").groupBy("value").agg(F.count("*").alias("uses"))
    distinct = distinct.repartition(width(distinct), "value")

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b.assign(words=[sorted(set(tokens(fold(v)))) for v in b["value"]])

    words = cut(distinct.mapInPandas(cut_up, "value string, uses bigint, words array<string>"))

    def anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, k, n in zip(b["entity_id"], b["kind"], b["name"], strict=True):
                if n:
                    ks = Person(n).surname[-1:] if k == "person" else list(dict.fromkeys(organisation(n)[0]))
                    rows += [(i, k, n, w, x, w in (ks[0], ks[-1])) for w in ks for x in {w, digraphs(w) if k == "person" else w + "er"}]
            if rows:
                yield pd.DataFrame(rows, columns=["entity_id", "kind", "name", "word", "known", "edge"])

    every = registry.select("entity_id", "kind", "name").mapInPandas(anchors, "entity_id bigint, kind string, name string, word string, known string, edge boolean")
    common = every.groupBy("word").agg(F.countDistinct("entity_id").alias("df"))
    # the rarest of all words, and of the first and last one, which an acronym keeps; a few rows for each entity
    rarest = lambda *by: F.rank().over(Window.partitionBy("entity_id", "name", *by).orderBy("df"))
    known = every.join(common, "word").select("*", rarest().alias("r"), rarest("edge").alias("e"))
    known = cut(known.where("r = 1 OR edge AND e = 1").select("entity_id", "kind", "name", "known").distinct())
    counts = cut(words.select(F.explode("words").alias("word"), "uses").groupBy("word").agg(F.sum("uses").alias("uses")))
    near = trie_join(counts.select("word"), known.select("known"))
    right = counts.select(F.col("word").alias("known"), F.col("uses").alias("right_uses"))
    # a misspelling is as frequent as slips of the pen explain (mean and three deviations); a more frequent spelling needs more evidence, see person_fits
    slips = SLIPS * F.coalesce("right_uses", F.lit(0))
    near = near.join(counts, "word").join(right, "known", "left").select("word", "known", ((F.col("d") == 0) | (F.col("uses") <= slips + 3 * F.sqrt(slips) + 1)).alias("rare"))
    near = near.join(known, "known").groupBy("word", "entity_id", "kind", "name").agg(F.max("rare").alias("rare"))
    each = lambda rare: F.collect_set(F.when(F.col("rare") == rare, F.col("word")))
    pairs = words.select("value", F.explode("words").alias("word")).join(near, "word").groupBy("value", "entity_id", "kind", "name").agg(each(True).alias("allowed"), each(False).alias("frequent"))
    pairs = cut(pairs)

    def givens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, n, g) for i, n in zip(b["entity_id"], b["name"], strict=True) for g in Person(n).given]
            if rows:
                yield pd.DataFrame(rows, columns=["entity_id", "name", "given"])

    borne = known.where("kind = 'person'").select("entity_id", "name").distinct().mapInPandas(givens, "entity_id bigint, name string, given string")
    shorts = short_forms(pairs).join(borne.select(F.col("given").alias("short")).distinct(), "short", "left_anti")
    shorts = shorts.groupBy("given").agg(F.collect_list("short").alias("short"))
    forms = borne.join(shorts, "given").groupBy("entity_id", "name").agg(F.to_json(F.map_from_entries(F.collect_set(F.struct("given", "short")))).alias("forms"))

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok = []
            for v, k, n, r, q, f in zip(b["value"], b["kind"], b["name"], b["allowed"], b["frequent"], b["forms"], strict=True):
                ok.append(person_fits(v, n, set(r), set(q), {g: set(x) for g, x in json.loads(f).items()} if f else None) if k == "person" else org_fits(v, n))
            if any(ok):
                yield b.loc[ok, ["vid", "entity_id"]]

    asked = pairs.join(forms, ["entity_id", "name"], "left").select(F.xxhash64("value").alias("vid"), "value", "entity_id", "kind", "name", "allowed", "frequent", "forms")
    return asked.mapInPandas(check, "vid bigint, entity_id bigint").distinct()


def found(bib_entries: DataFrame, verifications: DataFrame, registry: DataFrame) -> DataFrame:
    """``src, row_id, entity_id``: each record and each registered entity named in its author list."""
    lists = cut(name_lists(bib_entries, verifications).select("src", "row_id", "parts"))
    # spellings are counted over distinct author lists, so that a much-cited one counts once
    once = lists.select("parts", F.xxhash64(F.array_sort("parts")).alias("h")).dropDuplicates(["h"])
    linked = links(once.select(F.explode("parts").alias("value")), registry)
    named = lists.select("src", "row_id", F.explode(F.array_distinct(F.transform("parts", lambda x: F.xxhash64(x)))).alias("vid"))
    return named.join(linked, "vid").select("src", "row_id", "entity_id").distinct()
