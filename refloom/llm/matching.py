"""Problem 1: entries and cached results about the same work, matched without a common key and with a confidence."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refloom.functions.similarity import lcs
from refloom.llm.variants import APOSTROPHES, bound, digraphs, distance, fold, tokens
from refloom.operators.packed_values import PARTICLES
from refloom.session import cut, spread, width

SAMPLE = 40_000  # labelled pairs the classifier is fitted on; all pairs are scored
TITLE_MINS, NAME_MINS = 3, 3  # least hashes of title words and of surnames that a record's blocks are made of
GENERIC = 4  # words of a title that many works bear
HALF = 5  # letters of a surname that a slip elsewhere spares
COMMON = 0.005  # share of the titles that hold a common word
STEM = 4  # letters of a word that enter the blocks, as titles are cut and abbreviated; whole titles are compared
#: Fixed: words that titles lose or swap freely.
STOP = frozenset("a an and of the in on for with to from by at und der die das des zur zum von mit fur fuer im auf le la les de des du et pour dans avec un une contre vers da do dos das em um uma com e na nas no nos para и в с на".split())
#: Fixed: words that tell a work from the one it follows: editions, sequels, later looks at it.
SEQUELS = tuple(
    tuple(x.split())
    for x in "revisited,reconsidered,reloaded,continued,a replication,replication,a sequel,erratum,corrigendum,addendum,a reply,a rejoinder,ten years later,twenty years later,five years later,second edition,third edition,fourth edition,new edition,revised edition,extended edition,extended version,zweite auflage,dritte auflage,neue auflage,deuxieme edition,seconde edition,nouvelle edition,segunda edicao,segunda edicion,nova edicao".split(",")
)
NUMBERED = frozenset("teil part partie parte band volume vol tome tomo book chapter часть том".split())
ROMAN = {"ii": "2", "iii": "3", "iv": "4", "v": "5", "vi": "6", "vii": "7", "viii": "8", "ix": "9"}


def alike(a: str, b: str, most: int) -> bool:
    """Whether two words are within ``most`` edits; each edit changes at most two of the letters that only one of them has."""
    return abs(len(a) - len(b)) <= most and len(set(a) ^ set(b)) <= 2 * most and distance(a, b, most) <= most


@lru_cache(1 << 16)
def endings(word: str) -> tuple[tuple[str, ...], ...]:
    """The sequel phrases that can end in a word or a misspelling of it."""
    return tuple(s for s in SEQUELS if alike(word, s[-1], min(2, bound(len(s[-1])) + (len(s[-1]) > 3))))


@lru_cache(1 << 16)
def numbered(word: str) -> bool:
    return any(alike(word, x, 1) for x in NUMBERED)


def sequel(words: list[str]) -> tuple[list[str], str]:
    """A title's words without a sequel's mark at the end, and the mark."""
    w = list(words)
    if len(w) < 2:
        return w, ""
    last = w[-1]
    if last.rstrip("s") in ROMAN:
        return w[:-1], ROMAN[last.rstrip("s")]
    if len(w) > 2 and last[0].isdigit() and re.fullmatch(r"\d\d?s?", last) and numbered(w[-2]):
        return w[:-2], last.rstrip("s")
    for s in endings(last):
        k = len(s)
        if len(w) > k and all(alike(a, b, min(2, bound(len(b)) + (len(b) > 3))) for a, b in zip(w[-k:-1], s, strict=False)):
            return w[:-k], s[-1]
    return w, ""


@lru_cache(1 << 16)
def split_title(title: str) -> tuple[tuple[str, ...], str, str]:
    """A title's content words, its letters in a row, and the mark of a sequel."""
    base, mark = sequel(title.split())
    return tuple(w for w in base if w not in STOP) or tuple(base), digraphs("".join(base)), mark


QUOTED = re.compile(r'"([^"]+)"|([^"]+)')
APART = re.compile(r"[;|/·•&\n{}]|\b(?:and|und|et|y|al|u)\b")
LETTERS = re.compile(r"[^\W\d_]+")


@lru_cache(1 << 16)
def surnames(authors: str | None) -> tuple[str, ...]:
    """Folded surnames of an author list; of organisations, the last word.

    Lists need no exact cut here: between sure separators a name with one
    comma has its surname before it; of several parts between commas each
    gives its last word, and those that hold initials only give none.
    """
    out = []
    for quoted, plain_ in QUOTED.findall(fold(authors or "")):
        for piece in [quoted] if quoted else APART.split(plain_):
            parts = [LETTERS.findall(APOSTROPHES.sub("", x)) for x in piece.split(",")]
            if len(parts) == 2 and len([w for w in parts[0] if len(w) > 2 and w not in PARTICLES]) == 1:
                parts = parts[:1]
            for ws in parts:
                words = [w for w in ws if len(w) > 2]
                if words:
                    out.append(digraphs(words[-1]))
    return tuple(dict.fromkeys(out))


def year_of(text: str | None) -> int:
    m = re.search(r"(?<!\d)(1[89]|20)\d\d(?!\d)", text or "")
    return int(m.group()) if m else 0


def prepared(title: str | None, authors: str | None, year: str | None) -> tuple[str, str, int]:
    """Title words, surnames and year in comparable form. What lacks a title has an empty one."""
    t = re.sub(r"\\&|&", " and ", title or "")
    return " ".join(digraphs(w) for w in tokens(fold(t))), " ".join(surnames(authors)), year_of(year)


@lru_cache(1 << 17)
def word_id(word: str) -> int:
    """60 bits of a word's hash."""
    return int.from_bytes(blake2b(word.encode("utf-8", "replace"), digest_size=8).digest(), "big") >> 4


@lru_cache(1 << 17)
def rank(word: str) -> tuple[int, str]:
    return zlib.crc32(word.encode("utf-8", "replace")), word


def least(words: set[str] | list[str], k: int) -> list[str]:
    """The words with the ``k`` least hashes (the bottom-k form of MinHash): two sets that share much share some of these."""
    return sorted(sorted(set(words), key=rank)[:k])


def block_keys(title: str, names: str, year: int, wide: bool, common: frozenset[str] = frozenset()) -> list[int]:
    """Blocks of a record.

    * all but one of the title's ``TITLE_MINS`` least words, those that are not
      ``common`` first, with one of the least surnames and the year
    * two of the least surnames with the year and one of the first two words or
      the last; of titles of a few words also without a word
    * all words of the title; of titles of a few words also with the year and
      half a surname
    * all words of the title on one side, all but one on the other
    * all words but one, and the beginning or end of that one, so that titles
      with one word misspelt on each side meet
    * the whole title on one side, each beginning of it on the other, so that
      a cut title meets the whole one

    Up to ``GENERIC`` words are borne by many works, and their pairs would grow
    with the square of the data: blocks of so few words hold a surname too, or
    the records without authors on one side and all on the other.
    The right side (``wide``) enters the blocks of the neighbouring years too.
    A block's id is the hash of a tuple of integers, which all processes
    compute alike, in 40 bits, which shuffle smaller than 64.
    """
    base, _ = sequel(title.split())
    content = [w for w in base if w not in STOP and len(w) > 1] or base
    full = {w[:STEM]: w for w in reversed(content)}
    stems = sorted(full)
    if not stems:
        return []
    years = ((year - 1, year, year + 1) if wide else (year,)) if year else ()
    listed = names.split()
    own = [word_id(w) for w in least(listed, NAME_MINS)]
    first = [word_id(w) for w in listed[:1]]
    mins = [word_id(w) for w in sorted(stems, key=lambda w: (w in common, rank(w)))[:TITLE_MINS]]
    words, order = [word_id(w) for w in stems], [word_id(w[:STEM]) for w in content]
    mine, other = (12, 11) if wide else (11, 12)
    out = []

    def put(kind: int, ids: list[int], by: list[int]) -> None:
        if len(ids) > GENERIC:
            out.append((kind, *ids))
            return
        out.extend((kind, *ids, 10, s) for s in by)
        out.append((kind, *ids, other))
        if not listed:
            out.append((kind, *ids, mine))

    if len(mins) > 1:
        out += [(1, y, s, *sorted(t)) for s in own for t in combinations(mins, len(mins) - 1) for y in years]
    heads = dict.fromkeys([*order[:2], order[-1], *[0] * (len(words) <= GENERIC)])
    out += [(2, y, a, b, h) for i, a in enumerate(own) for b in own[i + 1 :] for h in heads for y in years]
    put(4, words, [word_id(w) for w in listed])
    if len(words) <= GENERIC:
        out += [(3, y, part, *words) for w in listed for part in (word_id(w[:HALF]), word_id(w[-HALF:])) for y in years]
    fewer, more = (8, 9) if wide else (9, 8)
    if len(words) > 2:
        put(fewer, words, first)
    if len(words) > 3:
        for i, w in enumerate(stems):
            rest, n = words[:i] + words[i + 1 :], len(full[w])
            put(more, rest, first)
            # an edit of a short word spares its first or its last letter, one of a long word's stem spares its end
            if n <= HALF + 1:
                out += [(7, 0, word_id(full[w][0]), *rest), (7, 1, word_id(full[w][-1]), *rest)]
            if n > HALF:
                out.append((7, 2, word_id(full[w][-3:]), *rest))
    whole, part = (6, 5) if wide else (5, 6)
    put(whole, order, first)
    if len(order) > 2 and len(content[-1]) < STEM:  # the last word may be cut
        put(whole, order[:-1], first)
    for i in range(2, len(order) + 1):
        put(part, order[:i], first)
    return [hash(x) >> 24 for x in dict.fromkeys(out)]


def common_stems(titles: DataFrame) -> frozenset[str]:
    """Beginnings of words that more than one of ``1 / COMMON`` titles hold; there are never more than a few thousand."""
    stems = F.array_distinct(F.transform(F.split("title", " "), lambda w: F.substring(w, 1, STEM)))
    n = titles.count()
    rows = titles.select(F.explode(stems).alias("w")).groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") > COMMON * n)
    return frozenset(r["w"] for r in rows.collect())


@lru_cache(1 << 18)
def same_word(a: str, b: str) -> bool:
    """Equal, misspelt, or one the shortened form of the other."""
    if a == b or digraphs(a) == digraphs(b):
        return True
    short, long = sorted((a, b), key=len)
    if len(short) >= 3 and long.startswith(short) and len(long) - len(short) > 1:
        return True
    n = min(bound(len(a)), bound(len(b)))
    return bool(n) and alike(a, b, n)


@lru_cache(1 << 17)
def mask(word: str) -> int:
    """The letters of a word as bits."""
    m = 0
    for c in word:
        m |= 1 << (ord(c) & 63)
    return m


def partner(word: str, others: list[str]) -> str | None:
    """The first of some words that is the same word; those whose letters differ by more than four, and that begin unlike, are not looked at."""
    m = mask(word)
    for x in others:
        if ((m ^ mask(x)).bit_count() <= 4 or x.startswith(word) or word.startswith(x)) and same_word(word, x):
            return x
    return None


FEATURES = ("bias", "exact", "swapped", "missing", "sequel", "overlap", "no_authors", "conflict", "same_year", "near_year", "far_year", "no_year", "short", "short_no_authors", "missing_far", "short_conflict", "long_exact", "other_part", "other_words", "other_authors", "namesake")


def features(t1: str, n1: str, y1: int, t2: str, n2: str, y2: int) -> list[float]:
    """Similarity of a pair; see ``FEATURES``."""
    (ca, ja, s1), (cb, jb, s2) = split_title(t1), split_title(t2)
    exact = ja == jb
    # three edits need at most six letters more or less than the longest common run of letters in order
    close = exact or (len(ja) > 20 and abs(len(ja) - len(jb)) <= 3 and len(ja) + len(jb) - 2 * lcs(ja, jb) <= 6 and distance(ja, jb, 3) <= 3)
    if close:
        lost = extra = 0
    else:
        left = list(cb)
        rest = []
        for w in ca:
            if w in left:
                left.remove(w)
            else:
                rest.append(w)
        lost = 0
        for w in rest:
            hit = partner(w, left)
            if hit is None:
                lost += 1
            else:
                left.remove(hit)
        extra = len(left)
    swapped, missing = min(lost, extra), abs(lost - extra) / max(len(ca), len(cb), 1)
    u, v = n1.split(), n2.split()
    small, big = (u, v) if len(u) <= len(v) else (v, u)
    own = set(big)
    hits = sum(x in own or partner(x, big) is not None for x in small)
    overlap = hits / len(small) if small else 0.0
    both = bool(u and v)
    dy = abs(y1 - y2) if y1 and y2 else -1
    short = len(ca) <= 4 and len(cb) <= 4
    conflict, long_exact = both and hits == 0, close and not short
    # a mark of a sequel on one side only, unless the other title is cut short (the mark may be cut off too) and authors and year agree
    other_part = s1 != s2 and not (missing >= 0.12 and dy == 0 and overlap >= 0.5)
    # words that stand for other words need agreeing authors and years
    other_words = swapped >= 2 or (swapped and (overlap < 0.5 or dy > 1))
    # unlike authors need a title alike in full
    other_authors = conflict and (not long_exact or dy > 1)
    # titles of a few words that many works bear need agreeing authors, or, where these are not given, the same year
    namesake = short and (overlap < 0.5 or (dy > 1 and overlap < 0.8) if both else dy != 0 and not close)
    return [
        1.0, float(exact), float(swapped), missing, float(s1 != s2), overlap, float(not both), float(conflict), float(dy == 0), float(dy == 1), float(dy > 1), float(dy < 0), float(short), float(short and not both), missing * (dy > 1),
        float(short and conflict), float(long_exact), float(other_part), float(other_words), float(other_authors), float(namesake),
    ]


COL = {n: i for i, n in enumerate(FEATURES)}


def unpacked(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.float16).reshape(len(rows), len(FEATURES)).astype(float)


def weak_label(f: list[float]) -> int:
    """1, 0, or -1 (no label), from rules that are each right nearly always."""
    g = lambda n: f[COL[n]]
    if g("other_part") or g("swapped") >= 2 or g("missing") > 0.7 or g("other_words") or g("other_authors"):
        return 0
    if g("swapped") and g("overlap") < 0.75:
        return 0
    if g("namesake"):
        return 0 if g("conflict") or g("far_year") or not g("no_authors") else -1
    if g("overlap") >= 0.5 and not g("swapped") and not g("far_year") and g("missing") <= 0.6:
        return 1
    if g("overlap") >= 0.5 and g("exact") and not g("short"):
        return 1
    if g("no_authors") and g("long_exact") and not g("far_year"):
        return 1
    return -1


#: What is believed before any pair is labelled: the mean of the weights' prior distribution, in the order of ``FEATURES``.
PRIOR = np.array([1.0, 1.5, -3.0, -3.0, -1.0, 3.0, 1.0, -2.0, 1.5, 1.0, -1.5, 0.3, -0.5, -0.5, -4.0, -1.0, 1.5, -6.0, -5.0, -5.0, -5.0])


class Classifier:
    """Logistic regression with calibrated probabilities.

    Fitted by Newton steps on one half of the labelled pairs; a second
    one-variable logistic fit on the scores of the other half (Platt) makes
    the scores probabilities. Both have a normal prior around what is believed
    before (``PRIOR``; the scores as they are), so that any number of labels,
    none included, gives a model, and many outweigh it.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray):
        half = np.arange(len(y)) % 2 == 0
        self.w = self.fit(x[half], y[half], PRIOR, 0.5)
        s = x[~half] @ self.w
        self.platt = self.fit(np.column_stack([s, np.ones(len(s))]), y[~half], np.array([1.0, 0.0]), 5.0)

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, mean: np.ndarray, ridge: float) -> np.ndarray:
        w = mean.copy()
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(mean))
            step = np.linalg.solve(h, x.T @ (y - p) - ridge * (w - mean))
            w = w + step * min(1.0, 5.0 / max(1e-9, float(np.abs(step).max())))
        return w

    def probability(self, x: np.ndarray) -> np.ndarray:
        s = np.clip((x @ self.w) * self.platt[0] + self.platt[1], -30, 30)
        return 1 / (1 + np.exp(-s))


def signatures(rows: DataFrame, ident: str, title: str, authors: str, year: str) -> tuple[DataFrame, DataFrame]:
    """Records with the id of their signature, and the distinct signatures.

    Records that agree in title, authors and year after folding are one
    signature: a work cited by a third of all entries is compared once for
    each way it is written, not once for each entry. Records delivered again
    have one signature, so they are dropped behind it, when there is no text to
    move any more.
    """
    src = rows.select(F.col(ident).alias("ident"), F.col(title).alias("t"), F.col(authors).alias("a"), F.col(year).cast("string").alias("y"))
    src = spread(src.where("t IS NOT NULL AND t != ''"))

    def prepare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            p = [prepared(t, a, y) for t, a, y in zip(b["t"], b["a"], b["y"], strict=True)]
            yield pd.DataFrame({"ident": b["ident"], "title": [x[0] for x in p], "names": [x[1] for x in p], "year": [x[2] for x in p]})

    ready = src.mapInPandas(prepare, "ident bigint, title string, names string, year int").where("title != ''")
    ready = cut(ready.withColumn("sig", F.xxhash64("title", "names", "year")))

    # kept, as each reading of an exchange would deduplicate anew
    distinct = cut(ready.select("sig", "title", "names", "year").repartition(width(ready), "sig").dropDuplicates(["sig"]))
    return ready.select("ident", "sig").dropDuplicates(["ident"]), distinct


def blocks(distinct: DataFrame, wide: bool, common: frozenset[str]) -> DataFrame:
    """``sig, block`` of signatures; see ``block_keys``."""

    def block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                keys = [block_keys(t, n, int(y), wide, common) for t, n, y in zip(b["title"], b["names"], b["year"], strict=True)]
                yield pd.DataFrame({"sig": np.repeat(b["sig"].to_numpy(np.int64), [len(k) for k in keys]), "block": np.array([x for k in keys for x in k], np.int64)})

    return distinct.mapInPandas(block, "sig bigint, block bigint")


def scored_signatures(entries: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``l, r, confidence`` of all candidate pairs of signatures, and the records of both sides' signatures."""
    left, ls = signatures(entries, "entry_id", "title", "authors", "year")
    right, rs = signatures(cache, "result_id", "matched_title", "correct_authors", "note")
    common = common_stems(ls)
    lb, rb = blocks(ls, False, common), blocks(rs, True, common)
    # blocks come out of Python and grow with the data, so that no side of these joins is ever small
    pairs = lb.withColumnRenamed("sig", "l").join(rb.withColumnRenamed("sig", "r").hint("merge"), "block").select("l", "r").distinct()
    rs = rs.select(F.col("sig").alias("r"), F.col("title").alias("t2"), F.col("names").alias("n2"), F.col("year").alias("y2"))
    ls = ls.select(F.col("sig").alias("l"), F.col("title").alias("t1"), F.col("names").alias("n1"), F.col("year").alias("y1"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [features(*x) for x in zip(*[b.column(c).to_pylist() for c in ("t1", "n1", "y1", "t2", "n2", "y2")], strict=True)]
            data = np.array(rows, np.float16).tobytes()  # two bytes for each feature
            ends = np.arange(0, len(data) + 1, 2 * len(FEATURES), np.int32)
            f = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([b.column("l"), b.column("r"), f, pa.array([weak_label(x) for x in rows], pa.int32())], ["l", "r", "f", "label"])

    both = pairs.join(rs.hint("merge"), "r").join(ls.hint("merge"), "l")
    scored = cut(both.mapInArrow(compare, "l bigint, r bigint, f binary, label int"))
    # of each label the rows with the least hashes, about half a sample
    have = {r["label"]: r["n"] for r in scored.where("label >= 0").groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = lambda v: int(min(1.0, SAMPLE / 2 / have[v]) * (1 << 30))
    fit = [r for v in have for r in scored.where((F.col("label") == v) & (F.pmod(F.xxhash64("l", "r"), F.lit(1 << 30)) <= share(v))).collect()]
    fit.sort(key=lambda r: zlib.crc32(f"{r['l']},{r['r']}".encode()))
    model = Classifier(unpacked([r["f"] for r in fit]), np.array([r["label"] for r in fit], float))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = model.probability(unpacked(b.column("f").to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column("l"), b.column("r"), pa.array(p)], ["l", "r", "confidence"])

    good = scored.select("l", "r", "f").mapInArrow(judge, "l bigint, r bigint, confidence double")
    return good, left.withColumnRenamed("sig", "l"), right.withColumnRenamed("sig", "r")


def spelled_out(good: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of signatures as pairs of records."""
    out = good.join(right.select("r", F.col("ident").alias("result_id")).hint("merge"), "r").join(left.select("l", F.col("ident").alias("entry_id")).hint("merge"), "l")
    return out.select("entry_id", "result_id", "confidence")


def matched(entries: DataFrame, cache: DataFrame) -> DataFrame:
    """``entry_id, result_id, confidence`` of all candidate pairs, the unlikely ones too.

    An entry delivered again counts once. Entries and results without a title
    match nothing; missing authors or years make a match less certain. Extra
    columns are ignored.
    """
    return spelled_out(*scored_signatures(entries, cache))


def found(entries: DataFrame, cache: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``entry_id, result_id`` of the pairs that are more likely than not about one work."""
    good, left, right = scored_signatures(entries, cache)
    return spelled_out(good.where(F.col("confidence") >= threshold), left, right).select("entry_id", "result_id")
