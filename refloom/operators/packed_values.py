"""Problem 3: fields that hold several values, split by expectation-maximisation and Viterbi segmentation.

A field is cut into atoms at everything that can separate values; quoted and
braced spans are atoms of their own. Atoms between two sure separators form a
lattice of all their runs, and Viterbi takes the runs of least cost. A run is
a person, an organisation or a value known as a whole:

* persons by the shape of their words ("W,I", "IW", ...), with frequencies
  learned from the column;
* organisations by the words themselves: how often each begins an
  organisation's name, stands in one, or in a person's;
* whole values by how often the same value stands between sure separators,
  beside how often its first atom does.

The column itself teaches this. Its values between sure separators have a
class (person or organisation) that only some of them show by their shape;
expectation-maximisation finds the classes of the others and the word
frequencies of both. Then all fields are segmented; those in which words of
organisations meet doubtful separators are segmented again with counts that
include their own values, until the result stays the same.

What is learned goes to the workers as tables of hashed cells, whose number is
a parameter (``CELLS``) and no matter of the size of the data. There is no
list of words of organisations, and no bound on the atoms of a value.
"""

from __future__ import annotations

import math
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refloom.session import cut, records

#: Two primes: the cells that hashed words and values are counted in. A key's count is that of its emptier cell.
CELLS = (131071, 131063)
VALUE_ROUNDS = 6  # most rounds over the values between sure separators
FIELD_ROUNDS = 4  # most rounds over the fields in doubt
UNKNOWN = -3.0  # log-odds of a word never met in an organisation's name
STILL = 0.002  # share of change below which a loop has converged
#: Particles of persons' names; kept here for the operators that compare names. The segmentation learns its own.
PARTICLES = frozenset("van der den von zu zum zur vom de del della di da dos das du la le el al bin ibn ter ten".split())
HARD = r"[;|\n\r·•¦；]|(?<=\s)/(?=\s)"
SOFT = regex.compile(r"[,，]|&|(?<=[\s\"'})])(?i:[aаɑα]nd|und|et)(?=[\s\"{])|(?<=[\w.\"]{2}\s)y(?=\s[\w\"]{2})")
MARK = regex.compile(rf"(?P<h>{HARD})|(?P<q>[\"{{“„«‹])|(?P<s>{SOFT.pattern})")
REMARK = regex.compile(
    r"(?:^|[\s,;|/&·]+|\b(?:and|und)\s+)(?i:et\.?\s*al\.?|and others|and colleagues|et alii|и др\.)\s*[.,;]*\s*$"
    r"|(?<!,)\s+u\.\s?a\.\s*$"  # "X, u. a." has initials
)
INITIALS = regex.compile(r"(?:\p{L}\p{M}*\.-?)+|\p{L}\p{M}*\.?")
GLUED = regex.compile(r"(?:\p{L}\p{M}*\.)+-?\p{L}[\p{L}\p{M}'’-]+")
SPECIAL = regex.compile(r"[\p{Cf}！-～]|(?! )\p{Zs}")
PAIRS = {'"': '"', "{": "}", "“": "”", "„": "“", "«": "»", "‹": "›"}
VOID = "​"


def cleaned(text: str) -> str:
    """The text with one character for each of its characters: invisible ones and special spaces as U+200B and space, full width as usual width."""
    if text.isascii() or not SPECIAL.search(text):
        return text
    out = []
    for c in text:
        k = ord(c)
        if k < 128:
            out.append(c)
        elif 0xFF01 <= k <= 0xFF5E:
            out.append(chr(k - 0xFEE0))
        elif unicodedata.category(c) == "Cf":
            out.append(VOID)
        elif unicodedata.category(c) == "Zs":
            out.append(" ")
        else:
            out.append(c)
    return "".join(out)


def folded(value: str) -> str:
    """A value as the counts know it: without case, invisible characters and repeated spaces."""
    return " ".join(cleaned(value).replace(VOID, "").casefold().split())


class Atom:
    """A piece of a field between two possible separators: its place, its text, and what stands before it."""

    __slots__ = ("end", "fixed", "hard", "sep", "start", "text")

    def __init__(self, start: int, end: int, fixed: bool, hard: bool, sep: str, text: str):
        self.start, self.end, self.fixed, self.hard, self.sep, self.text = start, end, fixed, hard, sep, text


def close_of(s: str, i: int) -> int:
    """Where the quote or brace that opens at ``i`` closes; -1 if it doesn't. A doubled quote inside stays inside."""
    close = PAIRS[s[i]]
    if s[i] == "{":
        depth = 0
        for k in range(i, len(s)):
            depth += (s[k] == "{") - (s[k] == "}")
            if not depth:
                return k
        return -1
    k = i + 1
    while (k := s.find(close, k)) >= 0:
        if close == '"' and s[k + 1 : k + 2] == '"':
            k += 2
            continue
        return k
    return -1


def atoms(field: str) -> list[Atom]:
    """The pieces of a field in order. Invisible characters hide no separator and no mark."""
    s = cleaned(field)
    at = None
    if VOID in s:
        at = [i for i, c in enumerate(s) if c != VOID]
        s = s.replace(VOID, "")
    end = len(s)
    if m := REMARK.search(s):
        end = m.start()
    out: list[Atom] = []
    start, pos, hard, sep = 0, 0, True, ""
    while True:
        m = MARK.search(s, pos, end) if pos < end else None
        stop = m.start() if m else end
        kind = m.lastgroup if m else "h"
        if kind == "q":
            # a span is an atom only if nothing but space stands before it and a separator or the end follows
            k = -1
            if not s[start:stop].strip() and not (s[stop] == "{" and s[stop + 1 : stop + 2] == "\\"):
                k = close_of(s[:end], stop)
            if k > 0:
                j = k + 1
                while j < end and s[j] == " ":
                    j += 1
                n = MARK.match(s, j, end) if j < end else None
                n = n if n or k + 1 >= end else MARK.match(s, k + 1, end)
                if j >= end or (n and n.lastgroup != "q"):
                    out.append(Atom(stop, k + 1, True, hard, sep, s[stop : k + 1]))
                    hard, sep = False, ""
                    start = pos = k + 1
                    continue
            pos = stop + 1
            continue
        if m and kind == "s" and m.group() not in ",，&" and s[start:stop].rstrip().endswith("-"):
            pos = m.end()  # "Netz- und Signalkunde"
            continue
        a, b = start, stop
        while a < b and s[a].isspace():
            a += 1
        while a < b and s[b - 1].isspace():
            b -= 1
        if a < b:
            out.append(Atom(a, b, False, hard, sep, s[a:b]))
            hard, sep = False, ""
        if not m:
            break
        mark = "," if m.group() in ",，" else "&"
        sep = sep if hard else (mark if not sep else "&" if "&" in (sep, mark) else mark)
        hard = hard or kind == "h"
        start = pos = m.end()
    if at is not None:
        for x in out:
            x.start, x.end = at[x.start], at[x.end - 1] + 1
    return out


_KIND: dict[str, str] = {}


def kind_of(word: str) -> str:
    """I initials, i such in small letters, G initials and surname in one, l a word in small letters, W any other, '' no word."""
    k = _KIND.get(word)
    if k is None:
        w = word.strip(",;()")
        if not any(c.isalnum() for c in w):
            k = ""
        elif INITIALS.fullmatch(w):
            k = "i" if w[0].islower() else "I"
        elif GLUED.fullmatch(w):
            k = "G"
        else:
            k = "l" if w[0].islower() and w.rpartition("-")[2][:1].islower() else "W"
        if len(_KIND) > 300_000:  # a memory of this process, no part of any result
            _KIND.clear()
        _KIND[word] = k
    return k


_LOW: dict[str, str] = {}


def low_of(word: str) -> str:
    w = _LOW.get(word)
    if w is None:
        if len(_LOW) > 300_000:
            _LOW.clear()
        w = _LOW[word] = word.strip(",;()\"{}“”„«»").casefold()
    return w


def shape(kinds: str) -> str:
    """Kinds of words with repetitions of I and l as one; of more than eight letters the first eight."""
    while "II" in kinds:
        kinds = kinds.replace("II", "I")
    while "ll" in kinds:
        kinds = kinds.replace("ll", "l")
    return kinds[:8]


#: What EM starts from: names that show by their shape that they are of persons, in equal measure.
START = {k: 1.0 for k in ("W,I", "lW,I", "W,W", "W,WW", "lW,W", "lW,WW", "W,WI", "W,IW", "lW,WI", "IW", "IlW", "WW", "WIW", "WWW", "WlW", "WIlW", "WI")}


class Lexicon:
    """What a column has taught: cells of words and values, and frequencies of persons' shapes.

    ``words``: for each row of cells, cell -> (begins, inside, person, small):
    how often its words begin an organisation's name, stand elsewhere in one,
    stand in a person's name, and are written in small letters. Only cells
    with words of organisations or small ones are kept. ``values``: cell ->
    count of values of organisations. ``shapes``: of persons. ``lengths`` and
    ``seps``: words and inner separators of organisations. ``totals``: of
    persons, organisations, persons' words, and values of persons.
    """

    def __init__(self, words=({}, {}), values=({}, {}), shapes=None, lengths=None, seps=None, totals=(20.0, 1.0, 40.0)):
        self.words, self.values, self.totals = words, values, totals
        self.shapes = shapes or START
        self.lengths, self.seps = lengths or {}, seps or {}
        n = sum(self.shapes.values())
        self.shape_cost = {k: -math.log(v / n) for k, v in self.shapes.items() if v > 0}
        persons, orgs, _ = totals
        self.org_cost = -math.log((orgs + 0.5) / (persons + orgs + 1))
        self.length_cost = self.costs(self.lengths, 12)
        self.sep_cost = self.costs(self.seps, 6)
        self.memo: dict = {}
        self.known: dict = {}

    def __reduce__(self):
        return Lexicon, (self.words, self.values, self.shapes, self.lengths, self.seps, self.totals)

    @staticmethod
    def costs(counts: dict[int, float], most: int) -> list[float]:
        """Costs of 0 to ``most`` and beyond, smoothed by a geometric distribution."""
        n = sum(counts.values())
        return [-math.log((counts.get(i, 0.0) + 2.0 * 0.5 ** (i + 1)) / (n + 2.0)) for i in range(most + 1)]

    @staticmethod
    def cell(rows, key: str):
        h = zlib.crc32(key.encode("utf-8", "replace"))
        a, b = rows[0].get(h % CELLS[0]), rows[1].get(h % CELLS[1])
        return None if a is None or b is None else a if sum(a) <= sum(b) else b

    def word(self, low: str) -> tuple[float, float, bool]:
        """Log-odds of a word as the first and as a later one of an organisation's name against a person's, and whether it is a small word."""
        got = self.known.get(low)
        if got is None:
            c = self.cell(self.words, low)
            if c is None:
                got = (UNKNOWN, UNKNOWN, False)
            else:
                f, o, p, s = c
                _, orgs, pw = self.totals
                inside = max(1.0, orgs * 3.0)
                person = math.log((p + 0.3) / (pw + 1.0))
                clip = lambda x: max(-5.0, min(5.0, x))
                got = (clip(math.log((f + 0.02) / (orgs + 1.0)) - person), clip(math.log((o + 0.02) / (inside + 1.0)) - person), s > 0.5 * (f + o + p))
            if len(self.known) > 300_000:
                self.known.clear()
            self.known[low] = got
        return got

    def count(self, value: str) -> float:
        c = self.cell(self.values, value)
        return c[0] if c else 0.0

    def person(self, kinds: tuple[str, ...], seps: str) -> float:
        """Cost of a run as a person's name, by its shape."""
        if len(kinds) == 1:
            k = shape(kinds[0])
            if "W" not in k and "G" not in k:
                return 9.0 if "I" in k and "l" in k else 30.0
            if k == "W":
                return min(12.0, self.shape_cost.get(k, 12.0) + 4.0)
            return min(self.shape_cost.get(k, 99.0), 5.0 + 0.6 * len(k))
        if len(kinds) > 2 or seps[1] != ",":
            return 99.0
        left, right = shape(kinds[0]), shape(kinds[1])
        n = left.count("W")
        if not n or not right or "I" in left or "G" in left + right or "l" in left.lstrip("l"):
            return 30.0
        return min(self.shape_cost.get(f"{left},{right}", 99.0), 5.0 + 0.6 * len(right) if n == 1 else 4.0 * n - 1.5 + 1.5 * len(right))

    def organisation(self, lows: list[str], seps: int) -> float:
        """Cost of a run as an organisation's name, by its words."""
        if not lows:
            return 20.0
        gain = self.word(lows[0])[0] + sum(self.word(w)[1] for w in lows[1:])
        return self.org_cost + self.length_cost[min(len(lows), 12)] + self.sep_cost[min(seps, 6)] - gain


BETWEEN = regex.compile(r"\s+(?:and|und|&)\s+")
COMMA = regex.compile(r"\s*,\s*")


def spelled(text: str) -> str:
    """A value's key with its separator words written alike."""
    return COMMA.sub(", ", BETWEEN.sub(" & ", folded(text)))


def joined(field: str, parts: list[Atom]) -> str:
    """The value as it stands, without marks that only enclose it; a mark doubled inside counts once."""
    v = field[parts[0].start : parts[-1].end].strip()
    if len(v) > 1 and parts[0].fixed:
        q = cleaned(v[0])
        v = v[1:-1].strip()
        if q == '"':
            v = v.replace('""', '"')
    return v


def caseless(field: str) -> bool:
    return field.isupper() or field.islower()


def kinds_of(text: str, flat: bool, lex: Lexicon) -> tuple[str, list[str], bool]:
    """Kinds of an atom's words, the words without case, and whether one of them is known from organisations."""
    ks, lows, org = [], [], False
    for w in text.split():
        k = kind_of(w)
        if not k:
            continue
        low = low_of(w)
        if k == "i":
            k = "I" if flat else "l"
        elif k in "Wl":
            a, b, small = lex.word(low)
            org = org or a > 0 or b > 0
            if flat or w.isupper():
                k = "l" if small else "W"
        ks.append(k)
        lows.append(low)
    return "".join(ks), lows, org


def best_runs(group: list[Atom], kinds: list[str], lows: list[list[str]], org: bool, lex: Lexicon) -> list[tuple[int, bool]]:
    """Viterbi over the runs of a group of atoms: where each value ends, and whether it is an organisation."""
    n = len(group)
    if n == 1:
        if not org:
            return [(1, False)]
        seps = "," if group[0].sep == "," else "&"
        return [(1, lex.organisation(lows[0], 0) < lex.person((kinds[0],), seps))]
    seps = "".join("," if a.sep == "," else "&" for a in group)
    key = (tuple(kinds), seps)
    if not org and (got := lex.memo.get(key)) is not None:
        return got
    # sums over the first i atoms: words, and what these gain inside an organisation's name; what the first word of atom i gains as the first
    size, inside, first, peak = [0], [0.0], [], []
    if org:
        for w in lows:
            odds = [lex.word(x) for x in w] or [(-5.0, -5.0, False)]
            first.append(odds[0][0] - odds[0][1])
            size.append(size[-1] + len(w))
            inside.append(inside[-1] + sum(x[1] for x in odds))
            peak.append(max(first[-1] - inside[-2], peak[-1] if peak else -math.inf))
    best: list[tuple[float, int, bool]] = [(0.0, 0, False)]
    least = [0.0]
    for j in range(1, n + 1):
        now = (math.inf, 0, False)
        for i in range(j - 1, -1, -1):
            if j - i > 2 and (not org or least[i] + lex.org_cost - inside[j] - peak[i] - 3.0 >= now[0]):
                break  # no run from here or before can be cheaper: no person has more than two atoms, and no organisation gains enough
            c, is_org = lex.person(key[0][i:j], seps[i:j]), False
            if org:
                o = lex.org_cost + lex.length_cost[min(size[j] - size[i], 12)] + lex.sep_cost[min(j - i - 1, 6)] - (inside[j] - inside[i] + first[i])
                if o < 20:
                    text = group[i].text + "".join((", " if a.sep == "," else " & ") + a.text for a in group[i + 1 : j])
                    o -= min(3.0, math.log1p(lex.count(spelled(text))))
                if o < c:
                    c, is_org = o, True
            if best[i][0] + c < now[0] - 1e-9:
                now = (best[i][0] + c, i, is_org)
        best.append(now)
        least.append(min(least[-1], now[0]))
    out, j = [], n
    while j:
        out.append((j, best[j][2]))
        j = best[j][1]
    out.reverse()
    if not org:
        if len(lex.memo) > 100_000:
            lex.memo.clear()
        lex.memo[key] = out
    return out


def groups(found: list[Atom]) -> Iterator[list[Atom]]:
    """Atoms that only doubtful separators part; a quoted span is a group of its own."""
    now: list[Atom] = []
    for a in found:
        if now and (a.hard or a.fixed or now[-1].fixed):
            yield now
            now = []
        now.append(a)
    if now:
        yield now


def segment(field: str | None, lex: Lexicon) -> list[tuple[str, list[Atom]]]:
    """The values of a field with their atoms."""
    return [(v, parts) for v, parts, _, _ in segmented(field, lex)] if field else []


def segmented(field: str, lex: Lexicon) -> list[tuple[str, list[Atom], bool, bool]]:
    """Values, their atoms, whether each is an organisation, and whether it was in doubt."""
    out = []
    flat = caseless(field)
    for g in groups(atoms(field)):
        if g[0].fixed:
            out.append((joined(field, g), g, False, False))
            continue
        ks, ls, org = [], [], False
        for a in g:
            k, low, o = kinds_of(a.text, flat, lex)
            ks.append(k)
            ls.append(low)
            org = org or o
        i = 0
        for j, is_org in best_runs(g, ks, ls, org, lex):
            out.append((joined(field, g[i:j]), g[i:j], is_org, org and len(g) > 1))
            i = j
    return [x for x in out if x[0].strip(" .,;:-​")]


def seen_values(field: str) -> Iterator[tuple[str, float]]:
    """What the values between sure separators tell before anything is learned: keys with counts.

    ``s`` a person's shape, ``w`` a person's word, ``l`` a word in small
    letters, ``a`` a value of doubtful class (its shape, a tab, its key).
    A pair of atoms counts if the first is one word, which is no name by itself.
    """
    flat = caseless(field)
    none = EMPTY
    for g in groups(atoms(field)):
        text = g[0].text
        if g[0].fixed:
            text = text[1:-1]
            left, comma, right = text.partition(",")
            parts = [left, right] if comma and right.strip() else [text]
        elif len(g) == 1:
            parts = [text]
        elif len(g) == 2 and g[1].sep == ",":
            parts = [g[0].text, g[1].text]
        else:
            continue
        got = [kinds_of(p, flat, none) for p in parts]
        ks = [shape(k) for k, _, _ in got]
        if len(ks) == 2 and ks[0] not in ("W", "lW") and not flat and not g[0].fixed or not any(ks):
            continue
        lows = [w for _, low, _ in got for w in low]
        kinds = "".join(k for k, _, _ in got)
        if not flat:
            for k, w in zip(kinds, lows, strict=True):
                if k == "l":
                    yield "l" + w, 1.0
        name = ",".join(ks)
        if "I" in name or "G" in name or (not flat and name in ("W,W", "W,WW", "lW,W", "lW,WW", "WW", "W")):
            yield "s" + name, 1.0
            for w in lows:
                yield "w" + w, 1.0
        elif not flat or len(lows) > 2:
            yield f"a{'' if flat else name}\t{spelled(text)}", 1.0


EMPTY = Lexicon()


def first_guess(name: str, words: int) -> float:
    """Probability that a value of doubtful class is an organisation, by its shape alone: what EM starts from."""
    if words >= 5:
        return 0.95
    if "l" in name.lstrip("l"):
        return 0.6 if words >= 4 or "," in name else 0.4
    return 0.7 if words >= 4 and "," not in name else 0.2


def word_rows(key: str, is_org: float, n: float, out: Counter) -> None:
    """Adds the counts of one value: its words by role, and the value itself as one of an organisation."""
    words = [w for w in key.replace("&", " ").replace(",", " ").split() if any(c.isalnum() for c in w)]
    for i, w in enumerate(words):
        w = w.strip("()")
        if len(w) > 1:
            out["f" if i == 0 else "o", w] += n * is_org
            out["p", w] += n * (1 - is_org)
    if is_org > 0.5:
        out["v", key] += n
        out["n", str(min(len(words), 12))] += n
        out["k", str(min(6, key.count(" & ") + key.count(", ")))] += n
    out["c", "org"] += n * is_org
    out["c", "person"] += n * (1 - is_org)


COUNTED = "role string, key string, n double"
CELL_ROLES = {"f": 0, "v": 0, "o": 1, "p": 2, "w": 2, "l": 3}
CELLED = "kind string, row int, cell int, key string, f double, o double, p double, l double"


def batch_of(rows: Counter) -> pa.RecordBatch:
    """Counts by role and key as cells: words and values hashed (kinds w and v), the small tables by their keys."""
    sums: dict[tuple, list[float]] = {}
    for (role, key), n in rows.items():
        if role in CELL_ROLES:
            h = zlib.crc32(key.encode("utf-8", "replace"))
            for i, m in enumerate(CELLS):
                x = sums.setdefault(("v" if role == "v" else "w", i, h % m, None), [0.0] * 4)
                x[CELL_ROLES[role]] += n
        else:
            sums.setdefault((role, None, None, key), [0.0] * 4)[0] += n
    cols = [[k[i] for k in sums] for i in range(4)] + [[v[i] for v in sums.values()] for i in range(4)]
    types = [pa.string(), pa.int32(), pa.int32(), pa.string()] + [pa.float64()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["kind", "row", "cell", "key", *"fopl"])


def summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("kind", "row", "cell", "key").agg(*[F.sum(c).alias(c) for c in "fopl"])


def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``role, key, n``: what the fields' sure values tell, added up for each task."""
    seen: Counter = Counter()
    flush = lambda: pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1:] for k in seen], pa.string()), pa.array(list(seen.values()), pa.float64())], ["role", "key", "n"])
    for b in batches:
        for f in b.column(0).to_pylist():
            for k, n in seen_values(f):
                seen[k] += n
        if len(seen) > 200_000:
            yield flush()
            seen.clear()
    if seen:
        yield flush()


def judged(lex: Lexicon, first: bool = False):
    """The E-step over values of doubtful class: expected counts of their words, shapes and keys.

    The first time, when nothing is known of organisations, by the shape, and
    by whether the small words stand in persons' names too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: Counter = Counter()
        for b in batches:
            for text, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                name, _, key = text.partition("\t")
                words = [w for w in key.replace("&", " ").replace(",", " ").split() if any(c.isalnum() for c in w)]
                if first:
                    small = [c for w in words if (c := lex.cell(lex.words, w)) and c[3] > 0.5 * c[2]]
                    p = 0.02 if small and all(c[2] > 0.02 * c[3] for c in small) else first_guess(name or "W" * len(words), len(words))
                else:
                    kinds = tuple((name or "W" * len(words)).split(","))
                    a = lex.organisation(words, key.count(" & ") + key.count(", "))
                    c = lex.person(kinds, "," * len(kinds))
                    p = 1 / (1 + math.exp(max(-30.0, min(30.0, a - c))))
                word_rows(key, p, n, out)
                if p < 0.5 and name:
                    out["s", name] += n * (1 - p)
            if len(out) > 200_000:
                yield batch_of(out)
                out.clear()
        if out:
            yield batch_of(out)

    return run


def sure_cells(seen: DataFrame) -> DataFrame:
    """Words of persons and small words hashed to their cells, and the small tables, from the counts of ``tell``."""
    at = [F.struct(F.lit(i).alias("row"), F.pmod(F.crc32(F.encode("key", "UTF-8")), F.lit(m)).cast("int").alias("cell")) for i, m in enumerate(CELLS)]
    x = seen.where("role IN ('w', 'l')").select(F.explode(F.array(*at)).alias("at"), "role", "n")
    only = lambda r: F.when(F.col("role") == r, F.col("n")).otherwise(0.0)
    zero = F.lit(0.0)
    words = x.select(F.lit("w").alias("kind"), "at.row", "at.cell", F.lit(None).cast("string").alias("key"), zero.alias("f"), zero.alias("o"), only("w").alias("p"), only("l").alias("l"))
    small = seen.where("role IN ('s', 'w')").select(
        F.when(F.col("role") == "s", "s").otherwise("c").alias("kind"), F.lit(None).cast("int").alias("row"), F.lit(None).cast("int").alias("cell"),
        F.when(F.col("role") == "s", F.col("key")).otherwise("words").alias("key"), F.col("n").alias("f"), zero.alias("o"), zero.alias("p"), zero.alias("l"),
    )
    return summed(words.unionByName(small))


def lexicon(counts: DataFrame) -> Lexicon:
    """The M-step: counts as a lexicon.

    Collects the cells with words of organisations or small words (their
    number is bounded by ``CELLS``) and the small tables (shapes have at most
    eight letters of four kinds for each side of a comma).
    """
    words, values = ({}, {}), ({}, {})
    small: dict[str, dict[str, float]] = {"s": {}, "n": {}, "k": {}, "c": {}}
    for r in summed(counts).where("kind NOT IN ('w', 'v') OR f + o >= 0.5 OR l >= 1").collect():
        if r["kind"] == "w":
            words[r["row"]][r["cell"]] = (r["f"], r["o"], r["p"], r["l"])
        elif r["kind"] == "v":
            values[r["row"]][r["cell"]] = (r["f"],)
        else:
            small[r["kind"]][r["key"]] = r["f"]
    shapes = dict(small["s"])
    for k, v in START.items():
        shapes[k] = shapes.get(k, 0.0) + v
    numbers = lambda d: {int(k): v for k, v in d.items()}
    persons = sum(shapes.values())
    return Lexicon(words, values, shapes, numbers(small["n"]), numbers(small["k"]), (persons, small["c"].get("org", 0.0), small["c"].get("words", 0.0) + 2 * small["c"].get("person", 0.0) + 40.0))


def moved(a: Lexicon, b: Lexicon) -> float:
    """Share of the organisations' words and values in which two lexicons differ."""
    d = t = 0.0
    pad = lambda c: c if len(c) > 1 else (c[0], 0.0)
    for x, y in zip((*a.words, *a.values), (*b.words, *b.values), strict=True):
        for k in x.keys() | y.keys():
            p, q = pad(x.get(k, (0.0,))), pad(y.get(k, (0.0,)))
            d += abs(p[0] + p[1] - q[0] - q[1])
            t += q[0] + q[1]
    return d / t if t else 0.0


def learn(fields: DataFrame, column: str = "value") -> tuple[Lexicon, DataFrame]:
    """EM over the values between sure separators: the lexicon, and the counts it rests on."""
    seen = cut(fields.select(column).mapInArrow(tell, COUNTED).groupBy("role", "key").agg(F.sum("n").alias("n")))
    doubtful = seen.where("role = 'a'").select("key", "n")
    sure = cut(sure_cells(seen))
    lex = lexicon(sure)
    for k in range(VALUE_ROUNDS):
        new = lexicon(sure.unionByName(doubtful.mapInArrow(judged(lex, k == 0), CELLED)))
        still = moved(lex, new) < STILL
        lex = new
        if still:
            break
    return lex, cut(summed(sure.unionByName(doubtful.mapInArrow(judged(lex), CELLED))))


def cutter(lex: Lexicon, column: int, evidence: bool):
    """A function over Arrow batches that adds the values of each field, and with ``evidence`` what they tell.

    A field is in doubt if a word known from organisations stands beside a
    doubtful separator.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts, doubt, told = [], [], []
            for f in b.column(column).to_pylist():
                got = segmented(f, lex)
                parts.append([x[0] for x in got])
                unsure = [x for x in got if x[3]]
                doubt.append(bool(unsure))
                if evidence:
                    told.append([spelled(x[0]) for x in unsure if x[2]])
            cols = [*b.columns[: column + 1], pa.array(parts, pa.list_(pa.string())), pa.array(doubt, pa.bool_())]
            names = [*b.schema.names[: column + 1], "parts", "doubt"]
            if evidence:
                cols.append(pa.array(told, pa.list_(pa.string())))
                names.append("told")
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: Counter = Counter()
    for b in batches:
        for key in b.column(0).to_pylist():
            out["v", key] += 1.0
    if out:
        yield batch_of(out)


def split_fields(fields: DataFrame, column: str = "value") -> DataFrame:
    """The rows of ``fields`` with ``parts``, the values of ``column`` in order.

    Null fields give no row, blank ones an empty list; empty places and
    remarks that names were left out are no values. Fields of any length are
    segmented whole. Repeated rows are kept, each with its values.
    """
    keep = [c for c in fields.columns if c != column]
    fields = cut(fields.select(*keep, column).where(F.col(column).isNotNull()))
    lex, base = learn(fields, column)
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields.schema.fields)
    done = cut(fields.mapInArrow(cutter(lex, len(keep), False), f"{head}, parts array<string>, doubt boolean"))
    state = done.where("doubt").select(*keep, column, "parts")
    for k in range(FIELD_ROUNDS):
        # the fields in doubt once more, with what they told themselves
        again = cut(state.select(*keep, column).mapInArrow(cutter(lex, len(keep), True), f"{head}, parts array<string>, doubt boolean, told array<string>"))
        new = lexicon(base.unionByName(again.select(F.explode("told").alias("key")).mapInArrow(tally, CELLED)))
        still = k > 0 and moved(lex, new) < STILL
        lex, state = new, again
        if still:
            break
    return done.where("NOT doubt").select(*keep, column, "parts").unionByName(state.select(*keep, column, "parts"))


def split_column(fields: DataFrame, column: str = "value") -> DataFrame:
    """``column, pos, part``: each distinct field with its values, ``pos`` from 1. Null fields and fields without values give no row."""
    got = split_fields(fields.select(column).distinct(), column)
    return got.select(column, F.posexplode("parts").alias("i", "part")).select(column, (F.col("i") + 1).alias("pos"), "part")


def author_fields(bib_entries: DataFrame, verifications: DataFrame) -> DataFrame:
    """``src, row_id, value``: the author lists of both tables, each record once."""
    a = records(bib_entries.select("entry_id", "authors"), "entry_id").select(F.lit("bib_entries").alias("src"), F.col("entry_id").alias("row_id"), F.col("authors").alias("value"))
    b = records(verifications.select("verification_id", "correct_authors"), "verification_id").select(F.lit("verifications").alias("src"), F.col("verification_id").alias("row_id"), F.col("correct_authors").alias("value"))
    return a.unionByName(b).where("value IS NOT NULL AND value != ''")


def name_lists(bib_entries: DataFrame, verifications: DataFrame) -> DataFrame:
    """``src, row_id, value, parts``: every author list with its names in order."""
    return split_fields(author_fields(bib_entries, verifications))


def found(bib_entries: DataFrame, verifications: DataFrame) -> DataFrame:
    """``src, row_id, pos, value``: all names of every field that holds two or more."""
    lists = name_lists(bib_entries, verifications).where(F.size("parts") > 1)
    return lists.select("src", "row_id", F.posexplode("parts").alias("i", "value")).select("src", "row_id", (F.col("i") + 1).alias("pos"), "value")
