"""Problem 5: text that looks the same but differs in its characters, brought to one form."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refloom.llm.chargrams import EDGE, Bigrams, learn
from refloom.session import spread

#: Fixed: letters of other alphabets that have the shape of a Latin letter, and that letter.
CYRILLIC = dict(zip("аеорсухіѕјһԁԛԝӏґАВЕКМНОРСТУХІЅЈԌԚԜ", "aeopcyxisjhdqwlrABEKMHOPCTYXISJGQW", strict=True))
GREEK = dict(zip("ορνικυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧϲϳ", "opvikuxABEZHIKMNOPTYXcj", strict=True))
OTHER = dict(zip("ɡɑıօսոհցԼՕՏ", "gaiounhgLOS", strict=True))  # Latin letters of phonetics, and Armenian
TO_LATIN = {**CYRILLIC, **GREEK, **OTHER}
TO_LATIN.pop("ґ")
TO_CYRILLIC = {v: k for k, v in CYRILLIC.items() if k not in "ґԁԛԝӏԌԚԜѕіјһЅІЈ"}  # into Russian letters only
TO_CYRILLIC |= {g: TO_CYRILLIC[x] for g, x in GREEK.items() if x in TO_CYRILLIC}
#: Fixed: ranges whose characters stand for plain ones: ligatures, full and half width, mathematical letters, Roman numerals; and the signs of Ohm, Kelvin and Angstrom.
COMPATIBLE = ((0xFB00, 0xFB06), (0xFF01, 0xFFEF), (0x1D400, 0x1D7FF), (0x2160, 0x2188), (0x2126, 0x2126), (0x212A, 0x212B), (0x1C4, 0x1CC), (0x1F1, 0x1F3))
JOINERS = frozenset("͏ᅟᅠ឴឵ㅤﾠ")
WORD = regex.compile(r"[\p{L}\p{M}]+")
SWITCH = -6.0  # log-probability of a change of script inside a word
SWAP = -0.7  # log-probability of a look-alike in place of a letter


def invisible(c: str) -> bool:
    """Characters that take no place: format characters, variation selectors, fillers."""
    return unicodedata.category(c) == "Cf" or c in JOINERS or 0xFE00 <= ord(c) <= 0xFE0F


def plain(text: str) -> str:
    """Compatibility forms, special spaces and split accents in their usual form; invisible characters deleted.

    Superscripts, fractions and other signs of a shape of their own stay.
    """
    out = []
    for c in text:
        k = ord(c)
        if k < 128:
            out.append(c)
        elif invisible(c):
            continue
        elif unicodedata.category(c) == "Zs":
            out.append(" ")
        elif any(a <= k <= b for a, b in COMPATIBLE):
            out.append(unicodedata.normalize("NFKC", c))
        else:
            out.append(c)
    return unicodedata.normalize("NFC", "".join(out))


def script(c: str) -> str:
    """L, C, G or O: the alphabet of a letter, marks and others counting as O."""
    k = ord(c)
    if c in OTHER:
        return "X"
    if k < 0x250:
        return "L"
    if 0x370 <= k < 0x400 or 0x1F00 <= k < 0x2000:
        return "G"
    if 0x400 <= k < 0x530:
        return "C"
    return "O"


def choices(c: str) -> list[str]:
    """A letter and its look-alikes."""
    out = [c]
    latin = TO_LATIN.get(c)
    if latin:
        out.append(latin)
    cyr = TO_CYRILLIC.get(c)
    if cyr and cyr not in out:
        out.append(cyr)
    return out


def sure(word: str) -> str:
    """The alphabet of a word's letters that have no look-alike in another one; '' if there is none or they disagree."""
    seen = {script(c) for c in word if len(choices(c)) == 1 and script(c) in "LCG"}
    return seen.pop() if len(seen) == 1 else ""


def best_path(word: str, model: Bigrams, lean: str) -> str:
    """Viterbi over the look-alike lattice of a word.

    A path pays for each look-alike it takes, for each change of alphabet
    inside the word and for letters not of the alphabet ``lean`` of the text
    around; among equals the word as it stands wins, as its letters come first.
    """
    paths: dict[str, tuple[float, str]] = {EDGE: (0.0, "")}
    for c in word:
        new: dict[str, tuple[float, str]] = {}
        for k, o in enumerate(choices(c)):
            s = script(o)
            own = (SWAP if k else 0.0) + (-1.5 if lean and s != lean and s != "O" else 0.0) + (-4.0 if s == "X" else 0.0)
            for p, (score, text) in paths.items():
                step = model.step(p, o) + own
                if p != EDGE and "O" not in (s, script(p)) and script(p) != s:
                    step += SWITCH
                if o not in new or score + step > new[o][0] + 1e-9:
                    new[o] = (score + step, text + o)
        paths = new
    return max(((score + model.step(p, EDGE), text == word, text) for p, (score, text) in paths.items()), default=(0, True, word))[2]


def one_form(text: str, model: Bigrams) -> str:
    """The text in its one form: ``plain``, then each word with letters of doubtful alphabet by its best path.

    Words of one alphabet whose letters are partly without look-alikes stay
    as they are (a Cyrillic word, a Greek letter of a formula); so does a
    single small Greek letter before a hyphen or digit.
    """
    t = plain(text)
    if t.isascii():
        return t
    words = list(WORD.finditer(t))
    kinds = [sure(m.group()) for m in words]
    out, end = [], 0
    for i, m in enumerate(words):
        w = m.group()
        out.append(t[end : m.start()])
        end = m.end()
        scripts = {script(c) for c in w} - {"O"}
        if w.isascii() or not any(len(choices(c)) > 1 or script(c) == "X" for c in w):
            out.append(w)
            continue
        if len(scripts) == 1 and kinds[i] and "X" not in scripts:
            out.append(w)  # letters of one alphabet, some of which exist in it alone
            continue
        after = t[end : end + 1]
        if len(w) == 1 and script(w) == "G" and w.islower() and (after in "-‐‑–_^²³" and after or not any(kinds)):
            out.append(w)
            continue
        if kinds[i]:
            lean = kinds[i]
        else:
            # the nearest words whose alphabet is sure, on both sides
            left = next((k for k in reversed(kinds[:i]) if k), "")
            right = next((k for k in kinds[i + 1 :] if k), "")
            lean = left if left == right or not right else right if not left else "" if {left, right} == {"L", "C"} and len(scripts) == 1 else left
        if len(scripts) == 1 and lean in ("", *scripts):
            out.append(w)
            continue
        new = best_path(w, model, lean)
        # a word that stays mixed holds a slip of the pen, not look-alikes
        out.append(new if len({script(c) for c in new} - {"O"}) == 1 else w)
    out.append(t[end:])
    return "".join(out)


def long_form(entries: DataFrame, fields: tuple[str, ...] = ("title", "authors"), ident: str = "entry_id") -> DataFrame:
    """``ident, field, value`` of every field that is not null, each record once."""
    once = entries.select(ident, *fields).dropDuplicates([ident])
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])).alias("p")
    return once.select(F.col(ident).alias("ident"), pairs).select("ident", "p.field", "p.value").where("value IS NOT NULL")


def model_of(values: DataFrame) -> Bigrams:
    """Bigrams of all words of the column whose letters are of one alphabet."""
    w = values.select(F.explode(F.split("value", r"[^\p{L}]+")).alias("word")).where("word != ''").groupBy("word").agg(F.count("*").alias("n"))
    mixed = F.col("word").rlike(r"\p{IsLatin}") & F.col("word").rlike(r"[\p{IsCyrillic}\p{IsGreek}\p{IsArmenian}]")
    other = F.col("word").rlike(r"[\p{IsGreek}\p{IsArmenian}ɡ]|[＀-￯]")
    return learn(w.where(~mixed & ~other))


def canonical(entries: DataFrame, fields: tuple[str, ...] = ("title", "authors"), ident: str = "entry_id") -> DataFrame:
    """``ident, field, value, changed``: every value in one form.

    Values of ASCII characters only never leave the JVM. Null fields give no
    row, empty ones stay empty. A record delivered again counts once.
    """
    values = long_form(entries, fields, ident)
    model = model_of(values)
    kind = entries.schema[ident].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            new = [one_form(v, model) for v in b["value"]]
            yield pd.DataFrame({"ident": b["ident"], "field": b["field"], "value": new, "changed": [a != o for a, o in zip(new, b["value"], strict=True)]})

    far = F.col("value").rlike(r"[^\x00-\x7F]")
    done = spread(values.where(far)).mapInPandas(run, f"ident {kind}, field string, value string, changed boolean")
    return done.unionByName(values.where(~far).withColumn("changed", F.lit(False))).withColumnRenamed("ident", ident)


def found(entries: DataFrame) -> DataFrame:
    """``entry_id, field`` of the values that held a character passing for another, or one that cannot be seen."""
    return canonical(entries).where("changed").select("entry_id", "field")
