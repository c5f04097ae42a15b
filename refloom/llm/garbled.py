"""Problem 8: text decoded with a wrong character encoding, found and restored through a table of garbled word forms."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refloom.llm.chargrams import Bigrams, learn
from refloom.session import cut, spread

#: Fixed: encodings of Western and Cyrillic texts that are commonly taken for each other.
BYTES = ("cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1251", "koi8-r", "cp866")
#: What ends a word: ASCII other than letters. Encodings agree on it, so a word's garbled form is one word.
BREAK = r"[\x00-\x40\x5b-\x60\x7b-\x7f]+"
UNIT = re.compile("[^\x00-\x7f]+")
LOST = "\ufffd"
MORE = 20
SHORT = 3  # a byte read as another byte leaves a word of the same length; shorter ones are words of some language too often


def wide(data: bytes, code: str, gaps: str) -> str | None:
    """Decode; ``gaps`` says what becomes of bytes the encoding leaves undefined."""
    try:
        return data.decode(code)
    except UnicodeDecodeError:
        if gaps == "strict":
            return None
        if gaps == "c1":
            return "".join(bytes([b]).decode(code, "ignore") or chr(b) for b in data)
        return data.decode(code, gaps)


def forms(word: str) -> dict[str, str]:
    """Every garbled form of a word and the chain that makes it (the first chain in the order below).

    Chains: UTF-8 read as each single-byte encoding, the same twice, each
    single-byte encoding read as another one, and as UTF-8 with replacement.
    """
    out: dict[str, str] = {}
    utf = word.encode("utf-8", "replace")
    once = {}
    for d in BYTES:
        for gaps in ("c1", "ignore", "replace"):
            g = wide(utf, d, gaps)
            if g and g != word:
                once.setdefault((d, g), None)
                out.setdefault(g, f"utf-8>{d}")
    for (d, g), e in itertools.product(once, BYTES):
        for gaps in ("c1", "ignore"):
            h = wide(g.encode("utf-8", "replace"), e, gaps)
            if h:
                out.setdefault(h, f"utf-8>{d}>utf-8>{e}")
    for e in BYTES:
        try:
            raw = word.encode(e)
        except UnicodeEncodeError:
            continue
        for d in BYTES:
            g = wide(raw, d, "c1") if d != e else None
            if g and g != word:
                out.setdefault(g, f"{e}>{d}")
        g = raw.decode("utf-8", "replace")
        if LOST in g:
            out.setdefault(g, f"{e}>utf-8")
    return out


def words_of(documents: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """``ident, word``: each document's distinct words that hold a character beyond ASCII."""
    w = F.explode(F.array_distinct(F.split(F.col(text), BREAK)))
    return documents.select(F.col(ident).alias("ident"), w.alias("word")).where(F.col("word").rlike(r"[^\x00-\x7F]"))


def vocabulary(words: DataFrame) -> DataFrame:
    """``word, unit, n``: words with the number of documents they occur in, and their parts beyond ASCII (units)."""
    v = words.groupBy("word").agg(F.count("*").alias("n"))
    units = v.select(F.explode(F.array_distinct(F.expr(r"regexp_extract_all(word, '[^\\x00-\\x7F]+', 0)"))).alias("word"), "n").groupBy("word").agg(F.sum("n").alias("n"))
    return v.select("word", F.lit(False).alias("unit"), "n").unionByName(units.select("word", F.lit(True).alias("unit"), "n"))


def garbled_table(vocab: DataFrame) -> DataFrame:
    """``form, unit, original, chain, n``: garbled forms of all words and units of the corpus.

    Forms with a character that no text holds are left out, as nothing can
    match them. A unit counts only if its form is longer than one character
    or a replacement character, as one character alone proves nothing.
    """
    chars = vocab.where("unit").select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).distinct()
    held = frozenset(r["c"] for r in chars.collect()) | {chr(i) for i in range(128)}  # an alphabet: bounded by Unicode

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for w, unit, n in zip(b["word"], b["unit"], b["n"], strict=True):
                for g, chain in forms(w).items():
                    wide_chain = chain.startswith("utf-8") or LOST in g
                    if held.issuperset(g) and (wide_chain and (not unit or LOST in g or len(g) > 1) or not unit and len(g) >= SHORT):
                        rows.append((g, bool(unit), w, chain, int(n)))
            if rows:
                yield pd.DataFrame(rows, columns=["form", "unit", "original", "chain", "n"])

    return spread(vocab).mapInPandas(run, "form string, unit boolean, original string, chain string, n bigint")


def verified(hits: DataFrame, model: Bigrams) -> DataFrame:
    """Keep pairs in which the original reads better than the form, and the best original of each form.

    Reading better: for a form no longer than the original (a byte read as
    another byte, so that the way back garbles too) at least as many documents
    and a higher mean log-probability of its characters under the bigrams of
    the whole corpus. A longer form, or one with lost characters, shows by
    itself what it is; it may be more frequent than its original by ``MORE``
    times, as where a large source was read wrongly as a whole.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            gain = [model.mean(o) - model.mean(f) if LOST not in f and len(f) <= len(o) else 1.0 for o, f in zip(b["original"], b["form"], strict=True)]
            yield b.assign(gain=gain)

    scored = hits.mapInPandas(run, "form string, unit boolean, original string, chain string, n bigint, m bigint, gain double")
    shows = (F.length("form") > F.length("original")) | F.contains(F.col("form"), F.lit(LOST))
    good = scored.where((F.col("gain") > 0.3) & ((F.col("n") >= F.col("m")) | shows & (F.col("n") * MORE >= F.col("m"))))
    best = good.groupBy("form", "unit").agg(
        F.max_by(F.struct("original", "chain"), F.struct("n", "original")).alias("o"), F.countDistinct("original").alias("choices")
    )
    lost = F.col("form").contains(LOST) & (F.col("choices") > 1)
    return best.select("form", "unit", F.when(~lost, F.col("o.original")).alias("original"), F.col("o.chain").alias("chain"))


def matches(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Words of all documents, and the garbled ones: ``word, original, chain``.

    A word is garbled if it is in the table, or if one of its units is. Its
    original is null where two originals give the same form (lost characters).
    """
    words = cut(words_of(spread(documents.select("doc_id", "text"))))
    vocab = cut(vocabulary(words))
    table = garbled_table(vocab)
    here = vocab.select(F.col("word").alias("form"), "unit", F.col("n").alias("m"))
    # both sides come out of Python or grow with the corpus, so that none of these joins may broadcast
    hits = table.join(here.hint("merge"), ["form", "unit"])
    good = cut(verified(hits.select("form", "unit", "original", "chain", "n", "m"), learn(vocab.where("NOT unit"))))
    whole = good.where("NOT unit").select(F.col("form").alias("word"), "original", "chain")
    # words with a garbled unit: the originals of the units in place of the units
    parts = vocab.where("NOT unit").select("word", F.explode(F.array_distinct(F.expr(r"regexp_extract_all(word, '[^\\x00-\\x7F]+', 0)"))).alias("form"))
    by_unit = parts.join(good.where("unit").select("form", "original", "chain").hint("merge"), "form").groupBy("word").agg(
        F.map_from_entries(F.collect_list(F.struct("form", F.coalesce("original", F.lit(LOST))))).alias("m"), F.max("chain").alias("chain")
    )
    swapped = F.aggregate(F.map_entries("m"), F.col("word"), lambda w, e: F.replace(w, e["key"], e["value"]))
    by_unit = by_unit.select("word", F.when(~swapped.contains(LOST), swapped).alias("original"), "chain")
    rest = by_unit.join(whole.select("word").hint("merge"), "word", "left_anti")
    return words, whole.unionByName(rest)


def found(documents: DataFrame) -> DataFrame:
    """Documents with at least one garbled passage. Null and empty texts are no cases."""
    words, bad = matches(documents)
    return words.join(bad.select("word").hint("merge"), "word", "left_semi").select(F.col("ident").alias("doc_id")).distinct()


def restored(documents: DataFrame) -> DataFrame:
    """``doc_id, n_garbled, n_lost, text`` of each affected document, with the originals put in.

    ``n_garbled`` counts distinct garbled words, ``n_lost`` those of them whose
    original is unknown; these stay as they are. Repeated ``doc_id`` rows are
    restored each.
    """
    words, bad = matches(documents)
    of = words.distinct().join(bad.hint("merge"), "word").groupBy("ident").agg(
        F.count("*").alias("n_garbled"), F.count_if(F.col("original").isNull()).alias("n_lost"),
        F.to_json(F.map_from_entries(F.collect_list(F.when(F.col("original").isNotNull(), F.struct("word", "original"))))).alias("swap"),
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        cut_at = re.compile(f"({BREAK})")
        for b in batches:
            if not len(b):
                continue
            done = []
            for text, swap in zip(b["text"], b["swap"], strict=True):
                m = json.loads(swap) if swap else {}
                done.append("".join(m.get(w, w) for w in cut_at.split(text)))
            yield b.drop(columns="swap").assign(text=done)

    joined = documents.select("doc_id", "text").join(of.withColumnRenamed("ident", "doc_id").hint("merge"), "doc_id").select("doc_id", "n_garbled", "n_lost", "text", "swap")
    return joined.mapInPandas(run, "doc_id bigint, n_garbled bigint, n_lost bigint, text string")
