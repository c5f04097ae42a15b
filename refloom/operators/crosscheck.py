"""Cited against listed keys, duplicate titles inside a paper, self-citations."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refloom.functions.similarity import alike_among, alike_within
from refloom.functions.text import blank, normal_title, strip, umlauts_out
from refloom.session import cut, width

BLOCK = 16000  # titles of a paper that are compared with as many others in one unit of work
FEW = 200  # titles of a paper up to which it is compared together with other papers


def unique_entries(entries: DataFrame) -> DataFrame:
    """One row for each (doc_id, key): the last entry's fields at the first entry's place."""
    cols = [c for c in entries.columns if c not in ("doc_id", "key", "ord")]
    g = entries.groupBy("doc_id", "key").agg(F.max_by(F.struct(*cols), "ord").alias("e"), F.min("ord").alias("ord"))
    return g.select("doc_id", "key", "ord", "e.*")


def cross_check(citations: DataFrame, entries: DataFrame) -> DataFrame:
    """``doc_id, key, class`` of every key: missing (cited only), orphan (listed only) or ok.

    One aggregate over both sides instead of two distincts and a full outer
    join: each task sends a key at most once for each side.
    """
    both = citations.select("doc_id", "key", F.lit(1).alias("c"), F.lit(0).alias("b")).unionByName(entries.select("doc_id", "key", F.lit(0).alias("c"), F.lit(1).alias("b")))
    g = both.groupBy("doc_id", "key").agg(F.max("c").alias("c"), F.max("b").alias("b"))
    return g.select("doc_id", "key", F.when(F.col("b") == 0, "missing").when(F.col("c") == 0, "orphan").otherwise("ok").alias("class"))


def title_pairs(titles: DataFrame, threshold: float = 0.85) -> DataFrame:
    """``doc_id, title_a, title_b, similarity`` of all pairs of different normal titles of a paper that are alike.

    Exact. A paper's titles are dealt into blocks of about ``BLOCK``; each pair
    of blocks is one unit of work, so that a paper with a tenth of all entries
    is spread over many tasks and no task holds more than two blocks. A unit
    bounds all its pairs at once (``similarity.alike_within``, papers of up to
    ``FEW`` titles many together by ``similarity.alike_among``) and lets out the
    alike ones only.
    """
    t = titles.where("t IS NOT NULL AND t != ''").select("doc_id", "t").distinct()
    size = t.groupBy("doc_id").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("blocks > 0")
    t = t.join(size, "doc_id").withColumn("b", F.pmod(F.xxhash64("t"), F.col("blocks")).cast("int"))
    units = t.select("doc_id", "t", "b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o")).select("doc_id", F.least("b", "o").alias("lo"), F.greatest("b", "o").alias("hi"), "b", "t")
    mine = lambda c: F.sort_array(F.collect_list(F.when(F.col("b") == F.col(c), F.col("t"))))
    # units are few bytes and much work, so they must not be put together by size
    units = units.repartition(width(units), "doc_id", "lo", "hi").groupBy("doc_id", "lo", "hi").agg(mine("lo").alias("left"), mine("hi").alias("right")).where("size(left) + size(right) > 1")
    kind = titles.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            units = list(zip(b["doc_id"], b["lo"], b["hi"], b["left"], b["right"], strict=True))
            few = [(d, list(u)) for d, lo, hi, u, _ in units if lo == hi and len(u) <= FEW]
            rows = []
            for k in range(0, len(few), FEW):
                part = few[k : k + FEW]
                rows += [(part[i][0], *x) for i, *x in alike_among([u for _, u in part], threshold)]
            rows += [(d, *x) for d, lo, hi, u, v in units if lo != hi or len(u) > FEW for x in alike_within(list(u), None if lo == hi else list(v), threshold)]
            if rows:
                yield pd.DataFrame(rows, columns=["doc_id", "title_a", "title_b", "similarity"])

    return units.mapInPandas(run, f"doc_id {kind}, title_a string, title_b string, similarity double")


def duplicate_pairs(entries: DataFrame, threshold: float = 0.85) -> DataFrame:
    """``doc_id, key_a, key_b, title_a, title_b, similarity, type``: classes of entries of a paper with alike titles.

    Keys are unique in a paper (the last entry of a key counts). Entries of one
    normal title are one class; a row pairs the first keys of two classes, or
    gives one class of several keys with its first and last key. So a title
    copied a thousand times yields one row, not all pairs of copies; with
    ``duplicate_classes`` nothing is lost. From .97 on the type is exact.
    """
    u = unique_entries(entries.select("doc_id", "key", "ord", "title")).withColumn("t", normal_title(F.col("title"))).where("t != ''")
    c = u.groupBy("doc_id", "t").agg(F.min("key").alias("k"), F.max("key").alias("z"), F.min_by("title", "key").alias("title"), F.max_by("title", "key").alias("last"))
    same = c.where("k != z").select("doc_id", F.col("k").alias("key_a"), F.col("z").alias("key_b"), F.col("title").alias("title_a"), F.col("last").alias("title_b"), F.lit(1.0).alias("similarity"))
    pairs = title_pairs(c, threshold)
    for s in "ab":
        pairs = pairs.join(c.select("doc_id", F.col("t").alias(f"title_{s}"), F.col("k").alias(f"k_{s}"), F.col("title").alias(f"x_{s}")), ["doc_id", f"title_{s}"])
    flip = F.col("k_a") > F.col("k_b")
    pick = lambda c, first: F.when(flip == F.lit(first), F.col(f"{c}_b")).otherwise(F.col(f"{c}_a"))
    across = pairs.select("doc_id", pick("k", True).alias("key_a"), pick("k", False).alias("key_b"), pick("x", True).alias("title_a"), pick("x", False).alias("title_b"), "similarity")
    both = same.unionByName(across)
    return both.withColumn("type", F.when(F.col("similarity") >= 0.97, "exact").otherwise("near-duplicate")).withColumn("similarity", F.floor(F.col("similarity") * 100 + 0.5) / 100)


def duplicate_classes(entries: DataFrame) -> DataFrame:
    """``doc_id, title, n_entries`` of normal titles that several entries of a paper bear."""
    t = entries.select("doc_id", normal_title(F.col("title")).alias("title")).where("title != ''")
    return t.groupBy("doc_id", "title").agg(F.count("*").alias("n_entries")).where("n_entries > 1")


def duplicate_counts(entries: DataFrame, threshold: float = 0.85) -> DataFrame:
    """``doc_id, n_duplicates``: pairs of keys of a paper whose titles are equal or alike.

    Counted by classes of equal normal titles: the pairs inside a class, and
    for each pair of alike classes the product of their sizes.
    """
    u = unique_entries(entries.select("doc_id", "key", "ord", "title"))
    # kept, as it is read five times
    n = cut(u.select("doc_id", normal_title(F.col("title")).alias("t")).where("t != ''").groupBy("doc_id", "t").agg(F.count("*").alias("n")))
    inside = n.where("n > 1").select("doc_id", F.expr("n * (n - 1) div 2").alias("p"))
    across = title_pairs(n, threshold).join(n.select("doc_id", F.col("t").alias("title_a"), F.col("n").alias("na")), ["doc_id", "title_a"])
    across = across.join(n.select("doc_id", F.col("t").alias("title_b"), F.col("n").alias("nb")), ["doc_id", "title_b"]).select("doc_id", (F.col("na") * F.col("nb")).alias("p"))
    return inside.unionByName(across).groupBy("doc_id").agg(F.sum("p").alias("n_duplicates"))


def self_citations(docs: DataFrame, entries: DataFrame, text: str = "body") -> DataFrame:
    """``doc_id, key, matched_author``: entries with a name among the capitalised words of the first 2000 characters (as the rule defines it)."""
    words = F.array_distinct(F.transform(F.regexp_extract_all(F.substring(F.col(text), 1, 2000), F.lit(r"(?U)\b([A-ZÄÖÜ][a-zäöüß]{3,})\b"), F.lit(1)), umlauts_out))
    names = F.transform(F.split("authors", "[;,]"), strip)
    j = entries.where(~blank(F.col("authors"))).select("doc_id", "key", names.alias("names")).join(docs.select("doc_id", words.alias("words")), "doc_id")
    hit = F.get(F.filter("names", lambda n: (F.length(n) > 3) & F.array_contains(F.col("words"), umlauts_out(n))), F.lit(0))
    return j.select("doc_id", "key", hit.alias("matched_author")).where("matched_author IS NOT NULL")


def key_lists(crossed: DataFrame) -> DataFrame:
    """``doc_id, cited_not_in_bib, in_bib_not_cited, correctly_used``: each paper's keys of the three classes in order."""
    of = lambda c: F.array_sort(F.collect_set(F.when(F.col("class") == c, F.col("key"))))
    return crossed.groupBy("doc_id").agg(of("missing").alias("cited_not_in_bib"), of("orphan").alias("in_bib_not_cited"), of("ok").alias("correctly_used"))
