"""Deterministic verdicts, overlays, scores and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refloom.functions.text import blank, grade, normal_title

#: Fixed: count column, points for each, most points.
PENALTIES = (("n_missing", 10, 30), ("n_orphan", 5, 20), ("n_incomplete", 5, 20), ("n_fake", 10, 30), ("n_duplicates", 5, 10), ("n_style", 2, 6))
FALLBACK = (("n_fake", 15, 45), ("n_missing", 10, 30), ("n_incomplete", 5, 20), ("n_orphan", 3, 12), ("n_key_issues", 5, 15))


def pre_screen(overlap: Column, similarity: Column, status: Column) -> Column:
    """``struct<verdict,confidence>`` where author overlap decides, else null."""
    found = status.isin("verified", "partial_match")
    v = lambda name, conf: F.struct(F.lit(name).alias("verdict"), conf.cast("double").alias("confidence"))
    low = F.when(similarity >= 0.5, v("FAKE", F.bround(1 - overlap, 2))).otherwise(v("SUSPICIOUS", F.lit(0.45)))
    return F.when((overlap < 0.3) & found, low).when((overlap >= 0.7) & (status == "verified"), v("REAL", F.least(F.lit(1.0), 0.8 + 0.2 * overlap)))


def fallback_verdict(status: Column, confidence: Column) -> Column:
    """Without a model: verified is real, anything else suspicious."""
    return F.struct(F.when(status == "verified", "REAL").otherwise("SUSPICIOUS").alias("verdict"), F.coalesce(confidence, F.lit(0.5)).alias("confidence"))


def deductions(rules=PENALTIES) -> Column:
    """``array<struct<category,count,deduction>>`` of the rules that cost something."""
    all_ = F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).cast("bigint").alias("count"), F.least(F.col(c) * w, F.lit(m)).cast("bigint").alias("deduction")) for c, w, m in rules])
    return F.filter(all_, lambda x: x["deduction"] > 0)


def score(rules=PENALTIES) -> Column:
    lost = sum((F.least(F.coalesce(F.col(c), F.lit(0)) * w, F.lit(m)) for c, w, m in rules), F.lit(0))
    return F.greatest(F.lit(100) - lost, F.lit(0)).cast("int")


def scored(counts: DataFrame) -> DataFrame:
    return counts.withColumn("score", score()).withColumn("grade", grade(F.col("score"))).withColumn("deductions", deductions())


def overall(counts: DataFrame) -> DataFrame:
    """Adds the fallback's score, grade and PASS, FLAG or FAIL."""
    c = counts.withColumn("score", score(FALLBACK)).withColumn("grade", grade(F.col("score")))
    fail, flag = (F.col("n_fake") >= 3) | (F.col("score") < 45), (F.col("n_fake") >= 1) | (F.col("n_key_issues") >= 2) | (F.col("score") < 75)
    return c.withColumn("verdict", F.when(fail, "FAIL").when(flag, "FLAG").otherwise("PASS"))


def overlay(results: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Lookup results with the status of the verdict put over them; entries with a verdict only are added."""
    v = verdicts.select("doc_id", "key", "verdict", F.col("confidence").alias("verdict_confidence"))
    s = F.when(F.col("verdict") == "REAL", "verified").when(F.col("verdict") == "FAKE", "not_found").when(F.col("verdict").isNotNull(), "partial_match")
    over = results.join(v, ["doc_id", "key"], "left").withColumn("status", F.coalesce(s, F.col("status")))
    only = v.join(results.select("doc_id", "key").distinct(), ["doc_id", "key"], "left_anti").withColumn("status", s)
    return over.unionByName(only, allowMissingColumns=True)


def verdict_counts(verdicts: DataFrame, *by: str) -> DataFrame:
    """What is neither fake nor suspicious counts as real."""
    v = F.col("verdict")
    return verdicts.groupBy(*by).agg(F.count_if(v == "FAKE").alias("n_fake"), F.count_if(v == "SUSPICIOUS").alias("n_suspicious"), F.count_if(~F.coalesce(v, F.lit("")).isin("FAKE", "SUSPICIOUS")).alias("n_real"))


def merge_extractions(entries: DataFrame, found: DataFrame, fields: list[str]) -> DataFrame:
    """Fill blank fields of entries from extracted records of the same normal title in the same paper (the last record wins)."""
    last = found.withColumn("_t", normal_title(F.col("title"))).where("_t != ''").groupBy("doc_id", "_t").agg(F.max_by(F.struct(*fields), "n").alias("_x"))
    j = entries.withColumn("_t", normal_title(F.col("title"))).join(last, ["doc_id", "_t"], "left")
    return j.select(*[F.coalesce(F.when(~blank(F.col(c)), F.col(c)), F.col(f"_x.{c}")).alias(c) if c in fields else F.col(c) for c in entries.columns])


def fill_blanks(entries: DataFrame, parsed: DataFrame, fields: list[str]) -> DataFrame:
    """Fill blank fields from re-parsed records of the same key."""
    p = parsed.select("doc_id", "key", F.struct(*fields).alias("_x"))
    j = entries.join(p, ["doc_id", "key"], "left")
    return j.select(*[F.coalesce(F.when(~blank(F.col(c)), F.col(c)), F.col(f"_x.{c}")).alias(c) if c in fields else F.col(c) for c in entries.columns])


def batch_order(reports: DataFrame) -> DataFrame:
    """Best score first, failed papers last, the order of delivery among equals."""
    return reports.orderBy(F.coalesce(F.col("score"), F.lit(-1)).desc(), "ord")
