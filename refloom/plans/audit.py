"""The whole audit of a corpus as one plan, and its reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refloom.functions.text import style_counts
from refloom.operators import crosscheck, validate, verdict


def paper_counts(citations: DataFrame, entries: DataFrame, verdicts: DataFrame | None = None, docs: DataFrame | None = None, this_year: int = 2025) -> DataFrame:
    """Counters of each paper: missing, orphan, ok, incomplete, duplicates, fake, key issues, style.

    Each part is pre-aggregated to a row for each paper before the joins, so a
    paper with a tenth of all entries moves as counters only.
    """
    x = crosscheck.cross_check(citations, entries).groupBy("doc_id").agg(*[F.count_if(F.col("class") == c).alias(f"n_{c}") for c in ("missing", "orphan", "ok")])
    i = validate.issues(entries, this_year)
    e = i.groupBy("doc_id").agg(F.count("*").alias("n_entries"), F.count_if(F.size("issues") > 0).alias("n_incomplete"), F.count_if(F.exists("issues", lambda t: F.contains(t, F.lit("key")))).alias("n_key_issues"))
    d = crosscheck.duplicate_counts(entries)
    out = x.join(e, "doc_id", "full_outer").join(d, "doc_id", "left")
    out = out.join(verdict.verdict_counts(verdicts, "doc_id"), "doc_id", "left") if verdicts is not None else out.withColumn("n_fake", F.lit(0))
    if docs is not None:
        out = out.join(docs.select("doc_id", F.size(style_counts(F.col("body"))).alias("n_style")), "doc_id", "left")
    else:
        out = out.withColumn("n_style", F.lit(0))
    return out.fillna(0)


def report_lines(scored: DataFrame) -> DataFrame:
    """``doc_id, report``: a text report of each paper; sections without content are left out."""
    cost = F.transform("deductions", lambda x: F.concat(F.lit("  -"), F.lpad(x["deduction"].cast("string"), 2, " "), F.lit(" "), x["category"], F.lit(" ("), x["count"].cast("string"), F.lit(")")))
    lines = F.concat_ws(
        "\n", F.concat(F.lit("Paper "), F.col("doc_id").cast("string")), F.concat(F.lit("Score "), F.col("score").cast("string"), F.lit(" "), F.col("grade")),
        F.when(F.size("deductions") > 0, F.concat(F.lit("Deductions\n"), F.array_join(cost, "\n"))),
        F.when(F.col("n_missing") > 0, F.concat(F.lit("Cited but not listed: "), F.col("n_missing").cast("string"))),
        F.when(F.col("n_orphan") > 0, F.concat(F.lit("Listed but not cited: "), F.col("n_orphan").cast("string"))),
    )
    return scored.select("doc_id", lines.alias("report"))


def report_json(scored: DataFrame) -> DataFrame:
    """``doc_id, report``: nested JSON with summary and score."""
    n = F.struct(*[c for c in scored.columns if c.startswith("n_")])
    return scored.select("doc_id", F.to_json(F.struct("doc_id", n.alias("summary"), F.struct("score", "grade", "deductions").alias("score"))).alias("report"))
