"""Problem 7: one mixture of several sources with target shares, by weighted sampling without replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refloom.session import cut

BINS = 512  # slices of each source's key range; bounds the totals that are added up in one task


def quality_weight(tokens: Column, chars: Column, lang: Column) -> Column:
    """A document's weight from facts that all tables of documents have.

    Texts whose language is known weigh more, and so do texts that the
    tokenizer packs well (garbled or symbol-heavy texts need more tokens for a
    character). Always within 0.2 and 2.
    """
    known = F.when(lang.isNotNull() & (lang != "und"), 1.0).otherwise(0.5)
    packed = F.coalesce(chars / F.nullif(tokens, F.lit(0)), F.lit(1.0)) / 3.0
    return F.greatest(F.lit(0.2), F.least(F.lit(2.0), known * packed))


def uniform(seed: int, *cols: str) -> Column:
    """A repeatable number in (0, 1) of each row's id."""
    return (F.pmod(F.xxhash64(F.lit(seed), *[F.col(c) for c in cols]), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def plan(sizes: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """The token budget of each listed source; one row for each row of ``targets``.

    Without ``total`` the mixture is the largest one in which every listed
    source that has tokens reaches its share without using a document more
    than ``max_copies`` times. Sources without tokens get nothing and the
    other shares are scaled to sum 1. With a ``total`` beyond that size, a
    source whose documents do not suffice gives all its copies and the report
    shows its lower share. A null ``max_copies`` counts as 1, a null or
    negative share as 0.
    """
    have = sizes.groupBy("source").agg(F.sum("tokens").alias("available"), F.count("*").alias("documents"))
    t = (
        targets.select("source", F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("target_share"), F.coalesce("max_copies", F.lit(1)).cast("bigint").alias("max_copies"))
        .join(have, "source", "left")
        .fillna(0, ["available", "documents"])
    )
    w = Window.partitionBy(F.lit(1))  # a row for each listed source
    live = F.col("available") > 0
    t = t.withColumn("share", F.when(live, F.col("target_share")).otherwise(0.0))
    t = t.withColumn("share", F.coalesce(F.col("share") / F.nullif(F.sum("share").over(w), F.lit(0.0)), F.lit(0.0)))
    most = F.min(F.when(F.col("share") > 0, F.col("max_copies") * F.col("available") / F.col("share"))).over(w)
    t = t.withColumn("total", F.floor(F.coalesce(F.lit(total).cast("double") if total is not None else most, F.lit(0.0))))
    budget = F.least(F.floor(F.col("share") * F.col("total") + 1e-6), F.col("max_copies") * F.col("available"))
    return t.withColumn("budget", budget.cast("bigint")).withColumn("epochs", F.when(live, F.floor(F.col("budget") / F.col("available"))).otherwise(0)).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("available"))


def mixture(sized: DataFrame, targets: DataFrame, *, total: float | None = None, seed: int = 17) -> DataFrame:
    """Documents of the mixture with the number of times each is used.

    ``sized``: ``doc_id, source, tokens, weight``. Each source first gives
    complete epochs (all its documents); the fraction left is filled with the
    documents of the smallest keys ``-ln(u) / weight`` (Efraimidis and
    Spirakis), in key order, as long as they fit into the budget left. A
    document without tokens, without a listed source or with a weight of 0
    or below is not used (the last one only in complete epochs).
    Equal keys fall back to ``doc_id``. Repeated rows are separate copies.

    The prefix sums run in two steps: totals of ``BINS`` key ranges of each
    source (pre-aggregated before the shuffle), then the rows of the one range
    in which the budget ends. No task ever holds all rows of a source.
    """
    budgets = plan(sized, targets, total)
    rate = F.when(F.col("weight") > 0, F.col("weight"))
    keyed = (
        sized.where((F.col("tokens") > 0) & F.col("source").isNotNull())
        .withColumn("k", -F.log(uniform(seed, "doc_id")) / rate)
        # 1 - exp(-k) spreads the keys over (0, 1); the order stays
        .withColumn("bin", F.coalesce(F.least(F.floor((1 - F.exp(-F.col("k") * 0.7)) * BINS), F.lit(BINS - 1)), F.lit(BINS)).cast("int"))
    )
    bins = keyed.groupBy("source", "bin").agg(F.sum("tokens").alias("t"))
    before = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("before", F.coalesce(F.sum("t").over(before), F.lit(0)))
    # at most BINS + 1 rows for each listed source
    edges = bins.join(budgets.select("source", "epochs", "rest"), "source").withColumn(
        "state", F.when((F.col("bin") == BINS) | (F.col("before") >= F.col("rest")), "out").when(F.col("before") + F.col("t") <= F.col("rest"), "in").otherwise("edge")
    )
    rows = keyed.join(edges.select("source", "bin", "before", "epochs", "rest", "state"), ["source", "bin"])
    run = Window.partitionBy("source", "bin").orderBy("k", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    sure = rows.where("state != 'edge'").withColumn("extra", F.when(F.col("state") == "in", 1).otherwise(0))
    edge = rows.where("state = 'edge'").withColumn("extra", F.when(F.col("before") + F.sum("tokens").over(run) <= F.col("rest"), 1).otherwise(0))
    out = sure.unionByName(edge).withColumn("copies", (F.col("epochs") + F.col("extra")).cast("int"))
    return out.where("copies > 0").select("doc_id", "source", F.col("tokens").cast("bigint").alias("tokens"), "copies")


def report(mixed: DataFrame, sized: DataFrame, targets: DataFrame, *, total: float | None = None) -> DataFrame:
    """One row for each listed source: target, budget and what was reached."""
    got = mixed.groupBy("source").agg(
        F.sum(F.col("tokens") * F.col("copies")).alias("tokens_used"), F.count("*").alias("documents_used"), F.max("copies").alias("most_copies")
    )
    w = Window.partitionBy(F.lit(1))  # a row for each listed source
    t = plan(sized, targets, total).join(got, "source", "left").fillna(0, ["tokens_used", "documents_used", "most_copies"])
    return t.select(
        "source", "target_share", F.col("max_copies").cast("int").alias("max_copies"), "documents", F.col("available").alias("tokens_available"), F.col("budget").alias("tokens_budget"),
        "tokens_used", "documents_used", "most_copies",
        F.coalesce(F.col("tokens_used") / F.nullif(F.sum("tokens_used").over(w), F.lit(0)), F.lit(0.0)).alias("actual_share"),
    )


def sized_documents(documents: DataFrame, **encoder) -> DataFrame:
    """``doc_id, source, tokens, weight`` of every document, written once: the encoding is the costly part."""
    from refloom.llm.tokenize import encode

    sized = encode(documents, "text", ("doc_id", "source", "lang", "n_chars"), lengths_only=True, into="tokens", **encoder)
    return cut(sized.select("doc_id", "source", F.col("tokens").cast("bigint").alias("tokens"), quality_weight(F.col("tokens"), F.col("n_chars"), F.col("lang")).alias("weight")))
