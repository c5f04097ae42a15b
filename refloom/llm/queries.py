"""Queries of the training-data problems, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from refloom.llm import copies, garbled, lookalikes, matching, mixing, tokenize, variants
from refloom.session import table


def _mix(spark: SparkSession, d: str):
    sized = mixing.sized_documents(table(spark, d, "documents"))
    targets = table(spark, d, "mix_targets")
    return mixing.mixture(sized, targets), sized, targets


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    mixed, sized, targets = _mix(spark, d)
    return mixing.report(mixed, sized, targets)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": lambda s, d: matching.found(table(s, d, "bib_entries"), table(s, d, "verification_cache")),
        "p1_confidences": lambda s, d: matching.matched(table(s, d, "bib_entries"), table(s, d, "verification_cache")),
        "p2_found": lambda s, d: copies.found(table(s, d, "bib_entries")),
        "p2_references": lambda s, d: copies.distinct_references(table(s, d, "bib_entries")),
        "p4_found": lambda s, d: variants.found(table(s, d, "bib_entries"), table(s, d, "verifications"), table(s, d, "name_registry")),
        "p5_found": lambda s, d: lookalikes.found(table(s, d, "bib_entries")),
        "p5_one_form": lambda s, d: lookalikes.canonical(table(s, d, "bib_entries")),
        "p6_ids": lambda s, d: tokenize.encode(table(s, d, "documents")),
        "p7_mixture": lambda s, d: _mix(s, d)[0],
        "p7_shares": p7_shares,
        "p8_found": lambda s, d: garbled.found(table(s, d, "documents")),
        "p8_restored": lambda s, d: garbled.restored(table(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    """None of the problems can be put into plain SQL; brute-force tests stand in for it."""
    return {}
