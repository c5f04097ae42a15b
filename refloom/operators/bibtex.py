"""BibTeX records: scan, fields, inheritance, rendering."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RECORD = regex.compile(r"@(\w+)\s*\{\s*(\w+)\s*,(.*?)\}\s*(?=@|\Z)", regex.S)
VALUE = regex.compile(r"""(?P<name>\w+)\s*=\s*(?:(?P<brace>\{(?:[^{}]++|(?P&brace))*+\})|"(?P<quoted>(?:[^"\\]|\\.)*+)")""", regex.S)


def fields_of(body: str) -> dict[str, str]:
    """Braced (nested to any depth) and quoted values by lower-case name; bare values are not taken."""
    out = {}
    for m in VALUE.finditer(body):
        v = m["brace"][1:-1] if m["brace"] is not None else m["quoted"]
        v = " ".join(v.split())
        if v.startswith("{") and v.endswith("}") and "}" not in v[1:-1]:
            v = v[1:-1]
        out[m["name"].lower()] = v.replace("{", "").replace("}", "")
    return out


def records(files: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, ord, key, entry_type, fields`` of every record; null and empty files have none."""
    kind = files.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, n, m[2], m[1].lower(), fields_of(m[3])) for d, t in zip(b["doc_id"], b["t"], strict=True) for n, m in enumerate(RECORD.finditer(t or ""), 1)]
            if rows:
                yield pd.DataFrame(rows, columns=["doc_id", "ord", "key", "entry_type", "fields"])

    return files.select("doc_id", F.col(text).alias("t")).mapInPandas(run, f"doc_id {kind}, ord int, key string, entry_type string, fields map<string,string>")


def inherit(recs: DataFrame) -> DataFrame:
    """Records with the fields their crossref parent has and they lack; one level."""
    up = recs.select("doc_id", F.col("key").alias("_p"), F.col("fields").alias("_f"), F.col("ord").alias("_o")).groupBy("doc_id", "_p").agg(F.max_by("_f", "_o").alias("_f"))
    j = recs.withColumn("_p", F.col("fields")["crossref"]).join(up, ["doc_id", "_p"], "left")
    own = F.map_keys("fields")
    rest = F.map_filter(F.coalesce("_f", F.expr("map_from_arrays(array(), array())").cast("map<string,string>")), lambda k, v: ~F.array_contains(own, k) & (k != "crossref"))
    return j.select("doc_id", "ord", "key", "entry_type", F.map_concat("fields", rest).alias("fields"))


def rendered(recs: DataFrame) -> DataFrame:
    """One bracketed bibliography line for each record; of records with one key, the last."""
    f = lambda n: F.nullif(F.col("fields")[n], F.lit(""))
    book = F.when(f("journal").isNull(), F.concat(F.lit("In: "), f("booktitle"), F.lit(".")))
    line = F.concat_ws(
        " ", F.concat(F.lit("["), F.col("key"), F.lit("]")), F.concat(f("author"), F.lit(":")), F.concat(f("title"), F.lit(".")), F.concat(f("journal"), F.lit(".")), book, F.concat(f("publisher"), F.lit(".")),
        F.concat(F.lit("S. "), f("pages"), F.lit(".")), F.concat(F.lit("doi: "), f("doi")), f("url"), F.concat(F.lit("Stand: "), f("urldate")), F.concat(f("year"), F.lit(".")),
    )
    return recs.groupBy("doc_id", "key").agg(F.max_by("fields", "ord").alias("fields"), F.min("ord").alias("ord")).select("doc_id", "ord", "key", line.alias("line"))
