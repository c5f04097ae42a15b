"""Papers rendered from order lines, so that parsing can be held against the columns they come from."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed: surnames of the rendered authors.
SURNAMES = ("Meier", "Kowalski", "Duarte", "Larsen", "Novak", "Fischer", "Okafor")


def truth(lineitem: DataFrame) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    name = F.get(F.array(*map(F.lit, SURNAMES)), (F.col("l_suppkey") % len(SURNAMES)).cast("int"))
    year = F.year("l_shipdate")
    kind = F.when(F.col("l_returnflag") == "A", "article").when(F.col("l_returnflag") == "N", "proceedings").otherwise("book")
    lo = (F.col("l_partkey") % 300 + 1).cast("int")
    return lineitem.select(
        F.col("l_orderkey").alias("doc_id"), F.row_number().over(w).alias("ord"), F.concat(F.substring(name, 1, 2), F.lpad((year % 100).cast("string"), 2, "0")).alias("key"), name.alias("surname"),
        F.concat(F.lit("Wasser und Boden "), (F.col("l_partkey") % 97).cast("string")).alias("title"), year.alias("year"), kind.alias("kind"), lo.alias("lo"), (lo + F.col("l_quantity").cast("int") * 5).alias("hi"),
    )


def papers(lineitem: DataFrame) -> DataFrame:
    """``doc_id, text``: running text that cites two of three entries, a heading, and the entries."""
    t = truth(lineitem)
    s = lambda c: F.col(c).cast("string")
    pages = F.concat(F.lit(", S. "), s("lo"), F.when(F.col("ord") % 2 == 0, "-").otherwise("--"), s("hi"), F.lit(", "), s("year"), F.lit("."))
    tail = F.when(F.col("kind") == "article", F.concat(F.lit(". Hydrologie, Jg. "), s("ord"), pages)).when(F.col("kind") == "proceedings", F.concat(F.lit(". In: Tagung Berlin"), pages)).otherwise(
        F.concat(F.lit(". Nordverlag, "), s("year"), F.lit("."))
    )
    entry = F.concat(F.lit("["), F.col("key"), F.lit("] "), F.col("surname"), F.lit(", A.: "), F.col("title"), tail)
    cite = F.when(F.col("ord") % 3 != 0, F.concat(F.lit("As shown before ["), F.col("key"), F.lit("].")))
    # an order has at most some dozens of lines
    g = t.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", entry.alias("e"), cite.alias("c")))).alias("l"))
    body = F.array_join(F.transform("l", lambda x: x["c"]), " ")
    return g.select("doc_id", F.concat(F.lit("Introduction. "), body, F.lit("\nLiteratur\n"), F.array_join(F.transform("l", lambda x: x["e"]), "\n")).alias("text"))


def preprints(lineitem: DataFrame) -> DataFrame:
    """``doc_id, ord, url, doi, raw_text, journal``: order lines as citations of preprints, the identifier in one of five places and shapes or nowhere."""
    t = lineitem.select("l_orderkey", "l_partkey", "l_suppkey", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")).alias("ord"))
    s = lambda c: F.col(c).cast("string")
    new = F.concat((F.col("l_partkey") % 9000 + 1000).cast("string"), F.lit("."), F.lpad(s("l_suppkey"), 5, "0"))
    old = F.concat(F.lit("math/"), F.lpad(s("l_partkey"), 7, "0"))
    v = F.concat(F.lit("v"), (F.col("ord") % 3 + 1).cast("string"))
    shape = (F.col("l_partkey") % 6).cast("int")
    return t.select(
        F.col("l_orderkey").alias("doc_id"), "ord", F.when(shape == 0, F.concat(F.lit("https://arxiv.org/abs/"), new, v)).when(shape == 1, F.concat(F.lit("http://arXiv.org/pdf/"), old)).alias("url"),
        F.when(shape == 2, F.concat(F.lit("10.48550/arXiv."), new)).alias("doi"), F.when(shape == 3, F.concat(F.lit("Meier, A.: Rivers. arXiv:"), old, v, F.lit(", 1999."))).otherwise("Meier, A.: Rivers.").alias("raw_text"),
        F.when(shape == 4, F.concat(F.lit("ARXIV:"), new)).alias("journal"),
    )
