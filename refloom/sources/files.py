"""File sources: directories of papers, page texts, DOCX packages, reports."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refloom.functions.text import strip
from refloom.operators import bibtex
from refloom.operators.sections import KEY, clean_latex, embedded_bibliography, split_sections

LIMIT = 30 * 1024 * 1024  # larger uploads are refused
KNOWN = ("pdf", "docx", "tex", "latex", "bib")
WORDS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def papers(spark: SparkSession, folder: str) -> DataFrame:
    """``path, format, length, content, rejected`` of a folder; foreign and oversized files are rejected with a reason."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    kind = suffix(F.col("path"))
    why = F.when(~kind.isin(*KNOWN), "format").when(F.col("length") > LIMIT, "size")
    return f.select("path", kind.alias("format"), "length", "content", why.alias("rejected"))


def full_texts(files: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """``path, format, text, body, bibliography`` of the accepted files of all formats.

    LaTeX has its cleaned body and, as bibliography, the rendered records of
    its BibTeX file, else what its source embeds; of the other formats the text
    is split at its bibliography's heading. PDF texts come from ``pages``
    (``path, page, text``), as there is no reader of PDF bytes here.
    """
    ok = files.where("rejected IS NULL")
    tex = latex_texts(ok).withColumn("doc_id", F.col("path"))
    side = bibtex.rendered(bibtex.inherit(bibtex.records(tex.where("sidecar IS NOT NULL"), "sidecar"))).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n").alias("side"))
    own = F.array_join(F.transform(embedded_bibliography(F.col("text")), lambda e: F.concat(F.lit("["), e["key"], F.lit("] "), e["body"])), "\n")
    latex = tex.join(side, "doc_id", "left").select("path", F.lit("tex").alias("format"), "text", "body", F.coalesce(F.nullif("side", F.lit("")), own).alias("bibliography"))
    rest = docx_texts(ok).select("path", F.lit("docx").alias("format"), "text")
    if pages is not None:
        rest = rest.unionByName(page_texts(pages.withColumnRenamed("path", "doc_id")).select(F.col("doc_id").alias("path"), F.lit("pdf").alias("format"), "text"))
    split = split_sections(rest)
    return latex.unionByName(split.select("path", "format", "text", "body", unwrap_bibliography(F.col("bibliography")).alias("bibliography")))


def latex_texts(files: DataFrame) -> DataFrame:
    """``path, text, body, sidecar``: source with bad bytes replaced, cleaned body, and the BibTeX file of the same name."""
    text = F.make_valid_utf8(F.col("content").cast("string"))
    stem = F.regexp_replace("path", r"\.[^./]+$", "")
    tex = files.where(F.col("format").isin("tex", "latex")).select("path", stem.alias("stem"), text.alias("text"))
    bib = files.where("format = 'bib'").select(stem.alias("stem"), text.alias("sidecar"))
    return tex.join(bib, "stem", "left").select("path", "text", clean_latex(F.col("text")).alias("body"), "sidecar")


def docx_texts(files: DataFrame) -> DataFrame:
    """``path, text`` of DOCX files: paragraphs, then table cells, each stripped and on its line; a broken package gives null."""

    def text_of(data: bytes) -> str | None:
        try:
            body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{WORDS}body")
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
            return None
        mark = {f"{WORDS}t": lambda t: t.text or "", f"{WORDS}tab": lambda t: "\t", f"{WORDS}br": lambda t: "\n", f"{WORDS}cr": lambda t: "\n"}
        said = lambda p: "".join(mark[t.tag](t) for t in p.iter() if t.tag in mark).strip()
        cell = lambda c: "\n".join(said(p) for p in c.findall(f"{WORDS}p")).strip()
        lines = [said(p) for p in body.findall(f"{WORDS}p")] + [cell(c) for c in body.iter(f"{WORDS}tc")]
        return "\n".join(x for x in lines if x)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "text": [text_of(c) for c in b["content"]]})

    return files.where("format = 'docx'").select("path", "content").mapInPandas(run, "path string, text string")


def page_texts(pages: DataFrame) -> DataFrame:
    """``doc_id, text`` from ``doc_id, page, text``: pages in order, empty ones skipped, words broken at line ends joined."""
    p = pages.where(F.length(F.coalesce("text", F.lit(""))) > 0)
    t = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: F.concat(x["text"], F.lit("\n"))), "")
    return p.groupBy("doc_id").agg(F.regexp_replace(t, r"-\n(?=\S)", "").alias("text"))


def unwrap_bibliography(c: Column) -> Column:
    """Lines of one entry joined, each entry on a line of its own."""
    return strip(F.regexp_replace(F.regexp_replace(c, r"\n(?!\[)", " "), rf"\s*(\[{KEY}\])", "\n$1"))


def read_reports(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)
