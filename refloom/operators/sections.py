"""From document text to sections, citations and contexts, all as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refloom.functions.text import strip

#: Fixed: headings of bibliographies, in title case and capitals.
HEADINGS = (
    "Literaturverzeichnis", "Literatur(?:\\b|:)", "Quellenverzeichnis", "Quellen(?:\\b|:)", "Schrifttum", "Literaturangaben", "Literaturliste", "References?(?:\\b|:)", "Bibliography", "Works\\s+Cited",
    "Reference\\s+List", "List\\s+of\\s+References", "List\\s+of\\s+Sources", "Sources?(?:\\b|:)", "Citations?(?:\\b|:)", "Cited\\s+Works", "Cited\\s+References",
)
KEY = r"[A-Za-z]{2,6}\d{2}[a-z]?"
GROUP = rf"\[({KEY}(?:,\s*{KEY})*)\]"
FLOATS = "figure|table|lstlisting|verbatim|equation|align"
UNWRAP = r"textbf|textit|emph|texttt|text|section\*?|subsection\*?|subsubsection\*?|caption|label|ref|Cref|cref|url|href"


def _caps(p: str) -> str:
    """A heading in capitals; escapes and quantifiers keep their letters."""
    return p.replace("References?", "REFERENCES?").replace("Sources?", "SOURCES?").replace("Citations?", "CITATIONS?") if "?(" in p and "s?" in p else "".join(c if i and p[i - 1] == "\\" else c.upper() for i, c in enumerate(p))


HEADING = r"(?:^|\n)(?:\d+(?:\.\d+)*\.?\s+)?(?:" + "|".join(h for p in HEADINGS for h in (p, _caps(p))) + ")"


def bibliography_start(text: Column) -> Column:
    """0-based start of the bibliography heading, -1 without one.

    Of all headings the last one with a key within 500 characters wins, else
    the last. Starts come from the lengths of the pieces between the matches.
    """
    hits = F.regexp_extract_all(text, F.lit(HEADING), F.lit(0))
    gaps = F.split(text, HEADING)
    starts = F.transform(F.sequence(F.lit(1), F.size(hits)), lambda i: F.aggregate(F.slice(gaps, 1, i), F.lit(0), lambda a, g: a + F.length(g)) + F.aggregate(F.slice(hits, 1, i - 1), F.lit(0), lambda a, h: a + F.length(h)))
    keyed = F.filter(starts, lambda p: F.substring(text, p + 1, F.lit(500)).rlike(r"\[" + KEY + r"\]"))
    return F.when(F.size(hits) > 0, F.coalesce(F.array_max(keyed), F.array_max(starts))).otherwise(-1)


def split_sections(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``body`` and ``bibliography``; null and empty texts have empty sections."""
    d = docs.withColumn("_t", F.coalesce(F.col(text), F.lit(""))).withColumn("_p", bibliography_start(F.col("_t")))
    body = F.when(F.col("_p") >= 0, F.substring(F.col("_t"), F.lit(1), F.col("_p"))).otherwise(F.col("_t"))
    bib = F.when(F.col("_p") >= 0, F.substring(F.col("_t"), F.col("_p") + 1, F.length("_t"))).otherwise("")
    return d.withColumn("body", strip(body)).withColumn("bibliography", strip(bib)).drop("_t", "_p")


def clean_latex(c: Column) -> Column:
    """Body text of LaTeX source: comments, floats and macros out, common macros unwrapped, white space collapsed."""
    for pattern, by in (
        (r"(?d)%.*", ""), (rf"(?s)\\begin\{{({FLOATS})[^}}]*\}}.*?\\end\{{\1\}}", ""), (rf"\\(?:{UNWRAP})\{{([^}}]*)\}}", "$1"),
        (r"\\[a-zA-Z]+\*?\{[^}]*\}", ""), (r"\\[a-zA-Z]+\*?", ""), (r"[{}]", ""), (r"(?U)\s+", " "),
    ):
        c = F.regexp_replace(c, pattern, by)
    return strip(c)


def embedded_bibliography(c: Column) -> Column:
    """``array<struct<key,body>>`` of the first thebibliography environment; items with options are not seen."""
    env = F.regexp_extract(c, r"(?s)\\begin\{thebibliography\}.*?\\end\{thebibliography\}", 0)
    item = r"(?s)\\bibitem\{(\w+)\}\s*(.*?)(?=\\bibitem|\\end\{thebibliography\})"
    tidy = lambda b: strip(F.regexp_replace(F.regexp_replace(F.regexp_replace(b, r"\\[a-zA-Z]+\{([^}]*)\}", "$1"), r"[{}\\]", ""), r"(?U)\s+", " "))
    return F.zip_with(F.regexp_extract_all(env, F.lit(item), F.lit(1)), F.regexp_extract_all(env, F.lit(item), F.lit(2)), lambda k, b: F.struct(k.alias("key"), tidy(b).alias("body")))


def latex_cite_keys(docs: DataFrame, text: str = "text") -> DataFrame:
    r"""Distinct ``doc_id, key`` of \cite, \citet and \citep in raw source."""
    groups = F.regexp_extract_all(F.col(text), F.lit(r"\\(?:[Cc]ite|[Cc]itet|citep)\{([^}]+)\}"), F.lit(1))
    keys = docs.select("doc_id", F.explode(groups).alias("g")).select("doc_id", F.explode(F.split("g", ",")).alias("key")).select("doc_id", strip(F.col("key")).alias("key"))
    return keys.where("key != ''").distinct()


def bracket_citations(docs: DataFrame, text: str = "body") -> DataFrame:
    """Distinct ``doc_id, key`` of bracketed keys in running text."""
    g = docs.select("doc_id", F.explode(F.regexp_extract_all(F.col(text), F.lit(GROUP), F.lit(1))).alias("g"))
    return g.select("doc_id", F.explode(F.split("g", r",\s*")).alias("key")).distinct()


def numeric_flag(c: Column) -> Column:
    return c.rlike(r"\[\d{1,3}\]")


def citation_contexts(docs: DataFrame, text: str = "body") -> DataFrame:
    """``doc_id, key, n, snippet``: the first two contexts of each key, 80 characters without a period on each side."""
    p = rf"([^.]{{0,80}}){GROUP}([^.]{{0,80}})"
    hits = docs.select("doc_id", F.posexplode(F.arrays_zip(F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0)).alias("s"), F.regexp_extract_all(F.col(text), F.lit(p), F.lit(2)).alias("g"))))
    keys = hits.select("doc_id", "pos", strip(F.col("col.s")).alias("snippet"), F.posexplode(F.split("col.g", r",\s*")).alias("k", "key"))
    w = Window.partitionBy("doc_id", "key").orderBy("pos", "k")
    return keys.withColumn("n", F.row_number().over(w)).where("n <= 2").select("doc_id", "key", "n", "snippet")
