"""Typed bibliography entries from text, as one projection of JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refloom.functions.text import blank, first_match, strip
from refloom.operators.sections import KEY

#: Fixed: words by which entry types are told.
PUBLISHER = r"(?i)(?:Verlag|Press|Publishers?|Sons|GmbH|Books?|Springer|Wiley|Elsevier|ACM|IEEE|MIT|O'Reilly|Pearson|Hanser|dpunkt|Addison[- ]Wesley|Cambridge|Oxford)"
PROCEEDINGS = r"(?iU)(?:\bIn\s*[\(\[]|Proc\.|Proceedings|Conference|Workshop|Symposium|Tagung|Konferenz|Hrsg\b|eds?\b|editors?\b)"
VOLUME = r"(?iU)(?:Jg\.|Vol\.|Volume|Band|Heft|Nr\.|Issue|No\.)\s*\d+"
JOURNAL = r"(?iU)\b(?:Journal|Zeitschrift|Magazin|Review|Transactions|Letters|Bulletin|Annals|Communications|Informatik|Computing)\b"
#: Fixed: shapes of identifiers, dates, pages, volumes, numbers and names.
DOI = r"(?iU)(?:doi:\s*|https?://doi\.org/)([^\s,;\]]+)"
ISBN = r"(?iU)(?:ISBN[:\s-]*)(\d[\d -]{8,16}[\dXx])"
URLDATE = r"(?iU)(?:Stand:|Abruf:|abgerufen am|accessed|besucht am)[:\s]*([\d./-]+)"
PAGES = r"(?iU)(?:S\.|pp?\.)\s*(\d+\s*[-–—]{1,2}\s*\d+)"
VOLUME_OF = r"(?iU)(?:Jg\.|Vol\.|Volume|Band)\s*(\d+)"
NUMBER_OF = r"(?iU)(?:Nr\.|No\.|Issue|Heft)\s*(\d+)"
BOOK_IN, BOOK_COLON = r"(?iU)In\s*[\(\[]([^\)\]]+)[\)\]]", r"(?iU)In:\s*([^,\.]{5,80})"
JOURNAL_OF = r"(?iuU)\.\s+([A-ZÄÖÜ][^,\.]+?),\s*(?:Jg|Vol|Nr|Band|No)"
#: Fixed: where a title can end.
TITLE_STOPS = (
    r"(?iU)\.\s+In\s+[\(\[]", r"(?iU)\.\s+In:\s+", r"(?iU),\s+(?:Jg\.|Vol\.|Nr\.|Band|No\.)", r"(?iU)\.\s+(?:19|20)\d{2}[,\.]",
    r"(?iuU)\.\s+[A-ZÄÖÜ][^\s].*?(?:Verlag|Press|Publishers?|Springer|Wiley|Elsevier)", r"(?iuU)\.\s+[A-ZÄÖÜ][^,\.]{2,40},\s+(?:Jg\.|Vol\.|Nr\.|Band|No\.|Issue)", r"(?U)(?<![A-ZÄÖÜ])\.\s+[A-ZÄÖÜ]",
)


def split_entries(docs: DataFrame, text: str = "bibliography") -> DataFrame:
    """``doc_id, ord, key, raw_text`` of each bracketed entry, in order."""
    p = rf"(?sU)\[({KEY})\]\s+(.*?)(?=\n\[|\z)"
    both = F.arrays_zip(F.regexp_extract_all(F.col(text), F.lit(p), F.lit(1)).alias("key"), F.regexp_extract_all(F.col(text), F.lit(p), F.lit(2)).alias("raw"))
    return docs.select("doc_id", F.posexplode(both).alias("p", "e")).select("doc_id", (F.col("p") + 1).alias("ord"), "e.key", F.regexp_replace(strip(F.col("e.raw")), r"(?U)\s+", " ").alias("raw_text"))


def _title(rest: Column, kind: Column) -> Column:
    at = [F.regexp_instr(rest, F.lit(p)) for p in TITLE_STOPS]
    cuts = F.filter(
        F.array(*[F.when(a > 6, F.rtrim(strip(F.substring(rest, F.lit(1), a - 1)), F.lit("."))) for a in at], F.nullif(strip(F.substring_index(rest, ".", 1)), F.lit(""))), lambda c: c.isNotNull()
    )
    fits = F.filter(cuts, lambda c: (F.length(c) > 5) & (F.length(c) <= F.floor(F.length(rest) * 0.85)))
    longest = F.aggregate(fits, F.lit(""), lambda a, c: F.when(F.length(c) > F.length(a), c).otherwise(a))
    shortest = F.aggregate(F.slice(cuts, 2, 20), F.get(cuts, F.lit(0)), lambda a, c: F.when(F.length(c) < F.length(a), c).otherwise(a))
    t = F.when(F.size(fits) > 0, longest).when(F.size(cuts) > 0, shortest).otherwise(F.substring(rest, 1, 120))
    t = F.when(kind == "article", F.regexp_replace(strip(t), r"\.\s+[A-ZÄÖÜ][^.]{1,50}$", "")).otherwise(t)
    return F.nullif(F.regexp_replace(strip(t), r"^[.,;:]+|[.,;:]+$", ""), F.lit(""))


def parse_entries(entries: DataFrame, raw: str = "raw_text") -> DataFrame:
    """Adds the fields of each entry. A web address makes an entry a website, which has neither authors nor year."""
    r = F.coalesce(F.col(raw), F.lit(""))
    e = entries.select("doc_id", "ord", "key", raw)
    e = e.withColumn("doi", F.rtrim(first_match(r, DOI), F.lit(".")))
    e = e.withColumn("isbn", F.regexp_replace(first_match(r, ISBN), r"[\s-]", ""))
    e = e.withColumn("_u", first_match(r, r"(?U)(https?://\S+|www\.\S+)")).withColumn("_web", F.col("_u").isNotNull())
    web = F.col("_web")
    e = e.withColumn("url", F.rtrim(F.col("_u"), F.lit(".,;)"))).withColumn("urldate", F.when(web, first_match(r, URLDATE)))
    e = e.withColumn("entry_type", F.when(web, "website").when(r.rlike(VOLUME) | r.rlike(JOURNAL), "article").when(r.rlike(PROCEEDINGS), "proceedings").when(r.rlike(PUBLISHER), "book").otherwise("unknown"))
    # authors end at the first colon; the strict list may be up to 180 characters long, any other head 119
    head = F.substring_index(r, ":", 1)
    n = F.instr(r, ":") - 1
    word = r"[A-ZÄÖÜ][a-zäöüß\-]+"
    strict = (n > 0) & (n < 180) & F.when((n > 0) & (n < 180), head.rlike(rf"^(?:{word}(?:,\s*[A-Za-zÄÖÜäöüß\.\s\-]+)?(?:;\s*)?)+$")).otherwise(False)
    loose = (n > 0) & (n < 120) & head.rlike(rf"^{word}")
    e = e.withColumn("authors", F.when(~web & (strict | loose), strip(head)))
    e = e.withColumn("_r", F.when(web, "").when(F.col("authors").isNotNull(), strip(F.substring(r, n + 2, F.length(r)))).otherwise(r))
    rest = F.col("_r")
    e = e.withColumn("year", first_match(rest, r"(?U)\b((?:19|20)\d{2})\b"))
    e = e.withColumn("pages", F.replace(first_match(rest, PAGES), F.lit(" "), F.lit("")))
    at, hit = F.regexp_instr(rest, F.lit(PUBLISHER)), F.regexp_extract(rest, PUBLISHER, 0)
    start = F.greatest(F.lit(1), at - 30)
    e = e.withColumn("publisher", F.when(at > 0, F.substring(F.ltrim(strip(F.substring(rest, start, at + F.length(hit) - start)), F.lit(",. ")), 1, 80)))
    e = e.withColumn("volume", first_match(rest, VOLUME_OF)).withColumn("number", first_match(rest, NUMBER_OF))
    web_title = F.nullif(F.rtrim(strip(F.substring(r, F.lit(1), F.instr(r, F.col("_u")) - 1)), F.lit(",.")), F.lit(""))
    e = e.withColumn("title", F.when(web, web_title).when(rest != "", _title(rest, F.col("entry_type"))))
    book = F.coalesce(first_match(rest, BOOK_IN), first_match(rest, BOOK_COLON))
    e = e.withColumn("booktitle", F.when(F.col("entry_type") == "proceedings", strip(book)))
    e = e.withColumn("journal", F.when(F.col("entry_type") == "article", strip(first_match(rest, JOURNAL_OF))))
    e = e.withColumn("needs_ai_parsing", blank(F.col("title")) | (~web & ((F.col("entry_type") == "unknown") | F.col("authors").isNull())))
    return e.drop("_u", "_web", "_r")
