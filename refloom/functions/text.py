"""Scalar text functions as JVM column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed: words that titles are compared without.
TITLE_STOP = "the a an in of for on and to with der die das und fur von mit im an zu eine ein des dem".split()
#: Fixed: style rules in reporting order: type, pattern, whether case is ignored.
STYLE_RULES = (
    ("Macro:eg", r"(?U)\be\.g\.", True), ("Macro:ie", r"(?U)\bi\.e\.", True), ("Macro:cf", r"(?U)\bcf\.", True), ("Macro:etal", r"(?U)\bet al\.", True),
    ("Heading", r"\n([A-Z]{4,}(?:\s+[A-Z]{2,})*)\n", False), ("Emphasis", r"\\textbf\{[^}]{1,20}\}", False), ("Quotes", r'(?<!`)"[^"]{1,60}"', False),
    ("Dash", r"(?U)\w–\w", False), ("Spacing", r"(?U)\w\[(?:[A-Za-z]{2,6}\d{2})", False),
)


def blank(c: Column) -> Column:
    return c.isNull() | (c == "")


def strip(c: Column) -> Column:
    """Trim all white space; Spark's own trim knows the space only."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def first_match(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null if there is none."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def umlauts_out(c: Column) -> Column:
    out = F.lower(c)
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def title_words(c: Column) -> Column:
    """Words of a title as similarity sees them, in order."""
    t = F.regexp_replace(umlauts_out(c), r"\\[a-zA-Z]+\{([^}]*)\}", "$1")
    t = F.regexp_replace(F.regexp_replace(t, r"[{}]", ""), r"(?U)[^\p{L}\p{N}_\s]", " ")
    return F.filter(F.split(t, r"(?U)\s+"), lambda w: (w != "") & ~w.isin(TITLE_STOP))


def normal_title(c: Column) -> Column:
    return F.array_join(title_words(F.coalesce(c, F.lit(""))), " ")


def cache_form(c: Column) -> Column:
    """Lower case, punctuation removed, white space collapsed."""
    return strip(F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)[^\p{L}\p{N}_\s]", ""), r"(?U)\s+", " "))


def cache_key(title: Column, authors: Column) -> Column:
    """24 hex digits of the SHA-256 of title and first surname."""
    surname = F.lower(strip(F.substring_index(F.substring_index(F.coalesce(authors, F.lit("")), ";", 1), ",", 1)))
    return F.substring(F.sha2(F.concat_ws("|", cache_form(F.coalesce(title, F.lit(""))), surname), 256), 1, 24)


def prompt_key(model: Column, system: Column, prompt: Column) -> Column:
    return F.sha2(F.concat_ws("|", model, system, prompt), 256)


def status_band(similarity: Column) -> Column:
    return F.when(similarity >= 0.75, "verified").when(similarity >= 0.40, "partial_match").otherwise("not_found")


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 75, "B").when(score >= 60, "C").when(score >= 45, "D").otherwise("F")


def percent(x: Column) -> Column:
    return (x * 100.0).cast("int")


def style_counts(body: Column) -> Column:
    """``array<struct<rule,count>>`` of the rules that hit, in rule order."""
    hits = [F.struct(F.lit(n).alias("rule"), F.regexp_count(body, F.lit(("(?iu)" if ci else "") + p)).alias("count")) for n, p, ci in STYLE_RULES]
    mixed = F.when(body.rlike(r"\[[A-Za-z]{2,6}\d{2}\]"), F.regexp_count(body, F.lit(r"\[\d{1,3}\]"))).otherwise(0)
    return F.filter(F.array(*hits, F.struct(F.lit("CitationStyle").alias("rule"), mixed.alias("count"))), lambda x: x["count"] > 0)


def arxiv_id(*fields: Column) -> Column:
    """``struct<id,version>`` of the first field and pattern that match."""
    new, old = r"(\d{4}\.\d{4,5})(v\d+)?", r"([a-z\-]+/\d{7})(v\d+)?"
    shapes = [rf"arxiv\.org/(?:abs|pdf)/{new}", rf"arxiv\.org/(?:abs|pdf)/{old}", rf"arxiv[:./]{new}", rf"arxiv:{old}"]
    return F.coalesce(
        *[F.when(f.rlike("(?iu)" + p), F.struct(F.regexp_extract(f, "(?iu)" + p, 1).alias("id"), first_match(f, "(?iu)" + p, 2).alias("version"))) for f in fields for p in shapes]
    )


def author_surnames(c: Column) -> Column:
    """Surnames of a list parted by semicolons or the word and, without those of up to two letters."""
    parts = F.transform(F.split(c, r"(?iu);|\band\b"), lambda p: umlauts_out(strip(p)))
    parts = F.filter(parts, lambda p: ~p.rlike(r"^et\s+al\.?$"))
    last = F.transform(parts, lambda p: F.when(F.contains(p, F.lit(",")), F.substring_index(p, ",", 1)).otherwise(F.element_at(F.split(p, r"(?U)\s+"), -1)))
    return F.filter(F.transform(last, lambda p: F.regexp_replace(p, r"[^\p{L}\p{N}_]", "")), lambda p: F.length(p) > 2)


def author_overlap(cited: Column, correct: Column) -> Column:
    """Share of the first ten cited surnames found in the other list; null with fewer than two on a side."""
    a, b = author_surnames(cited), F.array_distinct(author_surnames(correct))
    first = F.slice(a, 1, 10)
    hits = F.size(F.filter(first, lambda s: F.exists(b, lambda x: F.contains(x, s) | F.contains(s, x))))
    enough = ~blank(cited) & ~blank(correct) & (F.size(a) >= 2) & (F.size(author_surnames(correct)) >= 2)
    return F.when(enough, hits / F.size(first))


def keyword_coverage(title: Column, text: Column) -> Column:
    """Share of a title's distinct words of more than three letters that a text contains; 0 for titles without such words."""
    words = F.array_distinct(F.filter(F.split(F.lower(F.coalesce(title, F.lit(""))), r"(?U)\s+"), lambda w: F.length(w) > 3))
    hits = F.size(F.filter(words, lambda w: F.contains(F.lower(F.coalesce(text, F.lit(""))), w)))
    return F.when(F.size(words) > 0, hits / F.size(words)).otherwise(0.0)


def url_quote(c: Column) -> Column:
    """Percent-encoding of a path: letters, digits, ``_.-~`` and the slash stay."""
    out = F.url_encode(c)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%2F", "/"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def author_list(c: Column) -> Column:
    """``array<struct<family,given>>`` as "Family, Given; ...": of the first ten those with a family name; null if none is left."""
    first = F.filter(F.slice(c, 1, 10), lambda a: ~blank(a["family"]))
    return F.nullif(F.array_join(F.transform(first, lambda a: F.regexp_replace(F.concat(a["family"], F.lit(", "), F.coalesce(a["given"], F.lit(""))), r"^[, ]+|[, ]+$", "")), "; "), F.lit(""))


def repository(url: Column) -> Column:
    """``struct<owner,name>`` of the address of a code repository, else null."""
    p = r"^https?://github\.com/([^/\s]+)/([^/\s#?]+)"
    u = F.rtrim(url, F.lit("/"))
    return F.when(u.rlike(p), F.struct(F.regexp_extract(u, p, 1).alias("owner"), F.replace(F.regexp_extract(u, p, 2), F.lit(".git"), F.lit("")).alias("name")))


def forum_id(url: Column) -> Column:
    """The id in the address of a review forum, else null."""
    return F.when(F.contains(url, F.lit("openreview.net")), first_match(url, r"[?&]id=([A-Za-z0-9_\-]+)"))


def html_titles(html: Column) -> Column:
    """Titles of a page of search results, without markup and blank ones."""
    hits = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r'class="gs_rt"[^>]*>(?:<[^>]+>)*([^<]+)'), F.lit(1))
    return F.filter(F.transform(hits, lambda t: strip(F.regexp_replace(t, "<[^>]+>", ""))), lambda t: t != "")


def html_snippets(html: Column) -> Column:
    """The first three snippets of a page of search results, without markup."""
    hits = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r'(?s)class="result__snippet"[^>]*>(.*?)</a>'), F.lit(1))
    return F.transform(F.slice(hits, 1, 3), lambda t: strip(F.regexp_replace(t, "<[^>]+>", "")))


def reply_json(c: Column) -> Column:
    """The JSON text of a model's reply: the first line and the last one gone where they fence it."""
    t = strip(c)
    t = F.when(t.startswith("```"), F.regexp_replace(t, r"^[^\n]*\n?", "")).otherwise(t)
    t = F.when(t.endswith("```"), F.regexp_replace(t, r"(?:^|\n)[^\n]*$", "")).otherwise(t)
    return strip(t)


def line_chunks(c: Column, whole: int = 6000, least: int = 3000) -> Column:
    """A text in chunks of whole lines: one chunk up to ``whole`` characters, else each closed by the line with which it holds ``least`` or more."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit(0).alias("size"), F.lit(False).alias("open"))

    def step(a: Column, line: Column) -> Column:
        now = F.when(a["open"], F.concat(a["now"], F.lit("\n"), line)).otherwise(line)
        size = a["size"] + F.length(line)
        full = size >= least
        return F.struct(F.when(full, F.concat(a["done"], F.array(now))).otherwise(a["done"]).alias("done"), F.when(full, "").otherwise(now).alias("now"), F.when(full, 0).otherwise(size).alias("size"), (~full).alias("open"))

    cut = F.aggregate(F.split(c, "\n"), start, step, lambda a: F.when(a["open"], F.concat(a["done"], F.array(a["now"]))).otherwise(a["done"]))
    return F.when(F.length(c) > whole, cut).otherwise(F.array(c))


def list_chunks(c: Column, size: int) -> Column:
    """An array in pieces of ``size``."""
    return F.when(F.size(c) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(c) - 1) / size).cast("int")), lambda i: F.slice(c, i * size + 1, F.lit(size)))).otherwise(F.slice(F.array(c), 1, 0))
