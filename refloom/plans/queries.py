"""Queries of the core, each over whole tables, with equivalent SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refloom.functions import text as X
from refloom.operators import crosscheck, entries, lookup, packed_values, sections, validate, verdict
from refloom.plans import audit, oracle, synth
from refloom.plans.oracle import CROSS, E, MISSING, V
from refloom.session import table

YEAR = 2025


def bib(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "bib_entries").dropDuplicates(["entry_id"])


def ver(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "verifications").dropDuplicates(["verification_id"])


def sections_of(s: SparkSession, d: str) -> DataFrame:
    return sections.split_sections(synth.papers(table(s, d, "lineitem")))


def parsed(s: SparkSession, d: str) -> DataFrame:
    return entries.parse_entries(entries.split_entries(sections_of(s, d)))


def issues(s: SparkSession, d: str) -> DataFrame:
    return validate.issues(bib(s, d), YEAR)


def crossed(s: SparkSession, d: str) -> DataFrame:
    return crosscheck.cross_check(table(s, d, "citations"), bib(s, d))


def counts(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").select("doc_id", sections.clean_latex(F.col("text")).alias("body"))
    return audit.paper_counts(table(s, d, "citations"), bib(s, d), screened(s, d), docs, this_year=YEAR)


def keyed_results(s: SparkSession, d: str) -> DataFrame:
    return ver(s, d).select("doc_id", "key", "status", "confidence", "doi", "correct_authors", F.col("verification_id").alias("source_ord"))


def screened(s: SparkSession, d: str) -> DataFrame:
    e = crosscheck.unique_entries(bib(s, d)).select("doc_id", "key", "authors", F.col("title").alias("cited"))
    r = lookup.best_result(ver(s, d), ["doc_id", "key"], "verification_id").select("doc_id", "key", "status", "confidence", "correct_authors", "matched_title")
    j = e.join(r, ["doc_id", "key"])
    from refloom.functions.similarity import title_similarity

    sim = title_similarity(X.normal_title(F.col("cited")), X.normal_title(F.col("matched_title")))
    pre = verdict.pre_screen(X.author_overlap(F.col("authors"), F.col("correct_authors")), sim, F.col("status"))
    v = F.coalesce(pre, verdict.fallback_verdict(F.col("status"), F.col("confidence")))
    return j.select("doc_id", "key", v["verdict"].alias("verdict"), v["confidence"].alias("confidence"))


def hits_scored(s: SparkSession, d: str) -> DataFrame:
    e = crosscheck.unique_entries(bib(s, d).select("doc_id", "key", "ord", "title", "authors", "url", "doi", "isbn", "raw_text", "entry_type"))
    return lookup.score_hits(e, lookup.recorded_hits(ver(s, d)))


def all_cited(s: SparkSession, d: str) -> DataFrame:
    """Keys cited in a paper's text, in brackets or by macro, and those of the citation table."""
    docs = table(s, d, "documents").select("doc_id", "text")
    return sections.bracket_citations(docs, "text").unionByName(sections.latex_cite_keys(docs)).unionByName(table(s, d, "citations").select("doc_id", "key")).distinct()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    c = F.col
    one = lambda df, *cols: df.select(*cols)
    return {
        "flagship_paper_score": lambda s, d: one(verdict.scored(counts(s, d)), "doc_id", "n_missing", "n_orphan", "n_incomplete", "n_duplicates", "n_fake", "n_style", "score", "grade"),
        "bib_entry_split": lambda s, d: one(entries.split_entries(sections_of(s, d)), "doc_id", "ord", "key"),
        "entry_fields": lambda s, d: one(parsed(s, d), "doc_id", "ord", "key", "entry_type", "authors", "title", "year", "pages", "journal", "booktitle", "volume"),
        "real_entry_fields": lambda s, d: entries.parse_entries(bib(s, d).select("doc_id", F.col("entry_id").alias("ord"), "key", "raw_text")).select(F.col("ord").alias("entry_id"), "entry_type", "authors", "year", "pages", "volume", "number", "doi", "isbn", "url", "urldate"),
        "entry_type_counts": lambda s, d: bib(s, d).groupBy("entry_type").agg(F.count("*").alias("n")),
        "section_split_lengths": lambda s, d: sections_of(s, d).select("doc_id", F.length("body").alias("body_chars"), F.length("bibliography").alias("bib_chars")),
        "citation_keys": lambda s, d: sections.bracket_citations(sections_of(s, d)),
        "citation_contexts_top2": lambda s, d: sections.citation_contexts(sections_of(s, d)),
        "numeric_citation_flag": lambda s, d: table(s, d, "documents").select("doc_id", F.coalesce(sections.numeric_flag(c("text")), F.lit(False)).alias("numeric")),
        "latex_clean": lambda s, d: table(s, d, "documents").select("doc_id", sections.clean_latex(c("text")).alias("body")),
        "latex_cite_keys": lambda s, d: sections.latex_cite_keys(table(s, d, "documents")),
        "embedded_bibliography": lambda s, d: table(s, d, "documents").select("doc_id", F.explode(sections.embedded_bibliography(c("text"))).alias("e")).select("doc_id", "e.key", "e.body"),
        "style_counts": lambda s, d: table(s, d, "documents").select("doc_id", F.explode(X.style_counts(F.coalesce("text", F.lit("")))).alias("r")).select("doc_id", "r.rule", c("r.count").alias("n")),
        "bib_unique": lambda s, d: one(crosscheck.unique_entries(bib(s, d).select("doc_id", "key", "ord", "title")), "doc_id", "key", "ord", "title"),
        "cross_check_class": crossed,
        "cited_not_in_bib": lambda s, d: one(crossed(s, d).where("class = 'missing'"), "doc_id", "key"),
        "in_bib_not_cited": lambda s, d: one(crossed(s, d).where("class = 'orphan'"), "doc_id", "key"),
        "correctly_used": lambda s, d: one(crossed(s, d).where("class = 'ok'"), "doc_id", "key"),
        "missing_fields": lambda s, d: bib(s, d).select("entry_id", F.array_join(validate.missing_fields(), ",").alias("missing")),
        "page_issues": lambda s, d: bib(s, d).select("entry_id", validate.single_dash().alias("single_dash"), F.coalesce(validate.page_span() > 200, F.lit(False)).alias("wide_span")),
        "key_consistency": lambda s, d: bib(s, d).select("entry_id", validate.key_year_ok().alias("year_ok"), validate.key_consistent().isNull().alias("unknown")),
        "key_verdicts": lambda s, d: bib(s, d).select("entry_id", validate.key_consistent().alias("key_ok")),
        "issue_counts": lambda s, d: issues(s, d).select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count("*").alias("n")),
        "title_normalise": lambda s, d: bib(s, d).select("entry_id", X.normal_title(c("title")).alias("normal")),
        "cache_key_hash": lambda s, d: bib(s, d).where("title IS NOT NULL AND title != ''").select("entry_id", X.cache_key(c("title"), c("authors")).alias("hash")),
        "arxiv_ids": lambda s, d: synth.preprints(table(s, d, "lineitem")).select("doc_id", "ord", X.arxiv_id(c("url"), c("doi"), c("raw_text"), c("journal")).alias("a")).where("a IS NOT NULL").select("doc_id", "ord", "a.id", "a.version"),
        "author_overlap": lambda s, d: bib(s, d).select("doc_id", "key", "authors").join(ver(s, d).select("doc_id", "key", "verification_id", "correct_authors"), ["doc_id", "key"]).select("doc_id", "key", "verification_id", X.author_overlap(c("authors"), c("correct_authors")).alias("overlap")),
        "duplicate_pairs": lambda s, d: crosscheck.duplicate_pairs(bib(s, d)),
        "duplicate_classes": lambda s, d: crosscheck.duplicate_classes(bib(s, d)),
        "self_citations": lambda s, d: crosscheck.self_citations(table(s, d, "documents").select("doc_id", c("text").alias("body")), bib(s, d)),
        "lookup_status_bands": lambda s, d: ver(s, d).groupBy(X.status_band(c("confidence")).alias("band")).agg(F.count("*").alias("n")),
        "best_source_per_entry": lambda s, d: one(lookup.best_result(ver(s, d), ["doc_id", "key"], "verification_id"), "doc_id", "key", "verification_id", "status", "confidence"),
        "evidence_fusion": lambda s, d: lookup.fuse(keyed_results(s, d), ["doc_id", "key"]).select("doc_id", "key", "status", F.floor(c("confidence") * 10000 + 0.5).alias("confidence_e4"), "doi", "n_sources", "n_verified"),
        "lookup_results": lambda s, d: hits_scored(s, d).select("doc_id", "key", "source", "status", F.floor(c("confidence") * 10000 + 0.5).alias("confidence_e4"), "matched_title", "open_access_url", "web_evidence"),
        "lookup_fused": lambda s, d: lookup.full_fusion(hits_scored(s, d), ["doc_id", "key"]).select("doc_id", "key", "status", F.floor(c("confidence") * 10000 + 0.5).alias("confidence_e4"), "n_sources", "n_verified", F.array_join("sources_checked", ",").alias("sources"), "note"),
        "cache_rows": lambda s, d: lookup.cache_rows(crosscheck.unique_entries(bib(s, d).select("doc_id", "key", "ord", "title", "authors")), lookup.best_result(ver(s, d), ["doc_id", "key"], "verification_id").select("doc_id", "key", "status", "confidence")).select("hash", "doc_id", "key", "status", "confidence"),
        "key_lists": lambda s, d: crosscheck.key_lists(crossed(s, d)).select("doc_id", *[F.array_join(x, ",").alias(x) for x in ("cited_not_in_bib", "in_bib_not_cited", "correctly_used")]),
        "all_cited_keys": all_cited,
        "flagged_references": lambda s, d: screened(s, d).where("verdict IN ('FAKE', 'SUSPICIOUS')").select("doc_id", "key", "verdict"),
        "status_metrics": lambda s, d: table(s, d, "verification_cache").agg(F.count("*").alias("results_kept"), F.countDistinct("hash").alias("hashes_kept"), F.count_if(c("status") == "verified").alias("verified_kept")),
        "prescreen_verdict": screened,
        "verdict_counts": lambda s, d: verdict.verdict_counts(screened(s, d), "doc_id"),
        "verdict_counts_status": lambda s, d: ver(s, d).groupBy("doc_id").agg(F.count_if(c("status") == "verified").alias("n_verified"), F.count_if(c("status") == "error").alias("n_error")),
        "verification_overlay": lambda s, d: one(verdict.overlay(keyed_results(s, d), screened(s, d)), "doc_id", "key", "status", "verdict"),
        "paper_deductions": lambda s, d: verdict.scored(counts(s, d)).select("doc_id", F.inline("deductions")).select("doc_id", "category", F.col("count").alias("n"), "deduction"),
        "paper_summary": counts,
        "fallback_verdict": lambda s, d: one(verdict.overall(counts(s, d)), "doc_id", "score", "grade", "verdict"),
        "batch_ranking": lambda s, d: one(verdict.batch_order(verdict.scored(counts(s, d)).withColumn("ord", c("doc_id"))), "doc_id", "score"),
        "text_report_lines": lambda s, d: audit.report_lines(verdict.scored(counts(s, d))),
        "report_json": lambda s, d: audit.report_json(verdict.scored(counts(s, d))),
        "p3_found": lambda s, d: packed_values.found(table(s, d, "bib_entries"), table(s, d, "verifications")),
    }


NAMES = "['Meier','Kowalski','Duarte','Larsen','Novak','Fischer','Okafor']"
TRUTH = f"""t AS (SELECT l_orderkey AS doc_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS ord,
 {NAMES}[l_suppkey % 7 + 1] AS surname, 'Wasser und Boden ' || (l_partkey % 97) AS title, year(l_shipdate) AS y, l_returnflag AS f, l_partkey % 300 + 1 AS lo, l_partkey % 300 + 1 + CAST(trunc(l_quantity) AS INT) * 5 AS hi FROM lineitem),
 k AS (SELECT *, substr(surname, 1, 2) || lpad(CAST(y % 100 AS VARCHAR), 2, '0') AS key, CASE f WHEN 'A' THEN 'article' WHEN 'N' THEN 'proceedings' ELSE 'book' END AS kind FROM t)"""
NORMAL = oracle.normal("title")
CONTEXT = rf"([^.]{{0,80}}){sections.GROUP}([^.]{{0,80}})"


def oracle_sql() -> dict[str, str]:
    sel = lambda cls: f"WITH {E}, {CROSS} SELECT doc_id, key FROM x WHERE class = '{cls}'"
    return oracle.sql(YEAR) | {
        "arxiv_ids": """WITH t AS (SELECT l_orderkey AS doc_id, l_partkey AS p, l_suppkey AS q, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS ord FROM lineitem)
 SELECT doc_id, ord, CASE WHEN p % 6 IN (1, 3) THEN 'math/' || lpad(p::VARCHAR, 7, '0') ELSE (p % 9000 + 1000) || '.' || lpad(q::VARCHAR, 5, '0') END AS id, CASE WHEN p % 6 IN (0, 3) THEN 'v' || (ord % 3 + 1) END AS version FROM t WHERE p % 6 <> 5""",
        "bib_entry_split": f"WITH {TRUTH} SELECT doc_id, ord, key FROM k",
        "entry_fields": f"""WITH {TRUTH} SELECT doc_id, ord, key, kind AS entry_type, surname || ', A.' AS authors, title, CAST(y AS VARCHAR) AS year,
 CASE WHEN kind <> 'book' THEN lo || CASE WHEN ord % 2 = 0 THEN '-' ELSE '--' END || hi END AS pages, CASE WHEN kind = 'article' THEN 'Hydrologie' END AS journal,
 CASE WHEN kind = 'proceedings' THEN 'Tagung Berlin' END AS booktitle, CASE WHEN kind = 'article' THEN CAST(ord AS VARCHAR) END AS volume FROM k""",
        "entry_type_counts": f"WITH {E} SELECT entry_type, count(*) AS n FROM e GROUP BY entry_type",
        "citation_keys": f"WITH {TRUTH} SELECT DISTINCT doc_id, key FROM k WHERE ord % 3 <> 0",
        "numeric_citation_flag": r"SELECT doc_id, coalesce(regexp_matches(text, '\[\d{1,3}\]'), false) AS numeric FROM documents",
        "latex_cite_keys": r"""WITH g AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\(?:[Cc]ite|[Cc]itet|citep)\{([^}]+)\}', 1)) AS g FROM documents), k AS (SELECT doc_id, unnest(string_split(g, ',')) AS k FROM g)
 SELECT DISTINCT doc_id, trim(k, E' \t\r\n') AS key FROM k WHERE trim(k, E' \t\r\n') <> ''""",
        "title_normalise": f"WITH {E} SELECT entry_id, {NORMAL} AS normal FROM e",
        "duplicate_classes": f"WITH {E}, t AS (SELECT doc_id, {NORMAL} AS title FROM e) SELECT doc_id, title, count(*) AS n_entries FROM t WHERE title <> '' GROUP BY doc_id, title HAVING count(*) > 1",
        "section_split_lengths": f"""WITH {TRUTH}, b AS (SELECT doc_id, string_agg(CASE WHEN ord % 3 <> 0 THEN 'As shown before [' || key || '].' END, ' ' ORDER BY ord) AS c,
 string_agg('[' || key || '] ' || surname || ', A.: ' || title || CASE kind WHEN 'article' THEN '. Hydrologie, Jg. ' || ord WHEN 'proceedings' THEN '. In: Tagung Berlin' ELSE '. Nordverlag, ' || y || '.' END
 || CASE WHEN kind <> 'book' THEN ', S. ' || lo || CASE WHEN ord % 2 = 0 THEN '-' ELSE '--' END || hi || ', ' || y || '.' ELSE '' END, E'\\n' ORDER BY ord) AS l FROM k GROUP BY doc_id)
 SELECT doc_id, CAST(length(trim('Introduction. ' || coalesce(c, ''))) AS INT) AS body_chars, CAST(length('Literatur' || E'\\n' || l) AS INT) AS bib_chars FROM b""",
        "citation_contexts_top2": rf"""WITH {TRUTH}, b AS (SELECT doc_id, trim('Introduction. ' || coalesce(string_agg(CASE WHEN ord % 3 <> 0 THEN 'As shown before [' || key || '].' END, ' ' ORDER BY ord), '')) AS body FROM k GROUP BY doc_id),
 h AS (SELECT doc_id, unnest(list_zip(regexp_extract_all(body, '{CONTEXT}', 0), regexp_extract_all(body, '{CONTEXT}', 2), range(1, 1 + len(regexp_extract_all(body, '{CONTEXT}', 0))))) AS z FROM b),
 q AS (SELECT doc_id, z[3] AS pos, {oracle.strip('z[1]')} AS snippet, unnest(list_zip(regexp_split_to_array(z[2], ',\s*'), range(1, 1 + len(regexp_split_to_array(z[2], ',\s*'))))) AS y FROM h),
 r AS (SELECT doc_id, y[1] AS key, CAST(row_number() OVER (PARTITION BY doc_id, y[1] ORDER BY pos, y[2]) AS INT) AS n, snippet FROM q) SELECT doc_id, key, n, snippet FROM r WHERE n <= 2""",
        "verdict_counts_status": f"""WITH {V} SELECT doc_id, count(*) FILTER (status = 'verified') AS n_verified, count(*) FILTER (status = 'error') AS n_error FROM v GROUP BY doc_id""",
        "bib_unique": f"WITH {E} SELECT doc_id, key, min(ord) AS ord, arg_max(title, ord) AS title FROM e GROUP BY doc_id, key",
        "cross_check_class": f"WITH {E}, {CROSS} SELECT doc_id, key, class FROM x",
        "cited_not_in_bib": sel("missing"), "in_bib_not_cited": sel("orphan"), "correctly_used": sel("ok"),
        "missing_fields": f"""WITH {E} SELECT entry_id, array_to_string({MISSING}, ',') AS missing FROM e""",
        "page_issues": rf"""WITH {E} SELECT entry_id, coalesce(regexp_matches(pages, '\d-\d') AND NOT contains(pages, '--'), false) AS single_dash,
 coalesce(TRY_CAST(nullif(regexp_extract(pages, '(\d+)\s*[-–—]+\s*(\d+)', 2), '') AS BIGINT) - TRY_CAST(nullif(regexp_extract(pages, '(\d+)\s*[-–—]+\s*(\d+)', 1), '') AS BIGINT) > 200, false) AS wide_span FROM e""",
        "key_consistency": r"""WITH """ + E + r""" SELECT entry_id, CASE WHEN coalesce(year, '') <> '' THEN right(year, 2) = regexp_extract(key, '^([A-Za-z]+)(\d{2})([a-z])?$', 2) END AS year_ok,
 (coalesce(year, '') = '' AND len(list_filter(string_split(coalesce(authors, ''), ';'), lambda a: trim(string_split(trim(a), ',')[1]) <> '')) = 0) OR NOT regexp_matches(key, '^([A-Za-z]+)(\d{2})([a-z])?$') AS "unknown" FROM e""",
        "lookup_status_bands": f"WITH {V} SELECT CASE WHEN confidence >= 0.75 THEN 'verified' WHEN confidence >= 0.40 THEN 'partial_match' ELSE 'not_found' END AS band, count(*) AS n FROM v GROUP BY 1",
        "best_source_per_entry": f"""WITH {V} SELECT doc_id, key, verification_id, status, confidence FROM v QUALIFY row_number() OVER (PARTITION BY doc_id, key
 ORDER BY CASE status WHEN 'verified' THEN 3 WHEN 'partial_match' THEN 2 WHEN 'not_found' THEN 1 ELSE 0 END DESC, confidence DESC, verification_id) = 1""",
        "evidence_fusion": f"""WITH {V}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY CASE status WHEN 'verified' THEN 3 WHEN 'partial_match' THEN 2 WHEN 'not_found' THEN 1 ELSE 0 END DESC, confidence DESC, verification_id) AS o FROM v)
 SELECT doc_id, key, arg_min(status, o) AS status, CAST(floor((CASE WHEN count(*) FILTER (status = 'verified') >= 2 THEN least(1.0, arg_min(confidence, o) + 0.05 * (count(*) FILTER (status = 'verified') - 1)) ELSE arg_min(confidence, o) END) * 10000 + 0.5) AS BIGINT) AS confidence_e4,
 arg_min(doi, o) FILTER (coalesce(doi, '') <> '') AS doi, CAST(count(*) AS BIGINT) AS n_sources, count(*) FILTER (status = 'verified') AS n_verified FROM r GROUP BY doc_id, key""",
    }
