"""Scoring of recorded lookup hits, ranking and fusion of sources, result cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refloom.functions.similarity import title_similarity
from refloom.functions.text import arxiv_id, blank, cache_key, keyword_coverage, normal_title, repository, status_band, strip

#: Fixed: sources in ranking order.
SOURCES = "crossref_doi crossref semantic_scholar openalex arxiv_version arxiv dblp acl openreview_forum openreview open_library_isbn open_library scholar web repository url".split()
#: Fixed: lowest confidence of sources found by an exact identifier, and the similarity from which they count as verified (0: always).
EXACT = {"crossref_doi": (0.95, 0.0), "open_library_isbn": (0.95, 0.0), "openreview_forum": (0.90, 0.7)}
#: Fixed: sources of which the most similar hit counts, not the first; their confidence has two places.
BEST_OF = ("openreview", "arxiv_version")
HIT_COLUMNS = "doc_id key source hit_rank http_status title authors doi oa_url year snippet latest_version error".split()


def title_lookups(entries: DataFrame, hits: DataFrame) -> DataFrame:
    """One result for each entry and source that is searched by title or identifier.

    The first hit of a source counts; of those in ``BEST_OF`` the most similar
    one (the first of equals). Identifier sources are verified by the
    identifier. A book found by title whose authors lack the first cited
    surname loses .15 of a similarity of .5 or more. A preprint cited in an
    older version than the latest gets a note. An error or no hit gives
    confidence 0.
    """
    e = entries.select("doc_id", "key", F.col("title").alias("cited"), F.col("authors").alias("cited_authors"), arxiv_id(F.col("url"), F.col("doi"), F.col("raw_text"))["version"].alias("cited_version"))
    j = e.join(hits.where(~F.col("source").isin("web", "repository", "url")).select(*HIT_COLUMNS), ["doc_id", "key"])
    j = j.withColumn("similarity", title_similarity(normal_title(F.col("cited")), normal_title(F.col("title"))))
    best_of = F.col("source").isin(*BEST_OF)
    w = Window.partitionBy("doc_id", "key", "source").orderBy(F.when(best_of, -F.col("similarity")).otherwise(0.0), "hit_rank")
    top = j.withColumn("n", F.row_number().over(w)).where("n = 1")
    first = F.lower(strip(F.substring_index(F.substring_index(F.col("cited_authors"), ";", 1), ",", 1)))
    other = (F.col("source") == "open_library") & ~blank(F.col("cited_authors")) & ~blank(F.col("authors")) & (F.col("similarity") >= 0.5) & ~F.contains(F.lower("authors"), first)
    sim = F.when(other, F.greatest(F.lit(0.0), F.col("similarity") - 0.15)).otherwise(F.col("similarity"))
    top = top.withColumn("similarity", F.when(best_of, F.bround(sim, 2)).otherwise(sim))
    status, conf = status_band(F.col("similarity")), F.col("similarity")
    for s, (least, from_) in EXACT.items():
        own = (F.col("source") == s) & (F.col("http_status") == 200)
        status = F.when(own, F.when(F.col("similarity") >= from_, "verified").otherwise("partial_match")).otherwise(status)
        conf = F.when(own, F.greatest(F.col("similarity"), F.lit(least))).otherwise(conf)
    bad, none = F.col("error").isNotNull() | (F.col("http_status") >= 400), F.col("title").isNull() & ~F.col("source").isin(list(EXACT))
    older = F.regexp_replace("cited_version", "[^0-9]", "").try_cast("int") < F.col("latest_version")
    note = F.when((F.col("source") == "arxiv_version") & older, F.concat(F.lit("Cited version "), F.col("cited_version"), F.lit(", latest is v"), F.col("latest_version").cast("string")))
    return top.select(
        "doc_id", "key", "source", F.when(bad, "error").when(none, "not_found").otherwise(status).alias("status"), F.when(bad | none, 0.0).otherwise(conf).alias("confidence"),
        F.col("title").alias("matched_title"), "doi", F.col("oa_url").alias("open_access_url"), F.col("authors").alias("correct_authors"), F.lit(None).cast("string").alias("web_evidence"), note.alias("version_note"),
    )


def web_lookups(entries: DataFrame, hits: DataFrame) -> DataFrame:
    """One result for each entry with hits of a web search: the share of the title's longer words in the first three snippets."""
    h = hits.where("source = 'web' AND hit_rank <= 3").groupBy("doc_id", "key").agg(F.array_sort(F.collect_list(F.struct("hit_rank", "snippet"))).alias("s"), F.max("http_status").alias("http_status"))
    j = entries.select("doc_id", "key", F.col("title").alias("cited")).join(h, ["doc_id", "key"])
    cover = F.bround(keyword_coverage(F.col("cited"), F.array_join(F.transform("s", lambda x: x["snippet"]), " ")), 4)
    j = j.withColumn("c", cover).withColumn("bad", F.col("http_status") != 200)
    status = F.when(F.col("bad"), "error").when(F.col("c") >= 0.85, "verified").when(F.col("c") >= 0.7, "partial_match").otherwise("not_found")
    text = lambda: F.lit(None).cast("string")
    return j.select(
        "doc_id", "key", F.lit("web").alias("source"), status.alias("status"), F.when(F.col("bad"), 0.0).otherwise(F.bround("c", 2)).alias("confidence"), text().alias("matched_title"), text().alias("doi"),
        text().alias("open_access_url"), text().alias("correct_authors"), F.when(~F.col("bad") & (F.col("c") >= 0.7), F.substring(F.get("s", F.lit(0))["snippet"], 1, 150)).alias("web_evidence"), text().alias("version_note"),
    )


def address_lookups(entries: DataFrame, hits: DataFrame) -> DataFrame:
    """One result for each entry whose address was asked for: a repository that exists, or a page that answers."""
    j = entries.select("doc_id", "key", "url").join(hits.where("source IN ('repository', 'url') AND hit_rank = 1").select("doc_id", "key", "source", "http_status", "error"), ["doc_id", "key"])
    j = j.where((F.col("source") == "url") | repository(F.col("url")).isNotNull())
    code = F.col("http_status")
    seen = F.when(F.col("source") == "url", code < 400).otherwise(code == 200)
    gone = F.when(F.col("source") == "url", code >= 400).otherwise(code == 404)
    status = F.when(F.col("error").isNotNull(), "error").when(seen, "verified").when(gone, "not_found").otherwise("error")
    text = lambda: F.lit(None).cast("string")
    return j.select("doc_id", "key", "source", status.alias("status"), F.when(status == "verified", 1.0).otherwise(0.0).alias("confidence"), text().alias("matched_title"), text().alias("doi"), F.when(status == "verified", F.col("url")).alias("open_access_url"), text().alias("correct_authors"), text().alias("web_evidence"), text().alias("version_note"))


def score_hits(entries: DataFrame, hits: DataFrame) -> DataFrame:
    """One result for each entry and source from recorded hits, with ``source_ord``.

    ``hits`` holds what the services answered; entries count once for each key
    of a paper. Entries of websites are looked up by their address only, all
    others never. Entries with nothing to look up get an error.
    """
    site = F.coalesce(F.col("entry_type") == "website", F.lit(False))
    able = lookup_able(entries)
    found = title_lookups(able.where(~site), hits).unionByName(web_lookups(able.where(~site), hits)).unionByName(address_lookups(entries.where(site), hits))
    none = entries.where(~site & blank(F.col("title")) & blank(F.col("doi")) & blank(F.col("isbn")))
    lost = none.select("doc_id", "key", F.lit("none").alias("source"), F.lit("error").alias("status"), F.lit(0.0).alias("confidence"))
    order = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, SOURCES)), F.col("source")), F.lit(0)), F.lit(99))
    return found.unionByName(lost, allowMissingColumns=True).withColumn("source_ord", order.cast("int"))


def recorded_hits(verifications: DataFrame) -> DataFrame:
    """Results of the lookup table as the hits of one source each, dealt by the record's id: what a run without a network looks up in."""
    n = F.pmod("verification_id", F.lit(len(SOURCES))).cast("int")
    text = F.concat_ws(" ", "matched_title", "correct_authors")
    return verifications.select(
        "doc_id", "key", F.get(F.array(*map(F.lit, SOURCES)), n).alias("source"), F.row_number().over(Window.partitionBy("doc_id", "key", n).orderBy("verification_id")).alias("hit_rank"),
        F.when(F.col("status") == "error", 500).when(F.col("status") == "not_found", 404).otherwise(200).alias("http_status"), F.col("matched_title").alias("title"), F.col("correct_authors").alias("authors"), "doi", F.col("open_access_url").alias("oa_url"),
        F.lit(None).cast("int").alias("year"), F.lower(text).alias("snippet"), F.pmod("verification_id", F.lit(4)).cast("int").alias("latest_version"), F.when(F.col("status") == "error", F.coalesce("note", F.lit("error"))).alias("error"),
    )


def full_fusion(results: DataFrame, by: list[str], order: str = "source_ord") -> DataFrame:
    """``fuse`` with all that is carried along: sources in ranking order, first evidence and version note, and the note of agreement."""
    ranked = F.array_sort(F.collect_list(F.struct((-priority(F.col("status"))).alias("p"), (-F.col("confidence")).alias("c"), F.col(order).alias("o"), "source", "web_evidence", "version_note", "matched_title")))
    first = lambda f: F.get(F.transform(F.filter("r", lambda x: ~blank(x[f])), lambda x: x[f]), F.lit(0))
    more = results.groupBy(*by).agg(ranked.alias("r")).select(*by, F.transform("r", lambda x: x["source"]).alias("sources_checked"), first("web_evidence").alias("web_evidence"), first("version_note").alias("version_note"), F.get("r", F.lit(0))["matched_title"].alias("matched_title"))
    out = fuse(results, by, order).join(more, by)
    return out.withColumn("note", F.when((F.col("n_verified") >= 2) & (F.col("status") == "verified"), F.concat(F.lit("Confirmed by "), F.col("n_verified").cast("string"), F.lit(" independent sources"))))


def priority(status: Column) -> Column:
    return F.when(status == "verified", 3).when(status == "partial_match", 2).when(status == "not_found", 1).otherwise(0)


def best_result(results: DataFrame, by: list[str], order: str = "source_ord") -> DataFrame:
    """The best result of each group: status, then confidence, then the fixed order of sources."""
    w = Window.partitionBy(*by).orderBy(priority(F.col("status")).desc(), F.col("confidence").desc(), order)
    return results.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def fuse(results: DataFrame, by: list[str], order: str = "source_ord") -> DataFrame:
    """One verdict of evidence for each group.

    Status and confidence of the best result; with n >= 2 verified sources the
    confidence grows by .05 for each further one, up to 1. DOI and authors are
    the first non-blank ones in ranking order, whatever that result's status.
    """
    ranked = F.array_sort(F.collect_list(F.struct((-priority(F.col("status"))).alias("p"), (-F.col("confidence")).alias("c"), F.col(order).alias("o"), "status", "confidence", "doi", "correct_authors")))
    g = results.groupBy(*by).agg(ranked.alias("r"), F.count_if(F.col("status") == "verified").alias("n_verified"), F.count("*").alias("n_sources"))
    top = F.get("r", F.lit(0))
    first = lambda f: F.get(F.transform(F.filter("r", lambda x: ~blank(x[f])), lambda x: x[f]), F.lit(0))
    boost = F.when(F.col("n_verified") >= 2, F.least(F.lit(1.0), top["confidence"] + 0.05 * (F.col("n_verified") - 1))).otherwise(top["confidence"])
    return g.select(*by, top["status"].alias("status"), boost.alias("confidence"), first("doi").alias("doi"), first("correct_authors").alias("correct_authors"), "n_sources", "n_verified")


def cache_probe(entries: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries found in a cache keyed by title and first surname, and those to look up.

    A hit gets the entry's own key and `` [cache]`` behind its note. Entries
    without title are never cached.
    """
    e = entries.withColumn("hash", F.when(~blank(F.col("title")), cache_key(F.col("title"), F.col("authors"))))
    c = cache.drop("doc_id", "key", "title").withColumn("note", F.concat(F.coalesce("note", F.lit("")), F.lit(" [cache]")))
    return e.select("doc_id", "key", "title", "hash").join(c, "hash"), e.join(cache.select("hash"), "hash", "left_anti")


def cache_rows(entries: DataFrame, results: DataFrame) -> DataFrame:
    """What a cache keeps: each result under the hash of its entry, one for each hash (the last key's); entries without title leave none."""
    e = entries.where(~blank(F.col("title"))).select("doc_id", "key", "title", cache_key(F.col("title"), F.col("authors")).alias("hash"))
    cols = [c for c in results.columns if c not in ("doc_id", "key")]
    j = e.join(results, ["doc_id", "key"])
    return j.groupBy("hash").agg(F.max_by(F.struct("doc_id", "key", "title", *[c for c in cols if c != "title"]), F.struct("doc_id", "key")).alias("x")).select("hash", "x.*")


def lookup_able(entries: DataFrame) -> DataFrame:
    """Entries with something to look up: a title, DOI or ISBN."""
    return entries.where(~(blank(F.col("title")) & blank(F.col("doi")) & blank(F.col("isbn"))))
