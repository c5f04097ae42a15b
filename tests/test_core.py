"""Operators of the core on small fixtures."""

import itertools
import json
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from refloom.functions import similarity, text
from refloom.operators import bibtex, crosscheck, entries, lookup, sections, validate, verdict

BIB = "doc_id long, ord int, key string, entry_type string, authors string, title string, publisher string, journal string, booktitle string, url string, urldate string, year string, pages string"


def bib(spark, *rows):
    cols = [c.split()[0] for c in BIB.split(", ")]
    return spark.createDataFrame([tuple(r.get(c) for c in cols) for r in rows], BIB)


def col(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("authors", "key", "year", "ok"),
    [("Ezgarani, I.", "Ez10", "2010", True), ("Mueller, H.; Schmidt, E.", "MS12", "2012", True), ("Ezgarani, I.", "Ez10", "2011", False), (None, "Ez10", None, None), ("", "Ez10", "", None)],
)
def test_key_consistency(spark, authors, key, year, ok):
    assert validate.issues(bib(spark, {"doc_id": 1, "key": key, "authors": authors, "year": year}), 2025).first()["key_ok"] is ok


@pytest.mark.parametrize(("pages", "found"), [("12-34", ["pages:dash"]), ("12--34", []), ("12–34", []), ("1--201", []), ("1--202", ["pages:span"]), (None, [])])
def test_pages(spark, pages, found):
    got = validate.issues(bib(spark, {"doc_id": 1, "key": "Ez10", "entry_type": "misc", "title": "T", "year": "2010", "pages": pages}), 2025).first()["issues"]
    assert got == found


def test_missing_fields_follow_the_type(spark):
    got = validate.issues(bib(spark, {"doc_id": 1, "key": "Ab10", "entry_type": "website", "title": "T"}, {"doc_id": 2, "key": "Ab10", "entry_type": None}), 2025)
    assert [r["issues"] for r in got.orderBy("doc_id").collect()] == [["missing:url", "missing:urldate"], ["missing:authors", "missing:title", "missing:year"]]


@pytest.mark.parametrize(("sim", "band"), [(0.75, "verified"), (0.74, "partial_match"), (0.40, "partial_match"), (0.39, "not_found")])
def test_bands(spark, sim, band):
    assert col(spark, sim, text.status_band, "double") == band


def test_sections_and_entries(spark):
    d = spark.createDataFrame([(1, "Intro [Ez10] text.\nLiteratur\n[Ez10] Ezgarani, I.: On water. Nordverlag,\n2010.\n[Di02] See www.a.example/x, Stand: 01.02.2020"), (2, None), (3, "")], "doc_id long, text string")
    s = sections.split_sections(d)
    assert [r["body"] for r in s.orderBy("doc_id").collect()] == ["Intro [Ez10] text.", "", ""]
    got = entries.parse_entries(entries.split_entries(s)).orderBy("ord").collect()
    assert [(r["key"], r["entry_type"], r["authors"], r["year"]) for r in got] == [("Ez10", "book", "Ezgarani, I.", "2010"), ("Di02", "website", None, None)]
    assert (got[1]["url"], got[1]["urldate"]) == ("www.a.example/x", "01.02.2020")


def test_brackets_and_numbers(spark):
    d = spark.createDataFrame([(1, "a [Ab10, Cd11] b [7]"), (2, "[1234]"), (3, None)], "doc_id long, body string")
    assert {r["key"] for r in sections.bracket_citations(d).collect()} == {"Ab10", "Cd11"}
    assert [r[0] for r in d.orderBy("doc_id").select(sections.numeric_flag(F.col("body"))).collect()] == [True, False, None]


def test_cross_check_with_repeats_and_empty_tables(spark):
    c = spark.createDataFrame([(1, "A"), (1, "A"), (1, "B")], "doc_id long, key string")
    b = spark.createDataFrame([(1, "B", 1), (1, "C", 2)], "doc_id long, key string, ord int")
    assert {(r["key"], r["class"]) for r in crosscheck.cross_check(c, b).collect()} == {("A", "missing"), ("B", "ok"), ("C", "orphan")}
    assert crosscheck.cross_check(c.limit(0), b.limit(0)).count() == 0


def test_unique_keeps_last_fields_at_first_place(spark):
    got = crosscheck.unique_entries(bib(spark, {"doc_id": 1, "ord": 1, "key": "A", "title": "x"}, {"doc_id": 1, "ord": 2, "key": "A", "title": "y"})).first()
    assert (got["ord"], got["title"]) == (1, "y")


@pytest.mark.parametrize(("a", "b", "s"), [("databases", "advanced databases", 1.0), ("", "x", 0.0), ("ab", "ab", 1.0)])
def test_similarity_cases(a, b, s):
    assert similarity.token_set(a, b) == s


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for c in a:
        new = [0]
        for j, d in enumerate(b, 1):
            new.append(row[j - 1] + 1 if c == d else max(row[j], new[-1]))
        row = new
    return row[-1]


@given(st.text("abc ", max_size=12), st.text("abc ", max_size=12))
def test_similarity_is_symmetric_and_lcs_right(a, b):
    assert similarity.lcs(a, b) == plain_lcs(a, b)
    assert similarity.token_set(a, b) == pytest.approx(similarity.token_set(b, a))
    assert 0 <= similarity.token_set(a, b) <= 1


def test_duplicates_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    words = "water soil river model study method basin flow sediment archive".split()
    titles = [" ".join(rng.sample(words, rng.randint(2, 6))) for _ in range(60)]
    titles += [t.replace("e", "a", 1) for t in titles[:20]] + ["", None]
    rows = [{"doc_id": d, "ord": i, "key": f"K{i:03}", "title": t} for d in (1, 2) for i, t in enumerate(titles)]
    want = {(d, a, b) for d in (1, 2) for a, b in itertools.combinations(sorted({t for t in titles if t}), 2) if similarity.token_set(a, b) >= 0.85}
    n = bib(spark, *rows).select("doc_id", F.col("title").alias("t"))
    assert {(r["doc_id"], r["title_a"], r["title_b"]) for r in crosscheck.title_pairs(n).collect()} == want
    # blocks of a few titles give the same pairs
    monkeypatch.setattr(crosscheck, "BLOCK", 7)
    assert sorted((r["doc_id"], r["title_a"], r["title_b"]) for r in crosscheck.title_pairs(n).collect()) == sorted(want)


def test_duplicate_pairs_have_keys(spark):
    rows = [{"doc_id": 1, "ord": i, "key": k, "title": t} for i, (k, t) in enumerate([("B", "Slow rivers north"), ("A", "Slow rivers, north"), ("C", "Slow river north"), ("D", "Archives"), ("D", None), ("E", "")])]
    got = sorted(tuple(r) for r in crosscheck.duplicate_pairs(bib(spark, *rows)).select("key_a", "key_b", "similarity", "type").collect())
    assert got == [("A", "B", 1.0, "exact"), ("A", "C", 0.97, "near-duplicate")]
    assert crosscheck.duplicate_pairs(bib(spark, *rows).limit(0)).count() == 0


@given(st.lists(st.text("abé ", max_size=16), min_size=2, max_size=8), st.sampled_from([0.5, 0.85, 0.97]))
def test_bounds_lose_no_pair(titles, threshold):
    own = sorted({" ".join(t.split()) for t in titles})
    want = {(x, y, similarity.token_set(x, y)) for x, y in itertools.combinations(own, 2) if similarity.token_set(x, y) >= threshold}
    assert set(similarity.alike_within(own, None, threshold)) == want
    half = len(own) // 2
    assert set(similarity.alike_within(own[:half], own[half:], threshold)) == {w for w in want if (w[0] in own[:half]) != (w[1] in own[:half])}


def test_few_titles_are_compared_one_by_one(monkeypatch):
    """Titles of one template have alike letters; nearly all of their pairs are ruled out before the comparison. Long titles are compared too."""
    rng = random.Random(7)
    stems = [f"{a}{b}{c}" for a in "ba ko ru te mi so".split() for b in "lar nes tid mon".split() for c in ("ing", "ed", "er")]
    titles = sorted({" ".join(["how", rng.choice(stems), "is", *rng.sample(stems, 3), "beyond", rng.choice(stems)]) for _ in range(400)})
    titles += [t.replace("o", "a", 1) for t in titles[:30]] + ["x" * 200 + " y", "x" * 199 + " y", " ".join(stems), " ".join(stems[1:]) + " bolaring"]
    want = {(x, y, similarity.token_set(x, y)) for x, y in itertools.combinations(sorted(titles), 2) if similarity.token_set(x, y) >= 0.85}
    calls, real = [], similarity.token_set
    monkeypatch.setattr(similarity, "token_set", lambda x, y: calls.append(1) or real(x, y))
    got = list(similarity.alike_within(titles, None, 0.85))
    assert len(got) == len(want) and set(got) == want and len(calls) <= 2 * len(want) + 20


@given(st.lists(st.lists(st.text("abé ", max_size=16), max_size=6), min_size=1, max_size=5), st.sampled_from([0.5, 0.85, 0.97]))
def test_lists_compared_together_lose_no_pair(lists, threshold):
    lists = [sorted({" ".join(t.split()) for t in x}) for x in lists]
    want = {(i, x, y, similarity.token_set(x, y)) for i, own in enumerate(lists) for x, y in itertools.combinations(own, 2) if similarity.token_set(x, y) >= threshold}
    got = list(similarity.alike_among(lists, threshold))
    assert len(got) == len(want) and set(got) == want


def test_small_papers_are_compared_together(spark, monkeypatch):
    """Most papers have a few titles; the arrays of a search are made once for hundreds of papers, not for each. Larger papers and long titles are in the same table."""
    rng = random.Random(5)
    words = "water soil river model study method basin flow sediment archive".split()
    titles = {d: sorted({" ".join(rng.sample(words, rng.randint(3, 6))) for _ in range(40 if d % 50 == 0 else 6)} | ({"x" * 200 + " y", "x" * 199 + " y"} if d == 7 else set())) for d in range(500)}
    want = {(d, a, b) for d, own in titles.items() for a, b in itertools.combinations(own, 2) if similarity.token_set(a, b) >= 0.85}
    made, real = [], similarity.Titles
    monkeypatch.setattr(similarity, "Titles", lambda *x: made.append(1) or real(*x))
    assert {(d, a, b) for d, a, b, _ in similarity.alike_among(list(titles.values()), 0.85)} == want and len(made) == 1
    monkeypatch.setattr(crosscheck, "FEW", 30)
    t = spark.createDataFrame([(d, x) for d, own in titles.items() for x in own], "doc_id long, t string")
    assert sorted((r["doc_id"], r["title_a"], r["title_b"]) for r in crosscheck.title_pairs(t).collect()) == sorted(want)


def test_two_blocks_of_long_titles_are_looked_through_once(monkeypatch):
    """The word lists of two blocks are made once for both directions, and shared words take no machine word of a pair."""
    rng = random.Random(11)
    stems = [f"{a}{b}{c}" for a in "ba ko ru te mi so".split() for b in "lar nes tid mon".split() for c in ("ing", "ed", "er")]
    titles = sorted({" ".join(rng.sample(stems, 14)) for _ in range(60)})
    titles += [t.replace("o", "a", 1) for t in titles[:15]] + [t.rsplit(" ", k)[0] for k in (1, 3) for t in titles[:15]] + [f"{t} {stems[0]}" for t in titles[:15]]
    titles = sorted(set(titles))
    left, right = titles[::2], titles[1::2]
    want = {(*sorted((x, y)), similarity.token_set(x, y)) for x in left for y in right if similarity.token_set(x, y) >= 0.85}
    made, real = [], similarity.Titles.post
    monkeypatch.setattr(similarity.Titles, "post", lambda t: made.append(1) or real(t))
    got = list(similarity.alike_within(left, right, 0.85))
    assert want and len(got) == len(want) and set(got) == want and len(made) == 1
    # unshared letters fit one word, or take two; the bound is the ratio over all words, or above it
    a = similarity.Titles([t for t in titles if len(t) < similarity.LETTERS], {})
    assert a.size.max() > 110 and a.plain.all()
    p, q = np.triu_indices(len(a.titles), 1)
    bound = similarity.ratio_bound(a, a, p, q)

    def ratio(s, t):
        x, y = (" ".join([*sorted(u - v), ""]) for u, v in ((set(s.split()), set(t.split())), (set(t.split()), set(s.split()))))
        size = sum(len(" ".join(set(u.split()))) for u in (s, t))
        return 1 - (len(x) + len(y) - 2 * similarity.lcs(x, y)) / size if x and y else 0.0

    assert all(b >= ratio(a.titles[i], a.titles[j]) - 1e-9 for i, j, b in zip(p, q, bound, strict=True))
    words, count = [], np.bitwise_count
    monkeypatch.setattr(np, "bitwise_count", lambda w: words.append(1) or count(w))
    one = similarity.Titles([" ".join(stems[:14]), " ".join([*stems[:13], "x"])], {})
    similarity.ratio_bound(one, one, np.array([0]), np.array([1]))
    assert len(words) == 1


def test_paper_counts_have_fakes_style_and_near_duplicates(spark, tmp_path):
    from refloom.plans import queries

    spark.createDataFrame([(1, "A")], "doc_id long, key string").write.parquet(f"{tmp_path}/citations.parquet")
    cols = "entry_id long, " + BIB
    names, titles = "Meier, A.; Bell, C.", ["Slow rivers of the north", "Slow rivers of the north", "Slow river of the north", "Archives"]
    rows = [(i, 1, i, k, "misc", names, t, None, None, None, None, None, "2010", None) for i, (k, t) in enumerate(zip("ABCD", titles, strict=True))]
    spark.createDataFrame(rows, cols).write.parquet(f"{tmp_path}/bib_entries.parquet")
    v = [(i, 1, k, "verified", 0.9, titles["ABCD".index(k)], None, a) for i, (k, a) in enumerate([("A", "Novak, J.; Duarte, P."), ("B", names), ("D", "Novak, J.; Duarte, P.")])]
    spark.createDataFrame(v, "verification_id long, doc_id long, key string, status string, confidence double, matched_title string, doi string, correct_authors string").write.parquet(f"{tmp_path}/verifications.parquet")
    spark.createDataFrame([(1, "As Bell et al. say, e.g. here. % i.e. not here")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    q = queries.queries()
    r = q["paper_summary"](spark, str(tmp_path)).first()
    assert (r["n_fake"], r["n_style"], r["n_duplicates"]) == (2, 2, 3)
    # orphans 15, incomplete 0, fakes 20, duplicates 10, style 4
    assert q["flagship_paper_score"](spark, str(tmp_path)).first()["score"] == 100 - 15 - 5 * min(r["n_incomplete"], 4) - 20 - 10 - 4
    assert q["fallback_verdict"](spark, str(tmp_path)).first()["verdict"] != "PASS"


def audited(spark, path, name):
    """A query over two small papers, and how often its plan reads the entries."""
    from refloom.plans import queries

    names, titles = "Meier, A.; Bell, C.", ["Slow rivers of the north", "Slow rivers of the north", "Slow river of the north", "Archives"]
    rows = [(10 * d + i, d, i, k, "misc", names, t, None, None, None, None, None, "2010", None) for d in (1, 2) for i, (k, t) in enumerate(zip("ABCD", titles, strict=True)) if d == 1 or k == "D"]
    spark.createDataFrame(rows, "entry_id long, " + BIB).write.parquet(f"{path}/bib_entries.parquet")
    spark.createDataFrame([(1, "A"), (1, "Z"), (2, "D")], "doc_id long, key string").write.parquet(f"{path}/citations.parquet")
    v = [(1, 1, "A", "verified", 0.9, titles[0], None, "Novak, J.; Duarte, P."), (2, 1, "B", "verified", 0.9, titles[1], None, names)]
    spark.createDataFrame(v, "verification_id long, doc_id long, key string, status string, confidence double, matched_title string, doi string, correct_authors string").write.parquet(f"{path}/verifications.parquet")
    spark.createDataFrame([(1, "As Bell et al. say, e.g. here."), (2, "Plain.")], "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    df = queries.queries()[name](spark, str(path))
    return df, sum("entry_id#" in line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Relation [" in line)


def test_deductions_read_the_entries_once_for_each_part(spark, tmp_path):
    """The titles of a paper are kept; five more readings of the entries stood in the plan before."""
    df, reads = audited(spark, tmp_path, "paper_deductions")
    got = {(r["doc_id"], r["category"]): (r["n"], r["deduction"]) for r in df.collect()}
    assert got[1, "n_duplicates"] == (3, 10) and got[1, "n_missing"] == (1, 10) and got[1, "n_orphan"] == (3, 15) and got[1, "n_fake"] == (1, 10) and got[1, "n_style"] == (2, 4)
    assert not any(k in got for k in [(2, "n_duplicates"), (2, "n_missing"), (2, "n_orphan"), (2, "n_fake"), (2, "n_style")])
    assert reads == 3


def test_json_reports_read_the_entries_once_for_each_part(spark, tmp_path):
    df, reads = audited(spark, tmp_path, "report_json")
    got = {r["doc_id"]: json.loads(r["report"]) for r in df.collect()}
    # of 100: missing 10, orphans 15, fake 10, duplicates 10, style 4, and what is incomplete
    left = 100 - 10 - 15 - 10 - 10 - 4 - min(5 * got[1]["summary"]["n_incomplete"], 20)
    assert sorted(got) == [1, 2] and all(got[d]["doc_id"] == d for d in got) and got[1]["score"]["score"] == left
    assert [got[1]["summary"][f"n_{c}"] for c in ("missing", "orphan", "ok", "entries", "duplicates", "fake", "real", "style")] == [1, 3, 1, 4, 3, 1, 1, 2]
    assert {"category": "n_duplicates", "count": 3, "deduction": 10} in got[1]["score"]["deductions"]
    assert reads == 3


def test_summaries_read_the_entries_once_for_each_part(spark, tmp_path):
    df, reads = audited(spark, tmp_path, "paper_summary")
    got = {r["doc_id"]: r.asDict() for r in df.collect()}
    assert sorted(got) == [1, 2] and df.count() == 2
    names = ["n_missing", "n_orphan", "n_ok", "n_entries", "n_duplicates", "n_fake", "n_real", "n_style"]
    assert [[got[d][c] for c in names] for d in (1, 2)] == [[1, 3, 1, 4, 3, 1, 1, 2], [0, 0, 1, 1, 0, 0, 0, 0]]
    assert reads == 3


def test_text_reports_read_the_entries_once_for_each_part(spark, tmp_path):
    df, reads = audited(spark, tmp_path, "text_report_lines")
    got = {r["doc_id"]: r["report"].split("\n") for r in df.collect()}
    assert sorted(got) == [1, 2] and got[1][0] == "Paper 1" and got[1][2] == "Deductions" and got[1][-2:] == ["Cited but not listed: 1", "Listed but not cited: 3"]
    assert {"  -10 n_missing (1)", "  -15 n_orphan (3)", "  -10 n_fake (1)", "  -10 n_duplicates (3)", "  - 4 n_style (2)"} <= set(got[1])
    assert not any(line.startswith(("Cited", "Listed")) for line in got[2])
    assert reads == 3


def test_ranking_reads_the_entries_once_for_each_part(spark, tmp_path):
    df, reads = audited(spark, tmp_path, "batch_ranking")
    got = [(r["doc_id"], r["score"]) for r in df.collect()]
    assert [d for d, _ in got] == [2, 1] and got[0][1] > got[1][1] and got[1][1] <= 100 - 10 - 15 - 10 - 10 - 4
    assert reads == 3


def test_fusion_boost_and_order(spark):
    r = spark.createDataFrame([(1, "A", s, 0.9 - i / 100, None, None, i) for i, s in enumerate(["verified"] * 3 + ["error"])], "doc_id long, key string, status string, confidence double, doi string, correct_authors string, source_ord int")
    got = lookup.fuse(r, ["doc_id", "key"]).first()
    assert (got["status"], got["confidence"], got["n_verified"], got["doi"]) == ("verified", 1.0, 3, None)


@pytest.mark.parametrize(
    ("o", "s", "status", "want"),
    [(0.2, 0.5, "verified", ("FAKE", 0.8)), (0.2, 0.49, "verified", ("SUSPICIOUS", 0.45)), (0.7, 0.9, "verified", ("REAL", 0.94)), (0.7, 0.9, "partial_match", None), (None, 0.9, "verified", None)],
)
def test_pre_screen(spark, o, s, status, want):
    got = spark.createDataFrame([(o, s, status)], "o double, s double, t string").select(verdict.pre_screen(F.col("o"), F.col("s"), F.col("t")).alias("v")).first()["v"]
    assert (None if got is None else (got["verdict"], pytest.approx(got["confidence"]))) == want


def test_scores(spark):
    cols = ["n_missing", "n_orphan", "n_incomplete", "n_fake", "n_duplicates", "n_style", "n_key_issues"]
    d = spark.createDataFrame([(4, 0, 0, 0, 0, 0, 0), (0, 0, 0, 1, 0, 0, 0), (0, 0, 0, 3, 0, 0, 0)], ", ".join(f"{c} int" for c in cols))
    assert [(r["score"], r["grade"]) for r in verdict.scored(d).collect()][0] == (70, "C")
    assert [(r["score"], r["grade"], r["verdict"]) for r in verdict.overall(d).collect()][1:] == [(85, "B", "FLAG"), (55, "D", "FAIL")]


def test_bibtex(spark):
    src = '@book{a, title = {A {B} C}, author = "X \\" Y", year = 2020}\n@inproceedings{b, crossref = {p}}\n@proceedings{p, year = {1999}}'
    recs = bibtex.inherit(bibtex.records(spark.createDataFrame([(1, src), (2, None)], "doc_id long, text string")))
    got = {r["key"]: r["fields"] for r in recs.collect()}
    assert got["a"]["title"] == "A B C" and "year" not in got["a"]
    assert got["b"]["year"] == "1999"


def test_overlap_needs_two_names(spark):
    d = spark.createDataFrame([("A Meier; Bell, C.", "Meier; Bell"), ("Meier", "Meier; Bell"), (None, "x; y")], "a string, b string")
    assert [r[0] for r in d.select(text.author_overlap(F.col("a"), F.col("b"))).collect()] == [1.0, None, None]


def cols(spark, value, kind, *exprs):
    return list(spark.createDataFrame([(value,)], f"v {kind}").select(*[e.alias(f"c{i}") for i, e in enumerate(exprs)]).first())


def test_small_functions(spark):
    v = F.col("v")
    assert cols(spark, "a b/ü~*+", "string", text.url_quote(v)) == ["a%20b/%C3%BC~%2A%2B"]
    assert cols(spark, [("Meier", "A."), ("", "B."), ("Bell", None)], "array<struct<family:string,given:string>>", text.author_list(v)) == ["Meier, A.; Bell"]
    assert cols(spark, [], "array<struct<family:string,given:string>>", text.author_list(v)) == [None]
    r, f = cols(spark, "https://github.com/own/tool.git/tree", "string", text.repository(v), text.forum_id(v))
    assert (r["owner"], r["name"], f) == ("own", "tool", None)
    assert cols(spark, "https://openreview.net/forum?id=aB_-1&x", "string", text.forum_id(v)) == ["aB_-1"]
    assert cols(spark, '<h3 class="gs_rt" x><b><a href="q">Slow rivers</a></h3><h3 class="gs_rt"> </h3>', "string", text.html_titles(v)) == [["Slow rivers"]]
    assert cols(spark, '<a class="result__snippet" h>the <b>slow</b>\nriver</a>' * 4, "string", F.size(text.html_snippets(v)), F.get(text.html_snippets(v), F.lit(0))) == [3, "the slow\nriver"]
    assert cols(spark, '```json\n{"a": 1}\n```', "string", text.reply_json(v)) == ['{"a": 1}']
    assert cols(spark, ' {"a": 1} ', "string", text.reply_json(v)) == ['{"a": 1}']
    assert cols(spark, list("abcde"), "array<string>", text.list_chunks(v, 2)) == [[["a", "b"], ["c", "d"], ["e"]]]
    assert cols(spark, [], "array<string>", F.size(text.list_chunks(v, 2))) == [0]
    assert cols(spark, "Rivers of the slow north", "string", text.keyword_coverage(v, F.lit("the RIVERS are slow"))) == [pytest.approx(2 / 3)]
    assert cols(spark, 0.567, "double", text.percent(v)) == [56]


@given(st.lists(st.text("ab", max_size=5), min_size=1, max_size=12))
@settings(max_examples=5, deadline=None)
def test_line_chunks_against_a_loop(spark, lines):
    s = "\n".join(lines)
    want, now, size = [], [], 0
    for x in lines:
        now.append(x)
        size += len(x)
        if size >= 4:
            want.append("\n".join(now))
            now, size = [], 0
    want += ["\n".join(now)] if now else []
    assert cols(spark, s, "string", text.line_chunks(F.col("v"), whole=6, least=4)) == [want if len(s) > 6 else [s]]


def test_lookup_rules(spark):
    e = spark.createDataFrame([(1, "A", "Slow rivers of the north", "Meier, A.; Bell, C.", "https://arxiv.org/abs/1234.5678v1", None, None, "", "misc"), (1, "B", "x", None, "https://github.com/a/b", None, None, "", "website"), (1, "C", None, None, None, None, None, "", "misc")], "doc_id long, key string, title string, authors string, url string, doi string, isbn string, raw_text string, entry_type string")
    h = [("A", "crossref", 1, 200, "Slow river of north", None), ("A", "crossref", 2, 200, "Slow rivers of the north", None), ("A", "openreview", 1, 200, "Archives", None), ("A", "openreview", 2, 200, "Slow rivers north", None), ("A", "open_library", 1, 200, "Slow rivers north", None),
         ("A", "crossref_doi", 1, 200, "Archives", None), ("A", "dblp", 1, 503, None, None), ("A", "acl", 1, 200, None, None), ("A", "arxiv_version", 1, 200, "Slow rivers north", None), ("A", "web", 1, 200, None, "slow RIVERS run"), ("A", "web", 2, 200, None, "in the north"), ("B", "repository", 1, 404, None, None), ("B", "url", 1, 302, None, None), ("B", "crossref", 1, 200, "x", None)]
    hits = spark.createDataFrame([(1, k, s, r, c, t, "Novak, J.", None, None, None, None if x is None else x.lower(), 3, None) for k, s, r, c, t, x in h], "doc_id long, key string, source string, hit_rank int, http_status int, title string, authors string, doi string, oa_url string, year int, snippet string, latest_version int, error string")
    got = {(r["key"], r["source"]): r for r in lookup.score_hits(e, hits).collect()}
    brief = {k: (r["status"], round(r["confidence"], 2)) for k, r in got.items()}
    assert brief.pop(("A", "crossref"))[0] == "verified" and got["A", "crossref"]["confidence"] < 1
    assert brief == {
        ("A", "openreview"): ("verified", 1.0), ("A", "open_library"): ("verified", 0.85), ("A", "crossref_doi"): ("verified", 0.95), ("A", "dblp"): ("error", 0.0), ("A", "acl"): ("not_found", 0.0), ("A", "arxiv_version"): ("verified", 1.0),
        ("A", "web"): ("verified", 1.0), ("B", "repository"): ("not_found", 0.0), ("B", "url"): ("verified", 1.0), ("C", "none"): ("error", 0.0),
    }
    assert got["A", "arxiv_version"]["version_note"] == "Cited version v1, latest is v3" and got["A", "web"]["web_evidence"] == "slow rivers run"
    f = {r["key"]: r for r in lookup.full_fusion(lookup.score_hits(e, hits), ["doc_id", "key"]).collect()}
    assert f["A"]["note"].startswith("Confirmed by") and f["A"]["version_note"] and f["A"]["sources_checked"][-1] == "dblp" and f["C"]["status"] == "error"
    assert lookup.score_hits(e, hits.limit(0)).count() == 1 and lookup.score_hits(e.limit(0), hits).count() == 0


def test_cache_round_trip(spark):
    e = spark.createDataFrame([(1, "A", "Slow rivers", "Meier, A."), (2, "Z", "Slow  rivers!", "meier, B."), (1, "B", "Other", None), (1, "C", None, None)], "doc_id long, key string, title string, authors string")
    r = spark.createDataFrame([(1, "A", "verified", "n"), (1, "C", "verified", None)], "doc_id long, key string, status string, note string")
    kept = lookup.cache_rows(e, r)
    hit, miss = lookup.cache_probe(e, kept)
    assert {(x["doc_id"], x["key"], x["note"]) for x in hit.collect()} == {(1, "A", "n [cache]"), (2, "Z", "n [cache]")}
    assert {x["key"] for x in miss.collect()} == {"B", "C"}
