"""File sources, BibTeX, merges and streams."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from refloom.operators import bibtex, verdict
from refloom.plans import audit
from refloom.sources import files
from refloom.streaming import ingest

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx(body: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


@pytest.fixture
def folder(tmp_path):
    p = lambda t: f"<w:p><w:r>{t}</w:r></w:p>"
    t = lambda s: f"<w:t>{s}</w:t>"
    (tmp_path / "a.docx").write_bytes(docx(p(t("Text [Be10].")) + p(t("Literatur")) + p(t("[Be10] Bell, C.:") + "<w:br/>" + t("Slow rivers")) + f"<w:tbl><w:tr><w:tc>{p(t('x'))}{p(t('y'))}</w:tc></w:tr></w:tbl>"))
    (tmp_path / "broken.docx").write_bytes(b"no package")
    (tmp_path / "b.tex").write_bytes(b"\\textbf{Bold} text \\cite{k1} % note\n\xff")
    (tmp_path / "b.bib").write_text("@book{k1, author = {Bell, C.}, title = {Slow rivers}, year = {1999}}")
    (tmp_path / "c.tex").write_text("Body\n\\begin{thebibliography}{9}\\bibitem{k2} Novak. Archives.\\end{thebibliography}")
    (tmp_path / "d.exe").write_bytes(b"x")
    return str(tmp_path)


def test_folder_of_all_formats(spark, folder):
    f = files.papers(spark, folder)
    assert {r["path"].rpartition("/")[2]: r["rejected"] for r in f.collect()}["d.exe"] == "format"
    pages = spark.createDataFrame([("e.pdf", 2, "Refer-\nences\n[Be10] Bell: Rivers"), ("e.pdf", 1, "Bo-\ndy [Be10]"), ("e.pdf", 3, None)], "path string, page int, text string")
    got = {r["path"].rpartition("/")[2]: r for r in files.full_texts(f, pages).collect()}
    assert got["b.tex"]["body"].startswith("Bold text") and got["b.tex"]["bibliography"] == "[k1] Bell, C.: Slow rivers. 1999."
    assert got["c.tex"]["bibliography"] == "[k2] Novak. Archives."
    assert got["a.docx"]["body"] == "Text [Be10]." and got["a.docx"]["text"].endswith("Bell, C.:\nSlow rivers\nx\ny")
    assert got["a.docx"]["bibliography"].splitlines() == ["Literatur", "[Be10] Bell, C.: Slow rivers x y"]
    assert got["e.pdf"]["body"] == "Body [Be10]" and "[Be10] Bell: Rivers" in got["e.pdf"]["bibliography"]
    assert got["broken.docx"]["text"] is None and got["broken.docx"]["body"] == ""
    assert "d.exe" not in got and "b.bib" not in got


def test_bibtex_lines_and_crossref(spark):
    src = "@inproceedings{a, crossref = {p}, title = {Rivers}, pages = {1--2}} @proceedings{p, booktitle = {Proc}, year = {1999}} @article{a, title = {Last}, journal = {J}}"
    recs = bibtex.inherit(bibtex.records(spark.createDataFrame([(1, src), (2, None), (3, "")], "doc_id long, text string")))
    assert {r["key"]: r["line"] for r in bibtex.rendered(recs).collect()} == {"a": "[a] Last. J.", "p": "[p] In: Proc. 1999."}


def test_merges_fill_blanks_only(spark):
    e = spark.createDataFrame([(1, "A", "Slow Rivers!", None, ""), (1, "B", "Other", "x", None), (1, "C", None, None, None)], "doc_id long, key string, title string, authors string, year string")
    x = spark.createDataFrame([(1, 1, "slow rivers", "Bell", "1998"), (1, 2, "slow rivers", None, "1999"), (1, 3, "", "q", "q")], "doc_id long, n int, title string, authors string, year string")
    got = {r["key"]: (r["authors"], r["year"]) for r in verdict.merge_extractions(e, x, ["authors", "year"]).collect()}
    assert got == {"A": (None, "1999"), "B": ("x", None), "C": (None, None)}
    y = spark.createDataFrame([(1, "B", "y", "2001"), (1, "C", "z", None)], "doc_id long, key string, authors string, year string")
    got = {r["key"]: (r["authors"], r["year"]) for r in verdict.fill_blanks(e, y, ["authors", "year"]).collect()}
    assert got == {"A": (None, None), "B": ("x", "2001"), "C": ("z", None)}


def test_stream_of_papers(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    rows = lambda *ids: spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string")
    rows(1, 2, 2).coalesce(1).write.parquet(src)
    plan = lambda d: d.select("doc_id", F.length("text").alias("n"))
    for more in (None, (3,)):
        if more:
            rows(*more).coalesce(1).write.mode("append").parquet(src)
        ingest.run(ingest.watch(spark, src, "doc_id long, text string"), plan, out, ck).awaitTermination()
    assert sorted(r["doc_id"] for r in spark.read.parquet(f"{out}/results").collect()) == [1, 2, 3]
    assert sorted((r["batch"], r["rows"]) for r in spark.read.json(f"{out}/progress").collect()) == [(0, 2), (1, 1)]


def test_reports_round_trip(spark, tmp_path):
    cols = ["n_missing", "n_orphan", "n_incomplete", "n_fake", "n_duplicates", "n_style", "n_key_issues"]
    d = spark.createDataFrame([(1, 1, 0, 0, 0, 0, 0, 0)], ", ".join(["doc_id long", *[f"{c} int" for c in cols]]))
    report = audit.report_json(verdict.scored(d))
    assert json.loads(report.first()["report"])["score"]["score"] == 90
    report.select("report").write.text(str(tmp_path / "r"))
    back = files.read_reports(spark, str(tmp_path / "r"), "doc_id long, score struct<score:int,grade:string>")
    assert back.select("score.grade").first()[0] == "A"
