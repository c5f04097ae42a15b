"""Splitting of fields that hold several values."""

import pytest
from pyspark.sql import functions as F

from refloom.operators import packed_values as P


def split(s, lex=P.EMPTY):
    return [v for v, _ in P.segment(s, lex)]


@pytest.mark.parametrize(
    ("field", "want"),
    [
        ("Meier, Anna; Bell, C. and Novak, Jo et al.", ["Meier, Anna", "Bell, C.", "Novak, Jo"]),
        ("Meier, A., Bell, C., & Novak, J.", ["Meier, A.", "Bell, C.", "Novak, J."]),
        ('"Meier, Anna", "Werk ""Lot"" e. V."', ["Meier, Anna", 'Werk "Lot" e. V.']),
        ("Anna Meier, Carl Bell und Jo Novak u. a.", ["Anna Meier", "Carl Bell", "Jo Novak"]),
        ("Meier, U. A.", ["Meier, U. A."]),
        ("A Meier|B Bell\nC Novak / D Duarte · E Okafor", ["A Meier", "B Bell", "C Novak", "D Duarte", "E Okafor"]),
        ("{Soils; Northern Branch} and Bell, C.", ["Soils; Northern Branch", "Bell, C."]),
        (";; Meier, A.;; ", ["Meier, A."]),
        ("van der Meier, Anna", ["van der Meier, Anna"]),
        ("", []), (None, []), (" ; , ", []),
    ],
)
def test_cases(field, want):
    assert split(field) == want


def test_column_learns_organisations_in_no_list(spark):
    # "Bruderschaft zum" and "Orden" stand in no list of this package
    names = [f"Ber{a}{b}, {a.upper()}." for a in "aeiou" for b in "lmnrst"]
    orgs = [f"Bruderschaft zum {x} und {y} {z}" for x in ("Hirsch", "Stern") for y in ("Mond", "Anker") for z in ("Ulm", "Hof")]
    rows = [f'"{o}"; {n}; {m}' for i, o in enumerate(orgs) for n, m in zip(names[i::3], names[i + 1 :: 3])]
    doubt = "Bera, K. and Bruderschaft zum Stern und Anker Ulm and Berel, E."
    assert len(split(doubt)) == 4
    df = spark.createDataFrame([(r,) for r in [*rows, doubt, doubt, None, ""]], "value string")
    got = [r["part"] for r in P.split_column(df).where(F.col("value") == doubt).orderBy("pos").collect()]
    assert got == ["Bera, K.", "Bruderschaft zum Stern und Anker Ulm", "Berel, E."]


def test_value_of_many_atoms_stays_whole(spark):
    org = "Amt for Seas, Rivers, Lakes, Ponds, Springs and Wells, Hof"
    rows = [(f'"{org}"; Meier{i}, A.; "Amt for Seas and Lakes, Ulm"; "Amt for Springs, Wells and Ponds, Hof"; "Amt for Rivers, Hof"',) for i in range(12)] + [(f"Bell, C. and {org}",)]
    got = {r["part"] for r in P.split_column(spark.createDataFrame(rows, "value string")).collect()}
    assert org in got and "Bell, C." in got and "Lakes" not in got


def test_hashed_cells_agree_with_the_engine(spark):
    key = "für Wässer"
    df = spark.createDataFrame([("w", key, 3.0)], "role string, key string, n double")
    cells = {r["row"]: r["cell"] for r in P.sure_cells(df).where("kind = 'w'").collect()}
    assert cells == {r: c for k, r, c in zip(*(P.batch_of({("p", key): 1.0}).column(i).to_pylist() for i in range(3)), strict=True) if k == "w"}


def test_found_has_only_fields_of_two_or_more(spark):
    b = spark.createDataFrame([(1, "A Bell; C Novak", "x"), (1, "A Bell; C Novak", "y"), (2, "A Bell", "x"), (3, None, "x")], "entry_id long, authors string, extra string")
    v = spark.createDataFrame([(7, "A Bell and D Duarte")], "verification_id long, correct_authors string")
    got = {tuple(r) for r in P.found(b, v).select("src", "row_id", "pos", "value").collect()}
    assert got == {("bib_entries", 1, 1, "A Bell"), ("bib_entries", 1, 2, "C Novak"), ("verifications", 7, 1, "A Bell"), ("verifications", 7, 2, "D Duarte")}


def test_empty_tables(spark):
    b = spark.createDataFrame([], "entry_id long, authors string")
    v = spark.createDataFrame([], "verification_id long, correct_authors string")
    assert P.found(b, v).count() == 0


def test_very_long_field():
    s = "; ".join(f"Meier{i}, A." for i in range(3000))
    assert len(split(s)) == 3000


def test_rows_are_kept_with_other_columns(spark):
    df = spark.createDataFrame([(1, "x", "A Bell; C Novak"), (1, "x", "A Bell; C Novak"), (2, None, None), (3, "y", " ")], "row_id long, parts_of string, value string")
    got = sorted((r["row_id"], r["parts"]) for r in P.split_fields(df).collect())
    assert got == [(1, ["A Bell", "C Novak"]), (1, ["A Bell", "C Novak"]), (3, [])]


def test_soft_separated_field_of_any_length():
    s = " and ".join(f"Meier{i}, A." for i in range(1500))
    assert len(split(s)) == 1500
