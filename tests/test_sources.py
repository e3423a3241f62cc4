import os

import pytest
from pyspark.sql import functions as F

from kinfold.functions.text import blocks, note_layout, number_at_least_zero
from kinfold.sources import readers

HERE = os.path.join(os.path.dirname(__file__), "fixtures")


def cells(df):
    return [r.cells for r in df.orderBy("ord").collect()]


def write(tmp_path, name, data):
    (tmp_path / name).write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(tmp_path / name)


def test_csv_dedup_blank_rows_and_headers(spark):
    found = cells(readers.read_csv(spark, f"{HERE}/people.csv"))
    assert [c["name"] for c in found] == ["Ada Verma", "Boris O'Neil", "Chen Wu", "Dora Lind"]
    assert "phone" not in found[2] and found[2]["location"] == "Lyon, Rhone, France"


@pytest.mark.parametrize("sep", [";", "\t", "|"])
def test_csv_delimiters(spark, tmp_path, sep):
    path = write(tmp_path, "x.csv", sep.join(["Name", " Email "]) + "\n" + sep.join(["A B", "a@b.co"]) + "\n" + sep.join(["C D", "c@d.co"]) + "\n")
    assert cells(readers.read_csv(spark, path)) == [{"name": "A B", "email": "a@b.co"}, {"name": "C D", "email": "c@d.co"}]


def test_csv_latin1_quotes_lines_and_empty(spark, tmp_path):
    path = write(tmp_path, "x.csv", 'name,title\n"José\nNúñez","a ""b"" c"\n'.encode("latin-1"))
    assert cells(readers.read_csv(spark, path)) == [{"name": "José\nNúñez", "title": 'a "b" c'}]
    assert cells(readers.read_csv(spark, write(tmp_path, "e.csv", " \n"))) == []
    with pytest.raises(readers.SourceError):
        readers.read_csv(spark, str(tmp_path / "absent.csv"))


def records(spark, tmp_path, text):
    return readers.read_ats(spark, write(tmp_path, "x.json", text)).orderBy("ord").select(F.to_json("record").alias("j")).collect()


def test_ats_shapes(spark, tmp_path):
    assert len(records(spark, tmp_path, '[{"a":1},2,null,{"b":2}]')) == 2
    assert len(records(spark, tmp_path, '{"x":1,"applicants":[{"a":1}],"data":[{},{}]}')) == 1
    assert len(records(spark, tmp_path, '{"email":null}')) == 1
    assert records(spark, tmp_path, '{"other":1}') == []
    assert records(spark, tmp_path, "{broken") == []
    assert records(spark, tmp_path, "") == []


def test_note_blocks(spark):
    text = "one\t two\r\nx\n---\n\n===\nlast\nCandidate #2:\nmore"
    row = spark.createDataFrame([(text,)], "t string").select(blocks(note_layout(F.col("t"))).alias("b")).first()
    # the first rule takes the blank line after it, so the second has no line end before it and doesn't split
    assert [b.text for b in row.b] == ["one two\nx", "===\nlast", "more"]
    row = spark.createDataFrame([("a\n---\n \nx\n***\n\n\ncandidate 1\n",)], "t string").select(blocks(note_layout(F.col("t"))).alias("b")).first()
    assert [(b.pos, b.text) for b in row.b] == [(0, "a"), (1, "x"), (2, "candidate 1")]


def test_numbers(spark):
    given = ["7", " 8.5 ", "1_000", "-1", "nan", "inf", "8d", "", None, "1e3", "abc", "-0"]
    rows = spark.createDataFrame([(x,) for x in given], "t string").select(number_at_least_zero(F.col("t")).alias("n")).collect()
    assert [r.n for r in rows] == [7.0, 8.5, 1000.0, None, None, float("inf"), None, None, None, 1000.0, None, 0.0]


def test_later_column_of_a_field_wins(spark, tmp_path):
    from kinfold.operators.extract import extract_csv

    path = write(tmp_path, "x.csv", "position,title,role,email\na,b,c,x@y.zz\nd,e,,\n")
    rows = extract_csv(readers.read_csv(spark, path)).orderBy("ord").collect()
    assert [r.title.value for r in rows] == ["c", "e"]
