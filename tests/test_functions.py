import random

import pytest
from pyspark.sql import functions as F

from kinfold.functions import fuzzy
from kinfold.functions import normalize as N


def values(spark, given, f):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i int, t string")
    return [r.v for r in rows.select("i", f(F.col("t")).alias("v")).orderBy("i").collect()]


def test_email(spark):
    assert values(spark, [" A@B.Co ", "a@b", "a b@c.de", None, "x+y_z%1@q-r.s.travel", "a@b.c\n"], N.email) == ["a@b.co", None, None, None, "x+y_z%1@q-r.s.travel", None]


def test_email_list(spark):
    rows = spark.createDataFrame([(["B@x.io", "a@x.io", "b@x.io ", "bad"],), (["bad"],), (None,)], "e array<string>")
    assert [r.v for r in rows.select(N.email_list(F.col("e")).alias("v")).collect()] == [["a@x.io", "b@x.io"], None, None]


@pytest.mark.parametrize(
    "text, region, want",
    [
        ("98765 43210", "IN", "+919876543210"), ("09876543210", "IN", "+919876543210"), ("+91 98765-43210", "US", "+919876543210"), ("(415) 555-2671", "US", "+14155552671"),
        ("+1 415 555 2671", "IN", "+14155552671"), ("+44 (0)20 7946 0958", "IN", "+442079460958"), ("123", "IN", None), ("invalid", "IN", None), ("", "IN", None), (None, "IN", None),
        ("8123 4567", "SG", "+6581234567"), ("415 555 2671", "XX", None), ("0044 20 7946 0958", "IN", "+442079460958"),
        ("+351 912 345 678", "IN", "+351912345678"), ("00 7 495 123-45-67", "IN", "+74951234567"), ("+999 123 456 789", "IN", None), ("+351 12", "IN", None), ("+49 1", "IN", None), ("+351 1234567890123", "IN", None),
    ],
)
def test_phone(spark, text, region, want):
    row = spark.createDataFrame([(text, region)], "t string, r string").select(N.phone(F.col("t"), F.col("r")).alias("v")).first()
    assert row.v == want


def test_country(spark):
    given = ["US", "us", "USA", "ind", "UK", "India", "FRANCE", "Norway", "Freedonia", "", None, "ZZ", "u.s.a."]
    got = [tuple(v) if v else None for v in values(spark, given, N.country)]
    assert got == [("US", 1.0), ("US", 1.0), ("US", 1.0), ("IN", 1.0), ("GB", 0.95), ("IN", 0.95), ("FR", 0.95), ("NO", 0.95), None, None, None, None, ("US", 0.95)]


def test_parts_of_country_names(spark):
    got = [tuple(v) if v else None for v in values(spark, ["Nether", "emirates", "REPUBLIC", "Côte", "ôte d", "land", "xx", "Narnia"], N.country)]
    assert got[:2] == [("NL", 0.85), ("AE", 0.85)] and got[3] == ("CI", 0.85) and got[-2:] == [None, None]
    assert all(v and v[1] == 0.85 for v in got[2:6])


def test_dates(spark):
    given = ["January 2024", "Jan 2024", "1/2024", "2024-03", "2024/12", "03-2024", "2024 Mar", "Jan, 2024", "5.2024", "2024.05", "2024", "1800", "Present", "till date", "", None, "nonsense", "15 March 2021", "2024-01-15"]
    got = [tuple(v) if v else None for v in values(spark, given, N.date)]
    assert got == [("2024-01", 1.0)] * 3 + [("2024-03", 1.0), ("2024-12", 1.0), ("2024-03", 1.0), ("2024-03", 1.0), ("2024-01", 1.0), ("2024-05", 1.0), ("2024-05", 1.0), ("2024", 0.8), None, None, None, None, None, None, ("2021-03", 0.9), ("2024", 0.8)]


def test_skills(spark):
    rows = spark.createDataFrame([(["ML", "machine-learning", "Java", "JavaScript", "scikit-learn", "AWS Glue", "Figma", " ", None],), (None,), ([],)], "s array<string>")
    got = [r.v and {x.name: (round(x.confidence, 2), x.raw) for x in r.v} for r in rows.select(N.SkillDictionary().normalize(F.col("s")).alias("v")).collect()]
    assert got[1:] == [None, None]
    assert got[0]["Java"] == (1.0, "Java") and got[0]["JavaScript"] == (1.0, "JavaScript") and got[0]["Machine Learning"] == (1.0, "ML")
    assert got[0]["scikit-learn"][0] == 1.0 and got[0]["AWS"] == (0.9, "AWS Glue") and got[0]["Figma"] == (0.5, "Figma")
    own = N.SkillDictionary({"Foo": "Bar"})
    row = rows.limit(1).select(own.normalize(F.array(F.lit("foo"))).alias("v")).first()
    assert [x.name for x in row.v] == ["Bar"]


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_ratios_agree(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcé ") for _ in range(rng.randrange(1, 14))).strip() or "a"
    pairs = [(word(), word()) for _ in range(200)]
    assert all(fuzzy.lcs_length(a, b) == slow_lcs(a, b) for a, b in pairs)
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", fuzzy.token_sort_ratio(F.col("a"), F.col("b")).alias("x"), fuzzy.token_sort_udf("a", "b").alias("y")).collect()
    for r in rows:
        a, b = (" ".join(sorted(s.split())) for s in (r.a, r.b))
        assert r.x == pytest.approx(200 * slow_lcs(a, b) / (len(a) + len(b))) == r.y


def test_weighted_ratio_known_values():
    assert fuzzy.weighted_ratio("Python", "Python") == 100
    assert fuzzy.partial_ratio("AWS", "AWS Glue") == 100
    assert fuzzy.weighted_ratio("AWS Glue", "AWS") == pytest.approx(90)
    assert fuzzy.ratio("Pythn", "Python") == pytest.approx(2 * 5 / 11 * 100)
    assert fuzzy.token_set_ratio("a b c", "c b") == 100


def test_initials(spark):
    pairs = [("j. smith", "john smith", True), ("j smith", "jane smyth", False), ("john smith", "smith john", False), ("j. r. r. t", "john r ron tolk", True), ("john", "john smith", False)]
    rows = spark.createDataFrame(pairs, "a string, b string, w boolean")
    assert all(r.v == r.w for r in rows.select(fuzzy.initials_match(F.col("a"), F.col("b")).alias("v"), "w").collect())
