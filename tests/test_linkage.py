import json
import os
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from kinfold import vocabulary as V
from kinfold.functions import fuzzy
from kinfold.operators import extract, resolve, survivorship
from kinfold.operators.paths import compile_path
from kinfold.plans import linkage, metrics
from kinfold.plans.project import PRESETS, Field, OutputConfig, project
from kinfold.runtime import materialize
from kinfold.sources import readers
from kinfold.sources.readers import ConfigError
from kinfold.sources.writers import pretty_json

HERE = os.path.join(os.path.dirname(__file__), "fixtures")
PATHS = {"csv": f"{HERE}/people.csv", "ats_json": f"{HERE}/people.json", "recruiter_notes": f"{HERE}/notes.txt"}


@pytest.fixture(scope="module")
def records(spark):
    return materialize(linkage.run_raw(spark, **PATHS), "records")


@pytest.fixture(scope="module")
def by_name(records):
    return {r.full_name: r for r in records.collect()}


def test_csv_extraction(spark):
    rows = linkage.read_fragments(spark, {"csv": PATHS["csv"]}).orderBy("fid").collect()
    assert [r.full_name.value for r in rows] == ["Ada Verma", "Boris O'Neil", "Chen Wu", "Dora Lind"]
    assert rows[0].skills.value == ["Python", "Sparkling", "SQL"] and rows[0].skills.confidence == 0.95
    assert rows[2].emails.value == ["chen@mail.example", "CHEN@mail.example"] and rows[2].years_experience is None
    assert rows[3].years_experience is None and rows[0].location.value.text == "Pune, India" and rows[0].trust == 0.95


def test_ats_extraction(spark):
    rows = extract.extract_ats(readers.read_ats(spark, PATHS["ats_json"])).orderBy("ord").collect()
    ada, eve, boris, gil = rows
    assert ada.skills.value == ["python", "AWS Glue", "5"] and ada.years_experience.value == "8.0"
    assert ada.location.value.city == "Pune" and ada.link_linkedin.value == "https://l.example/ada"
    assert [x.key for x in ada.experience.value] == ["orbital labs|engineer|2020-01", "aero|intern|2018-05", "orbital labs|engineer|2020-01"]
    assert [x.item.end_year for x in ada.education.value] == [2018, 2020]
    # an explicit null under a mapped key reads as the text None
    assert eve.full_name.value == "None" and eve.emails.value == ["eve@mail.example"] and eve.phones.value == ["(415) 555-2671"]
    assert eve.current_company.value == "Flux" and eve.title.value == "CTO"
    assert boris.title.value == "Lead Analyst" and gil.current_company.value == '{"name":"Hex"}' and gil.location.value.bad
    loose = extract.extract_ats(readers.read_ats(spark, PATHS["ats_json"]), strict_parity=False).orderBy("ord").collect()
    assert loose[1].full_name is None


def test_notes_extraction(spark):
    ada, hugo = extract.extract_notes(readers.read_notes(spark, PATHS["recruiter_notes"])).orderBy("ord").collect()
    assert ada.full_name.value == "Ada Verma" and ada.full_name.confidence == pytest.approx(0.8 * 0.85)
    assert ada.emails.value == ["ada.verma@mail.example"] and ada.phones.value == ["+91 9876 511111"]
    assert ada.current_company.value == "Orbital Labs" and set(ada.skills.value) == {"Python", "Kafka", "Airflow"}
    assert hugo.full_name.value == "Hugo Stone" and hugo.title.value == "Platform Engineer"
    assert (hugo.location.value.city, hugo.location.value.country) == ("Lisbon", "Portugal") and hugo.phones.confidence == pytest.approx(0.76)


def test_end_to_end_records(by_name):
    # 4 csv rows, 4 applicant records (one of a wrong type, dropped), 2 notes: Ada thrice, Boris twice; Hugo's
    # number is read in Portugal's plan, which isn't known, so it doesn't join Eve's
    assert set(by_name) == {"Ada Verma", "Boris O'Neil", "Chen Wu", "Dora Lind", "None", "Hugo Stone"}
    ada = by_name["Ada Verma"]
    assert ada.emails == ["ada.verma@mail.example"] and ada.phones == ["+919876511111"]
    assert ada.title == "Data Engineer" and ada.years_experience == 7.0 and ada.location.country == "India"
    assert [e.company for e in ada.experience] == ["Orbital Labs", "Aero"] and [e.degree for e in ada.education] == ["MTech", "BTech"]
    skills = {s.name: s for s in ada.skills}
    assert skills["Python"].confidence == pytest.approx(0.95) and skills["Python"].sources == ["ats_json", "csv", "recruiter_notes"]
    assert by_name["Boris O'Neil"].title == "Analyst" and {s.name for s in by_name["Boris O'Neil"].skills} == {"Docker", "Kubernetes"}
    none = by_name["None"]
    assert none.emails == ["eve@mail.example"] and none.phones == ["+14155552671"] and none.location.country == "US"
    assert by_name["Hugo Stone"].phones == [] and by_name["Hugo Stone"].location.country == "PT"


def test_provenance_marks_winners_and_is_ordered(by_name):
    trail = by_name["Ada Verma"].provenance
    names = [p for p in trail if p.field == "full_name"]
    assert [p.source for p in names] == ["csv", "ats_json", "recruiter_notes"]
    assert [p.is_winner for p in names] == [True, False, False]
    assert [p.field for p in trail if not p.field.startswith("skills.")] == sorted((p.field for p in trail if not p.field.startswith("skills.")), key=V.SCALARS.index)
    assert all(p.is_winner for p in trail if p.field.startswith("skills."))
    years = [p.value for p in trail if p.field == "years_experience"]
    assert years == ["7.0", "8.0"]


def people(spark, rows):
    """Fragments of (email, phone, name, company, city)."""
    some = lambda f, v: F.when(v.isNotNull(), F.struct(v.alias("value"), F.lit(0.95).alias("confidence"))).cast(V.FIELDS[f])
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "fid long, email string, phone string, name string, company string, city string")
    place = F.when(F.col("city").isNotNull(), F.struct(F.col("city").alias("city"), F.lit(None).cast("string").alias("region"), F.lit("US").alias("country"), F.lit(None).cast("string").alias("text"), F.lit(False).alias("bad")))
    one = lambda c: F.when(F.col(c).isNotNull(), F.array(c))
    facts = {"emails": one("email"), "phones": one("phone"), "full_name": F.col("name"), "current_company": F.col("company"), "location": place}
    columns = [some(f, facts[f]).alias(f) if f in facts else F.lit(None).cast(k).alias(f) for f, k in V.FIELDS.items()]
    return materialize(df.select("fid", F.lit("csv").alias("source"), F.lit(0.95).alias("trust"), F.lit("direct_field_read").alias("method"), *columns), "people")


ROWS = [
    ("a@x.io", None, "Jon Smith", "Acme", None), ("a@x.io", "1", "Bob Ray", None, None), (None, "1", "Ray Bob", None, None), (None, None, "Jon Smith", "Other", None),
    (None, None, "Jonn Smith", "acme", None), (None, None, "Jonn Smyth", "Zeta", None), (None, None, "J. Smith", None, "Reno"), (None, None, "Ann Lee", "Q", "Reno"),
    (None, None, "Ann Leee", "W", "Reno"), (None, None, "Ann Leen", "W", "Oslo"), (None, None, None, "Acme", None), ("z@x.io", None, None, None, None), (None, None, "Ann Lee", None, None),
    ("h@x.io", None, "Kim Poe", None, None), ("h@x.io", None, "Kim Poe", None, None), ("h@x.io", None, "K Poe", "T", None),
]


def plain_pairs(rows, sources):
    """All pairs, one by one, as matching is described."""
    low = lambda s: s.strip().lower() if s else None
    sort = lambda s: " ".join(sorted(s.split()))
    alike = lambda a, b: bool(a and b) and fuzzy.ratio(sort(a), sort(b)) >= 80

    def initials(a, b):
        x, y = a.replace(".", " ").split(), b.replace(".", " ").split()
        return len(x) == len(y) > 0 and all(p == q or (len(p) == 1 and q.startswith(p)) or (len(q) == 1 and p.startswith(q)) for p, q in zip(x, y))

    out = {}
    for (i, a), (j, b) in combinations(enumerate(rows), 2):
        n, m = low(a[2]), low(b[2])
        if not (i in sources or j in sources) or not n or not m:
            continue
        score = max(fuzzy.ratio(sort(n), sort(m)), 95.0 if initials(n, m) else 0.0)
        place = lambda r: f"{r[4]} us".lower() if r[4] else None
        if score >= 85:
            if alike(low(a[3]), low(b[3])) or alike(place(a), place(b)):
                out[i, j] = score / 100
            elif score >= 95:
                out[i, j] = score / 100 * 0.7
    return out


def groups(labels):
    found = {}
    for x, label in labels.items():
        found.setdefault(label, set()).add(x)
    return sorted(map(sorted, found.values()))


def closure(n, edges):
    label = {i: i for i in range(n)}
    for a, b in edges:
        x, y = label[a], label[b]
        label = {i: min(x, y) if c in (x, y) else c for i, c in label.items()}
    return label


def test_blocking_unmatched_and_fuzzy_pairs(spark):
    fragments = people(spark, ROWS)
    emails = resolve.key_blocks(resolve.key_table(fragments, "emails")).collect()
    assert {(r.key, r.least, r.n) for r in emails} == {("a@x.io", 0, 2), ("h@x.io", 13, 3)}
    exact = resolve.star_edges(resolve.key_table(fragments, "emails")).unionByName(resolve.star_edges(resolve.key_table(fragments, "phones")))
    rest = resolve.unmatched(fragments, exact).select("fid")
    sources = {r.fid for r in rest.collect()}
    assert sources == set(range(3, 13))
    got = {(r.a, r.b): r.confidence for r in resolve.fuzzy_pairs(fragments, rest).collect()}
    want = plain_pairs(ROWS, sources)
    assert got == pytest.approx(want)
    compact = [(r.a, r.b) for r in resolve.fuzzy_edges(fragments, rest).collect()]
    block = [(0, 1), (1, 2), (13, 14), (13, 15)]
    assert groups(closure(len(ROWS), block + compact)) == groups(closure(len(ROWS), block + list(want)))
    clusters = {r.fid: r.cluster for r in resolve.resolve(fragments).collect()}
    assert groups(clusters) == groups(closure(len(ROWS), block + list(want)))
    assert all(c == min(i for i in clusters if clusters[i] == c) for c in clusters.values())


def test_fuzzy_pairs_of_few_profiles_are_written_out_from_blocks(spark, monkeypatch):
    monkeypatch.setattr(resolve, "PAIR_BLOCK", 3)
    rows = [(None, None, ("Person aa", "Person ab", "Person bb", "P aa")[i % 4], ("Acme", None, "Zq")[i % 3], (None, "Oslo", "Reno", None, "Pune")[i % 5]) for i in range(90)]
    fragments = people(spark, rows)
    for step in (1, 2, 7):
        sources = set(range(0, 90, step))
        found = resolve.fuzzy_pairs(fragments, spark.createDataFrame([(i,) for i in sources], "fid long"), digits=6)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan  # names, companies and places are compared before fragments are paired
        got = found.collect()
        assert len({(r.a, r.b) for r in got}) == len(got)
        assert {(r.a, r.b): r.confidence for r in got} == {k: round(v, 6) for k, v in plain_pairs(rows, sources).items()}


def test_normalisers_work_each_value_out_once(spark):
    from kinfold.functions import normalize as N

    numbers = spark.range(1).select(N.phone_list(F.array(F.lit("x")), F.col("id").cast("string")).alias("p"))
    assert numbers._jdf.queryExecution().analyzed().toString().count("regexp_replace(") <= 4
    rows = spark.createDataFrame([(t,) for t in ("Côte d", "kore", "Narnia", "ISLAND", "lan", "guine", "", None, "PRT", "pt", "U.S.", "xyz", "åland")], "t string")
    got = rows.select("t", N._plain(F.col("t")).alias("p"), N.country(F.col("t")).alias("c")).collect()
    told, want = {r.t: (r.c and (r.c.code, r.c.confidence)) for r in got}, {}
    for t, p, _ in got:
        found = [(min(at, 13), a) for a, _, n in N.iso_countries() if len(t or "") > 3 and (at := n.translate(str.maketrans(N._UNMARKED)).find(p)) >= 0]
        want[t] = (min(found)[1], 0.85) if found else None
    want |= {"PRT": ("PT", 1.0), "pt": ("PT", 1.0), "U.S.": ("US", 0.95), "åland": told["åland"]}
    assert told == want


def test_spread_uses_all_cores(spark, tmp_path):
    from kinfold.runtime import spread

    spark.range(10).coalesce(1).write.parquet(str(tmp_path / "t"))
    df = spread(spark.read.parquet(str(tmp_path / "t")))
    assert df.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and sorted(r.id for r in df.collect()) == list(range(10))


def test_name_pairs_lose_nothing(spark):
    import random

    rng = random.Random(9)
    names = {"".join(rng.choice("abc ") for _ in range(rng.randrange(1, 16))).strip() for _ in range(160)} - {""}
    names |= {"a", "ab", "john smith", "smith john", "jon smith", "j smith"}
    names = sorted(" ".join(n.split()) for n in names)
    got = {(r.name_a, r.name_b) for r in resolve.name_pairs(spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    rows = [(None, None, n, None, None) for n in sorted(set(names))]
    sort = lambda s: " ".join(sorted(s.split()))
    want = {(a, b) for a, b in combinations(sorted(set(names)), 2) if fuzzy.ratio(sort(a), sort(b)) >= 85}
    assert want <= got and rows
    for a, b in got - want:
        assert any(len(p) == 1 for p in (a + " " + b).split())


def test_ties_and_bonus(spark):
    rows = [(0, 7, "csv", "b"), (1, 7, "csv", "A"), (2, 7, "recruiter_notes", "c"), (3, 7, "recruiter_notes", "c")]
    claims = spark.createDataFrame(rows, "fid long, cluster long, source string, value string").withColumn("field", F.lit("title")).withColumn("trust", F.when(F.col("source") == "csv", 0.95).otherwise(0.6)).withColumn("score", F.col("trust") * 0.95).withColumn("method", F.lit("m"))
    best = survivorship.winners(claims).collect()
    assert [(r.value, round(r.score, 4)) for r in best] == [("A", 0.9025)]
    assert {(r.value, r.n) for r in survivorship.agreement(claims).collect()} == {("a", 1), ("b", 1), ("c", 2)}


def test_candidate_id_and_confidence(spark):
    import hashlib

    row = spark.range(1).select(
        survivorship.candidate_id(F.array(F.lit("a@b.c")), F.array().cast("array<string>"), F.lit(None).cast("string")).alias("e"),
        survivorship.candidate_id(F.array().cast("array<string>"), F.array().cast("array<string>"), F.lit(" Jo ")).alias("n"),
        survivorship.weighted_confidence({"full_name": F.lit(0.9), "emails": F.lit(0.8), "location": F.lit(None).cast("double")}).alias("c"),
        survivorship.weighted_confidence({"full_name": F.lit(None).cast("double")}).alias("z"),
    ).first()
    assert row.e == hashlib.sha256(b"email:a@b.c").hexdigest()[:16] and row.n == hashlib.sha256(b"name:jo").hexdigest()[:16]
    assert row.c == pytest.approx(0.85) and row.z == 0.0


def test_projection(records, by_name):
    config = OutputConfig.parse({"fields": [{"path": "who", "from": "full_name"}, {"path": "first", "from": "emails[0]"}, {"path": "ninth", "from": "emails[9]", "on_missing": "omit"}, {"path": "names", "from": "skills[].name"}, {"path": "city", "from": "location.city"}, {"path": "head", "from": "headline", "on_missing": "omit"}, {"path": "no", "from": "nothing.here"}, {"path": "src", "from": "skills[].sources[0]", "on_missing": "omit"}], "include_provenance": False})
    out = {r.who: r for r in project(records, config).collect()}
    ada = json.loads(out["Ada Verma"].json)
    assert list(ada) == ["who", "first", "names", "city", "head", "no", "overall_confidence"]
    assert ada["names"] == [s.name for s in by_name["Ada Verma"].skills] and ada["head"] is None and ada["no"] is None
    assert out["Chen Wu"].city == "Lyon"
    strict = OutputConfig.parse({"fields": [{"path": "phones[0]", "required": True, "on_missing": "error"}, {"path": "x", "from": "phones[5]", "on_missing": "error"}]})
    kept = project(records, strict, keep=("full_name",)).collect()
    assert {r.full_name for r in kept} == {n for n, r in by_name.items() if r.phones}
    assert compile_path("", records.schema) is None and compile_path("emails.count", records.schema) is None


def test_presets_and_errors(records, tmp_path):
    for spec in PRESETS.values():
        rows = project(records, OutputConfig.parse(spec), keep=("candidate_id",))
        assert rows.count() == 6 and json.loads(pretty_json(rows))
    for bad in ({"fields": []}, {}, {"fields": [{"path": "a"}], "on_missing": "x"}, {"fields": [{"path": "a", "on_missing": "x"}]}, {"fields": [{}]}):
        with pytest.raises(ConfigError):
            OutputConfig.parse(bad)
    with pytest.raises(ConfigError):
        OutputConfig.load(str(tmp_path / "absent.json"))
    assert OutputConfig((Field("a"),)).on_missing == "null"


def test_missing_source_is_left_out(spark):
    got = linkage.run_raw(spark, csv="/nowhere/x.csv", recruiter_notes=PATHS["recruiter_notes"])
    assert {r.full_name for r in got.collect()} == {"Ada Verma", "Hugo Stone"}
    assert linkage.run_raw(spark, csv="/nowhere/x.csv") is None


def test_metrics(spark):
    fragments = people(spark, ROWS[:3])
    clusters = spark.createDataFrame([(0, 0), (1, 0), (2, 2)], "fid long, cluster long")
    assert metrics.reduction(fragments, clusters).first().asDict() == {"n_sources": 1, "n_fragments": 3, "n_records": 2, "reduction_pct": 33.3333}
    assert metrics.source_coverage(fragments, clusters).first().n_records == 2 and metrics.multi_source(fragments, clusters).first().n_multi == 0
    bands = metrics.confidence_bands(spark.createDataFrame([(0.9,), (0.85,), (0.6,), (0.1,)], "overall_confidence double")).first()
    assert (bands.high, bands.medium, bands.low) == (2, 1, 1)


def test_cli_and_stream(spark, tmp_path, capsys):
    from kinfold import cli
    from kinfold.streaming.ingest import append_fragments, stream_notes

    assert cli.main(["--text", PATHS["recruiter_notes"], "--config", "contacts"]) == 0
    assert {x["who"] for x in json.loads(capsys.readouterr().out)} == {"Ada Verma", "Hugo Stone"}
    assert cli.main(["--text", PATHS["recruiter_notes"], "--config", str(tmp_path / "none.json")]) == 1
    with pytest.raises(SystemExit):
        cli.main([])
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text(open(PATHS["recruiter_notes"]).read())
    append_fragments(stream_notes(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert {r.full_name.value for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"Ada Verma", "Hugo Stone"}
