"""Registered queries of the parts that work on files, raw fields and odd values, with their DuckDB twins.

Sources are written from the given tables to the shared folder first and read from there, as a user's files are.
"""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold import vocabulary as V
from kinfold.functions import normalize as N
from kinfold.operators import extract, resolve, survivorship
from kinfold.plans import linkage
from kinfold.plans.project import OutputConfig, project
from kinfold.plans.queries import _PHONES_SQL, MEMBERS_SQL, PEOPLE_SQL, members, named_apart, query, table
from kinfold.runtime import folder, materialize, spread
from kinfold.sources import readers, writers

def nothing() -> Column:
    return F.lit(None).cast("string")


def fragment_rows(df: DataFrame, source: str, facts: dict[str, Column], kinds: dict[str, str] = V.FIELDS, conf: float = 0.8) -> DataFrame:
    """df's columns cluster and fid as fragments of one source with the given values."""
    said = lambda f: F.when(facts[f].isNotNull(), F.struct(facts[f].alias("value"), F.lit(conf).alias("confidence"))).cast(kinds[f])
    keys = [F.lit(source).alias("source"), F.lit(V.SOURCE_TRUST[source]).alias("trust"), F.lit(V.SOURCE_METHOD[source]).alias("method")]
    kept = [c for c in ("cluster", "fid") if c in df.columns]
    return df.select(*kept, *keys, *[(said(f) if f in facts else F.lit(None).cast(kind)).alias(f) for f, kind in kinds.items()])


def one_of(key: Column, *choices: str | None) -> Column:
    return F.get(F.array(*[F.lit(x) for x in choices]), (key % len(choices)).cast("int"))


# --- sources and sinks ----------------------------------------------------------------------------------------------


@query(r"""
    SELECT c_name || ' é' AS name, CASE WHEN c_custkey % 5 > 0 THEN c_mktsegment END AS company, CASE WHEN c_custkey % 3 = 0 THEN c_name || chr(10) || 'b;"c"' END AS summary
    FROM customer""")
def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delimiter and encoding found, headers and cells cleaned, blank and repeated rows dropped, quoted line breaks kept."""
    k, path = F.col("c_custkey"), f"{folder(spark)}/people.csv"
    rows = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("  "), "c_name", F.lit(" é ")).alias(" Name "), F.when(k % 5 > 0, F.col("c_mktsegment")).otherwise("   ").alias("COMPANY"),
        F.when(k % 3 == 0, F.concat("c_name", F.lit('\nb;"c"'))).alias("Summary"), F.lit("surplus").alias(" "),
    )
    blank = spark.createDataFrame([(" ", "", None, " ")], rows.schema)
    rows.unionByName(blank).unionByName(rows).write.option("sep", ";").option("header", True).option("encoding", "ISO-8859-1").option("escape", '"').option("quoteAll", True).csv(path)
    cell = lambda name: F.try_element_at("cells", F.lit(name)).alias(name)
    return readers.READERS["csv"](spark, path).select(cell("name"), cell("company"), cell("summary"))


@query("""
    SELECT s_nationkey AS file, s_name AS full_name FROM supplier WHERE s_nationkey % 4 < 2
    UNION ALL SELECT s_nationkey, min(s_name) FROM supplier WHERE s_nationkey % 4 = 2 GROUP BY 1""")
def ats_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON file a nation: arrays, lists under a known key, single records and text that isn't JSON."""
    path, k = f"{folder(spark)}/ats", F.col("s_nationkey")
    listed = F.concat(F.lit("["), F.array_join(F.collect_list(F.to_json(F.struct(F.col("s_name").alias("candidate_name")))), ",\n"), F.lit(',3,null,"x"]'))
    one = F.to_json(F.struct(F.min("s_name").alias("applicant_name")))
    docs = table(spark, sf_dir, "supplier").groupBy(k.alias("file")).agg(listed.alias("listed"), one.alias("one"))
    k = F.col("file")
    text = F.when(k % 4 == 0, F.col("listed")).when(k % 4 == 1, F.concat(F.lit('{"page":1,"results":[],"applicants":'), "listed", F.lit("}"))).when(k % 4 == 2, F.col("one")).otherwise(F.concat("listed", F.lit("]")))
    docs.select("file", text.alias("value")).repartition("file").write.partitionBy("file").option("lineSep", " ").text(path)
    found = extract.EXTRACTORS["ats_json"](readers.READERS["ats_json"](spark, path))
    return found.select(F.regexp_extract("ord.path", r"file=(\d+)", 1).cast("int").alias("file"), F.col("full_name.value").alias("full_name"))


@query("""
    WITH s AS (SELECT n_nationkey, n_regionkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i FROM nation)
    SELECT n_regionkey AS file, CAST(i + 1 AS INTEGER) AS block, 'Spoke with ' || n_name || ' é' || chr(10) || 'two words' AS text FROM s""")
def notes_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A note file a region; blank blocks count in the numbering and are dropped."""
    path = f"{folder(spark)}/notes"
    note = F.concat(F.lit("Spoke  with\t"), "n_name", F.lit(" é\r\ntwo   words"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", note.alias("t")))), lambda x: x["t"]), "\nCandidate 7:\n")
    files = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("file")).agg(F.concat(F.lit("\n---\n"), whole).alias("value"))
    files.repartition("file").write.partitionBy("file").text(path)
    found = readers.READERS["recruiter_notes"](spark, path)
    return found.select(F.regexp_extract("source_file", r"file=(\d+)", 1).cast("int").alias("file"), F.col("block_index").alias("block"), F.col("raw_text").alias("text"))


@query("""
    SELECT 'csv' AS source, CAST(n_nationkey AS BIGINT) AS fid, n_name AS full_name FROM nation
    UNION ALL SELECT 'recruiter_notes', 1099511627776 + r_regionkey, 'Ada ' || upper(r_name[1]) || lower(r_name[2:3]) FROM region""")
def ingest_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources in their order, numbered; a broken one is left out and fragments without any field are dropped."""
    path = folder(spark)
    rows = table(spark, sf_dir, "nation").orderBy("n_nationkey").select(F.col("n_name").alias("name"), F.lit("x").alias("unknown"))
    rows.coalesce(1).write.option("header", True).csv(f"{path}/csv")
    who = F.concat(F.upper(F.substring("r_name", 1, 1)), F.lower(F.substring("r_name", 2, 2)))
    note = F.concat(F.lit("name: Ada "), who, F.lit("\n---\nnothing here\n---"))
    table(spark, sf_dir, "region").orderBy("r_regionkey").select(note.alias("value")).coalesce(1).write.text(f"{path}/notes")
    spark.range(1).select(F.lit("no gzip").alias("value")).coalesce(1).write.text(f"{path}/broken")
    jpath = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/broken")
    fs = jpath.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    part = next(f for f in (x.getPath() for x in fs.listStatus(jpath)) if f.getName().startswith("part"))
    fs.rename(part, spark._jvm.org.apache.hadoop.fs.Path(f"{path}/broken.json.gz"))
    found = linkage.read_fragments(spark, {"csv": f"{path}/csv", "ats_json": f"{path}/absent.json", "recruiter_notes": f"{path}/notes"})
    return found.select("source", "fid", F.col("full_name.value").alias("full_name"))


@query("""
    SELECT cluster, '{"id":"' || id || '","n":' || n || '}' AS json FROM (SELECT c_nationkey AS cluster, min(c_name) AS id, count(*) AS n FROM customer GROUP BY 1)""")
def json_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines written and read back."""
    path = f"{folder(spark)}/out"
    rows = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("cluster")).agg(F.min("c_name").alias("id"), F.count("*").alias("n"))
    writers.write_json_lines(rows.select(F.to_json(F.struct("cluster", F.struct("id", "n").alias("json"))).alias("json")), path)
    v = F.parse_json("value")
    return spark.read.text(path).select(F.variant_get(v, "$.cluster", "int").alias("cluster"), F.to_json(F.variant_get(v, "$.json", "variant")).alias("json"))


# --- extraction -----------------------------------------------------------------------------------------------------


@query("""
    SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN 'a' || s_suppkey || ',b' WHEN 1 THEN 'a' || s_suppkey || ',c' WHEN 2 THEN CAST(s_suppkey AS VARCHAR) END AS phones,
           CASE s_suppkey % 4 WHEN 0 THEN CAST(s_suppkey AS VARCHAR) WHEN 1 THEN 'True' WHEN 2 THEN s_name WHEN 3 THEN 'None' END AS title,
           CASE s_suppkey % 3 WHEN 0 THEN 7.0 WHEN 1 THEN 8.5 END AS years, 'Pune' AS city, 'L' || s_suppkey AS linkedin FROM supplier""")
def ats_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of every JSON type: text is stripped and spelled out, lists lose nulls, numbers are parsed, places assembled."""
    k = F.col("s_suppkey")
    s = k.cast("string")
    phones = F.when(k % 4 == 0, F.concat(F.lit('["a'), s, F.lit('",null,"b"]'))).when(k % 4 == 1, F.concat(F.lit('" a'), s, F.lit(', c ,"'))).when(k % 4 == 2, s).otherwise(F.lit('"  "'))
    title = F.when(k % 4 == 0, s).when(k % 4 == 1, F.lit("true")).when(k % 4 == 2, F.concat(F.lit('" '), "s_name", F.lit(' "'))).otherwise(F.lit("null"))
    years = F.when(k % 3 == 0, F.lit('"7"')).when(k % 3 == 1, F.lit("8.5")).otherwise(F.lit("-1"))
    text = F.concat(F.lit('{"phone_number":'), phones, F.lit(',"job_title":'), title, F.lit(',"total_experience":'), years, F.lit(',"city":" Pune ","linkedin":{"url":"L'), s, F.lit('"}}'))
    rows = table(spark, sf_dir, "supplier").select(F.struct(k.alias("k")).alias("ord"), F.parse_json(text).alias("record"))
    value = lambda f: F.col(f"{f}.value")
    return extract.extract_ats(rows).select(F.col("ord.k").alias("id"), F.array_join(value("phones"), ",").alias("phones"), value("title").alias("title"), value("years_experience").cast("double").alias("years"), F.col("location.value.city").alias("city"), value("link_linkedin").alias("linkedin"))


@query("""
    SELECT s_suppkey AS id, ['Flux/Dev/2019', 'Hex/' || s_name || '/'] AS experience, ['Uni/BSc/CS/' || (2000 + s_suppkey % 20), 'School//Art/'] AS education FROM supplier""")
def ats_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Experience and education lists: objects only, numbers in text parsed, two names of the field of study."""
    k = F.col("s_suppkey")
    job = F.concat(F.lit('[{"company":"Flux","title":"Dev","start":"2019"},3,{"company":"Hex","title":"'), "s_name", F.lit('"}]'))
    study = F.concat(F.lit('[{"institution":"Uni","degree":"BSc","field":"CS","end_year":"'), (2000 + k % 20).cast("string"), F.lit('"},{"institution":"School","field_of_study":"Art","end_year":"x"}]'))
    text = F.concat(F.lit('{"work_history":'), job, F.lit(',"education":'), study, F.lit("}"))
    rows = table(spark, sf_dir, "supplier").select(F.struct(k.alias("k")).alias("ord"), F.parse_json(text).alias("record"))
    some = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    line = lambda f, names: F.transform(f"{f}.value", lambda e: F.concat_ws("/", *[some(e["item"][n]) for n in names])).alias(f)
    return extract.extract_ats(rows).select(F.col("ord.k").alias("id"), line("experience", ("company", "title", "start")), line("education", ("institution", "degree", "field_of_study", "end_year")))


#: Notes for every pattern of every field: text, name, company, title, city, region, country, skills.
NOTES = (
    ("Candidate: ada byron lane, met. Employer: Orbital & Sons, big. Title: Staff Engineer\nLocation: Pune, MH, India; yes", "ada byron lane", "Orbital & Sons", "Staff Engineer", "Pune", "MH", "India", None),
    ("Interviewed Ada Byron. Working at Tidal for years. Working as an Analyst on loan. based out of Oslo, Norway.", "Ada Byron", "Tidal", "Analyst", "Oslo", None, "Norway", None),
    ("Chat w Grace h today\nZenith background check\nBackend systems profile", "Grace h", "Zenith", "Backend systems", None, None, None, None),
    ("Linus reached out\nJoined from Infosys last\nPerth based\nskills: Go, rust; C and SQL\n", "Linus", "Infosys", None, "Perth", None, None, "C,Go,SQL,rust"),
    ("Tech stack - Scala; Kafka really deep. In Mumbai", None, None, None, "Mumbai", None, None, "Kafka,Scala"),
    ("Name: Ada 4ever\nSpoke to Mary Shelley\nOnly Rust, Elm...\n", "Mary Shelley", None, None, None, None, None, "Elm"),
)
_NOTE_VALUES = ", ".join("(" + str(i) + ", " + ", ".join("NULL" if x is None else "'" + x.replace("'", "''") + "'" for x in row[1:]) + ")" for i, row in enumerate(NOTES))


@query(f"""
    WITH n(i, full_name, company, title, city, region, country, skills) AS (VALUES {_NOTE_VALUES})
    SELECT c_custkey AS id, full_name, company, title, city, region, country, skills FROM customer JOIN n ON i = c_custkey % {len(NOTES)}""")
def note_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.struct(F.col("c_custkey").alias("id")).alias("ord"), one_of(F.col("c_custkey"), *[n[0] for n in NOTES]).alias("raw_text"))
    value = lambda f, name: F.col(f"{f}.value").alias(name)
    place = [F.col(f"location.value.{p}").alias(p) for p in V.LOCATION_PARTS]
    return extract.extract_notes(rows).select("ord.id", value("full_name", "full_name"), value("current_company", "company"), value("title", "title"), *place, F.array_join(F.array_sort("skills.value"), ",").alias("skills"))


@query(f"""
    WITH d AS (SELECT doc_id, text FROM documents WHERE regexp_matches(text, '[0-9]{{7}}|@')),
    p AS (SELECT doc_id, list_distinct(list_filter(list_concat({", ".join(f"[trim(x) FOR x IN regexp_extract_all(text, '{p}')]" for p in _PHONES_SQL)}), lambda x: x <> '')) AS phones,
                 list_distinct(regexp_extract_all(text, '\\b[a-zA-Z0-9._%+\\-]+@[a-zA-Z0-9.\\-]+\\.[a-zA-Z]{{2,}}\\b')) AS emails FROM d)
    SELECT doc_id, len(phones) AS n_phones, len(emails) AS n_emails FROM p WHERE len(phones) + len(emails) > 0""")
def note_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments of whole documents as notes, with the number of contacts in each."""
    docs = table(spark, sf_dir, "documents").filter(F.col("text").rlike("[0-9]{7}|@")).select(F.struct("doc_id").alias("ord"), F.col("text").alias("raw_text"))
    n = lambda f: F.coalesce(F.size(f"{f}.value"), F.lit(0)).cast("long")
    return extract.extract_notes(docs).select("ord.doc_id", n("phones").alias("n_phones"), n("emails").alias("n_emails")).filter("n_phones + n_emails > 0")


# --- normalisers ----------------------------------------------------------------------------------------------------


@query("""
    SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'a@b.co,z' || c_custkey || '@b.co' END AS emails,
           CASE c_custkey % 4 WHEN 0 THEN '+442079460' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') WHEN 1 THEN '+9198765' || lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0') WHEN 2 THEN '+14155550123' END AS phones,
           CASE c_custkey % 4 WHEN 0 THEN 'GB' WHEN 2 THEN 'US' END AS country, CAST(CASE c_custkey % 4 WHEN 0 THEN 0.76 WHEN 2 THEN 0.8 END AS DOUBLE) AS country_confidence,
           CASE WHEN c_custkey % 3 > 0 THEN c_name END AS full_name, CASE WHEN c_custkey % 3 = 1 AND c_custkey % 5 > 1 THEN 'Pune, India' END AS place, CASE c_custkey % 5 WHEN 0 THEN 'DE' WHEN 1 THEN 'Narnia' END AS inner_country,
           'AWS:1.0:aws|Python:1.0:py|Zq' || (c_custkey % 3) || ':0.5:Zq' || (c_custkey % 3) AS skills
    FROM customer""")
def normalize_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field of a fragment; the country places its numbers, what fails is absent."""
    k = F.col("c_custkey")
    s, pad = k.cast("string"), lambda n: F.lpad((k % 10**n).cast("string"), n, "0")
    number = F.when(k % 4 == 0, F.concat(F.lit("020 7946 0"), pad(3))).when(k % 4 == 1, F.concat(F.lit("098765 "), pad(5))).when(k % 4 == 2, F.lit("(415) 555-0123")).otherwise(F.lit("12"))
    place = F.when(k % 5 < 2, F.struct(F.lit("X").alias("city"), nothing().alias("region"), F.when(k % 5 == 0, "Germany").otherwise("Narnia").alias("country"), nothing().alias("text"), F.lit(False).alias("bad")))
    place = F.coalesce(place, F.when(k % 3 == 1, F.struct(nothing().alias("city"), nothing().alias("region"), nothing().alias("country"), F.lit(" Pune, India ").alias("text"), F.lit(False).alias("bad"))))
    facts = {
        "full_name": F.when(k % 3 > 0, F.concat(F.lit("  "), "c_name")).otherwise("   "), "emails": F.when(k % 2 == 0, F.array(F.concat(F.lit("Z"), s, F.lit("@B.co")), F.lit("a@b.co "), F.lit("A@b.co"))).otherwise(F.array(F.lit("bad"))),
        "phones": F.array(number, number), "location_country": one_of(k, "UK", "Narnia", "us", None), "location": place,
        "skills": F.array(F.concat(F.lit("Zq"), (k % 3).cast("string")), F.lit("py"), F.lit(" aws "), F.lit("Python")),
    }
    raw = fragment_rows(spread(table(spark, sf_dir, "customer")).withColumn("fid", k.cast("long")), "csv", facts, V.RAW_FIELDS)
    done = linkage.normalize(raw)
    value = lambda f: F.col(f"{f}.value")
    text = F.array_join(F.transform(value("skills"), lambda x: F.concat_ws(":", x["name"], x["confidence"].cast("string"), x["raw"])), "|")
    return done.select(F.col("fid").cast("int").alias("id"), F.array_join(value("emails"), ",").alias("emails"), F.array_join(value("phones"), ",").alias("phones"), value("location_country").alias("country"), F.round("location_country.confidence", 6).alias("country_confidence"), value("full_name").alias("full_name"), F.col("location.value.text").alias("place"), F.col("location.value.country").alias("inner_country"), text.alias("skills"))


#: (text, code, confidence) of countries by part of a name, and (text, E.164) of numbers of plans checked by length.
NEAR_COUNTRIES = (("Nether", "NL", 0.85), ("emirates", "AE", 0.85), ("Narnia", None, None), ("norw", "NO", 0.85), ("NOR", "NO", 1.0))
FAR_PHONES = (("+351 912 345 678", "+351912345678"), ("00 47 21 02 33 44", "+4721023344"), ("+999 123 456 789", None), ("+64 3", None), ("912 345 678 9", None))
_sql = lambda x: "NULL" if x is None else repr(x)


@query(f"""
    WITH c(i, code, confidence) AS (VALUES {", ".join(f"({i}, {_sql(c)}, {_sql(s)})" for i, (_, c, s) in enumerate(NEAR_COUNTRIES))}), p(j, phone) AS (VALUES {", ".join(f"({i}, {_sql(x)})" for i, (_, x) in enumerate(FAR_PHONES))})
    SELECT s_suppkey AS id, code, CAST(confidence AS DOUBLE) AS confidence, phone FROM supplier JOIN c ON i = s_suppkey % {len(NEAR_COUNTRIES)} JOIN p ON j = s_suppkey % {len(FAR_PHONES)}""")
def normalize_abroad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Countries by part of their name, and numbers of regions without a plan of their own."""
    k = F.col("s_suppkey")
    raw = [one_of(k, *[x[0] for x in given]) for given in (NEAR_COUNTRIES, FAR_PHONES)]
    return table(spark, sf_dir, "supplier").select(k.alias("id"), N.country(raw[0]).alias("c"), N.phone(raw[1], F.lit("PT")).alias("phone")).select("id", "c.code", "c.confidence", "phone")


#: (text, date, confidence) of dates that no fixed form fits, and of those that count as none.
LOOSE_DATES = (("around March 2019 or so", "2019-03", 0.9), ("since 12 Sep 2020", "2020-09", 0.9), ("2018, I think", "2018", 0.8), ("Present", None, None), ("till date", None, None), ("some day", None, None), ("5/2017", "2017-05", 1.0), ("1850", None, None))
_DATE_VALUES = ", ".join(f"({i}, {'NULL' if d is None else repr(d)}, {'NULL' if c is None else c})" for i, (_, d, c) in enumerate(LOOSE_DATES))


@query(f"WITH d(i, date, confidence) AS (VALUES {_DATE_VALUES}) SELECT o_orderkey AS id, date, CAST(confidence AS DOUBLE) AS confidence FROM orders JOIN d ON i = o_orderkey % {len(LOOSE_DATES)}")
def normalize_loose_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("id"), N.date(one_of(k, *[x for x, _, _ in LOOSE_DATES])).alias("d")).select("id", "d.date", "d.confidence")


#: (text, name, confidence): by alias, by a near name, unknown.
NEAR_SKILLS = (("Pythonn", "Python", 12 / 13), ("AWS Glue", "AWS", 0.9), ("Kuberntes", "Kubernetes", 18 / 19), ("qqqqq", "qqqqq", 0.5), ("golang", "Go", 1.0), ("Dockre", "Dockre", 0.5))


@query(f"WITH s(i, name, confidence) AS (VALUES {', '.join(f'({i}, {n!r}, {c})' for i, (_, n, c) in enumerate(NEAR_SKILLS))}) SELECT p_partkey AS id, name, round(CAST(confidence AS DOUBLE), 6) AS confidence FROM part JOIN s ON i = p_partkey % {len(NEAR_SKILLS)}")
def skill_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    skills = N.SkillDictionary().normalize(F.array(one_of(F.col("p_partkey"), *[t for t, _, _ in NEAR_SKILLS]), F.lit(" ")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.explode(skills).alias("s")).select("id", "s.name", F.round("s.confidence", 6).alias("confidence"))


@query("SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'Welding' WHEN 1 THEN 'Turning' END AS name FROM part")
def skill_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary from a file replaces the built-in one; a file that can't be read leaves it in force."""
    with tempfile.NamedTemporaryFile("w", suffix=".json", delete=False) as file:  # read by the driver only
        json.dump({" Arc Weld ": "Welding", "lathe": "Turning"}, file)
    skills = N.SkillDictionary(path=file.name)
    os.unlink(file.name)
    assert N.SkillDictionary(path=file.name).aliases == N.SkillDictionary().aliases
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), skills.exact(one_of(F.col("p_partkey"), "ARC-weld", "Lathe", "python")).alias("name"))


# --- matching -------------------------------------------------------------------------------------------------------


@query("""
    WITH n AS (SELECT s_suppkey AS fid, 'person ' || chr(CAST(97 + s_suppkey % 7 AS INTEGER)) || chr(CAST(97 + s_suppkey % 11 AS INTEGER)) AS name, repeat(chr(CAST(97 + s_suppkey % 3 AS INTEGER)), 4) AS company,
                      repeat(chr(CAST(104 + s_suppkey % 4 AS INTEGER)), 4) AS city FROM supplier),
    p AS (SELECT a.fid AS a, b.fid AS b, a.company = b.company OR a.city = b.city AS near, array_to_string(list_sort(string_split(a.name, ' ')), ' ') AS x, array_to_string(list_sort(string_split(b.name, ' ')), ' ') AS y FROM n a JOIN n b ON a.fid < b.fid),
    d AS (SELECT DISTINCT x, y FROM p),
    l AS (SELECT *, list_reduce(string_split(x, ''), lambda row, ch: list_reduce(range(1, length(y) + 1), lambda done, j: list_append(done, CASE WHEN substr(y, j, 1) = ch THEN row[j] + 1 ELSE greatest(row[j + 1], done[-1]) END), [CAST(0 AS BIGINT)]), [CAST(0 AS BIGINT) FOR i IN range(0, length(y) + 1)]) AS t FROM d),
    s AS (SELECT x, y, 200.0 * t[-1] / (length(x) + length(y)) AS score FROM l)
    SELECT a, b, round(CASE WHEN near THEN score / 100 ELSE score / 100 * 0.7 END, 6) AS confidence FROM p JOIN s USING (x, y) WHERE score >= 95 OR score >= 85 AND near""")
def fuzzy_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names alike count where the company or the place is alike too; sure names count anyway, at a discount."""
    k = F.col("s_suppkey")
    city = F.repeat(F.char(104 + k % 4), 4)
    facts = {
        "full_name": F.concat(F.lit("Person "), F.char(97 + k % 7), F.char(97 + k % 11)), "current_company": F.upper(F.repeat(F.char(97 + k % 3), 4)),
        "location": F.struct(city.alias("city"), nothing().alias("region"), F.lit("US").alias("country"), nothing().alias("text"), F.lit(False).alias("bad")),
    }
    rows = materialize(fragment_rows(table(spark, sf_dir, "supplier").withColumn("fid", k), "ats_json", facts), "fragments")
    return resolve.fuzzy_pairs(rows, rows.select("fid"), digits=6)


#: Exact keys, then equal names of the fragments without one: the made-up names are far apart otherwise.
RESOLVED_SQL = f"""
{PEOPLE_SQL},
named AS (SELECT * REPLACE (substr(md5(CAST(fid % 1301 AS VARCHAR)), 1, 7) || ' ' || substr(md5(CAST(fid % 1301 AS VARCHAR)), 9, 9) AS full_name) FROM people),
keys AS (SELECT fid, 'e' || lower(email) AS k FROM named UNION ALL SELECT fid, 'p' || phone FROM named),
edges AS (SELECT a.fid AS a, b.least AS b FROM keys a JOIN (SELECT k, min(fid) AS least FROM keys GROUP BY k HAVING count(*) > 1) b USING (k)),
rest AS (SELECT fid, full_name FROM named WHERE fid NOT IN (SELECT a FROM edges)),
every AS (SELECT a, b FROM edges UNION SELECT r.fid, n.fid FROM rest r JOIN named n USING (full_name)),
links AS (SELECT a, b FROM every UNION SELECT b, a FROM every),
reach AS (SELECT a AS fid, a AS other FROM links UNION SELECT r.fid, l.b FROM reach r JOIN links l ON l.a = r.other),
clusters AS (SELECT p.fid, coalesce(min(r.other), p.fid) AS cluster FROM named p LEFT JOIN reach r ON r.fid = p.fid GROUP BY p.fid)"""


@query(f"WITH RECURSIVE {RESOLVED_SQL} SELECT fid, cluster FROM clusters")
def resolve_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks, fuzzy names of the unmatched and components together."""
    return resolve.resolve(materialize(named_apart(spark, sf_dir), "fragments"))


@query(f"""
    WITH RECURSIVE {RESOLVED_SQL},
    m AS (SELECT named.*, cluster, trust * conf AS score FROM named JOIN clusters USING (fid)),
    best AS (SELECT cluster, full_name, max(score) OVER w AS s, max(trust) OVER w AS k FROM m WINDOW w AS (PARTITION BY cluster) QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY score DESC, trust DESC, lower(full_name), fid) = 1),
    u AS (SELECT cluster, list_sort(list_distinct(list(lower(email)))) AS emails, list_sort(list_distinct(list(phone))) AS phones, count(DISTINCT t) + 1 AS n_skills, 6 * count(*) AS n_claims FROM m GROUP BY cluster)
    SELECT substr(sha256('email:' || emails[1]), 1, 16) AS candidate_id, full_name, emails, phones, CAST(n_skills AS INTEGER) AS n_skills, CAST(n_claims AS INTEGER) AS n_claims, round((s * 13.5 + k * 2) / 15.5, 6) AS overall_confidence FROM u JOIN best USING (cluster)""")
def canonical_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolved, merged and projected people with their audit trail."""
    records = linkage.link(named_apart(spark, sf_dir).select(*V.FRAGMENT_KEYS, *V.FIELDS))
    return records.select("candidate_id", "full_name", "emails", "phones", F.size("skills").alias("n_skills"), F.size("provenance").alias("n_claims"), F.round("overall_confidence", 6).alias("overall_confidence"))


# --- survivorship ---------------------------------------------------------------------------------------------------


@query(f"""
    WITH {MEMBERS_SQL}, s AS (SELECT cluster, fid, source, method, 'Skill ' || CAST(t AS VARCHAR) AS value, trust * 1.0 AS c FROM m UNION ALL SELECT cluster, fid, source, method, 'Common', trust * 0.5 FROM m)
    SELECT cluster, 'skills.' || value AS field, source, method, value, round(c, 6) AS confidence, true AS is_winner FROM s""")
def skill_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    group = members(spark, sf_dir)
    trail = survivorship.provenance(group, survivorship.winners(survivorship.scalar_claims(group))).filter("entry.field LIKE 'skills.%'")
    return trail.select("cluster", "entry.*").withColumn("confidence", F.round("confidence", 6))


@query("""
    WITH c AS (SELECT c_nationkey AS cluster, c_custkey, 'https://l/' || c_custkey AS linkedin, CASE WHEN c_custkey % 3 > 0 THEN 'https://g/' || c_custkey END AS github, CASE WHEN c_custkey % 4 = 0 THEN 'City ' || c_custkey END AS city, c_custkey % 40 AS y FROM customer)
    SELECT cluster, arg_min(linkedin, c_custkey) AS linkedin, arg_min(github, c_custkey) FILTER (github IS NOT NULL) AS github, arg_min(city, c_custkey) FILTER (city IS NOT NULL) AS city,
           CAST(arg_min(y, CAST(y AS VARCHAR) || '.0') AS DOUBLE) AS years,
           round(CASE WHEN count(city) > 0 THEN (0.95 * 0.8 + 0.5) / 2 ELSE 0.95 * 0.8 END, 6) AS overall_confidence FROM c GROUP BY cluster""")
def links_and_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best of each link and part of a place; a place known by parts only counts half; years become a number."""
    k = F.col("c_custkey")
    url = lambda x: F.concat(F.lit(f"https://{x}/"), k.cast("string"))
    facts = {"link_linkedin": url("l"), "link_github": F.when(k % 3 > 0, url("g")), "location_city": F.when(k % 4 == 0, F.concat(F.lit("City "), k.cast("string"))), "years_experience": F.concat((k % 40).cast("string"), F.lit(".0"))}
    rows = fragment_rows(table(spark, sf_dir, "customer").select(k, F.col("c_nationkey").alias("cluster"), k.alias("fid")), "csv", facts)
    merged = survivorship.merge(rows, with_provenance=False)
    return merged.select("cluster", "links.linkedin", "links.github", "location.city", F.col("years_experience").alias("years"), F.round("overall_confidence", 6).alias("overall_confidence"))


@query("""
    WITH o AS (SELECT o_custkey AS cluster, o_orderkey AS fid, o_orderpriority AS school, o_orderstatus AS degree, CASE WHEN o_orderkey % 5 > 0 THEN CAST(year(o_orderdate) AS INTEGER) END AS y FROM orders),
    f AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY cluster, lower(school || '|' || degree) ORDER BY fid) = 1)
    SELECT cluster, list(school || '/' || degree || '/' || coalesce(CAST(y AS VARCHAR), '') ORDER BY coalesce(y, 0) DESC, school DESC, fid) AS education FROM f GROUP BY cluster""")
def education_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    item = F.struct(F.col("o_orderpriority").alias("institution"), F.col("o_orderstatus").alias("degree"), nothing().alias("field_of_study"), F.when(k % 5 > 0, F.year("o_orderdate")).alias("end_year"))
    entry = F.array(F.struct(F.lower(F.concat_ws("|", "o_orderpriority", "o_orderstatus")).alias("key"), item.alias("item"), F.lit(False).alias("bad")))
    rows = fragment_rows(table(spark, sf_dir, "orders").withColumns({"fid": k, "cluster": F.col("o_custkey")}), "ats_json", {"education": entry})
    some = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return survivorship.merge(rows, with_provenance=False).select("cluster", F.transform("education", lambda e: F.concat_ws("/", e["institution"], e["degree"], some(e["end_year"]))).alias("education"))


@query("""
    SELECT c_custkey AS cluster, substr(sha256(CASE c_custkey % 4 WHEN 0 THEN 'email:a' || c_custkey || '@b.co' WHEN 1 THEN 'phone:+91' || c_custkey WHEN 2 THEN 'name:' || lower(c_name) ELSE 'unknown' END), 1, 16) AS candidate_id FROM customer""")
def candidate_id_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The id comes from the first address, else number, else name."""
    k = F.col("c_custkey")
    s = k.cast("string")
    facts = {"emails": F.when(k % 4 == 0, F.array(F.concat(F.lit("a"), s, F.lit("@b.co")))), "phones": F.when(k % 4 < 2, F.array(F.concat(F.lit("+91"), s))), "full_name": F.when(k % 4 < 3, F.col("c_name")), "title": F.lit("x")}
    rows = fragment_rows(table(spark, sf_dir, "customer").withColumns({"fid": k, "cluster": k}), "csv", facts)
    return survivorship.merge(rows, with_provenance=False).select("cluster", "candidate_id")


# --- output ---------------------------------------------------------------------------------------------------------


@query(f"""
    WITH {MEMBERS_SQL}, best AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY score DESC, fid) = 1), n AS (SELECT cluster, max(score) AS s, max(trust) AS k, count(*) AS n FROM m GROUP BY cluster)
    SELECT cluster, city AS town, CASE WHEN source = 'csv' THEN 'India' ELSE 'US' END AS land, CAST(NULL AS VARCHAR) AS site, round((s * 13.5 + k * 2) / 15.5, 6) AS overall_confidence, CAST(6 * n AS INTEGER) AS n_claims FROM best JOIN n USING (cluster)""")
def project_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested paths, one through a null; confidence and audit trail switched on; the configuration comes from a file."""
    fields = [{"path": "town", "from": "location.city"}, {"path": "land", "from_path": "location.country"}, {"path": "site", "from": "links.portfolio"}]
    with tempfile.NamedTemporaryFile("w", suffix=".json", delete=False) as file:  # read by the driver only
        json.dump({"fields": fields, "include_confidence": True, "include_provenance": True}, file)
    config = OutputConfig.load(file.name)
    os.unlink(file.name)
    out = project(survivorship.merge(members(spark, sf_dir)), config, keep=("cluster",))
    return out.select("cluster", "town", "land", "site", F.round("overall_confidence", 6).alias("overall_confidence"), F.size("provenance").alias("n_claims"))


#: Configurations and whether they are sound.
CONFIGS = (
    ('{"fields": [{"path": "a"}]}', True), ('{"fields": []}', False), ('{"fields": [{"from": "a"}]}', False), ('{"fields": [{"path": "a"}], "on_missing": "drop"}', False),
    ('{"fields": [{"path": "a", "on_missing": "omit"}], "on_missing": "error"}', True), ('{"fields": [{"path": "a", "on_missing": "x"}]}', False), ("{broken", False), ("[]", False),
)


@query(f"SELECT * FROM (VALUES {', '.join(f'({i}, {str(ok).lower()})' for i, (_, ok) in enumerate(CONFIGS))}) t(id, sound)")
def config_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = []
    with tempfile.TemporaryDirectory() as place:  # read by the driver only
        for i, (text, _) in enumerate(CONFIGS):
            with open(f"{place}/{i}.json", "w", encoding="utf-8") as file:
                file.write(text)
            try:
                OutputConfig.load(file.name)
                out.append((i, True))
            except readers.ConfigError:
                out.append((i, False))
    return spark.createDataFrame(out, "id int, sound boolean")


@query("SELECT * FROM (VALUES ('no source', 2), ('no configuration', 1), ('absent source', 0)) t(\"case\", code)")
def exit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the command line returns on success, failure and misuse."""
    import contextlib
    import io

    from kinfold import cli

    def code(*args: str) -> int:
        with contextlib.redirect_stdout(io.StringIO()), contextlib.redirect_stderr(io.StringIO()):
            try:
                return cli.main(list(args))
            except SystemExit as stop:
                return int(stop.code)

    absent = f"{folder(spark)}/absent.csv"
    rows = [("no source", code()), ("no configuration", code("--csv", absent, "--config", "/absent.json")), ("absent source", code("--csv", absent))]
    return spark.createDataFrame(rows, "case string, code int")
