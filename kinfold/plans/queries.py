"""Registered queries: every operator of the linkage engine over fragments derived from the given tables.

Customers stand for delimited rows, suppliers for applicant records and documents for notes; the derivations are the
same expressions in Spark and in the DuckDB twins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold import vocabulary as V
from kinfold.functions import fuzzy
from kinfold.functions import normalize as N
from kinfold.functions import text as T
from kinfold.operators import extract, resolve, survivorship
from kinfold.operators.components import component_ids
from kinfold.plans import linkage, metrics
from kinfold.plans.project import OutputConfig, project
from kinfold.runtime import materialize, tidy
from kinfold.sources.readers import first_occurrences

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = tidy(f)
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- derived people -------------------------------------------------------------------------------------------------


#: People of both kinds. Keys collide on purpose, so that e-mail and phone blocks, chains and fuzzy names occur.
PEOPLE_SQL = """
people_ AS (
    SELECT c_custkey AS fid, 'csv' AS source, CAST(0.95 AS DOUBLE) AS trust, 'direct_field_read' AS method, CAST(0.95 AS DOUBLE) AS conf,
           CAST(c_custkey % 211 AS BIGINT) AS grp, 'U' || CAST(c_custkey % 997 AS VARCHAR) || '@X.example' AS email,
           '+9198765' || lpad(CAST(c_custkey % 1201 AS VARCHAR), 5, '0') AS phone, c_mktsegment AS company, c_custkey % 5 AS t, 'City ' || CAST(c_nationkey AS VARCHAR) AS city,
           CAST(c_custkey % 31 AS VARCHAR) || '.0' AS years FROM customer
    UNION ALL
    SELECT 1099511627776 + s_suppkey, 'ats_json', CAST(0.90 AS DOUBLE), 'ats_mapped', CAST(0.90 AS DOUBLE),
           CAST(s_suppkey % 89 AS BIGINT), 'u' || CAST(s_suppkey * 3 AS VARCHAR) || '@x.example',
           '+9198765' || lpad(CAST(s_suppkey % 701 AS VARCHAR), 5, '0'), 'SUPPLY', s_suppkey % 7, 'City ' || CAST(s_nationkey AS VARCHAR),
           CAST(s_suppkey % 17 AS VARCHAR) || '.0' FROM supplier),
people AS (SELECT *, substr(md5(CAST(grp AS VARCHAR)), 1, 7) || ' ' || substr(md5(CAST(grp AS VARCHAR)), 9, 9) AS full_name FROM people_)
"""


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The people of PEOPLE_SQL as plain columns."""
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    text = lambda x: x.cast("string")

    def rows(df: DataFrame, key: Column, source: str, shift: int, name: Column, mail: Column, number: Column, company: Column, t: Column, city: Column, years: Column) -> DataFrame:
        conf = V.METHOD_CONFIDENCE[V.SOURCE_METHOD[source]]
        return df.select(
            (key + shift).alias("fid"), F.lit(source).alias("source"), F.lit(V.SOURCE_TRUST[source]).alias("trust"), F.lit(V.SOURCE_METHOD[source]).alias("method"), F.lit(conf).alias("conf"),
            name.cast("long").alias("grp"), F.concat_ws(" ", F.substring(F.md5(text(name)), 1, 7), F.substring(F.md5(text(name)), 9, 9)).alias("full_name"), mail.alias("email"), F.concat(F.lit("+9198765"), F.lpad(text(number), 5, "0")).alias("phone"),
            company.alias("company"), t.alias("t"), F.concat(F.lit("City "), text(city)).alias("city"), F.concat(text(years), F.lit(".0")).alias("years"),
        )

    k, j = F.col("c_custkey"), F.col("s_suppkey")
    csv = rows(c, k, "csv", 0, k % 211, F.concat(F.lit("U"), text(k % 997), F.lit("@X.example")), k % 1201, F.col("c_mktsegment"), k % 5, F.col("c_nationkey"), k % 31)
    ats = rows(s, j, "ats_json", 1 << 40, j % 89, F.concat(F.lit("u"), text(j * 3), F.lit("@x.example")), j % 701, F.lit("SUPPLY"), j % 7, F.col("s_nationkey"), j % 17)
    return csv.unionByName(ats)


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The people as normalised fragments; applicant records have structured places, delimited rows text ones."""
    p = people(spark, sf_dir)
    said = lambda f, v: F.when(v.isNotNull(), F.struct(v.alias("value"), F.col("conf").alias("confidence"))).cast(V.FIELDS[f]).alias(f)
    none = F.lit(None).cast("string")
    ats = F.col("source") == "ats_json"
    place = F.struct(F.when(ats, F.col("city")).alias("city"), none.alias("region"), F.when(ats, F.lit("US")).alias("country"), F.when(~ats, F.concat("city", F.lit(", India"))).alias("text"), F.lit(False).alias("bad"))
    title = F.concat(F.lit("Title "), F.col("t").cast("string"))
    skill = lambda name, c: F.struct(name.alias("name"), F.lit(c).alias("confidence"), name.alias("raw"))
    skills = F.array(skill(F.concat(F.lit("Skill "), F.col("t").cast("string")), 1.0), skill(F.lit("Common"), 0.5))
    facts = {
        "full_name": F.col("full_name"), "emails": F.array(F.lower("email")), "phones": F.array("phone"), "current_company": F.col("company"), "title": title,
        "years_experience": F.col("years"), "location": place, "skills": skills,
    }
    keys = [F.col("fid").cast("long").alias("fid"), "source", "trust", "method"]
    return p.select("grp", *keys, *[said(f, facts[f]) if f in facts else F.lit(None).cast(kind).alias(f) for f, kind in V.FIELDS.items()])


def named_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments with names that few share, so that fuzzy names join some of the unmatched and not all."""
    some = F.md5((F.col("fid") % 1301).cast("string"))
    name = F.concat_ws(" ", F.substring(some, 1, 7), F.substring(some, 9, 9))
    return fragments(spark, sf_dir).withColumn("full_name", F.col("full_name").withField("value", name))


CLUSTERS_SQL = f"""
{PEOPLE_SQL},
keys AS (SELECT fid, 'e' || lower(email) AS k FROM people UNION ALL SELECT fid, 'p' || phone FROM people),
edges AS (SELECT a.fid AS a, b.least AS b FROM keys a JOIN (SELECT k, min(fid) AS least FROM keys GROUP BY k HAVING count(*) > 1) b USING (k)),
links AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach AS (SELECT a AS fid, a AS other FROM links UNION SELECT r.fid, l.b FROM reach r JOIN links l ON l.a = r.other),
clusters AS (SELECT p.fid, coalesce(min(r.other), p.fid) AS cluster FROM people p LEFT JOIN reach r ON r.fid = p.fid GROUP BY p.fid)
"""


def exact_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fid, cluster) over e-mail and phone keys only."""
    whole = materialize(fragments(spark, sf_dir), "fragments")
    edges = resolve.star_edges(resolve.key_table(whole, "emails")).unionByName(resolve.star_edges(resolve.key_table(whole, "phones")))
    found = component_ids(edges).withColumnRenamed("node", "fid")
    return whole.select("fid").join(found, "fid", "left").select("fid", F.coalesce("component", "fid").alias("cluster"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments in groups that need no graph: people of one name."""
    return fragments(spark, sf_dir).withColumnRenamed("grp", "cluster")


MEMBERS_SQL = f"{PEOPLE_SQL}, m AS (SELECT *, grp AS cluster, trust * conf AS score FROM people)"

# --- extraction -----------------------------------------------------------------------------------------------------

_EMAIL_SQL, *_PHONES_SQL = (p.removeprefix("(?U)") for p in (extract.NOTE_EMAIL, *extract.NOTE_PHONES))


@query(f"""
    SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '{_EMAIL_SQL}'))) AS email FROM documents""")
def extract_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(extract.note_emails(F.col("text"))).alias("email"))


@query(f"""
    SELECT doc_id, unnest(list_distinct(list_filter(list_concat({", ".join(f"[trim(x) FOR x IN regexp_extract_all(text, '{p}')]" for p in _PHONES_SQL)}), lambda x: x <> ''))) AS phone
    FROM documents WHERE regexp_matches(text, '[0-9]')""")
def extract_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(extract.note_phones(F.col("text"))).alias("phone"))


_SAID = "'Spoke with ' || 'Ada ' || upper(chr(CAST(97 + c_custkey % 26 AS INTEGER))) || 'rmo' || ' today. ' || 'Works as a Data Engineer. Currently at ' || CASE WHEN c_custkey % 2 = 0 THEN 'Orbital Labs' ELSE 'Tidal' END || ' in Pune.'"


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A made-up note for each customer."""
    k = F.col("c_custkey")
    who = F.concat(F.lit("Ada "), F.upper(F.char(97 + k % 26)), F.lit("rmo"))
    firm = F.when(k % 2 == 0, "Orbital Labs").otherwise("Tidal")
    note = F.concat(F.lit("Spoke with "), who, F.lit(" today. Works as a Data Engineer. Currently at "), firm, F.lit(" in Pune."))
    return table(spark, sf_dir, "customer").select(k.alias("id"), note.alias("raw_text"), F.struct(k.alias("at")).alias("ord"))


@query(f"""
    WITH n AS (SELECT c_custkey AS id, {_SAID} AS t FROM customer)
    SELECT id, regexp_extract(t, 'Spoke with ([A-Z][a-z]+ [A-Z][a-z]+)', 1) AS name, regexp_extract(t, 'Currently at ([A-Za-z ]+?) in', 1) AS company,
           regexp_extract(t, 'Works as a ([A-Za-z ]+)[.]', 1) AS title, 'Pune' AS city FROM n""")
def extract_note_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("raw_text")
    return _notes(spark, sf_dir).select("id", extract.note_name(t).alias("name"), extract.note_company(t).alias("company"), extract.note_title(t).alias("title"), extract.note_location(t)["city"].alias("city"))


@query()
def extract_note_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.struct("doc_id").alias("ord"), F.col("text").alias("raw_text"))
    return extract.extract_notes(docs).select(F.col("ord.doc_id").alias("doc_id"), F.col("full_name.value").alias("full_name"), F.col("current_company.value").alias("company"), F.col("title.value").alias("title"), F.col("location.value.city").alias("city"))


_BLOCKS = r"(?i)\n\s*(?:---+|===+|___+|\*\*\*+)\s*\n|\n\s*candidate\s*(?:\d+|#\d+)\s*:?\s*\n"


@query(f"""
    WITH n AS (SELECT lang, source, string_agg(left(regexp_replace(text, '\\s+', ' ', 'g'), 20), chr(10) || '---' || chr(10) ORDER BY doc_id) AS t FROM documents GROUP BY lang, source),
    b AS (SELECT lang, source, unnest(string_split_regex(t, '{_BLOCKS}')) AS text, generate_subscripts(string_split_regex(t, '{_BLOCKS}'), 1) - 1 AS pos FROM n)
    SELECT lang, source, CAST(pos AS INTEGER) AS pos, regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), ' +', ' ', 'g') AS text FROM b WHERE trim(text) <> ''""")
def block_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.left(F.regexp_replace("text", r"\s+", " "), F.lit(20))
    notes = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", head.alias("h")))), lambda x: x["h"]), "\n---\n").alias("t"))
    return notes.select("lang", "source", F.explode(T.blocks(T.note_layout(F.col("t")))).alias("b")).select("lang", "source", "b.pos", "b.text")


@query("""
    SELECT c_custkey AS id, ['a' || (c_custkey % 3), 'b', 'c'] AS skills, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS years FROM customer""")
def csv_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header mapping, list split and numeric parse of delimited cells."""
    k = F.col("c_custkey")
    cells = F.create_map(F.lit("skills"), F.concat(F.lit("a"), (k % 3).cast("string"), F.lit("; b | c,")), F.lit("experience_years"), F.col("c_acctbal").cast("string"), F.lit("unknown"), F.lit("x"), F.lit("role"), F.col("c_name"))
    rows = table(spark, sf_dir, "customer").select(F.struct(k.alias("k")).alias("ord"), cells.alias("cells"))
    return extract.extract_csv(rows).select(F.col("ord.k").alias("id"), F.col("skills.value").alias("skills"), F.col("years_experience.value").cast("double").alias("years"))


@query("""
    SELECT s_suppkey AS id, s_name AS full_name, ['m' || s_suppkey || '@x.example'] AS emails, CASE WHEN s_suppkey % 2 = 0 THEN 'Flux' ELSE 'Hex' END AS company, 'C' || s_nationkey AS city FROM supplier""")
def ats_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered keys, nested contact and employer blocks of applicant JSON."""
    k = F.col("s_suppkey")
    flat = F.struct(F.col("s_name").alias("candidate_name"), F.concat(F.lit("m"), k.cast("string"), F.lit("@x.example")).alias("email_address"), F.lit("Flux").alias("company"), F.concat(F.lit("C"), F.col("s_nationkey").cast("string")).alias("city"))
    deep = F.struct(F.col("s_name").alias("applicant_name"), F.struct(F.concat(F.lit("m"), k.cast("string"), F.lit("@x.example")).alias("email")).alias("contact"), F.struct(F.lit("Hex").alias("name")).alias("employer"), F.concat(F.lit("C"), F.col("s_nationkey").cast("string")).alias("city"))
    record = F.parse_json(F.when(k % 2 == 0, F.to_json(flat)).otherwise(F.to_json(deep)))
    rows = table(spark, sf_dir, "supplier").select(F.struct(k.alias("k")).alias("ord"), record.alias("record"))
    out = extract.extract_ats(rows)
    return out.select(F.col("ord.k").alias("id"), F.col("full_name.value").alias("full_name"), F.col("emails.value").alias("emails"), F.col("current_company.value").alias("company"), F.col("location.value.city").alias("city"))


@query("""
    SELECT l_returnflag || '|' || l_linestatus || '|' || CAST(l_linenumber AS VARCHAR) AS cell, min(l_orderkey * 10 + l_linenumber) AS first_at FROM lineitem GROUP BY 1""")
def row_dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = F.concat_ws("|", "l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string"))
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.create_map(F.lit("c"), cell).alias("cells"))
    return first_occurrences(rows, F.to_json("cells")).select(F.col("cells")["c"].alias("cell"), F.col("ord").alias("first_at"))


# --- normalisers ----------------------------------------------------------------------------------------------------


@query("""
    WITH e AS (SELECT c_custkey AS id, unnest([' U' || (c_custkey % 7) || '@X.example ', 'u' || (c_custkey % 5) || '@x.example', 'bad', 'x@y']) AS e FROM customer)
    SELECT id, list_sort(list_distinct(list(lower(trim(e))))) AS emails FROM e WHERE regexp_matches(lower(trim(e)), '^[a-z0-9._%+-]+@[a-z0-9.-]+[.][a-z]{2,}$') GROUP BY id""")
def normalize_email_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    given = F.array(F.concat(F.lit(" U"), (k % 7).cast("string"), F.lit("@X.example ")), F.concat(F.lit("u"), (k % 5).cast("string"), F.lit("@x.example")), F.lit("bad"), F.lit("x@y"))
    return table(spark, sf_dir, "customer").select(k.alias("id"), N.email_list(given).alias("emails"))


@query("""
    SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN '+9198765' || lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0') WHEN 1 THEN '+1415555' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') WHEN 2 THEN '+442079460' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') END AS phone FROM customer""")
def normalize_phone(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    pad = lambda n: F.lpad((k % 10**n).cast("string"), n, "0")
    raw = F.when(k % 4 == 0, F.concat(F.lit("0 98765 "), pad(5))).when(k % 4 == 1, F.concat(F.lit("+1 (415) 555-"), pad(4))).when(k % 4 == 2, F.concat(F.lit("020 7946 0"), pad(3))).otherwise(F.concat(F.lit("12-"), pad(3)))
    region = F.when(k % 4 == 2, "GB").otherwise("IN")
    return table(spark, sf_dir, "customer").select(k.alias("id"), N.phone(raw, region).alias("phone"))


@query("""
    WITH a(name, code) AS (VALUES ('FRANCE', 'FR'), ('GERMANY', 'DE'), ('INDIA', 'IN'), ('CHINA', 'CN'), ('JAPAN', 'JP'), ('UNITED STATES', 'US'), ('UNITED KINGDOM', 'GB'), ('RUSSIA', 'RU'), ('BRAZIL', 'BR'), ('CANADA', 'CA')),
    n AS (SELECT n_nationkey AS id, (['France', 'uk', 'USA', ' in ', 'Freedonia', 'U.S.', 'Norway', 'zz'])[CAST(n_nationkey % 8 AS INTEGER) + 1] AS raw FROM nation)
    SELECT id, CASE trim(raw) WHEN 'France' THEN 'FR' WHEN 'uk' THEN 'GB' WHEN 'USA' THEN 'US' WHEN 'in' THEN 'IN' WHEN 'U.S.' THEN 'US' WHEN 'Norway' THEN 'NO' END AS code,
           CAST(CASE WHEN trim(raw) IN ('USA', 'in') THEN 1.0 WHEN trim(raw) IN ('France', 'uk', 'U.S.', 'Norway') THEN 0.95 END AS DOUBLE) AS confidence FROM n""")
def country_dim_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.element_at(F.array(*[F.lit(x) for x in ("France", "uk", "USA", " in ", "Freedonia", "U.S.", "Norway", "zz")]), F.col("n_nationkey") % 8 + 1)
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), N.country(raw).alias("c")).select("id", "c.code", "c.confidence")


@query("""
    SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 3 THEN strftime(o_orderdate, '%Y') ELSE strftime(o_orderdate, '%Y-%m') END AS date, CAST(CASE o_orderkey % 4 WHEN 3 THEN 0.8 ELSE 1.0 END AS DOUBLE) AS confidence FROM orders""")
def normalize_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = {0: "MMMM yyyy", 1: "M/yyyy", 2: "yyyy.MM", 3: "yyyy"}
    k, raw = F.col("o_orderkey"), F.lit(None).cast("string")
    for i, form in forms.items():
        raw = F.when(k % 4 == i, F.date_format("o_orderdate", form)).otherwise(raw)
    return table(spark, sf_dir, "orders").select(k.alias("id"), N.date(raw, lenient=False).alias("d")).select("id", "d.date", "d.confidence")


_ALIAS_VALUES = ", ".join("('" + a.replace("'", "''") + "', '" + n.replace("'", "''") + "')" for a, n in V.SKILL_ALIASES.items() if "-" not in a)
_RAW_SKILLS = ("ML", "machine_learning", " Node.JS ", "k8s", "C++", "golang", "deep  learning", "py")


@query(f"""
    WITH a(alias, name) AS (VALUES {_ALIAS_VALUES}),
    p AS (SELECT p_partkey AS id, ([{", ".join(f"'{x}'" for x in _RAW_SKILLS)}])[CAST(p_partkey % {len(_RAW_SKILLS)} AS INTEGER) + 1] AS raw FROM part)
    SELECT id, name FROM p JOIN a ON alias = regexp_replace(regexp_replace(lower(trim(raw)), '[-_]+', ' ', 'g'), '\\s+', ' ', 'g')""")
def skill_alias_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.element_at(F.array(*[F.lit(x) for x in _RAW_SKILLS]), (F.col("p_partkey") % len(_RAW_SKILLS) + 1).cast("int"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), N.SkillDictionary().exact(raw).alias("name"))


@query()
def skill_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names near a canonical skill, unknown ones kept at half confidence."""
    raw = F.array(F.concat(F.lit("Pythn "), F.col("p_brand")), F.lit("AWS Glue"), F.col("p_type"))
    skills = N.SkillDictionary().normalize(raw)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.explode(skills).alias("s")).select("id", "s.name", F.round("s.confidence", 6).alias("confidence"))


@query()
def normalize_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = extract.extract_notes(table(spark, sf_dir, "documents").select(F.struct("doc_id").alias("ord"), F.col("text").alias("raw_text")))
    done = linkage.normalize(raw.withColumn("fid", F.col("ord.doc_id")))
    return done.select(F.col("fid").alias("doc_id"), F.col("emails.value").alias("emails"), F.col("phones.value").alias("phones"), F.size(F.coalesce("skills.value", F.array().cast("array<struct<name:string,confidence:double,raw:string>>"))).alias("n_skills"))


# --- matching -------------------------------------------------------------------------------------------------------


@query(f"WITH {PEOPLE_SQL} SELECT lower(email) AS key, min(fid) AS least, count(*) AS n FROM people GROUP BY 1 HAVING count(*) > 1")
def email_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.key_blocks(resolve.key_table(fragments(spark, sf_dir), "emails"))


@query(f"WITH {PEOPLE_SQL} SELECT phone AS key, min(fid) AS least, count(*) AS n FROM people GROUP BY 1 HAVING count(*) > 1")
def phone_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.key_blocks(resolve.key_table(fragments(spark, sf_dir), "phones"))


@query(f"WITH {PEOPLE_SQL} SELECT fid FROM people WHERE lower(email) NOT IN (SELECT lower(email) FROM people GROUP BY 1 HAVING count(*) > 1)")
def unmatched_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = materialize(fragments(spark, sf_dir), "fragments")
    return resolve.unmatched(whole, resolve.star_edges(resolve.key_table(whole, "emails"))).select("fid")


@query(f"WITH RECURSIVE {CLUSTERS_SQL} SELECT fid, cluster FROM clusters")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_clusters(spark, sf_dir)




@query("""
    WITH n AS (SELECT DISTINCT c_mktsegment AS a FROM customer), m AS (SELECT DISTINCT p_type AS b FROM part),
    p AS (SELECT a, b, array_to_string(list_sort(string_split(lower(a), ' ')), ' ') AS x, array_to_string(list_sort(string_split(lower(b), ' ')), ' ') AS y FROM n, m),
    l AS (SELECT *, list_reduce(string_split(x, ''), lambda row, ch: list_reduce(range(1, length(y) + 1), lambda done, j: list_append(done, CASE WHEN substr(y, j, 1) = ch THEN row[j] + 1 ELSE greatest(row[j + 1], done[-1]) END), [CAST(0 AS BIGINT)]), [CAST(0 AS BIGINT) FOR i IN range(0, length(y) + 1)]) AS t FROM p)
    SELECT a, b, round(200.0 * t[-1] / (length(x) + length(y)), 6) AS score FROM l""")
def token_sort_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The native expression over two small distinct lists."""
    a = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("a")).distinct()
    b = table(spark, sf_dir, "part").select(F.col("p_type").alias("b")).distinct()
    return a.join(F.broadcast(b), F.length("a") + F.length("b") > 0).select("a", "b", F.round(fuzzy.token_sort_ratio(F.lower("a"), F.lower("b")), 6).alias("score"))


@query("""
    WITH n AS (SELECT s_suppkey AS id, 'john r smith' AS a, (['j. r. smith', 'j r s', 'john smith', 'jon r smith', 'john r smith', 'k r smith'])[CAST(s_suppkey % 6 AS INTEGER) + 1] AS b FROM supplier)
    SELECT id, b IN ('j. r. smith', 'j r s', 'john r smith') AS matches FROM n""")
def initials_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.element_at(F.array(*[F.lit(x) for x in ("j. r. smith", "j r s", "john smith", "jon r smith", "john r smith", "k r smith")]), (F.col("s_suppkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), fuzzy.initials_match(F.lit("john r smith"), b).alias("matches"))


@query("""
    WITH n AS (SELECT s_suppkey AS fid, 'person ' || chr(CAST(97 + s_suppkey % 7 AS INTEGER)) || chr(CAST(97 + s_suppkey % 11 AS INTEGER)) AS name FROM supplier),
    p AS (SELECT a.fid AS a, b.fid AS b, array_to_string(list_sort(string_split(a.name, ' ')), ' ') AS x, array_to_string(list_sort(string_split(b.name, ' ')), ' ') AS y FROM n a JOIN n b ON a.fid < b.fid),
    d AS (SELECT DISTINCT x, y FROM p),
    l AS (SELECT *, list_reduce(string_split(x, ''), lambda row, ch: list_reduce(range(1, length(y) + 1), lambda done, j: list_append(done, CASE WHEN substr(y, j, 1) = ch THEN row[j] + 1 ELSE greatest(row[j + 1], done[-1]) END), [CAST(0 AS BIGINT)]), [CAST(0 AS BIGINT) FOR i IN range(0, length(y) + 1)]) AS t FROM d),
    s AS (SELECT x, y, 200.0 * t[-1] / (length(x) + length(y)) AS score FROM l)
    SELECT a, b, round(score / 100 * 0.7, 6) AS confidence FROM p JOIN s USING (x, y) WHERE score >= 95""")
def fuzzy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of suppliers by name alone, found through shared segments."""
    k = F.col("s_suppkey")
    name = F.concat(F.lit("person "), F.char(97 + k % 7), F.char(97 + k % 11))
    facts = {"full_name": F.struct(name.alias("value"), F.lit(0.9).alias("confidence"))}
    rows = table(spark, sf_dir, "supplier").select(k.alias("fid"), *[(facts[f].cast(t) if f in facts else F.lit(None).cast(t)).alias(f) for f, t in V.FIELDS.items()])
    rows = materialize(rows, "fragments")
    return resolve.fuzzy_pairs(rows, rows.select("fid"), digits=6)


# --- survivorship ---------------------------------------------------------------------------------------------------

_TITLES = "SELECT cluster, fid, source, method, trust, score, 'Title ' || CAST(t AS VARCHAR) AS value FROM m"
_RANK = "(PARTITION BY cluster ORDER BY score DESC, trust DESC, lower(value), fid)"


@query(f"WITH {MEMBERS_SQL}, c AS ({_TITLES}) SELECT cluster, 'title' AS field, value, round(score, 6) AS score FROM c QUALIFY row_number() OVER {_RANK} = 1")
def scalar_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivorship.winners(survivorship.scalar_claims(members(spark, sf_dir), ("title",))).withColumn("score", F.round("score", 6))


@query(f"""
    WITH {MEMBERS_SQL}, c AS ({_TITLES})
    SELECT cluster, 'title' AS field, source, method, value, round(score, 6) AS confidence, value = first_value(value) OVER {_RANK} AND score = first_value(score) OVER {_RANK} AS is_winner FROM c""")
def winner_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    group = members(spark, sf_dir)
    trail = survivorship.provenance(group, survivorship.winners(survivorship.scalar_claims(group))).filter("entry.field = 'title'")
    return trail.select("cluster", "entry.*").withColumn("confidence", F.round("confidence", 6))


@query(f"WITH {MEMBERS_SQL} SELECT cluster, 'current_company' AS field, lower(trim(company)) AS value, count(*) AS n FROM m GROUP BY ALL")
def agreement_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivorship.agreement(survivorship.scalar_claims(members(spark, sf_dir), ("current_company",)))


@query(f"WITH {MEMBERS_SQL} SELECT cluster, list_sort(list_distinct(list(lower(email)))) AS emails, list_sort(list_distinct(list(phone))) AS phones FROM m GROUP BY cluster")
def email_phone_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivorship.merge(members(spark, sf_dir), with_provenance=False).select("cluster", "emails", "phones")


@query(f"""
    WITH {MEMBERS_SQL}, s AS (SELECT cluster, source, 'Skill ' || CAST(t AS VARCHAR) AS name, trust * 1.0 AS score FROM m UNION ALL SELECT cluster, source, 'Common', trust * 0.5 FROM m)
    SELECT cluster, name, round(max(score), 6) AS confidence, list_sort(list_distinct(list(source))) AS sources FROM s GROUP BY cluster, name""")
def skill_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = survivorship.merge(members(spark, sf_dir), with_provenance=False)
    return merged.select("cluster", F.inline("skills")).select("cluster", "name", F.round("confidence", 6).alias("confidence"), "sources")


@query(f"""
    WITH {MEMBERS_SQL}, best AS (SELECT cluster, max(score) AS s, max(trust) AS k FROM m GROUP BY cluster)
    SELECT cluster, round((s * 3 + s * 2 + s * 1.5 + s * 1 + s * 3 + s * 2 + k * 2 + s * 1) / 15.5, 6) AS overall_confidence FROM best""")
def weighted_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = survivorship.merge(members(spark, sf_dir), with_provenance=False)
    return merged.select("cluster", F.round("overall_confidence", 6).alias("overall_confidence"))


@query(f"WITH {MEMBERS_SQL} SELECT cluster, substr(sha256('email:' || min(lower(email))), 1, 16) AS candidate_id FROM m GROUP BY cluster")
def candidate_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivorship.merge(members(spark, sf_dir), with_provenance=False).select("cluster", "candidate_id")


@query(f"""
    WITH {MEMBERS_SQL}, best AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY score DESC, fid) = 1)
    SELECT cluster, city, CASE WHEN source = 'csv' THEN 'India' ELSE 'US' END AS country FROM best""")
def location_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivorship.merge(members(spark, sf_dir), with_provenance=False).select("cluster", "location.city", "location.country")


@query("""
    WITH o AS (SELECT o_custkey AS cluster, o_orderkey AS fid, o_orderpriority AS company, o_orderstatus AS title, strftime(o_orderdate, '%Y-%m') AS start FROM orders),
    f AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY cluster, lower(company || '|' || title || '|' || start) ORDER BY fid) = 1)
    SELECT cluster, list(company || '/' || title || '/' || start ORDER BY start DESC, company DESC, fid) AS experience FROM f GROUP BY cluster""")
def experience_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.struct(F.col("o_orderpriority").alias("company"), F.col("o_orderstatus").alias("title"), F.date_format("o_orderdate", "yyyy-MM").alias("start"), F.lit(None).cast("string").alias("end"), F.lit(None).cast("string").alias("summary"))
    key = F.lower(F.concat_ws("|", "o_orderpriority", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM")))
    entry = F.struct(F.array(F.struct(key.alias("key"), item.alias("item"), F.lit(False).alias("bad"))).alias("value"), F.lit(0.9).alias("confidence"))
    facts = {"experience": entry}
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("fid"), F.col("o_custkey").alias("cluster"), F.lit("ats_json").alias("source"), F.lit(0.9).alias("trust"), F.lit("ats_mapped").alias("method"), *[(facts[f].cast(t) if f in facts else F.lit(None).cast(t)).alias(f) for f, t in V.FIELDS.items()])
    merged = survivorship.merge(rows, with_provenance=False)
    return merged.select("cluster", F.transform("experience", lambda e: F.concat_ws("/", e["company"], e["title"], e["start"])).alias("experience"))


# --- output ---------------------------------------------------------------------------------------------------------

_RECORDS_SQL = f"""WITH {MEMBERS_SQL}, r AS (
    SELECT cluster, min(full_name) AS name, list_sort(list_distinct(list(lower(email)))) AS emails, list_sort(list_distinct(list('Skill ' || CAST(t AS VARCHAR)) || ['Common'])) AS skills FROM m GROUP BY cluster)"""


def _project(spark: SparkSession, sf_dir: str, fields: list[dict], on_missing: str = "null") -> DataFrame:
    merged = survivorship.merge(members(spark, sf_dir), with_provenance=False)
    config = OutputConfig.parse({"fields": fields, "include_confidence": False, "include_provenance": False, "on_missing": on_missing})
    return project(merged, config, keep=("cluster",))


@query(_RECORDS_SQL + " SELECT cluster, name, emails[1] AS first_email, emails[4] AS fourth_email, skills AS skill_names, CAST(NULL AS VARCHAR) AS nothing FROM r")
def project_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain, indexed, projected and unknown paths."""
    fields = [{"path": "name", "from": "full_name"}, {"path": "first_email", "from": "emails[0]"}, {"path": "fourth_email", "from": "emails[3]"}, {"path": "skill_names", "from": "skills[].name"}, {"path": "nothing", "from": "no.such.path"}]
    return _project(spark, sf_dir, fields).drop("json")


@query(_RECORDS_SQL + """ SELECT cluster, '{"id":"' || emails[1] || '"' || CASE WHEN len(emails) > 3 THEN ',"fourth":"' || emails[4] || '"' ELSE '' END || ',"head":null}' AS json FROM r""")
def project_omit_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing values left out of the object, nulls kept."""
    fields = [{"path": "id", "from": "emails[0]"}, {"path": "fourth", "from": "emails[3]", "on_missing": "omit"}, {"path": "head", "from": "headline", "on_missing": "omit"}]
    return _project(spark, sf_dir, fields).select("cluster", "json")


@query(_RECORDS_SQL + " SELECT cluster, emails[3] AS third FROM r WHERE len(emails) > 2")
def project_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records without a required value are dropped."""
    return _project(spark, sf_dir, [{"path": "third", "from": "emails[2]", "required": True, "on_missing": "error"}]).select("cluster", "third")


# --- metrics --------------------------------------------------------------------------------------------------------


@query(f"""
    WITH RECURSIVE {CLUSTERS_SQL}
    SELECT count(DISTINCT source) AS n_sources, count(*) AS n_fragments, count(DISTINCT cluster) AS n_records, round((1 - count(DISTINCT cluster) / count(*)) * 100, 4) AS reduction_pct FROM people JOIN clusters USING (fid)""")
def metrics_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.reduction(fragments(spark, sf_dir), exact_clusters(spark, sf_dir))


@query(f"WITH {MEMBERS_SQL} SELECT source, count(DISTINCT cluster) AS n_records FROM m GROUP BY source")
def source_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.source_coverage(fragments(spark, sf_dir), members(spark, sf_dir).select("fid", "cluster"))


@query(f"WITH {MEMBERS_SQL} SELECT count(*) FILTER (n > 1) AS n_multi FROM (SELECT cluster, count(DISTINCT source) AS n FROM m GROUP BY cluster)")
def multi_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.multi_source(fragments(spark, sf_dir), members(spark, sf_dir).select("fid", "cluster"))


@query(f"""
    WITH {MEMBERS_SQL}, best AS (SELECT cluster, max(score) AS s, max(trust) AS k FROM m GROUP BY cluster), c AS (SELECT (s * 13.5 + k * 2) / 15.5 AS o FROM best)
    SELECT count(*) FILTER (o >= 0.85) AS high, count(*) FILTER (o >= 0.6 AND o < 0.85) AS medium, count(*) FILTER (o < 0.6) AS low FROM c""")
def confidence_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confidence_bands(survivorship.merge(members(spark, sf_dir), with_provenance=False))


# --- the whole way --------------------------------------------------------------------------------------------------


@query(r"""
    WITH RECURSIVE e AS (
        SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(text, '\b[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}\b'))) AS email FROM documents),
    v AS (SELECT * FROM e WHERE regexp_matches(email, '^[a-z0-9._%+-]+@[a-z0-9.-]+[.][a-z]{2,}$')),
    links AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM v a JOIN v b USING (email)),
    reach AS (SELECT a AS doc_id, b AS other FROM links UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other),
    c AS (SELECT doc_id, min(other) AS cluster FROM reach GROUP BY doc_id)
    SELECT substr(sha256('email:' || min(email)), 1, 16) AS candidate_id, list_sort(list_distinct(list(email))) AS emails, count(DISTINCT doc_id) AS n_fragments
    FROM c JOIN v USING (doc_id) GROUP BY cluster""")
def link_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses in documents, normalised, blocked, joined into components and merged."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("fid"), N.email_list(extract.note_emails(F.col("text"))).alias("e")).filter("e IS NOT NULL")
    facts = {"emails": F.struct(F.col("e").alias("value"), F.lit(0.8).alias("confidence"))}
    rows = materialize(docs.select("fid", F.lit("recruiter_notes").alias("source"), F.lit(0.6).alias("trust"), F.lit("regex_extracted").alias("method"), *[(facts[f].cast(t) if f in facts else F.lit(None).cast(t)).alias(f) for f, t in V.FIELDS.items()]), "fragments")
    found = component_ids(resolve.star_edges(resolve.key_table(rows, "emails"))).withColumnRenamed("node", "fid")
    group = materialize(rows.join(found, "fid", "left").withColumn("cluster", F.coalesce("component", "fid")).drop("component"), "members")
    sizes = group.groupBy("cluster").agg(F.count("*").alias("n_fragments"))
    return survivorship.merge(group, with_provenance=False).join(sizes, "cluster").select("candidate_id", "emails", "n_fragments")
