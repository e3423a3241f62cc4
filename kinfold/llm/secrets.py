"""Secret scans over a content-addressed ledger of blobs, in DataFrame and SQL functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.runtime import join_hot, materialize, membership_bitmap, split_by_bitmap, tidy


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose ``group`` has ``least`` characters or more; ``order`` ranks kinds at one start."""

    kind: str
    order: int
    pattern: str
    group: int = 0
    least: int = 1


#: Rule versions. To change a rule, add a version: blobs already scanned under the others are not read again.
# The base patterns and lengths.
BASE = "base-1"
RULES: dict[str, tuple[Rule, ...]] = {
    BASE: (
        Rule("assign", 0, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
        Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20),
        Rule("hex", 2, r"[0-9a-f]{24,}"),
    ),
    "provider-1": (
        Rule("pem", 3, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
        Rule("forge", 4, r"gh[opsur]_[A-Za-z0-9]{36,}"),
        Rule("jwt", 5, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    ),
}
_SPANS = "array<struct<start:int,order:int,end:int,kind:string>>"


def rule_spans(text: Column, rule: Rule) -> Column:
    """Spans (start, order, end, kind) in code points, leftmost and non-overlapping.

    The matches and the pieces between them alternate, so running lengths of both give exact offsets.
    """
    pattern = F.lit(rule.pattern)
    whole, value = (F.regexp_extract_all(text, pattern, F.lit(g)) for g in (0, rule.group))
    sizes = F.zip_with(whole, value, lambda w, v: F.struct(F.char_length(w).alias("size"), (F.char_length(v) >= rule.least).alias("good")))
    parts = F.zip_with(sizes, F.split(text, rule.pattern, -1), lambda s, gap: F.struct(F.char_length(gap).alias("gap"), s["size"].alias("size"), s["good"].alias("good")))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        end = start + F.coalesce(x["size"], F.lit(0))
        span = F.struct(start.alias("start"), F.lit(rule.order).alias("order"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        return F.struct(end.alias("at"), F.when(F.coalesce(x["good"], F.lit(False)), F.concat(state["found"], F.array(span))).otherwise(state["found"]).alias("found"))

    none = F.array().cast(_SPANS)
    found = F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("found")), step, lambda s: s["found"])
    return F.when(text.rlike(rule.pattern), found).otherwise(none)


_LEDGER = f"blob_id string, rule_version string, copies long, spans {_SPANS}"


def unseen(paths: DataFrame, ledger: DataFrame | None, rules: dict[str, tuple[Rule, ...]]) -> DataFrame:
    """(blob_id, copies, missing array<string>) of the blobs of paths that lack a rule version in ledger; ids only."""
    blobs = paths.groupBy("blob_id").agg(F.count("*").alias("copies"))
    every = F.array(*[F.lit(v) for v in rules])
    if ledger is None:
        return blobs.withColumn("missing", every)
    seen = ledger.groupBy("blob_id").agg(F.collect_set("rule_version").alias("seen"))
    known = F.coalesce("seen", F.array().cast("array<string>"))
    return blobs.join(seen, "blob_id", "left").select("blob_id", "copies", F.array_except(every, known).alias("missing")).filter(F.size("missing") > 0)


def scan(versions: DataFrame, todo: DataFrame, whole: bool, rules: dict[str, tuple[Rule, ...]] = RULES) -> DataFrame:
    """Ledger rows (blob_id, rule_version, copies, spans) of the pairs in todo, a written table of unseen().

    versions has blob_id and text, one row for each version of each path; whole says that todo holds all its blobs with
    all rule versions. Rows of blobs that todo hasn't are cleared by a bitmap of fixed size before anything is
    shuffled. A blob that one row has is scanned where it stands; only texts of several rows meet, so each is scanned
    once. Combined before the shuffle, a hot text moves once a task.
    """
    several = todo.filter("copies > 1")
    if not whole:
        versions = split_by_bitmap(versions, membership_bitmap(todo, "blob_id"), F.col("blob_id")).filter("kf_maybe_").drop("kf_maybe_")
    marked = split_by_bitmap(versions, membership_bitmap(several, "blob_id"), F.col("blob_id"))
    alone = marked.filter("NOT kf_maybe_").select("blob_id", "text")
    met = marked.filter("kf_maybe_").groupBy("blob_id", "text").agg(F.count("*").alias("copies"))
    if whole:
        blobs = alone.withColumn("copies", F.lit(1).cast("long")).unionByName(met).withColumn("missing", F.array(*[F.lit(v) for v in rules]))
    else:
        blobs = alone.unionByName(met.drop("copies")).join(todo, "blob_id")
    rows = [F.when(F.array_contains("missing", v), F.struct(F.lit(v).alias("rule_version"), F.concat(*[rule_spans(F.col("text"), r) for r in group]).alias("spans"))) for v, group in rules.items()]
    return blobs.select("blob_id", "copies", F.explode(F.array_compact(F.array(*rows))).alias("row")).select("blob_id", "row.rule_version", "copies", "row.spans")


def findings(paths: DataFrame, ledger: DataFrame, rules: dict[str, tuple[Rule, ...]] = RULES) -> DataFrame:
    """Every row of paths (id, blob_id: a written table) with its blob's spans under the given rules, in order."""
    known = ledger.filter(F.col("rule_version").isin(*rules)).filter(F.size("spans") > 0)
    by_blob = known.groupBy("blob_id").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    sizes = paths.groupBy("blob_id").agg(F.count("*").alias("n"))
    out = join_hot(paths, materialize(by_blob.join(sizes, "blob_id"), "findings"), "blob_id", "left", total=paths.count())
    return out.withColumn("spans", F.coalesce("spans", F.array().cast(_SPANS))).drop("n")


def open_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger kept at path, empty if nothing was written there yet."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(place)
    return spark.read.schema(_LEDGER).parquet(path) if there else spark.createDataFrame([], _LEDGER)


def append_ledger(fresh: DataFrame, path: str) -> None:
    """Keep new ledger rows; what is there already is neither read nor written again."""
    fresh.write.mode("append").parquet(path)


@tidy
def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ledger: DataFrame | None = None, rules: dict[str, tuple[Rule, ...]] = RULES) -> tuple[DataFrame, DataFrame]:
    """(findings, new ledger rows) for every row of docs; a row is one historical version of a path.

    Texts are content-addressed where they stand. The pairs of blob and rule version that ledger lacks are found on ids
    alone, and only their texts are scanned. Findings: doc_id, blob_id, spans (array of start, order, end, kind, by
    start and kind). Repeated rows and rows of one text each get the findings of their blob; null text counts as empty
    and has none; a null id is kept. Other columns aren't read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    versions = docs.select(F.sha2(text, 256).alias("blob_id"), text.alias("text"))
    paths = materialize(docs.select(F.col(id_col).alias("doc_id"), F.sha2(text, 256).alias("blob_id")), "paths")
    todo = materialize(unseen(paths, ledger, rules), "todo")
    fresh = materialize(scan(versions, todo, ledger is None, rules), "ledger")
    whole = fresh if ledger is None else ledger.select(*fresh.columns).unionByName(fresh)
    return findings(paths, whole, rules), fresh


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, hash of the base spans and all spans as text."""
    base = F.filter("spans", lambda s: s["order"] < len(RULES[BASE]))
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda order: F.size(F.filter("spans", lambda s: s["order"] == order)).cast("long")
    counts = [count(r.order).alias(f"n_{r.kind}") for r in RULES[BASE]]
    return found.select("doc_id", *counts, F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))
