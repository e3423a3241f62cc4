"""Session-level plumbing: shared folder, written intermediates, skew-safe joins."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder and all tasks run on this machine (tests, local runs).
LOCAL_SHARED = "file:///tmp/checkpoints"
#: A key is hot when it holds at least 1/HOT_SHARE of all rows, so there are at most HOT_SHARE hot keys.
HOT_SHARE = 1000
#: Bits of the membership bitmap: 1024 rows of 4 KB, 4 MB whatever the input.
BITMAP_BUCKETS, BITMAP_BITS = 1024, 32768
#: Bytes of texts that go to Python at once, of 64 MB that Spark takes else: each of a machine's tasks holds several
#: copies of them, on both sides.
TEXT_BATCH, _BATCH_SETTING = "4m", "spark.sql.execution.arrow.maxBytesPerBatch"


#: Names of the written intermediates that the calls on the way have made and not deleted yet.
_made: list[str] = []
_NAME = re.compile("kinfold-[0-9a-f]{32}")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, as the session or its context names it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and (set_ := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        found = set_.get()
    if not found and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    return (found or LOCAL_SHARED).rstrip("/")


def folder(spark: SparkSession) -> str:
    """A new folder for intermediates. It is deleted when the application's process ends, if not before."""
    name = f"kinfold-{uuid.uuid4().hex}"
    path, fs = _path(spark, name)
    fs.deleteOnExit(path)
    _made.append(name)
    return f"{shared_dir(spark)}/{name}"


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
    return path, path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def materialize(df: DataFrame, name: str, texts: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here and a lost executor costs a re-read.

    texts: df comes from Arrow functions over whole texts, which get them in batches of TEXT_BATCH while it is written.
    """
    path, conf = f"{folder(df.sparkSession)}/{name}", df.sparkSession.conf
    before = conf.get(_BATCH_SETTING) if texts else None
    if texts:
        conf.set(_BATCH_SETTING, TEXT_BATCH)
    try:
        df.write.parquet(path)
    finally:
        if texts:
            conf.set(_BATCH_SETTING, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _reads(df: DataFrame) -> set[str]:
    """Names of the intermediates that df's plan reads."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    return {name for i in range(leaves.size()) if (leaf := leaves.apply(i)).getClass().getSimpleName() == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation" for name in _NAME.findall(leaf.relation().location().rootPaths().toString())}


def _delete(spark: SparkSession, names: list[str]) -> None:
    for name in names:
        path, fs = _path(spark, name)
        fs.delete(path, True)
        fs.cancelDeleteOnExit(path)
        _made[:] = [x for x in _made if x != name]


def discard(df: DataFrame) -> None:
    """Delete what materialize() wrote, once nothing reads it any more."""
    _delete(df.sparkSession, sorted(_reads(df)))


def tidy(f: Callable) -> Callable:
    """f, which returns a DataFrame or several; intermediates it wrote that none of them reads are deleted on return."""

    @wraps(f)
    def call(*args, **named):
        before = len(_made)
        out = f(*args, **named)
        frames = [x for x in (out if isinstance(out, tuple) else (out,)) if isinstance(x, DataFrame)]
        still = set().union(*map(_reads, frames))
        _delete(frames[0].sparkSession, [x for x in _made[before:] if x not in still])
        return out

    return call


def spread(df: DataFrame) -> DataFrame:
    """A table as read, its rows dealt to all cores if its files give fewer tasks; for work that takes long a row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(cores)


def join_hot(left: DataFrame, right: DataFrame, on: str, how: str = "left", n: str = "n", total: int | None = None) -> DataFrame:
    """Join left to right, which has one row a key and in ``n`` how many rows of left hold that key.

    Keys that hold 1/1000 of all rows or more (so 1000 rows of right at most) are broadcast; the others are
    shuffled. Both sides are read twice and ought to be written tables. Null keys match nothing.
    """
    total = total if total is not None else (right.agg(F.sum(n)).first()[0] or 0)
    is_hot = F.col(n) * HOT_SHARE >= max(total, 1)
    hot, cold = right.filter(is_hot), right.filter(~is_hot)
    first = left.join(F.broadcast(hot), on, "inner")
    rest = left.join(F.broadcast(hot.select(on)), on, "left_anti").join(cold, on, how)
    return first.unionByName(rest)


def membership_bitmap(values: DataFrame, value: str) -> DataFrame:
    """A one-hash filter of a long column: 1024 rows (bucket, bits) at most, so it may be broadcast at any size.

    It lets through every value it was made from, and others more often as it fills; an exact step has to follow.
    """
    at = F.pmod(F.xxhash64(value), F.lit(BITMAP_BUCKETS * BITMAP_BITS))
    return values.groupBy((at / BITMAP_BITS).cast("int").alias("kf_bucket_")).agg(F.bitmap_construct_agg(at % BITMAP_BITS).alias("kf_bits_"))


def split_by_bitmap(df: DataFrame, bitmap: DataFrame, value: Column) -> DataFrame:
    """df with a column ``kf_maybe_``: false where the value is certainly not among those of the bitmap."""
    at = F.pmod(F.xxhash64(value), F.lit(BITMAP_BUCKETS * BITMAP_BITS))
    inside = (at % BITMAP_BITS).cast("int")
    marked = df.withColumn("kf_bucket_", (at / BITMAP_BITS).cast("int")).withColumn("kf_at_", inside).join(F.broadcast(bitmap), "kf_bucket_", "left")
    byte = F.conv(F.hex(F.substring("kf_bits_", (F.col("kf_at_") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.expr("shiftright(kf_byte_, kf_at_ % 8) & 1")
    return marked.withColumn("kf_byte_", byte).withColumn("kf_maybe_", F.coalesce(bit == 1, F.lit(False))).drop("kf_bucket_", "kf_at_", "kf_bits_", "kf_byte_")


def anti_join_ids(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows of df whose key isn't in gone; only rows that the bitmap can't clear are shuffled. Null keys stay."""
    marked = split_by_bitmap(df, membership_bitmap(gone, key), F.col(key))
    clear = marked.filter(~F.col("kf_maybe_")).drop("kf_maybe_")
    names = [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]
    return clear.select(*names).unionByName(marked.filter("kf_maybe_").drop("kf_maybe_").join(gone.select(key), key, "left_anti").select(*names))
