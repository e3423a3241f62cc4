import math
import random

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from kinfold.llm import queries, topk


def test_boundary_holds_the_best_rows():
    rng = np.random.default_rng(0)
    for n, scale in ((5, 10), (300, 3), (1000, 500), (1000, 100_000)):
        rows = rng.integers(-scale, scale + 1, (n, 12))
        rows[: n // 3] = rows[0]
        index = topk.BitSlicedIndex(rows)
        for query in rng.integers(-scale, scale + 1, (10, 12)):
            scores = rows @ query
            at = set(index.boundary(query, 10).tolist())
            least = np.sort(scores)[::-1][min(9, n - 1)]
            assert {i for i in range(n) if scores[i] >= least} <= at


def brute(rows, is_query, k):
    ints = {i: [math.floor(1024 * x) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for q in ints:
        if is_query(q):
            best = sorted((-sum(a * b for a, b in zip(ints[q], ints[c])), c) for c in ints if c != q)[:k]
            out |= {(q, n + 1, c, -s) for n, (s, c) in enumerate(best)}
    return out


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "INDEX_ROWS", 100)
    monkeypatch.setattr(topk, "QUERY_ROWS", 4)
    rng = random.Random(1)
    f32 = lambda x: float(np.float32(x))
    rows = [(i, [f32(rng.gauss(0, 0.2)) for _ in range(8)]) for i in range(400)]
    rows += [(i, rows[20][1]) for i in range(400, 600)]  # a hot vector, tied everywhere
    rows += [(700, None), (701, [None] * 8), (702, [float("nan")] * 8), (703, [float("inf")] * 8), (None, [0.5] * 8), (704, [0.5]), (720, [])]
    docs = spark.createDataFrame([r + (1,) for r in rows], "vec_id long, embedding array<float>, v int")
    found = topk.top_k(docs, F.col("vec_id") % 20 == 0).collect()
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in found} == brute(rows, lambda q: q % 20 == 0, 10)


def test_few_candidates_and_empty(spark):
    schema = "vec_id long, embedding array<float>"
    found = topk.top_k(spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [-1.0])], schema), F.col("vec_id") == 0).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in sorted(found, key=lambda r: r["rank"])] == [(0, 1, 1, 2 * 1024**2), (0, 2, 2, -(1024**2))]
    assert topk.top_k(spark.createDataFrame([], schema), F.col("vec_id") == 0).collect() == []


def test_repeated_ids_and_large_components(spark):
    """Equal to the SQL twin where that can hold the numbers."""
    rng = random.Random(5)
    rows = [(rng.randrange(130), [rng.choice([rng.uniform(-1, 1), rng.uniform(-(2.0**20), 2.0**20)]) for _ in range(6)]) for _ in range(200)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").createOrReplaceTempView("e")
    found = topk.top_k(spark.table("e"), F.col("vec_id") % 100 == 0).collect()
    db = duckdb.connect()
    table = pa.table({"vec_id": [r[0] for r in rows], "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float32()))})
    db.register("embeddings", table)
    want = db.sql(queries.ORACLE_SQL["op1_topk"]).fetchall()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found) == sorted(want)


def test_integers_of_any_size(spark):
    schema = "vec_id long, embedding array<double>"
    rows = [(0, [1.0]), (1, [2.0**31]), (2, [2.0**32]), (3, [2.0**60]), (4, [2.0**60 + 2.0**10]), (5, [-(2.0**70)]), (6, [1e300]), (7, [-5.0]), (8, [2.0**32])]
    found = topk.top_k(spark.createDataFrame(rows, schema), F.col("vec_id") == 0).collect()
    whole = lambda x: math.floor(1024 * x) if abs(x) < 2**53 else 1024 * int(x)
    want = sorted((-1024 * whole(v[0]), i) for i, v in rows if i)
    assert [(r.vec_id, r.score) for r in sorted(found, key=lambda r: r["rank"])] == [(i, -s if -(2**63) <= -s < 2**63 else None) for s, i in want]


def test_scores_do_not_wrap():
    rng = np.random.default_rng(2)
    rows, query = rng.integers(-(2**61), 2**61, (50, 4)), rng.integers(-(2**61), 2**61, 4)
    want = [sum(a * b for a, b in zip(r, query.tolist())) for r in rows.tolist()]
    assert topk.exact_scores(rows, query).tolist() == want
    at = topk.BitSlicedIndex(rows).boundary(query, 5)
    assert set(sorted(range(50), key=lambda i: -want[i])[:5]) <= set(at.tolist())
