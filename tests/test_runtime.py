import os

import pytest

from kinfold import runtime
from kinfold.operators.components import component_ids


@pytest.fixture
def shared(monkeypatch, tmp_path):
    monkeypatch.setattr(runtime, "shared_dir", lambda spark: str(tmp_path))
    return str(tmp_path)


def test_only_what_the_result_reads_is_left(spark, shared):
    found = component_ids(spark.createDataFrame([(i, i + 1) for i in range(40)] + [(90, 91)], "a long, b long"))
    assert len(os.listdir(shared)) <= 3
    assert {r.component for r in found.collect()} == {0, 90}


def test_discard_and_tidy(spark, shared):
    kept = runtime.materialize(spark.range(3), "kept")

    @runtime.tidy
    def query():
        runtime.materialize(spark.range(5), "passing")
        left, right = (runtime.materialize(spark.range(n), "end") for n in (7, 8))
        return left.join(right, "id"), kept

    found, same = query()
    assert len(os.listdir(shared)) == 3 and found.count() == 7 and same.count() == 3
    runtime.discard(found)
    assert len(os.listdir(shared)) == 1


def test_a_cluster_needs_a_shared_folder(spark):
    class Far:
        """A session on a cluster without the setting."""

        class sparkContext:  # noqa: N801
            master = "spark://somewhere"
            _jsc = spark.sparkContext._jsc
            getConf = staticmethod(lambda: {})

        conf = {}

    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        with pytest.raises(RuntimeError):
            runtime.shared_dir(Far)


def test_texts_go_to_python_in_small_batches(spark, shared):
    import pyarrow as pa

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    key, texts = "spark.sql.execution.arrow.maxBytesPerBatch", spark.range(0, 24, 1, 1).selectExpr("repeat('x', 1000000) AS text")
    before = spark.conf.get(key)
    small = [r.n for r in runtime.materialize(texts.mapInArrow(sizes, "n long"), "small", texts=True).collect()]
    assert sum(small) >= 24_000_000 and max(small) <= 6_000_000
    assert spark.conf.get(key) == before
    assert runtime.materialize(texts.mapInArrow(sizes, "n long"), "whole").count() == 1
