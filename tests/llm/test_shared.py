from __future__ import annotations

import pyarrow as pa
import pytest

from lexigrid.llm import _shared


def test_batches_are_cut_by_rows_and_bytes():
    texts = ["a" * n for n in (5, 400, 0, 3, 90, 30, 2, 2, 2, 2)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["i", "t"])
    got = list(_shared.bounded([batch, batch.slice(3, 1)], rows=3, size=100))
    assert [b.num_rows for b in got] == [1, 1, 3, 3, 3, 1]
    assert [t for b in got[:-1] for t in b.column(1).to_pylist()] == texts
    assert all(b.num_rows == 1 or sum(len(t or "") for t in b.column(1).to_pylist()) <= 100 for b in got)
    lists = pa.RecordBatch.from_arrays([pa.array([[1] * 50, None, [2] * 60])], ["x"])
    assert [b.num_rows for b in _shared.bounded([lists], size=500)] == [2, 1]
    numbers = pa.RecordBatch.from_arrays([pa.array(range(5000))], ["i"])
    assert [b.num_rows for b in _shared.bounded([numbers])] == [5000]


def test_session_settings_stay(spark, docs):
    from lexigrid.llm import simhash

    before = dict(spark.sparkContext.getConf().getAll()) | {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", _shared._CLEANUP)}
    simhash.near_groups(docs).count()
    assert before == dict(spark.sparkContext.getConf().getAll()) | {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", _shared._CLEANUP)}


class _Cluster:
    """A session whose master is not local and that has no shared folder."""

    class conf:
        @staticmethod
        def get(key, default=None):
            return default

    class sparkContext:
        master = "spark://somewhere:7077"

        class _jsc:
            class sc:
                class getCheckpointDir:
                    @staticmethod
                    def isDefined():
                        return False


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        _shared.shared_root(_Cluster)
    assert _shared.is_local("local") and _shared.is_local("local[8]") and not _shared.is_local("local-cluster[3,2,1000]") and not _shared.is_local("yarn")
