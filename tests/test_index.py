"""Status and reset of an index."""

import pytest

from spanloom.operators import index


def test_last_sync(spark):
    logs = [("a", 1, "old"), ("a", 2, '{"added": 3}'), ("b", 5, "Traceback\n" + "x" * 150 + "y" * 200 + "\n  \n"), ("c", 1, " \n"), ("d", 1, None)]
    found = {r["index"]: (r["at"], r["report"], r["error"]) for r in index.last_sync(spark.createDataFrame(logs, "index string, at long, text string")).collect()}
    assert found == {"a": (2, '{"added": 3}', None), "b": (5, None, "y" * 200), "c": (1, None, "empty log"), "d": (1, None, "empty log")}


def test_reset(spark):
    chunks = {"chunks": spark.createDataFrame([("p", 1)], "path string, n int")}
    cache = spark.createDataFrame([("h", 0)], "content_hash string, seq int")
    stamp = spark.createDataFrame([("m", "1")], "model string, engine string")
    assert index.model_mismatch(stamp, "m", "1") is None and index.model_mismatch(stamp.limit(0), "m", "2") is None
    other = index.model_mismatch(stamp, "m", "2")
    assert "m (1)" in other
    with pytest.raises(ValueError):
        index.reset(chunks, cache, other)
    counts = lambda mismatch, force: [x.count() for x in (lambda t, c: (t["chunks"], c))(*index.reset(chunks, cache, mismatch, force))]
    assert counts(None, False) == [1, 1] and counts(None, True) == [0, 1] and counts(other, True) == [0, 0]
