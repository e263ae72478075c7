import pytest
from pyspark.errors import PySparkException

from graphloom.llm import token_rollups as t


def changes(spark, *rows):
    return spark.createDataFrame([("a", "en", "v1", *r) for r in rows], t.CHANGES)


def totals(store):
    return sorted(tuple(r) for r in store.totals().collect())


def test_batches_count_once(spark, tmp_path):
    s = t.RollupStore(spark, str(tmp_path / "s"))
    assert totals(s) == []
    assert s.commit(0, changes(spark, ("insert", 10, None), ("insert", 5, None)))
    assert totals(s) == [("a", "en", "v1", 2, 15)]
    assert not s.commit(0, changes(spark, ("insert", 100, None)))
    assert s.commit(1, changes(spark, ("revise", 7, 5), ("delete", 10, None)))
    assert totals(s) == [("a", "en", "v1", 1, 7)]
    s.compact()
    assert totals(s) == [("a", "en", "v1", 1, 7)] and s.batches() == [0, 1]
    assert not s.commit(1, changes(spark, ("insert", 100, None)))
    assert s.commit(5, changes(spark, ("delete", 7, None)))
    assert totals(s) == []
    s.compact()
    assert totals(s) == [] and s.batches() == [0, 1, 5]


def test_same_totals_in_any_order(spark, tmp_path):
    parts = [changes(spark, ("insert", 3, None)), changes(spark, ("revise", 9, 3)), changes(spark, ("insert", 1, None), ("delete", 1, None))]
    seen = set()
    for k, order in enumerate(((0, 1, 2), (2, 1, 0))):
        s = t.RollupStore(spark, str(tmp_path / f"o{k}"))
        for b in order:
            s.commit(b, parts[b])
        seen.add(str(totals(s)))
    assert seen == {str([("a", "en", "v1", 1, 9)])}


def test_nulls_are_keys_and_zero(spark, tmp_path):
    s = t.RollupStore(spark, str(tmp_path / "n"))
    s.commit(0, spark.createDataFrame([(None, None, None, "insert", None, None)], t.CHANGES))
    s.commit(1, spark.createDataFrame([], t.CHANGES))
    assert totals(s) == [(None, None, None, 1, 0)]


def test_unknown_changes_fail(spark, tmp_path):
    s = t.RollupStore(spark, str(tmp_path / "u"))
    with pytest.raises(PySparkException):
        s.commit(0, changes(spark, ("add", 1, None)))
    assert s.batches() == []
    with pytest.raises(ValueError):
        s.commit(-1, changes(spark))
