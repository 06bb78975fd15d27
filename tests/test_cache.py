"""Tables shared between sessions: found again, made anew when the source or the parameters change, evicted."""
from dataclasses import replace

import pytest

from stillvalid.plans.monitor import Monitor
from stillvalid.sources.cache import TableCache
from stillvalid.sources.stream_log import StreamSpec

SPEC = StreamSpec(name="t", table="t", stream="s", order=("i",), time="i", target="y", score_key="k", window=5)


@pytest.fixture
def source(spark, tmp_path):
    def write(n):
        path = str(tmp_path / "source")
        spark.createDataFrame([("a", i, float(i % 7), str(i % 2)) for i in range(n)], "s string, i long, y double, k string").write.mode("overwrite").parquet(path)
        return path
    return write


def test_second_session_builds_nothing(spark, source, tmp_path):
    path, root = source(200), f"file://{tmp_path}/cache"
    first = Monitor(spark.read.parquet(path), SPEC, TableCache(spark, root))
    risk, states = first.risk.collect(), first.states.collect()
    assert "states" in first.cache.built and not first.cache.reused
    other = spark.newSession()
    again = Monitor(other.read.parquet(path), SPEC, TableCache(other, root))
    assert sorted(again.risk.collect()) == sorted(risk) and sorted(again.states.collect()) == sorted(states)
    assert again.cache.built == [] and set(again.cache.reused) == {"risk", "states"}
    assert again.risk.schema == first.risk.schema


def test_other_parameters_and_changed_sources_are_other_tables(spark, source, tmp_path):
    root = str(tmp_path / "cache")
    df = spark.read.parquet(source(200))
    Monitor(df, SPEC, TableCache(spark, root)).risk
    wide = Monitor(df, replace(SPEC, window=10), TableCache(spark, root))
    few = Monitor(df.filter("i < 150"), SPEC, TableCache(spark, root))
    assert wide.risk.count() != few.risk.count() and "risk" in wide.cache.built and "risk" in few.cache.built
    longer = Monitor(spark.read.parquet(source(300)), SPEC, TableCache(spark, root))
    assert longer.risk.count() == 300 * 4 // 5 // 5 and "risk" in longer.cache.built
    cache = TableCache(spark, root)
    assert len(cache.entries()) == 4 and cache.evict(3600) == []
    assert len(cache.evict(0)) == 4 and cache.entries() == []
    with pytest.raises(ValueError, match="no files"):
        cache.key(spark.range(3), "x")


def test_the_first_of_two_builders_wins(spark, tmp_path):
    cache = TableCache(spark, str(tmp_path / "cache"))

    def slow():
        TableCache(spark, cache.root).table("k", "t", lambda: spark.range(3))   # another session is faster
        return spark.range(5)

    assert cache.table("k", "t", slow).count() == 3 and cache.built == [] and cache.reused == ["t"]
    assert [e["labels"] for e in cache.entries()] == [["t"]]
