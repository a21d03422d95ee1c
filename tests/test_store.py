"""The bar store: delta files, merge on read, compaction, and commits that survive failures."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tickloom.session import scratch
from tickloom.sources import store
from tickloom.streaming import jobs

BAR = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double, oi double, value double, seq int"


def bars(spark, days, close, symbols=("A", "B"), seq=0):
    rows = [(s, dt.datetime.combine(d, dt.time()), close, close, close, close, 1.0, None, close, seq) for s in symbols for d in days]
    return spark.createDataFrame(rows, BAR)


def month(m, n=5):
    return [dt.date(2020, m, d + 1) for d in range(n)]


def rows(df):
    return sorted((r["symbol"], r["ts"].date(), r["close"]) for r in df.collect())


def files(df):
    return {f.split("/data/")[1].rsplit("/", 1)[0] for f in df.inputFiles()}


def months_of(df):
    return sorted({f.split("month=")[1] for f in files(df)})


@pytest.fixture
def path(spark):
    p = scratch(spark, "test-store")
    store.write_bars(spark, bars(spark, month(1) + month(2) + month(3), 1.0), p, "1d", "b1")
    return p


def test_a_batch_writes_its_own_months_alone(spark, path):
    before = files(store.read_bars(spark, path))
    store.write_bars(spark, bars(spark, month(2, 2), 2.0, ("A",)), path, "1d", "b2")
    new = files(store.read_bars(spark, path)) - before
    assert {f.split("month=")[1] for f in new} == {"2020-02"} and before <= files(store.read_bars(spark, path))
    got = dict(((s, d), c) for s, d, c in rows(store.read_bars(spark, path)))
    assert len(got) == 30 and sum(c == 2.0 for c in got.values()) == 2 and got["A", dt.date(2020, 2, 1)] == 2.0


def test_a_range_scan_opens_its_months_alone(spark, path):
    part = store.read_bars(spark, path, ["A", "NOWHERE"], "2020-02-02", "2020-02-28")
    assert months_of(part) == ["2020-02"]
    assert rows(part) == [("A", d, 1.0) for d in month(2)[1:]]
    assert store.read_bars(spark, path, start="2021-01-01").count() == 0
    assert store.read_bars(spark, path, freq="5m").count() == 0
    assert store.read_bars(spark, scratch(spark, "test-none")).count() == 0


def test_months_of_one_batch_are_not_merged(spark, path, capsys):
    store.write_bars(spark, bars(spark, month(3, 1), 3.0), path, "1d")
    store.read_bars(spark, path, end="2020-02-28").explain()
    assert "Exchange" not in capsys.readouterr().out


def test_compaction_keeps_the_rows(spark, path):
    for k in range(3):
        store.write_bars(spark, bars(spark, month(2, k + 1), 10.0 + k), path, "1d")
    want = rows(store.read_bars(spark, path))
    assert store.compact(spark, path)
    assert rows(store.read_bars(spark, path)) == want
    assert len([f for f in files(store.read_bars(spark, path)) if "2020-02" in f]) == 1
    assert not store.compact(spark, path)
    store.write_bars(spark, bars(spark, month(2, 1), 99.0), path, "1d")
    assert sum(c == 99.0 for _, _, c in rows(store.read_bars(spark, path))) == 2


def test_a_batch_published_during_a_compaction_wins(spark, path, monkeypatch):
    store.write_bars(spark, bars(spark, month(2, 1), 5.0), path, "1d")
    publish = store.publish

    def slow(spark_, where, entry):
        monkeypatch.setattr(store, "publish", publish)
        store.write_bars(spark_, bars(spark_, month(2, 1), 7.0), where, "1d")
        return publish(spark_, where, entry)

    monkeypatch.setattr(store, "publish", slow)
    store.compact(spark, path)
    assert {c for _, d, c in rows(store.read_bars(spark, path)) if d == dt.date(2020, 2, 1)} == {7.0}


def test_a_number_taken_meanwhile_is_skipped(spark, path, monkeypatch):
    seen = store.manifest(spark, path)
    calls = iter([seen[:0], seen])  # the first look misses the entry that exists
    real = store.manifest
    monkeypatch.setattr(store, "manifest", lambda *a: next(calls, None) or real(*a))
    assert store.publish(spark, path, {"batch": "x", "folder": "x", "freq": "1d", "months": [], "replaces": [], "as_of": None})
    assert [e["number"] for e in real(spark, path)] == [1, 2]


def test_freq_and_repeated_rows(spark, path):
    twice = bars(spark, month(4, 1), 1.0).union(bars(spark, month(4, 1), 8.0, seq=1)).withColumnRenamed("seq", "_seq")
    store.write_bars(spark, twice, path, "5m")
    assert {c for _, _, c in rows(store.read_bars(spark, path, freq="5m"))} == {8.0}
    assert store.read_bars(spark, path).count() == 30


def land(spark, root):
    query = jobs.land_increment(spark, f"{root}/in", spark.createDataFrame([], BAR).schema, f"{root}/store", f"{root}/checkpoint")
    query.awaitTermination()


@pytest.mark.parametrize("after", [False, True])
def test_a_failed_landing_replays_to_the_same_store_and_audit(spark, monkeypatch, after):
    """The first try dies before or after the entry is published, the checkpoint not written either way."""
    root = scratch(spark, "test-land")
    bars(spark, month(1), 1.0).write.parquet(f"{root}/in")
    write = store.publish

    def dies(spark_, where, entry):
        if after:
            write(spark_, where, entry)
        raise RuntimeError("lost the driver")

    monkeypatch.setattr(store, "publish", dies)
    with pytest.raises(Exception, match="lost the driver"):
        land(spark, root)
    monkeypatch.setattr(store, "publish", write)
    assert store.read_bars(spark, f"{root}/store").count() == (10 if after else 0)
    for _ in range(2):
        land(spark, root)
    assert rows(store.read_bars(spark, f"{root}/store")) == [(s, d, 1.0) for s in "AB" for d in month(1)]
    audit = store.read_audit(spark, f"{root}/store")
    assert sorted((r["symbol"], r["rows"]) for r in audit.collect()) == [("A", 5), ("B", 5)]
    bars(spark, month(1, 2), 2.0, seq=1).write.mode("append").parquet(f"{root}/in")
    land(spark, root)
    assert sum(c == 2.0 for _, _, c in rows(store.read_bars(spark, f"{root}/store"))) == 4
    assert audit.count() == 2 and store.read_audit(spark, f"{root}/store").agg(F.sum("rows")).first()[0] == 14
