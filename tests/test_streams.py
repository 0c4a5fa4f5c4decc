"""The merging sink over restarts, and readers whose answers break off."""

from __future__ import annotations

from datetime import UTC, datetime

import pytest

from ballastry.sources import klines, store
from ballastry.streaming.candles import merge_into, read_merged

SCHEMA = "symbol string, open_time timestamp, close double"


def rows(spark, *triples):
    return spark.createDataFrame([(s, datetime.fromtimestamp(t, UTC), c) for s, t, c in triples], SCHEMA)


def content(df):
    return sorted((r["symbol"], int(r["open_time"].replace(tzinfo=UTC).timestamp()), r["close"]) for r in df.collect())


def test_new_stream_goes_on_after_an_old_one(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    first, second = merge_into(path, "one"), merge_into(path, "two")
    first(rows(spark, ("A", 1, 1.0)), 0)
    first(rows(spark, ("B", 1, 2.0)), 1)
    second(rows(spark, ("C", 1, 3.0)), 0)  # a new checkpoint numbers its batches from 0 again
    assert content(read_merged(spark, path)) == [("A", 1, 1.0), ("B", 1, 2.0), ("C", 1, 3.0)]


def test_replayed_batches_change_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    write = merge_into(path, "one")
    write(rows(spark, ("A", 1, 1.0)), 0)
    write(rows(spark, ("A", 1, 5.0)), 1)
    before = store.newest(spark, path)
    write(rows(spark, ("A", 1, 1.0)), 0)  # older than what is stored
    write(rows(spark, ("A", 1, 5.0)), 1)
    assert store.newest(spark, path) == before
    assert content(read_merged(spark, path)) == [("A", 1, 5.0)]


def test_batch_cut_off_while_written_is_written_again(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    write = merge_into(path, "one")
    write(rows(spark, ("A", 1, 1.0)), 0)
    write(rows(spark, ("B", 1, 2.0)), 1)
    (tmp_path / "t" / "manifests" / "v00000001.json").unlink()  # its data are there, but nothing says so
    assert content(read_merged(spark, path)) == [("A", 1, 1.0)]
    write(rows(spark, ("B", 1, 3.0)), 1)
    assert content(read_merged(spark, path)) == [("A", 1, 1.0), ("B", 1, 3.0)]


MONTH = 31 * 86_400


def test_only_touched_slices_are_written(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    first = [(s, k * MONTH + 5, 1.0) for s in ("A", "B/é=", "C", None) for k in range(4)]
    store.merge_version(rows(spark, *first), path)
    files = lambda: {p.relative_to(tmp_path): p.stat().st_mtime_ns for p in tmp_path.rglob("part-*.parquet")}
    before = files()
    assert len(before) == 16
    made = store.merge_version(rows(spark, ("A", 2 * MONTH + 5, 7.0), ("A", 2 * MONTH + 6, 8.0)), path)
    after = files()
    assert len(after) == 17 and before.items() <= after.items()
    assert sorted(made.live.values()) == [0] * 15 + [1]
    want = {(s, t): c for s, t, c in first} | {("A", 2 * MONTH + 5): 7.0, ("A", 2 * MONTH + 6): 8.0}
    got = {(r["symbol"], int(r["open_time"].replace(tzinfo=UTC).timestamp())): r["close"] for r in read_merged(spark, path).collect()}
    assert got == want
    assert store.vacuum(spark, path) == 1 and store.vacuum(spark, path) == 0
    assert len(files()) == 16 and len(list((tmp_path / "t" / "manifests").glob("*.json"))) == 1
    assert read_merged(spark, path).count() == 17


def test_replaced_symbols_let_go_of_all_their_slices(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    store.merge_version(rows(spark, *[(s, k * MONTH, 1.0) for s in "AB" for k in range(3)]), path)
    store.merge_version(rows(spark, ("A", 9 * MONTH, 2.0)), path, mode="replace_symbol")
    assert content(read_merged(spark, path)) == [("A", 9 * MONTH, 2.0), *[("B", k * MONTH, 1.0) for k in range(3)]]
    with pytest.raises(KeyError):
        store.merge_version(rows(spark, ("A", 1, 2.0)), path, mode="other")


def test_empty_batches_and_second_writers(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    write = merge_into(path, "one")
    write(rows(spark), 0)
    assert content(read_merged(spark, path)) == []
    write(rows(spark, ("A", 1, 1.0)), 1)
    write(rows(spark), 2)
    assert content(read_merged(spark, path)) == [("A", 1, 1.0)] and store.newest(spark, path).batches == {"one": 2}
    stale = store.Manifest(2, {}, "{}", {})
    with pytest.raises(RuntimeError):
        store._commit(spark, path, stale)
    with pytest.raises(FileNotFoundError):
        read_merged(spark, f"file://{tmp_path}/none")


def test_real_streams_with_two_checkpoints(spark, tmp_path):
    path, source = f"file://{tmp_path}/t", f"{tmp_path}/in"
    for k, name in enumerate("ABC"):
        rows(spark, (name, 1, float(k))).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        checkpoint = f"{tmp_path}/c{k % 2}"
        query = stream.writeStream.foreachBatch(merge_into(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    assert [r[0] for r in content(read_merged(spark, path))] == ["A", "B", "C"]


def page(start, n):
    return [[start + k, "1", "2", "0.5", "1.5", "10", start + k + 1, "15", 3, "5", "7", "0"] for k in range(n)]


def breaking(url, params):
    """Symbol GOOD answers in full; HALF fails on its second page; ODD has a row that is too short."""
    start = int(params["startTime"])
    if params["symbol"] == "HALF" and start > 0:
        raise OSError("connection lost")
    if params["symbol"] == "ODD":
        return [*page(start, 3), [start + 3]]
    if params["symbol"] == "NONE":
        return {"code": -1121, "msg": "Invalid symbol."}
    return page(start, 1_000) if start == 0 else []


@pytest.mark.parametrize("partitions", [1, 4])
def test_symbols_come_whole_or_not_at_all(spark, partitions):
    got = klines.historical_klines(spark, ["GOOD", "HALF", "ODD", "NONE"], "1d", "1970-01-01", "2000-01-01", "http://x", transport="test_streams:breaking", pause=0, partitions=partitions)
    assert {(r["symbol"], r["count"]) for r in got.groupBy("symbol").count().collect()} == {("GOOD", 1_000)}
