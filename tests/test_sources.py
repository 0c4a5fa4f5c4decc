"""Sources with recorded payloads, upserts, streams, and the entry module."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from ballastry.sources import klines, prices, store
from ballastry.streaming.candles import candles, merge_into, read_merged

DAY = 86_400_000


def page(start: int, n: int) -> list:
    return [[start + k * DAY, "1.0", "2.0", "0.5", "1.5", "10", start + k * DAY + DAY - 1, "15", 3, "4", "6", "0"] for k in range(n)]


def test_pages_go_on_after_the_last_candle():
    asked = []

    def fetch(url, parameters):
        asked.append(parameters["startTime"])
        return {0: page(0, 3), 2 * DAY + 1: page(3 * DAY, 1)}.get(parameters["startTime"], [])

    rows = list(klines.pages(fetch, "u", "A", "1d", 0, 10 * DAY, pause=0))
    assert len(rows) == 4 and asked == [0, 2 * DAY + 1, 3 * DAY + 1]
    row = klines.candle("A", rows[0])
    assert row[0] == "A" and row[2:7] == (1.0, 2.0, 0.5, 1.5, 10.0) and row[9] == 3


def test_payloads(spark):
    got = klines.parse_klines(spark.createDataFrame([("A", json.dumps(page(DAY, 2))), ("B", "[]")], "symbol string, payload string")).collect()
    assert len(got) == 2 and got[0]["close"] == 1.5 and got[0]["num_trades"] == 3
    info = spark.createDataFrame([(json.dumps({"symbols": [{"symbol": "AUSDT"}, {"symbol": "AB"}]}),)], "payload string")
    assert [r["symbol"] for r in klines.quoted_symbols(info).collect()] == ["AUSDT"]
    wanted = spark.createDataFrame([(1, "AUSDT"), (2, "X"), (3, "AUSDT")], "ordinal long, symbol string")
    assert [r["ordinal"] for r in klines.existing_symbols(wanted, klines.quoted_symbols(info)).collect()] == [1, 3]
    data = {"prices": [[0, 1.0], [DAY, 2.0]], "market_caps": [[DAY, 9.0]]}
    rows = prices.parse_history(spark.createDataFrame([("c", json.dumps(data))], "coin_id string, payload string")).orderBy("timestamp").collect()
    assert [(r["price"], r["market_cap"], r["volume"]) for r in rows] == [(1.0, None, None), (2.0, 9.0, None)]


def test_listing(spark):
    listing = spark.createDataFrame([("a", "usdt", "A", 9.0), ("b", "bb", "B", None), ("c", "cc", "C", 5.0)], "id string, symbol string, name string, market_cap double")
    assert [(r["symbol"], r["market_cap"]) for r in prices.without_stable(prices.top_coins(listing)).collect()] == [("CC", 5.0), ("BB", 0.0)]
    names = spark.createDataFrame([("btc",), ("ETHUSDT",)], "s string").select(prices.quoted_name(F.col("s")).alias("q"))
    assert [r["q"] for r in names.collect()] == ["BTCUSDT", "ETHUSDT"]
    history = spark.createDataFrame([(c, dt.datetime(2024, 1, k + 1), float(k + 1)) for c in "bc" for k in range(3)], "coin_id string, timestamp timestamp, price double")
    out = prices.dataset(listing, history, n=2).collect()
    assert {r["symbol"] for r in out} == {"CCUSDT", "BBUSDT"} and len(out) == 4


def test_upsert(spark):
    schema = "symbol string, open_time long, close double"
    old = spark.createDataFrame([("A", k, 1.0) for k in range(4)] + [("B", 0, 1.0)], schema)
    new = spark.createDataFrame([("A", 3, 2.0), ("A", 4, 2.0)], schema)
    merged = sorted(map(tuple, store.upsert(old, new).collect()))
    assert merged == [("A", 0, 1.0), ("A", 1, 1.0), ("A", 2, 1.0), ("A", 3, 2.0), ("A", 4, 2.0), ("B", 0, 1.0)]
    assert sorted(map(tuple, store.upsert(old, new, "replace_symbol").collect())) == [("A", 3, 2.0), ("A", 4, 2.0), ("B", 0, 1.0)]
    with pytest.raises(KeyError):
        store.upsert(old, new, "other")


def test_files(spark, tmp_path):
    rows = klines.parse_klines(spark.createDataFrame([("A", json.dumps(page(DAY, 2)))], "symbol string, payload string"))
    for kind in ("csv", "parquet"):
        path = f"{tmp_path}/{kind}"
        store.write_table(rows, path, kind)
        store.write_table(rows.limit(0), path, kind, mode="ignore")
        assert store.read_klines(spark, path, kind).count() == 2
    assert {r["symbol"]: r["start"] for r in store.resume_points(rows).collect()} == {"A": 2 * DAY}


def test_stream_merges_candles(spark, tmp_path):
    source, target = f"{tmp_path}/ticks", f"{tmp_path}/candles"
    schema = "symbol string, ts timestamp, value double"
    at = lambda h, m: dt.datetime(2024, 1, 1, h, m)
    spark.createDataFrame([("A", at(0, 5), 1.0), ("A", at(0, 50), 3.0), ("A", at(5, 0), 2.0)], schema).write.parquet(source)
    stream = candles(spark.readStream.schema(schema).parquet(source), late="1 hour")
    query = stream.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/state").foreachBatch(merge_into(target)).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {r["open_time"].hour: (r["open"], r["close"], r["num_trades"]) for r in read_merged(spark, target).collect()}
    assert len(got) == 2 and (1.0, 3.0, 2) in got.values()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns
    assert set(entry.oracle_sql()) <= set(entry.queries())


def recorded(url, parameters):
    """A transport: daily candles up to the end asked for, one symbol that fails, one that answers no JSON."""
    import json as decoder

    if "listing" in url:
        return [{"id": c, "symbol": s, "name": c, "market_cap": m} for c, s, m in (("a", "aa", 9.0), ("t", "usdt", 8.0), ("b", "bb", None))]
    if "history" in url:
        if url.endswith("/b"):
            decoder.loads("<html>")
        return {"prices": [[k * DAY, 1.0 + k] for k in range(3)]}
    if parameters["symbol"] == "BAD":
        raise OSError("no answer")
    if parameters["symbol"] == "HTML":
        decoder.loads("<html>")
    first = -(-parameters["startTime"] // DAY)
    n = min(2, parameters["endTime"] // DAY - first)
    return page(first * DAY, n) if n > 0 else []


def test_collect_goes_on_where_it_ended(spark, tmp_path):
    from ballastry.sources.collect import collect

    here = f"file://{tmp_path}/k"
    call = lambda end, mode="merge": collect(spark, here, ["A", "BAD", "HTML", "C"], "1970-01-01", end, "u", transport="test_sources:recorded", pause=0, partitions=2, mode=mode)
    assert [r["n"] for r in call("1970-01-06").groupBy("symbol").agg(F.count("*").alias("n")).orderBy("symbol").collect()] == [5, 5]
    rows = call("1970-01-09").collect()
    assert len(rows) == 16 and [r["symbol"] for r in rows] == ["A"] * 8 + ["C"] * 8 and rows == sorted(rows, key=lambda r: (r["symbol"], r["open_time"]))
    (tmp_path / "k" / "v00000007").mkdir()  # a version that a lost run left unfinished
    assert call("1970-01-10", "replace_symbol").count() == 4  # from the last stored day on, older ones dropped


def test_dataset_end_to_end(spark):
    out = prices.fetch_dataset(spark, "u/listing", "u/history", n=2, pause=0, transport="test_sources:recorded").collect()
    assert [(r["symbol"], r["ret"]) for r in sorted(out, key=lambda r: r["t_idx"])] == [("AAUSDT", 1.0), ("AAUSDT", 0.5)]


def test_rate_is_the_same_on_any_cluster():
    o = {"symbols": "A,B,C,D", "start": "1970-01-01", "end": "1970-01-02", "pause": "0.5"}
    for n in (1, 3, 9):
        parts = klines.KlineReader(o | {"partitions": str(n)}).partitions()
        assert sum(len(p.symbols) for p in parts) == 4 and sum(1 / p.pause for p in parts) == pytest.approx(2)


def test_replayed_batch_changes_nothing(spark, tmp_path):
    here = f"file://{tmp_path}/m"
    write = merge_into(here)
    schema = "symbol string, open_time long, close double"
    batches = [spark.createDataFrame(rows, schema) for rows in ([("A", 0, 1.0)], [("A", 0, 2.0), ("B", 0, 1.0)])]
    write(batches[0], 0)
    write(batches[1], 1)
    write(batches[1], 1)
    (tmp_path / "m" / "v00000002").mkdir()
    assert sorted(map(tuple, read_merged(spark, here).collect())) == [("A", 0, 2.0), ("B", 0, 1.0)]
