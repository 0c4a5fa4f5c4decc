"""Stored candles: CSV and Parquet files, resuming, and upserts."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StructType, TimestampType

from ballastry.schema import KLINES
from ballastry.session import kept

SPAN_MS = 31 * 86_400_000


def read_klines(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Stored candles. The schema is given, never inferred."""
    reader = spark.read.schema(KLINES)
    return reader.csv(path, header=True) if kind == "csv" else reader.parquet(path)


def write_table(df: DataFrame, path: str, kind: str = "parquet", mode: str = "error", by: list[str] | None = None) -> None:
    """Writes df; mode="ignore" keeps what is there. Candles are best stored by symbol."""
    writer = df.write.mode(mode)
    writer = writer.partitionBy(*by) if by else writer
    writer.csv(path, header=True) if kind == "csv" else writer.parquet(path)


def resume_points(stored: DataFrame) -> DataFrame:
    """(symbol, start): the last stored time of each symbol in ms, from which a collection goes on."""
    return stored.groupBy("symbol").agg(F.unix_millis(F.max("open_time")).alias("start"))


def upsert(stored: DataFrame, new: DataFrame, mode: str = "merge") -> DataFrame:
    """stored with new rows.

    mode "merge" replaces rows by (symbol, open_time), the new one winning; "replace_symbol" drops all
    stored rows of a symbol that has new ones.
    """
    keys = {"merge": ["symbol", "open_time"], "replace_symbol": ["symbol"]}[mode]
    return stored.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


@dataclass(frozen=True)
class Manifest:
    """One version of a table: which version wrote each live slice, the columns, and the last batch taken of each stream."""

    number: int
    live: dict[str, int]
    schema: str
    batches: dict[str, int]


def _hadoop(spark: SparkSession, path: str):
    """(file system, function that makes its paths) of path."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark._jsc.hadoopConfiguration()), at


def newest(spark: SparkSession, path: str) -> Manifest | None:
    """The manifest of the newest version of the table under path; None without any."""
    files, at = _hadoop(spark, path)
    folder = at(f"{path}/manifests")
    names = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
    numbers = [int(n[1:-5]) for n in names if re.fullmatch(r"v\d+\.json", n)]
    if not numbers:
        return None
    text = spark.read.text(f"{path}/manifests/v{max(numbers):08d}.json", wholetext=True).first()[0]
    return Manifest(max(numbers), **json.loads(text))


def _commit(spark: SparkSession, path: str, manifest: Manifest) -> None:
    """Writes a manifest beside its place and renames it: the one step that makes a version visible."""
    files, at = _hadoop(spark, path)
    draft, place = at(f"{path}/manifests/draft-{uuid.uuid4().hex}"), at(f"{path}/manifests/v{manifest.number:08d}.json")
    out = files.create(draft)
    try:
        out.write(bytearray(json.dumps({"live": manifest.live, "schema": manifest.schema, "batches": manifest.batches}).encode()))
    finally:
        out.close()
    if files.exists(place) or not files.rename(draft, place):
        files.delete(draft, False)
        raise RuntimeError(f"{place.toString()} was written by another run meanwhile")


def _slices(df: DataFrame) -> Column:
    """The slice of each row, <symbol in hexadecimal>_<number of the span of 31 days>: safe in a path, and the same in every time zone."""
    symbol = F.coalesce(F.hex(F.encode("symbol", "UTF-8")), F.lit("null"))
    at = F.unix_millis("open_time") if isinstance(df.schema["open_time"].dataType, TimestampType) else F.col("open_time").cast("long")
    span = F.coalesce(F.floor(at / F.lit(SPAN_MS)).cast("string"), F.lit("null"))
    return F.concat(symbol, F.lit("_"), span)


def _folder(path: str, number: int) -> str:
    return f"{path}/v{number:08d}"


def _read(spark: SparkSession, path: str, manifest: Manifest, slices: Iterable[str]) -> DataFrame:
    schema = StructType.fromJson(json.loads(manifest.schema))
    paths = [f"{_folder(path, manifest.live[s])}/slice={s}" for s in slices]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_versioned(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of a table."""
    found = newest(spark, path)
    if found is None:
        raise FileNotFoundError(path)
    return _read(spark, path, found, sorted(found.live))


def merge_version(new: DataFrame, path: str, mode: str = "merge", batch: tuple[str, int] | None = None) -> Manifest:
    """Merges new rows (symbol, open_time and others) into the table at path; the manifest of the result.

    Copy on write: a table is cut into slices, a symbol's span of 31 days each. Only slices that new rows fall in are read, merged
    and written again (with mode="replace_symbol", the other slices of those symbols are let go unread); all others stay the files they
    are. A version is seen once its manifest is in place, so a lost run leaves nothing but files that nobody reads.

    batch is (stream, number): one that the table has taken before, or an older one of that stream, changes nothing. The numbers of
    different streams do not meet. One writer at a time; a second one fails at its end. The driver holds a name for each slice,
    as it does for the files of any table.
    """
    spark = new.sparkSession
    old = newest(spark, path)
    if old and batch and old.batches.get(batch[0], -1) >= batch[1]:
        return old
    number = old.number + 1 if old else 0
    live = dict(old.live) if old else {}
    columns = [c for c in new.columns if c != "slice"]
    sliced = kept(new.select(*columns, _slices(new).alias("slice")))
    touched = {r["slice"] for r in sliced.select("slice").distinct().collect()}  # a row a file to write
    if mode == "merge":
        again = sorted(touched & live.keys())
        rows = upsert(_read(spark, path, old, again), sliced.select(*columns), mode) if again else sliced.select(*columns)
    elif mode == "replace_symbol":
        symbols = {s.rsplit("_", 1)[0] for s in touched}
        live = {s: v for s, v in live.items() if s.rsplit("_", 1)[0] not in symbols}
        rows = sliced.select(*columns)
    else:
        raise KeyError(mode)
    if touched:
        rows = rows.withColumn("slice", _slices(rows)).repartition("slice")
        rows.write.mode("overwrite").partitionBy("slice").parquet(_folder(path, number))
    made = Manifest(number, live | dict.fromkeys(touched, number), old.schema if old else new.select(*columns).schema.json(), (old.batches if old else {}) | ({batch[0]: batch[1]} if batch else {}))
    _commit(spark, path, made)
    return made


def vacuum(spark: SparkSession, path: str) -> int:
    """Deletes slices and manifests that the newest version does not use; how many slices. Readers of older versions must have ended."""
    found = newest(spark, path)
    if found is None:
        return 0
    files, at = _hadoop(spark, path)
    gone = 0
    for version in files.listStatus(at(path)):
        name = version.getPath().getName()
        if not re.fullmatch(r"v\d+", name):
            continue
        slices = [f.getPath() for f in files.listStatus(version.getPath()) if f.getPath().getName().startswith("slice=")]
        stale = [s for s in slices if found.live.get(s.getName()[6:]) != int(name[1:])]
        if len(stale) == len(slices):
            files.delete(version.getPath(), True)
        else:
            for s in stale:
                files.delete(s, True)
        gone += len(stale)
    for f in files.listStatus(at(f"{path}/manifests")):
        if f.getPath().getName() != f"v{found.number:08d}.json":
            files.delete(f.getPath(), False)
    return gone


def profile(df: DataFrame) -> DataFrame:
    """(column, n, nulls, n_distinct, least, largest, mean, sd, q25, q50, q75) of every column, in one pass.

    Extremes are given as text; mean, deviation and quartiles are null unless the column is a number. Quartiles are values of the
    column whose ranks are off by 1 in 10,000 at most.
    """
    numbers = {f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)}

    def figures(c: str) -> list[Column]:
        if c not in numbers:
            return [F.lit(None).cast("double").alias(n) for n in ("mean", "sd", "q25", "q50", "q75")]
        quartiles = [F.percentile_approx(c, q, 10_000).cast("double").alias(f"q{q * 100:.0f}") for q in (0.25, 0.5, 0.75)]
        return [F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd"), *quartiles]

    stats = [
        F.struct(
            F.lit(c).alias("column"),
            F.count(F.col(c)).alias("n"),
            F.count_if(F.col(c).isNull()).alias("nulls"),
            F.countDistinct(F.col(c)).alias("n_distinct"),
            F.min(c).cast("string").alias("least"),
            F.max(c).cast("string").alias("largest"),
            *figures(c),
        )
        for c in df.columns
    ]
    return df.agg(*[s.alias(f"c{k}") for k, s in enumerate(stats)]).select(F.explode(F.array(*[f"c{k}" for k in range(len(stats))])).alias("s")).select("s.*")
