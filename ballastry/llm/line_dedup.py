"""Line deduplication across a corpus.

Every text is split at line feeds. A line's key is the line without white space at its ends and
with A-Z lower-cased. Keys that at least ``min_docs`` documents hold are dropped everywhere; the
lines that stay are put together again by position.

Plan: lines are rows before their keys are hashed, so that generated code does it; the keys are hashed inside the scan, so no line text is shuffled for counting. Distinct
(hash, document) pairs are counted per hash with map-side combining. The join with the frequent
hashes is salted, because one line may be in a third of all documents. It carries positions only;
the texts move once, for the join with the positions to drop.

Defined results: a null text counts as the empty text and has one empty line. Empty keys are never
dropped. Rows that repeat a doc_id count as one document for the threshold, and each row is cleaned
by its own text; rows without doc_id count as one document. An empty table gives an empty result.
Other columns pass through, whatever their names, except those that this module names ``_ld_*``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ballastry.llm.common import ascii_lower, table

SALTS = 64
SPACE = " \t\n\x0b\x0c\r"


def _trimmed(line: Column) -> Column:
    """The line without white space at its ends; most lines have none there, and a look at two characters costs less than btrim."""
    at_end = [test(c) for c in SPACE for test in (line.startswith, line.endswith)]
    return F.when(reduce(Column.__or__, at_end), F.btrim(line, F.lit(SPACE))).otherwise(line)


def line_key(line: Column) -> Column:
    return ascii_lower(_trimmed(line))


def _hashed(lines: DataFrame) -> DataFrame:
    """lines with 96 bits that stand for the key of ``_ld_line``, without rows of empty keys."""
    key = line_key(F.col("_ld_line"))
    return lines.where(_trimmed(F.col("_ld_line")) != "").withColumns({"h": F.xxhash64(key), "g": F.hash(key)}).drop("_ld_line")


def frequent_lines(docs: DataFrame, min_docs: int = 10) -> DataFrame:
    """The hashes (h, g) of the keys that at least min_docs documents hold, with n_docs."""
    lines = docs.select(F.col("doc_id").alias("_ld_id"), F.explode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("_ld_line"))
    return _hashed(lines).distinct().groupBy("h", "g").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") >= min_docs)


def dedup_lines(docs: DataFrame, min_docs: int = 10) -> DataFrame:
    """docs with ``text`` cleaned (a null one becomes empty), and _ld_n_lines, _ld_n_dropped."""
    base = docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("_ld_key", F.xxhash64("text"))
    lines = base.select(F.col("doc_id").alias("_ld_id"), "_ld_key", F.posexplode(F.split("text", "\n", -1)).alias("_ld_pos", "_ld_line"))
    positions = _hashed(lines).withColumn("salt", F.pmod(F.hash("_ld_key", "_ld_pos"), F.lit(SALTS)))
    frequent = frequent_lines(docs, min_docs).select("h", "g", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    drops = (
        positions.join(frequent, ["h", "g", "salt"])
        .groupBy("_ld_id", F.col("_ld_key").alias("_ld_drop_key"))
        .agg(F.collect_set("_ld_pos").alias("_ld_drop"))
    )
    joined = base.join(drops, (base["doc_id"].eqNullSafe(drops["_ld_id"])) & (base["_ld_key"] == drops["_ld_drop_key"]), "left")
    lines = F.split("text", "\n", -1)
    n = F.size(lines)
    kept = F.transform(
        F.array_except(F.sequence(F.lit(0), n - 1), F.col("_ld_drop")), lambda i: F.element_at(F.col("_ld_lines"), i + 1)
    )
    return (
        joined.withColumn("_ld_n_lines", n.cast("long"))
        .withColumn("_ld_n_dropped", F.coalesce(F.size("_ld_drop"), F.lit(0)).cast("long"))
        .withColumn("_ld_n_dropped", F.greatest("_ld_n_dropped", F.lit(0).cast("long")))
        .withColumn("_ld_lines", F.when(F.col("_ld_n_dropped") > 0, lines))
        .withColumn("text", F.when(F.col("_ld_n_dropped") > 0, F.array_join(kept, "\n")).otherwise(F.col("text")))
        .select(*[F.col(c) for c in docs.columns], "_ld_n_lines", "_ld_n_dropped")
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select(
        "doc_id",
        F.col("_ld_n_lines").alias("n_lines"),
        F.col("_ld_n_dropped").alias("n_dropped"),
        F.sha2("text", 256).alias("kept_sha256"),
    )


OP7_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
hot AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT keyed.*, hot.k IS NOT NULL AS drop_it FROM keyed LEFT JOIN hot ON keyed.k = hot.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, count_if(drop_it)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT drop_it), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
