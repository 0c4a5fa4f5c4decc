"""Benchmark decontamination by n-gram windows, with built-in functions only.

Texts are reduced to words (A-Z lower-cased; runs of digits, letters and all characters beyond
ASCII). Every window of 13 item words, or the whole of a shorter item, is hashed; the hash of a
window is composed pairwise from the hashes of its halves, so a document of n words costs about
n * log2(13) hash steps. Document windows are looked up in the set of item windows, and each hit
is verified by its words.

Plan: the item windows are broadcast when a count shows that they are at most
``broadcast_windows``; beyond that, hashes of document windows are shuffled and joined, and the few
documents with hits get their words back for the verification. With the
broadcast, the scan of the documents has no shuffle before the hits, which are few. Word counts
come from a second scan that splits texts but shuffles only (id, text hash, count).

Defined results: a null or empty text has no words, is hit by nothing and never contaminated. Items
that are null or without words match nothing; items that repeat an item_id are the same item, and
null item ids are never listed. Rows that repeat a doc_id are judged each by its own text. Empty
tables on either side work. Other columns pass through unless they are named ``_dc_*``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ballastry.llm.common import ascii_lower, same_keys, table

WINDOW = 13
MIN_SHARE_INVERSE = 20  # contaminated: 20 * n_hit >= n_words
BROADCAST_WINDOWS = 2_000_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS, -1), "")


def _with_window_hashes(df: DataFrame, words: str, out: str, k: int) -> DataFrame:
    """Adds an array with the hash of every window of k words; shorter arrays give an empty one."""
    df = df.withColumn("_dc_p1", F.transform(words, lambda w: F.xxhash64(w)))
    done, have, size = None, 0, 1
    rest = k
    while True:
        if rest & 1:
            part = f"_dc_p{size}"
            if done is None:
                df = df.withColumn(f"_dc_w{size}", F.col(part))
            else:
                # windows of `have` words starting at i, and of `size` words starting at i + have
                df = df.withColumn(f"_dc_w{have + size}", _pairs(f"_dc_w{have}", part, have))
            have += size
            done = f"_dc_w{have}"
        rest >>= 1
        if not rest:
            break
        df = df.withColumn(f"_dc_p{2 * size}", _pairs(f"_dc_p{size}", f"_dc_p{size}", size))
        size *= 2
    return df.withColumn(out, F.filter(done, lambda h: h.isNotNull())).drop(*[c for c in df.columns if c.startswith(("_dc_p", "_dc_w")) and c != words])


def _pairs(left: str, right: str, shift: int) -> Column:
    """hash(left[i], right[i + shift]) for all i for which both exist; null beyond."""
    ahead = F.slice(F.col(right), F.lit(shift + 1), F.greatest(F.size(right) - shift, F.lit(0)))
    return F.zip_with(F.slice(F.col(left), F.lit(1), F.greatest(F.size(right) - shift, F.lit(0))), ahead, lambda a, b: F.xxhash64(a, b))


def item_windows(benchmark: DataFrame, lengths: list[int]) -> DataFrame:
    """(k, hash, words joined by a space, sorted item ids) of the distinct item windows."""
    items = benchmark.select(F.col("item_id").cast("string").alias("_dc_item"), words_of(F.col("text")).alias("_dc_t"))
    out = None
    for k in lengths:
        own = items.where(F.size("_dc_t") >= k if k == WINDOW else F.size("_dc_t") == k)
        own = _with_window_hashes(own, "_dc_t", "_dc_h", k).select("_dc_item", "_dc_t", F.posexplode("_dc_h").alias("_dc_pos", "h"))
        own = own.select(F.lit(k).alias("k"), "h", F.array_join(F.slice("_dc_t", F.col("_dc_pos") + 1, k), " ").alias("window"), "_dc_item")
        out = own if out is None else out.unionByName(own)
    return out.groupBy("k", "h", "window").agg(F.collect_set("_dc_item").alias("items"))


def window_hits(docs: DataFrame, benchmark: DataFrame, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """(id, text hash, start, k, items) of each verified occurrence of an item window."""
    sizes = benchmark.select(F.least(F.size(words_of(F.col("text"))), F.lit(WINDOW)).alias("k")).where("k > 0").distinct()
    lengths = sorted(r["k"] for r in sizes.collect()) or [WINDOW]  # at most 13 numbers
    wanted = item_windows(benchmark, lengths)
    small = wanted.select("h").limit(broadcast_windows + 1).count() <= broadcast_windows
    if small:
        wanted = F.broadcast(wanted)
    found = docs.select(F.col("doc_id").alias("_dc_id"), F.xxhash64("text").alias("_dc_key"), words_of(F.col("text")).alias("_dc_t"))
    for k in lengths:
        found = _with_window_hashes(found, "_dc_t", f"_dc_h{k}", k)
    runs = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"_dc_h{k}").alias("hashes")) for k in lengths])
    texts = found.select("_dc_id", "_dc_key", "_dc_t")
    own = ["_dc_id", "_dc_key", "_dc_t"] if small else ["_dc_id", "_dc_key"]  # no words are shuffled with windows
    found = found.select(*own, F.explode(runs).alias("_dc_run"))
    found = found.select(*own, F.col("_dc_run.k").alias("_dc_k"), F.posexplode("_dc_run.hashes").alias("_dc_pos", "_dc_hash"))
    same = (found["_dc_hash"] == wanted["h"]) & (found["_dc_k"] == wanted["k"])
    hits = found.join(wanted, same & _reads("_dc_pos", "_dc_k", "window") if small else same)
    if not small:
        pairs = hits.groupBy(F.col("_dc_id").alias("i"), F.col("_dc_key").alias("t")).agg(F.collect_set(F.struct("_dc_pos", "_dc_k", "window", "items")).alias("_dc_hits"))
        texts = texts.dropDuplicates(["_dc_id", "_dc_key"])
        hits = texts.join(pairs, same_keys(texts, pairs, [("_dc_id", "i"), ("_dc_key", "t")])).select(*texts.columns, F.inline("_dc_hits")).where(_reads("_dc_pos", "_dc_k", "window"))
    return hits.select("_dc_id", "_dc_key", F.col("_dc_pos").alias("start"), F.col("_dc_k").alias("k"), "items")


def _reads(start: str, k: str, window: str) -> Column:
    """Whether the words from a start on are those of a window."""
    return F.array_join(F.slice("_dc_t", F.col(start) + 1, F.col(k)), " ") == F.col(window)


def judge(docs: DataFrame, benchmark: DataFrame, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """doc_id, the hash of the text, n_words, n_hit, items (sorted) and contaminated of each row.

    Word positions inside any window are counted once: the windows of a document, sorted by start,
    are folded into the length of their union.
    """
    hits = window_hits(docs, benchmark, broadcast_windows).groupBy("_dc_id", "_dc_key").agg(
        F.sort_array(F.collect_set(F.struct(F.col("start").alias("a"), (F.col("start") + F.col("k")).alias("b")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("found"),
    )
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    union = F.aggregate(
        "spans",
        start,
        lambda s, x: F.struct(
            F.greatest(s["end"], x["b"]).alias("end"),
            (s["n"] + F.greatest(x["b"] - F.greatest(s["end"], x["a"]), F.lit(0))).alias("n"),
        ),
    )["n"]
    counted = docs.select("doc_id", F.xxhash64("text").alias("_dc_text"), F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    hits = hits.select("_dc_id", "_dc_key", "found", union.cast("long").alias("hit"))
    out = counted.join(hits, same_keys(counted, hits, [("doc_id", "_dc_id"), ("_dc_text", "_dc_key")]), "left")
    n_hit = F.coalesce("hit", F.lit(0).cast("long"))
    return out.select(
        "doc_id",
        "_dc_text",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("found", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (n_hit * MIN_SHARE_INVERSE >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that are not contaminated, as they are."""
    bad = judge(docs, benchmark).where("contaminated").select(F.col("doc_id").alias("_dc_id"), F.col("_dc_text").alias("_dc_key")).distinct()
    keyed = docs.withColumn("_dc_text", F.xxhash64("text"))
    return keyed.join(bad, same_keys(keyed, bad, [("doc_id", "_dc_id"), ("_dc_text", "_dc_key")]), "left_anti").select(*docs.columns)


def remove_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs with the words of contaminated documents that lie in hit windows taken out.

    A contaminated text becomes its remaining normalised words, joined by spaces; other texts stay
    as they are.
    """
    bad = judge(docs, benchmark).where("contaminated").select(F.col("doc_id").alias("_dc_id"), F.col("_dc_text").alias("_dc_key")).distinct()
    inside = window_hits(docs, benchmark).groupBy("_dc_id", "_dc_key").agg(
        F.array_distinct(F.flatten(F.collect_set(F.sequence(F.col("start"), F.col("start") + F.col("k") - 1)))).alias("_dc_cut")
    )
    cuts = inside.join(bad.select(F.col("_dc_id").alias("i"), F.col("_dc_key").alias("t")), F.col("_dc_id").eqNullSafe(F.col("i")) & (F.col("_dc_key") == F.col("t")), "left_semi")
    keyed = docs.withColumn("_dc_text", F.xxhash64("text"))
    out = keyed.join(cuts, same_keys(keyed, cuts, [("doc_id", "_dc_id"), ("_dc_text", "_dc_key")]), "left").withColumn("_dc_t", words_of(F.col("text")))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("_dc_t") - 1), F.col("_dc_cut")), lambda i: F.element_at(F.col("_dc_t"), i + 1))
    return out.withColumn("text", F.when(F.col("_dc_cut").isNotNull(), F.array_join(kept, " ")).otherwise(F.col("text"))).select(*docs.columns)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = judge(docs, table(spark, sf_dir, "benchmark"))
    return judged.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


OP1_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM iw WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM wins),
dg AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, ks WHERE len(w) >= k)),
hits AS (SELECT dg.doc_id, dg.k, dg.i, wins.item_id FROM dg JOIN wins ON dg.k = wins.k AND dg.g = wins.g),
pos AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM hits)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(pos.n, 0)::BIGINT AS n_hit, coalesce(its.n, 0)::BIGINT AS n_items,
       sha256(coalesce(its.s, '')) AS items_sha256,
       coalesce(pos.n, 0) > 0 AND 20 * coalesce(pos.n, 0) >= len(d.w) AS contaminated
FROM dw d LEFT JOIN pos ON d.doc_id = pos.doc_id LEFT JOIN its ON d.doc_id = its.doc_id
"""
