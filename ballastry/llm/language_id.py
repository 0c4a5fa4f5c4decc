"""Language identification by rank-order profiles of character n-grams.

A profile is the list of the 400 most frequent n-grams (1 to 3 characters) of a text or language,
most frequent first. Texts are lower-cased; everything that is not a letter is a word border. The
distance of a document to a language is the sum, over the document's n-grams, of how far each is
out of place in the language's profile, or the maximum where it is absent; the nearest language
is the prediction. N-grams are hashed to 2**20 bins, so any script works with tables of fixed size.

Plan: a learning scan counts n-grams in numpy, for ``LANGUAGES_AT_ONCE`` languages at a time, and emits the counts of each partition;
one aggregate sums them, and the top of each language is kept. The driver gets 400 rows a
language. The predicting scan has no shuffle. Learning reads every text of the learning folds whole.

Defined results: the language is ``und`` with score 0 where a text is null or has no letter, or no
language was learned. The score is the gap between the best and second-best mean distance as a
share of the second best, times the share by which the best beats the maximum; it lies in [0, 1].
With a single learned language the second best is the maximum. Ties go to the smaller name. Rows
that repeat an id are predicted each by its own text; a null doc_id is in the learning fold.
Only text is an input of a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ballastry.llm.common import table

TOP = 400
BITS = 20
HELD_OUT = 2
FOLDS = 4
UNKNOWN = "und"
#: Texts in languages that were not learned, or in none, score less as a rule: 0 to 0.045 in the tests, as 12 of 10,000 documents of sf0.1 do.
MIN_SCORE = 0.05
CHARS_AT_ONCE = 1 << 20
LANGUAGES_AT_ONCE = 16


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point: itself if it is a letter, else 0."""
    return np.array([c if chr(c).isalpha() else 0 for c in range(0x110000)], dtype=np.uint32)


def _bins(a: np.ndarray) -> np.ndarray:
    return ((a * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int32)


def ngrams(text: str | None) -> np.ndarray:
    """The bins of all n-grams of a text; n-grams may touch word borders at either end, not span them."""
    codes = np.frombuffer((" " + (text or "").lower() + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    c = _letters()[codes]
    c = c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])].astype(np.uint64)  # one border between words
    if len(c) < 3:
        return np.empty(0, dtype=np.int32)
    one = c[c != 0]
    two = (c[:-1] << np.uint64(21)) | c[1:]
    three = ((c[:-2] << np.uint64(42)) | (c[1:-1] << np.uint64(21)) | c[2:])[c[1:-1] != 0]
    return np.concatenate([_bins(one + np.uint64(1 << 63)), _bins(two + np.uint64(1 << 62)), _bins(three)])


def profile(text: str | None, top: int = TOP) -> np.ndarray:
    """The bins of a text's most frequent n-grams, most frequent first, ties by bin."""
    grams = np.sort(ngrams(text))
    if not len(grams):
        return grams
    at = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    counts = np.diff(np.append(at, len(grams)))
    return grams[at][np.argsort(-counts, kind="stable")[:top]]


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sums: dict[str, np.ndarray] = {}

    def counted() -> Iterator[pd.DataFrame]:
        for lang, counts in sums.items():
            bins = np.flatnonzero(counts)
            yield pd.DataFrame({"lang": lang, "bin": bins, "n": counts[bins]})
        sums.clear()

    for batch in batches:
        for lang, texts in batch.groupby("lang")["text"]:
            if lang not in sums and len(sums) == LANGUAGES_AT_ONCE:
                yield from counted()
            counts = sums.setdefault(lang, np.zeros(1 << BITS, dtype=np.int64))
            part, size = [], 0
            for text in texts:
                part.append(ngrams(text))
                size += len(part[-1])
                if size > CHARS_AT_ONCE:
                    counts += np.bincount(np.concatenate(part), minlength=len(counts))
                    part, size = [], 0
            if part:
                counts += np.bincount(np.concatenate(part), minlength=len(counts))
    yield from counted()


def learn(docs: DataFrame, top: int = TOP) -> dict[str, list[int]]:
    """The profile of each language in docs (text, lang), from all its rows."""
    counts = docs.where("lang is not null and text is not null").select("text", "lang").mapInPandas(_count, "lang string, bin int, n long")
    counts = counts.groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    best = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "bin"))).where(F.col("rank") <= top)
    out: dict[str, list[int]] = {}
    for r in sorted(best.collect(), key=lambda r: (r["lang"], r["rank"])):  # top rows a language
        out.setdefault(r["lang"], []).append(r["bin"])
    return out


def predictor(profiles: dict[str, list[int]], top: int = TOP):
    """text -> (language, score). Profiles are held as an index by bin, whose size is that of the profiles."""
    names = sorted(profiles)
    bins = np.concatenate([np.array(profiles[name], dtype=np.int32) for name in names] or [np.empty(0, dtype=np.int32)])
    langs = np.repeat(np.arange(len(names)), [len(profiles[name]) for name in names])
    places = np.concatenate([np.arange(len(profiles[name])) for name in names] or [np.empty(0, dtype=np.int64)])
    order = np.argsort(bins, kind="stable")
    keys, starts, counts = np.unique(bins[order], return_index=True, return_counts=True)
    langs, places = langs[order], places[order]

    def predict(text: str | None) -> tuple[str, float]:
        own = profile(text, top)
        if not len(own) or not len(keys):
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
        rank = np.flatnonzero(keys[at] == own)
        n = counts[at[rank]]
        entries = np.arange(n.sum()) + np.repeat(starts[at[rank]] - (np.cumsum(n) - n), n)
        near = top - np.abs(places[entries] - np.repeat(rank, n))  # an n-gram that is absent counts top
        far = (len(own) * top - np.bincount(langs[entries], weights=near, minlength=len(names))) / len(own) / top
        best_first = np.argsort(far, kind="stable")
        best, second = far[best_first[0]], far[best_first[1]] if len(names) > 1 else 1.0
        gap = (second - best) / second if second > 0 else 0.0
        return names[best_first[0]], float(min(max(gap * (1 - best), 0.0), 1.0))

    return predict


def identify(docs: DataFrame, profiles: dict[str, list[int]], top: int = TOP) -> DataFrame:
    """docs with lang_pred and score added (or replaced)."""
    from pyspark.sql import types as T

    @F.pandas_udf(T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())]))
    def predicted(texts: pd.Series) -> pd.DataFrame:
        predict = predictor(profiles, top)
        return pd.DataFrame([predict(t) for t in texts], columns=["lang", "score"])

    found = docs.withColumn("_li", predicted("text"))
    return found.withColumn("lang_pred", F.col("_li.lang")).withColumn("score", F.col("_li.score")).drop("_li")


def keep_identified(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """docs without rows whose language can't be told: ``und``, or a score under min_score, as of texts in a language not learned."""
    profiles = learn(docs.where(~held_out(F.col("doc_id"))))
    marks = identify(docs.withColumnsRenamed({c: "_li_" + c for c in ("lang_pred", "score") if c in docs.columns}), profiles)
    kept = marks.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score)).drop("lang_pred", "score")
    return kept.withColumnsRenamed({"_li_" + c: c for c in ("lang_pred", "score") if c in docs.columns}).select(*docs.columns)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = learn(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs.select("doc_id", "text"), profiles).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
