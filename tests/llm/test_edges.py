"""What all operators and the pipeline do with null and repeated ids, empty tables, clashing columns; and the pipeline by brute force."""

from __future__ import annotations

import itertools
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ballastry.llm import cap_filters, decontaminate, hilbert_shards, html_text, language_id, ngram_jaccard, piece_dropout, token_files
from ballastry.llm.registry import QUERIES
from test_texts import components, dropped, judged, lower, shingles

BIG = 2**53 + 1
IDS = [BIG, None, BIG + 2, BIG + 2, None, -5]
SENTENCE = "the house by the river is old and the people of the town know it well "
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def write(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")


def tables(spark, folder, ids, texts):
    docs = [(i, t, "en", "s", None) for i, t in zip(ids, texts, strict=True)]
    write(spark, folder, "documents", docs, DOCUMENTS)
    write(spark, folder, "benchmark", [(str(k), t) for k, t in enumerate(texts)][:1], "item_id string, text string")
    write(spark, folder, "pages", [(i, None if t is None else f"http://a.org/{t[:3]}", t) for i, t in zip(ids, texts, strict=True)], "page_id long, url string, html string")
    write(spark, folder, "labels", [(i, 1, 0) for i in ids], "doc_id long, quality int, toxic int")
    write(spark, folder, "embeddings", [(i, [1.0, float(k % 2), 0.5]) for k, i in enumerate(ids)], "vec_id long, embedding array<float>")
    write(spark, folder, "conversations", [(i, k, "user", t) for k, (i, t) in enumerate(zip(ids, texts, strict=True))], "conv_id long, turn int, role string, text string")


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ("op12_whitening", "op13_prefix_trie")])  # those have other rows: test_sequences
def test_ids_beside_nulls(spark, tmp_path, name):
    texts = [SENTENCE * 3, None, SENTENCE * 3, "other", "", "Another short text."]
    tables(spark, tmp_path, IDS, texts)
    out = QUERIES[name](spark, str(tmp_path))
    key = next(c for c in ("doc_id", "page_id", "vec_id") if c in out.columns)
    assert Counter(r[key] for r in out.collect()) == Counter(IDS)


@pytest.mark.parametrize("name", [*QUERIES, "pipeline"])
def test_empty_tables(spark, tmp_path, name):
    tables(spark, tmp_path, [], [])
    assert (QUERIES | {"pipeline": corpus_pipeline.run})[name](spark, str(tmp_path)).count() == 0


def test_clashing_columns_pass(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c", "en", "s", 7, 8, 9, "x"), (2, None, None, None, 7, 8, 9, "y")], "doc_id long, text string, lang string, source string, curve int, size int, token int, ids string")
    encoded = piece_dropout.encode_texts(docs, _model())
    assert encoded.columns == docs.columns and dict(encoded.dtypes)["ids"] == "array<int>"
    assert [r["token"] for r in encoded.collect()] == [9, 9]
    hilbert_shards.write_shards(docs.withColumnRenamed("ids", "slot"), f"file://{tmp_path}/shards")
    back = spark.read.parquet(f"file://{tmp_path}/shards")
    assert sorted((r["doc_id"], r["curve"], r["size"], r["slot"]) for r in back.collect()) == [(1, 7, 8, 0), (2, 7, 8, 0)]
    pages = spark.createDataFrame([(1, "http://a.org", "<p>x", 3, 4)], "page_id long, url string, html string, key int, host int")
    assert html_text.extract_text(pages).columns == [*pages.columns, "text", "n_chars"]
    vectors = spark.createDataFrame([(1, [1.0, 2.0], 3, 4), (2, [1.0, 2.0], 3, 4)], "vec_id long, embedding array<double>, cls int, n int")
    assert [r["n_links"] for r in cap_filters.near_duplicates(vectors).collect()] == [1, 1]
    assert decontaminate.remove_spans(docs, spark.createDataFrame([(1, "a b c", 2)], "item_id long, text string, n_hit int")).columns == docs.columns
    files = token_files.write_token_files(docs, f"file://{tmp_path}/t", _model("byte_bpe_50k.json"))
    assert sum(n for _, n in files) == token_files.read_token_files(spark, f"file://{tmp_path}/t", files).agg({"n_tokens": "sum"}).first()[0]


def _model(name="piece_bpe_32k.model"):
    import public_tokenizers

    return public_tokenizers.path(name)


def test_border_rule_fits_the_tokenizer():
    from tokenizers import Tokenizer, pre_tokenizers

    tokenizer = Tokenizer.from_file(_model("byte_bpe_50k.json"))
    assert token_files.cut_at_spaces(tokenizer)
    tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=True)
    assert not token_files.cut_at_spaces(tokenizer)


def test_punctuation_is_put_to_words_that_are_there():
    from tokenizers import Tokenizer

    tokenizer, asked = Tokenizer.from_file(_model("byte_bpe_50k.json")), []

    class Listening:
        @staticmethod
        def encode(piece, **how):
            asked.append(piece)
            return tokenizer.encode(piece, **how)

    pieces = token_files.Pieces(Listening)
    words = [" house", "it's", "\nrock'n'roll", " x\u00b2", "na\u00efve", "a'", "'s", " 10", "\u5b57", "\u0259", "e\u0301", "_a", "$5", " \t", "1\u00ac"]
    for word, end in itertools.product(words, ["", ",", ".", "'", "'.", "...", "_", "$$$", "-)"]):
        for _ in range(2):
            assert pieces[word + end] == np.array(tokenizer.encode(word + end, add_special_tokens=False).ids, "<u4").tobytes()
    assert [p for p in asked if "house" in p] == [" house"]


def test_words_of_letters_go_to_the_model_alone():
    import pyarrow as pa
    from tokenizers import Tokenizer

    tokenizer, asked = Tokenizer.from_file(_model("byte_bpe_50k.json")), []

    class Listening:
        @staticmethod
        def encode(piece, **how):
            asked.append(piece)
            return tokenizer.encode(piece, **how)

    pieces = token_files.Pieces(Listening, tokenizer.model)
    for word in [" house", "house", "na\u00efve", " \u00d6l", "\u024f", " \u00d7", "1", " ", "\u0259", "a b"]:
        assert pieces[word] == np.array(tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
    assert asked == [" \u00d7", "1", " ", "\u0259", "a b"]

    counts, ids = next(token_files.piece_encoder(_model("byte_bpe_50k.json"))(pa.array(["a b, a b\n", None, "", "b"])))
    assert counts.tolist() == [7, 1, 1, 2] and ids.tolist() == [i for t in ["a b, a b\n", "", "", "b"] for i in [*tokenizer.encode(t).ids, 0]]


def test_other_tokenizers_encode_whole_texts(tmp_path):
    import pyarrow as pa
    from tokenizers import Tokenizer, pre_tokenizers

    tokenizer = Tokenizer.from_file(_model("byte_bpe_50k.json"))
    tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=True)
    tokenizer.save(f"{tmp_path}/other.json")
    texts = ["a b, c", None, "", " x", "\n"]
    found = list(token_files.piece_encoder(f"{tmp_path}/other.json")(pa.array(texts)))
    assert [ids.tolist() for _, ids in found] == [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]


def test_borders_of_pieces_are_borders_of_pre_tokens(monkeypatch):
    import pyarrow as pa
    from tokenizers import Tokenizer

    tokenizer, rng = Tokenizer.from_file(_model("byte_bpe_50k.json")), random.Random(9)
    chars = ["a", "B", "s", "t", "7", "'", ",", "_", " ", " ", " ", "\n", "\n", "\t", "\r", "\x1c", "\0", "\x85", "\u00a0", "\u00e9", "\u00d7", "\u00b2", "\u0301", "\u3000", "\u2003", "\u2014", "\u5b57", "\u0939", "\U0001f600", "<|endoftext|>"]
    texts = ["".join(rng.choices(chars[: rng.choice([11, 13, 26, 30])], k=rng.randrange(9))) for _ in range(6000)]
    texts[::50] = [None] * 120
    plain = [t for t in texts if t and "<" not in t]
    data, ends = np.frombuffer("".join(plain).encode(), np.uint8), np.cumsum([len(t.encode()) for t in plain])
    starts, own, at = token_files.piece_starts(data, ends).tolist(), set(), 0
    for t in plain:
        own |= {at + len(t[:a].encode()) for _, (a, _) in tokenizer.pre_tokenizer.pre_tokenize_str(t)}
        at += len(t.encode())
    assert set(starts) <= own and len(starts) > len(own) / 2
    for size in (1, 300, 1 << 20):
        monkeypatch.setattr(token_files, "BYTES_AT_ONCE", size)
        found = list(token_files.piece_encoder(_model("byte_bpe_50k.json"))(pa.array([*texts, *texts]).slice(7, 6000)))
        want = [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for t in [*texts, *texts][7:6007]]
        assert [n for counts, _ in found for n in counts.tolist()] == [len(w) for w in want]
        assert [i for _, ids in found for i in ids.tolist()] == [i for w in want for i in w]


def test_filters_fall_with_each_order(spark):
    """Every order is a filter: with each, candidates get fewer, and links stay."""
    rng = random.Random(6)
    shared = [f"p{k}" for k in range(60)]
    texts = []
    for k in range(120):  # passages of different lengths in unlike documents, and copies with changes
        own = [f"y{rng.randrange(10**6)}" for _ in range(60)]
        texts.append(" ".join(own[:30] + shared[k % 30 : k % 30 + 12] + own[30:]))
        if k % 6 == 0:
            texts.append(" ".join([*own[:30], *shared[k % 30 : k % 30 + 12], *own[30:-1], "end"]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    levels = spark.sparkContext.broadcast(ngram_jaccard.frequency_levels(docs) * 0)  # all tokens alike: orders are random
    counts = []
    for orders in (1, 2, 3):
        classes, reps, seed = ngram_jaccard._named(docs, levels, orders)
        rows = ngram_jaccard._shared_rows(docs, levels, seed).join(reps.select("cls", "k1", "k2"), "cls").select("token", "cls", "k1", "k2")
        one, two = rows.toDF("token", *ngram_jaccard.PAIR[:3]), rows.toDF("token", *ngram_jaccard.PAIR[3:])
        pairs = one.join(two, "token").where("a > b").select(*ngram_jaccard.PAIR).distinct()
        passed = ngram_jaccard.candidates(pairs, ngram_jaccard.signatures(pairs, classes).withColumn("bits", F.lit(b"\xff" * 8)))
        counts.append((pairs.count(), passed.count()))  # full bitmaps rule nothing out
        sets = {ngram_jaccard.class_of(s, seed)[0]: s for s in ngram_jaccard.shingle_sets(texts)}
        links = {(max(x, y), min(x, y)) for x, y in itertools.combinations(sets, 2) if ngram_jaccard.similar(sets[x], sets[y])}
        assert links == {(r["a"], r["b"]) for r in ngram_jaccard.verify(pairs, docs, classes).collect()} and len(links) == 20
    (all_pairs, one), (_, two), (_, three) = counts
    assert all_pairs == one > two > three >= 20


def test_workers_count_tokens_in_little_memory(monkeypatch):
    """A byte a bin while a task counts, one block at a time while blocks are summed; what goes beyond a byte is not lost."""
    monkeypatch.setattr(ngram_jaccard, "TOKENS_AT_ONCE", 1000)
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) + " all of them say these words" for _ in range(700)]
    texts += [f"few {k} of these words" for k in range(300)] + ["", None]
    batches = [pa.RecordBatch.from_pydict({"text": pa.array(texts * 2, pa.string())})]
    bins = np.concatenate([ngram_jaccard.bin_of(s) for s in ngram_jaccard.shingle_sets(texts * 2)])
    expected = np.bincount(bins, minlength=1 << ngram_jaccard.BITS)
    assert 1400 <= expected.max() and np.count_nonzero(expected > 255)
    tracemalloc.start()
    try:
        (counted,) = ngram_jaccard._counted(iter(batches))
        assert tracemalloc.get_traced_memory()[1] < 48 << 20  # four bytes a bin are 64 MB
        tracemalloc.reset_peak()
        held = tracemalloc.get_traced_memory()[0]
        summed = list(ngram_jaccard._summed(iter([counted.slice(0, 100), counted.slice(100)])))
        assert tracemalloc.get_traced_memory()[1] - held < 48 << 20  # eight bytes a bin are 128 MB
    finally:
        tracemalloc.stop()
    found = np.zeros((256, 1 << 16), dtype=np.int64)
    for block, data in zip(counted["block"].to_pylist(), counted["data"].to_pylist(), strict=True):
        raw = zlib.decompress(data)
        found[block] = np.frombuffer(raw, "u1" if len(raw) == 1 << 16 else "<u4")
    assert (found.ravel() == expected).all()
    levels = {b: x for part in summed for b, x in zip(part["block"].to_pylist(), part["levels"].to_pylist(), strict=True)}
    assert all((np.frombuffer(levels[b], np.int8) == ngram_jaccard.stand_out(found[b])).all() for b in range(256))


def test_workers_keep_no_encoder():
    """Python workers live on in other stages: the table of pieces goes with the task."""
    import public_tokenizers

    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["the house by the river", None]})
    parts = list(piece_dropout.encoded_batches(iter([batch]), public_tokenizers.path("piece_bpe_32k.model"), 0.0, 0))
    assert [len(ids) > 0 for _, found in parts for ids in found] == [True, False]
    assert not piece_dropout._kept


def test_frequent_tokens_stand_out_of_full_bins():
    """Bins that hold 40 rare tokens each, and 300 of them a token of frequency 60 as well, which must be late in the orders."""
    counts = np.random.default_rng(3).poisson(40, 1 << 16)
    counts[:300] += 60
    data = zlib.compress(counts.astype("<u4").tobytes())
    (out,) = ngram_jaccard._summed(iter([pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([data], pa.binary())], ["block", "data"])]))
    levels = np.frombuffer(out["levels"][0].as_py(), np.int8)
    assert levels[:300].min() >= 5 and (levels[300:] > 0).mean() < 0.01


def test_tokens_of_hot_groups_are_salted(spark, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "SALT_FROM", 2)
    rng = random.Random(7)
    base = [f"w{k}" for k in range(80)]
    texts = []
    for _ in range(90):
        own = list(base)
        own[rng.randrange(80)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngram_jaccard.jaccard_components(docs).collect()}
    assert got == components([shingles(t) for t in texts], list(range(90)))


def test_language_id_by_brute_force(spark):
    """Ranks and out-of-place distances of all texts in plain Python."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")

    def grams(text):
        padded = re.sub(r"\0+", "\0", "".join(c if c.isalpha() else "\0" for c in f" {(text or '').lower()} "))
        a = [ord(c) for c in padded]
        if len(a) < 3:
            return []
        out = [c + 2**63 for c in a if c]
        out += [(x << 21 | y) + 2**62 for x, y in itertools.pairwise(a)]
        out += [x << 42 | y << 21 | z for x, y, z in zip(a, a[1:], a[2:]) if y]
        return [(g * 0x9E3779B97F4A7C15 % 2**64) >> 44 for g in out]

    def ranked(counts):
        return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:400]]

    rows = docs.select("doc_id", "text", "lang", language_id.held_out(docs["doc_id"]).alias("held")).collect()
    counts = {}
    for r in rows:
        if r["lang"] is not None and not r["held"]:
            counts.setdefault(r["lang"], Counter()).update(grams(r["text"]))
    profiles = {lang: ranked(c) for lang, c in counts.items()}
    got = {r["doc_id"]: r for r in language_id.op6_language_id(spark, "/root/testdata/sf0.001").collect()}
    for r in rows:
        own = ranked(Counter(grams(r["text"])))
        if not own:
            assert (got[r["doc_id"]]["lang_pred"], got[r["doc_id"]]["score"]) == ("und", 0.0)
            continue
        far = {}
        for lang, p in profiles.items():
            place = {g: k for k, g in enumerate(p)}
            far[lang] = sum(abs(place[g] - k) if g in place else 400 for k, g in enumerate(own)) / len(own) / 400
        (best, lang), (second, _) = sorted((d, name) for name, d in far.items())[:2]
        assert got[r["doc_id"]]["lang_pred"] == lang
        assert abs(got[r["doc_id"]]["score"] - min(max((second - best) / second * (1 - best), 0), 1)) < 1e-12


def test_shards_keep_equal_texts_and_prune(spark, tmp_path):
    rng = random.Random(8)
    langs, sources = ["en", "de", "fr", None], [f"site{k}" for k in range(12)]
    rows = [(k, "x" * rng.choice([3, 30, 300, 3000]) + (f"a{k}" if k % 10 else f"b{rng.randrange(40)}"), rng.choice(langs), rng.choice(sources), None) for k in range(3000)]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    placed = hilbert_shards.hilbert_shards(docs).collect()
    of = {r["doc_id"]: (r["shard"], r["slot"]) for r in placed}
    groups = {}
    for k, t, *_ in rows:
        groups.setdefault(t, []).append(k)
    order = {k: n for n, k in enumerate(sorted(of, key=of.get))}
    for own in groups.values():  # neighbours in the order, so only a full shard cuts them
        at = sorted(order[k] for k in own)
        assert at == list(range(at[0], at[0] + len(at)))
    statistics = hilbert_shards.write_shards(docs, f"file://{tmp_path}/s")
    back = spark.read.parquet(f"file://{tmp_path}/s").collect()
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in back} == of
    rows = [r for r in rows if r[0] % 10]  # copies lie where their least cell is; here the cells alone decide
    statistics = hilbert_shards.shard_statistics(placed := hilbert_shards.hilbert_shards(docs.where("doc_id % 10 > 0")))
    of = {r["doc_id"]: (r["shard"], r["slot"]) for r in placed.collect()}
    by_id = {k: (t, lang, source) for k, t, lang, source, _ in rows}
    for wanted, holds in (({"lang": "de"}, lambda x: x[1] == "de"), ({"source": "site3"}, lambda x: x[2] == "site3"), ({"sizes": (0, 20)}, lambda x: len(x[0]) < 20)):
        read = {r["shard"] for r in hilbert_shards.shards_for(statistics, **wanted).collect()}
        assert {of[k][0] for k, x in by_id.items() if holds(x)} <= read and len(read) < 16, wanted


def test_pipeline_by_brute_force(spark, tmp_path):
    """Every stage on all that its predecessor kept, with null and repeated ids, equal rows and other columns."""
    rng = random.Random(9)
    words = "the house and the river of the town was old but people liked it when they came over from far away to see".split()
    texts = [" ".join(rng.choices(words, k=60)) for _ in range(60)]
    passage = " ".join(f"item{k}" for k in range(20))
    texts += [texts[0], texts[1] + " indeed", texts[2].upper(), None, "", "12 34", "shared line\nown " + texts[3], passage + " " + texts[4]]
    texts += [f"shared line\n{' '.join(rng.choices(words, k=40))}" for _ in range(12)] + ["shared line"] * 2 + [texts[5]]
    ids = [*range(len(texts) - 2), None, 5]
    docs = [(i, t, "en" if k % 2 else None, "s", 1, f"c{k}") for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    write(spark, tmp_path, "documents", docs, DOCUMENTS + ", score string")
    write(spark, tmp_path, "benchmark", [("a", passage)], "item_id string, text string")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "ngram_jaccard", "decontaminate", "piece_dropout"]
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = [r.asDict() for r in now.collect()]
        out = stage(spark, now, str(tmp_path))
        after = [r.asDict() for r in out.collect()]
        if name != "piece_dropout":
            assert out.columns == now.columns
        if name == "language_id":
            want = [r for r in before if any(c.isalpha() for c in r["text"] or "")]
            assert sorted(after, key=repr) == sorted(want, key=repr)
        elif name == "line_dedup":
            keys = Counter(k for i in {r["doc_id"] for r in before} for k in {lower(s.strip(" \t\n\x0b\x0c\r")) for r in before if r["doc_id"] == i for s in r["text"].split("\n")})
            want = []
            for r in before:
                kept = "\n".join(s for s in r["text"].split("\n") if not (k := lower(s.strip(" \t\n\x0b\x0c\r"))) or keys[k] < 10)
                want.append(r | {"text": kept, "n_chars": len(kept)})
            assert sorted(after, key=repr) == sorted(want, key=repr) and keys["shared line"] >= 10
        elif name == "ngram_jaccard":
            sets = [shingles(r["text"]) for r in before]
            of = components(sets, list(range(len(before))))
            groups = {}
            for k, r in enumerate(before):
                groups.setdefault(of[k], []).append(r)
            chosen = {c: min((r["doc_id"] is None, r["doc_id"] or 0) for r in own) for c, own in groups.items()}
            want = [r for c, own in groups.items() for r in own if (r["doc_id"] is None, r["doc_id"] or 0) == chosen[c]]
            assert len(after) == len(groups) < len(before) and all(r in want for r in after)
        elif name == "decontaminate":
            bad = [x[3] for x in judged([r["text"] for r in before], [("a", passage)])]
            assert sorted(after, key=repr) == sorted((r for r, b in zip(before, bad, strict=True) if not b), key=repr) and sum(bad) == 1
        else:
            assert len(after) == len(before) and out.columns == ["doc_id", "lang", "source", "n_tokens", "ids"]
            want = [dropped(_model(), r["doc_id"], r["text"], piece_dropout.DROPOUT, piece_dropout.SEED) for r in before]
            assert sorted((repr(r["doc_id"]), r["ids"]) for r in after) == sorted((repr(r["doc_id"]), ids) for r, ids in zip(before, want, strict=True))
        now = out
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(repr, final.collect())) == sorted(map(repr, now.collect()))
