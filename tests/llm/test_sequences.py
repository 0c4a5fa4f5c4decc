"""Byte-level BPE, whitening and the prefix trie against other libraries, brute force and their edge cases."""

from __future__ import annotations

import base64
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from ballastry.llm import byte_pairs, prefix_trie, whitening
from ballastry.llm.registry import QUERIES
from compare import differences
from test_texts import EDGES, documents

SF = "/root/testdata/sf0.001"


def _tiktoken():
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def _long_texts():
    draw = random.Random(5)
    return [
        "a" * 20_000,
        "ab" * 7_000 + " " + "".join(draw.choice("abcdefgh") for _ in range(30_000)),
        "".join(draw.choice("éüñ中文字😀 \n ") for _ in range(5_000)),
        " " * 3_000 + "\n" * 500 + "\t x",
        "1234567890" * 400,
        "\U0010ffff\x00\x7f�" * 50,
    ]


def test_byte_pairs_by_the_library(spark):
    own = _tiktoken()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op11_byte_pairs"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = own.encode_ordinary(texts[r["doc_id"]] or "")
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()


@pytest.mark.parametrize("at_once", [None, 50])
def test_byte_pairs_of_long_and_odd_texts(monkeypatch, at_once):
    if at_once:  # the borders between parts, and a table that is started anew
        for name in ("CHARS_AT_ONCE", "PIECES_AT_ONCE", "BYTES_AT_ONCE", "MAX_KEPT"):
            monkeypatch.setattr(byte_pairs, name, at_once)
    own, model = _tiktoken(), byte_pairs.RankModel(*_vocabulary())
    texts = [*EDGES, *_long_texts()]
    for text, parts in zip(texts, model.encode(texts), strict=True):
        ids = [i for part in parts for i in part]
        assert ids == own.encode_ordinary(text or "")
        assert model.decode(ids) == (text or "").encode()


def test_pieces_are_cut_by_the_pattern_once():
    """Texts of pieces that the worker knows are not cut by the pattern again, and any border at white space is one of the pattern's."""
    own, model = _tiktoken(), byte_pairs.RankModel(*_vocabulary())
    draw = random.Random(5)
    texts = ["".join(draw.choices(" \n\t\r\u00a0\u3000\x1c\x85aÉ中'sd1²!._\U0001f600", k=60)) for _ in range(400)]

    def encoded():
        return [[i for part in parts for i in part] for parts in model.encode(texts)]

    assert encoded() == [own.encode_ordinary(t) for t in texts]

    class Never:
        def findall(self, text):
            raise AssertionError(text)

    model.pattern = Never()
    kept = [t for t in texts if all(len(p) <= byte_pairs.KEPT_LENGTH for p in model.cut.findall(t))]
    assert kept and [[i for part in parts for i in part] for parts in model.encode(kept)] == [own.encode_ordinary(t) for t in kept]


def _by_scans(ranks, piece):
    """Merges by looking at all pairs for each merge."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_rank_queue_by_scans(tmp_path):
    """Vocabularies whose merges are in no order that training would give: later merges may have lower ranks."""
    draw = random.Random(11)
    for turn in range(30):
        tokens = {bytes([c]) for c in b"abc"} | {bytes(draw.choice(b"abc") for _ in range(draw.randint(2, 5))) for _ in range(60)}
        order = sorted(tokens)
        draw.shuffle(order)
        ranks = {t: 3 * k for k, t in enumerate(order)}  # with gaps
        path = tmp_path / f"{turn}.ranks"
        path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % k for t, k in ranks.items()))
        model = byte_pairs.RankModel(str(path), ".+")
        pieces = [bytes(draw.choice(b"abc") for _ in range(draw.randint(1, 80))) for _ in range(40)]
        assert model.merge(pieces) == [_by_scans(ranks, p) for p in pieces]
        assert model.merge(pieces[::-1]) == [_by_scans(ranks, p) for p in pieces[::-1]]  # the queue is empty again


def test_byte_pairs_columns_and_round_trip(spark):
    docs = documents(spark, EDGES).withColumnRenamed("source", "ids").withColumnRenamed("lang", "bytes")
    encoded = byte_pairs.encode_texts(docs, *_vocabulary())
    assert sorted(encoded.columns) == sorted(docs.columns) and dict(encoded.dtypes)["ids"] == "array<int>"
    back = {r["doc_id"]: bytes(r["bytes"]) for r in byte_pairs.decode_ids(encoded, *_vocabulary()).collect()}
    assert back == {k: (t or "").encode() for k, t in enumerate(EDGES)}


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def _whitened(rows):
    """Brute force: (n, deviations, values, vectors, mean, trace) of the rows that stay, by one length."""
    kept = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in kept}))
    n, total = len(fit), fit.sum(axis=0)
    centred = fit - total / n
    covariance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(covariance)
    return kept, n, total, values[::-1], vectors[:, ::-1], np.trace(covariance)


def _compare_whitening(got, rows):
    kept, n, total, values, vectors, trace = _whitened(rows)
    top = min(4, len(values))
    assert len(got) == len(kept) * top
    by = defaultdict(list)
    for r in got:
        by[r["component"]].append(r)
    for k in range(1, top + 1):
        want = sorted((i, sum((n * int(c) - int(s)) ** 2 for c, s in zip(x, total)), float((x - total / n) @ vectors[:, k - 1] / np.sqrt(values[k - 1]))) for i, x in kept)
        have = sorted((r["vec_id"], r["deviation"], r["whitened"]) for r in by[k])
        assert [h[:2] for h in have] == [w[:2] for w in want]
        sign = np.sign(sum(h[2] * w[2] for h, w in zip(sorted(have, key=lambda h: h[1]), sorted(want, key=lambda w: w[1]))))
        assert sorted(round(h[2], 6) for h in have) == pytest.approx(sorted(sign * w[2] for w in want), abs=2e-6)
        assert {r["n"] for r in by[k]} == {n}
        assert by[k][0]["explained"] == pytest.approx(values[k - 1] / trace, rel=1e-9)
        assert all(r["identity_error"] < 1e-6 for r in by[k])


def test_whitening_by_brute_force(spark):
    draw = np.random.default_rng(3)
    base = draw.normal(size=(300, 6)) * [5, 3, 2, 1, 0.5, 0.2] + 40
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(base)]
    rows += [(1_000 + k, rows[7][1]) for k in range(200)]  # copies weigh nothing in the fit
    rows += [(2_000, None), (2_001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2_002, [float("nan")] * 6), (2_003, [float("inf")] + [0.0] * 5), (7, rows[8][1])]
    got = whitening.whiten(_vectors(spark, rows).repartition(7)).collect()
    _compare_whitening(got, rows)


def test_whitening_of_the_given_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    _compare_whitening(QUERIES["op12_whitening"](spark, SF).collect(), rows)


def test_moments_merge_in_any_order():
    """Chan's formula equals one pass, also with a large common offset and uneven parts."""
    draw = np.random.default_rng(9)
    x = draw.integers(-500, 500, size=(1_000, 5)) + 10**7
    whole = whitening.state_of(x)
    for cuts in ([1], [1, 2, 3], [500], [10, 990], list(range(7, 1_000, 7))):
        parts = [whitening.state_of(p) for p in np.split(x, cuts)]
        draw.shuffle(order := np.arange(len(parts)))
        merged = parts[order[0]]
        for k in order[1:]:
            merged = whitening.merged(merged, parts[k])
        assert merged[:2] == whole[:2]
        assert np.allclose(merged[2], whole[2], rtol=1e-14) and np.allclose(merged[3], whole[3], rtol=0, atol=1e-11 * whole[3].max())


def test_whitening_edges(spark):
    one = whitening.whiten(_vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [1.0, 2.0])])).collect()
    assert len(one) == 6 and all(r["n"] == 1 and r["deviation"] == 0 and r["whitened"] is None for r in one)
    assert all(r["identity_error"] is None and r["explained"] is None for r in one)
    mixed = whitening.whiten(_vectors(spark, [(1, [1.0]), (2, [3.0]), (3, [1.0, 0.0]), (4, [0.0, 5.0]), (5, [])])).collect()
    assert {(r["vec_id"], r["component"], r["n"]) for r in mixed} == {(1, 1, 2), (2, 1, 2), (3, 1, 2), (3, 2, 2), (4, 1, 2), (4, 2, 2)}
    assert whitening.whiten(_vectors(spark, [(1, None)])).count() == 0
    huge = whitening.whiten(_vectors(spark, [(1, [1e300, 0.0]), (2, [-1e300, 1.0])])).collect()
    assert {r["deviation"] for r in huge} == {None}
    clash = spark.createDataFrame([(1, [1.0, 2.0], 3, 4), (2, [2.0, 5.0], 3, 4)], "vec_id long, embedding array<double>, n int, x int")
    assert whitening.whiten(clash).count() == 4


def _trie(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
        built[c] = own.get(base, [])[:h] + v[h:]
    members, kids, ends = defaultdict(list), defaultdict(set), defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
            if d:
                kids[tuple(v[: d - 1])].add(tuple(v[:d]))
        ends[tuple(v)].append(c)
    below = defaultdict(lambda: [0, 0])
    for key, own_members in members.items():
        saved = (len(own_members) - 1) * len(key[-1][1]) if key else 0
        for d in range(len(key) + 1):
            below[key[:d]][0] += not kids[key]
            below[key[:d]][1] += saved
    return sorted(
        (min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids[k]), *below[k], hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest())
        for k, m in list(members.items())
    )


FIELDS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _nodes(df):
    return sorted((tuple(r[f] for f in FIELDS) for r in df.collect()), key=lambda r: (r[0], r[1], r[2] is not None, r[2:]))


def _sorted(rows):
    return sorted(rows, key=lambda r: (r[0], r[1], r[2] is not None, r[2:]))


def _conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")


def test_prefix_trie_matches_sql(spark):
    from ballastry.llm.registry import ORACLES

    assert differences(QUERIES["op13_prefix_trie"](spark, SF), ORACLES["op13_prefix_trie"], SF) == []


def test_prefix_trie_by_brute_force(spark):
    draw = random.Random(2)
    rows = []
    for c in [*range(0, 12), *range(100, 130), 205, 999, 2**53 + 1, -7, -100]:
        for t in range(draw.choice([1, 2, 3, 8])):
            rows.append((c, draw.choice([t, t, 0, None]), draw.choice(["user", "user", None, "é"]), draw.choice(["hi", "hi", "", None, "中文 text"])))
    rows += [rows[3], rows[3], (None, 1, "user", "of no conversation")]
    draw.shuffle(rows)
    assert _nodes(prefix_trie.prefix_trie(_conversations(spark, rows).repartition(5))) == _sorted(_trie(rows))


def test_prefix_trie_of_long_conversations(spark, monkeypatch):
    """Depths of several doubling rounds, and a conversation that lies in many tasks of the sorts."""
    monkeypatch.setattr(prefix_trie, "BLOCK_ROWS", 3)
    rows = [(c, t, "user", f"turn {t % 3} {'x' * (t % 5)}") for c in (0, 1, 2, 3) for t in range(700 if c < 2 else 40)]
    rows += [(c, t, "user", "same") for c in range(500, 560) for t in range(2)]
    assert _nodes(prefix_trie.prefix_trie(_conversations(spark, rows).repartition(6))) == _sorted(_trie(rows))


def test_prefix_trie_edges(spark):
    assert prefix_trie.prefix_trie(_conversations(spark, [])).count() == 0
    assert prefix_trie.prefix_trie(_conversations(spark, [(None, 1, "user", "x")])).count() == 0
    alone = [(101, 0, None, None)]
    assert _nodes(prefix_trie.prefix_trie(_conversations(spark, alone))) == _sorted(_trie(alone))
    clash = spark.createDataFrame([(1, 0, "user", "x", 5, 6, "y"), (2, 0, "user", "x", 5, 6, "y")], "conv_id long, turn int, role string, text string, a int, depth int, ids string")
    assert prefix_trie.prefix_trie(clash).columns == FIELDS
