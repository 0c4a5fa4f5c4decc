"""Operators on documents against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from ballastry.llm import decontaminate, hilbert_shards, language_id, line_dedup, ngram_jaccard, piece_dropout, token_files
from compare import differences

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, ids=None, schema=SCHEMA):
    ids = ids or range(len(texts))
    rows = [(i, t, "en", "s", None) for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, schema)


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))


EDGES = [None, "", "   \n\t ", "one", "ONE", "a b c d", "A b\nc d", "é 中文 words İ", "x" * 200_000, "w " * 50_000, "same line\nother", "same line\nother"]


@pytest.mark.parametrize("name", ["op1_decontaminate", "op2_url_reputation", "op4_ngram_jaccard", "op7_line_dedup"])
def test_matches_sql(spark, name):
    from ballastry.llm.registry import ORACLES, QUERIES

    assert differences(QUERIES[name](spark, SF), ORACLES[name], SF) == []


def judged(texts, items):
    wins = {}
    for item, text in items:
        w = words(text)
        k = min(13, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            wins.setdefault(tuple(w[i : i + k]), set()).add(item)
    out = []
    for text in texts:
        w, hit, found = words(text), set(), set()
        for k in {len(x) for x in wins}:
            for i in range(len(w) - k + 1):
                if own := wins.get(tuple(w[i : i + k])):
                    hit |= set(range(i, i + k))
                    found |= own
        out.append((len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def test_decontaminate(spark):
    rng = random.Random(1)
    vocabulary = ["ab", "Cd", "e", "f1", "é"]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 5, 13, 14, 20])))) for k in range(8)] + [(98, None), (99, " .. ")]
    texts = EDGES + [" ".join(rng.choices(vocabulary, k=40)) + " " + rng.choice(items[:8])[1] for _ in range(20)]
    docs, bench = documents(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    for limit in (decontaminate.BROADCAST_WINDOWS, 0):
        got = {r["doc_id"]: r for r in decontaminate.judge(docs, bench, limit).collect()}
        for k, (n, hit, found, bad) in enumerate(judged(texts, [(str(i), t) for i, t in items])):
            r = got[k]
            assert (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) == (n, hit, found, bad)
    clean = decontaminate.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns
    assert clean.count() == sum(not r["contaminated"] for r in got.values())
    assert decontaminate.judge(docs.limit(0), bench).count() == 0
    assert decontaminate.judge(docs, bench.limit(0)).where("contaminated").count() == 0
    cut = {r["doc_id"]: r["text"] for r in decontaminate.remove_spans(docs, bench).collect()}
    assert len(cut) == len(texts) and all(cut[k] == t for k, t in enumerate(texts) if not got[k]["contaminated"])


def test_line_dedup(spark):
    rng = random.Random(2)
    texts = EDGES + ["\n".join(rng.choices(["Common", " common ", "", "other", f"r{k}"], k=5)) for k in range(30)]
    key = lambda s: lower(s.strip(" \t\n\x0b\x0c\r"))
    counts = {}
    for t in texts:
        for x in {key(s) for s in (t or "").split("\n")}:
            counts[x] = counts.get(x, 0) + 1
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(documents(spark, texts)).collect()}
    for k, t in enumerate(texts):
        own = (t or "").split("\n")
        kept = [s for s in own if not key(s) or counts[key(s)] < 10]
        assert (got[k]["text"], got[k]["_ld_n_lines"], got[k]["_ld_n_dropped"]) == ("\n".join(kept), len(own), len(own) - len(kept))
    assert line_dedup.dedup_lines(documents(spark, ["x"]).limit(0)).count() == 0


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def components(sets, ids):
    root = list(range(len(sets)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(range(len(sets)), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k in range(len(sets)):
        least[find(k)] = min(least.get(find(k), ids[k]), ids[k])
    return {ids[k]: least[find(k)] for k in range(len(sets))}


def test_line_keys_are_hashed_by_generated_code(spark):
    """Keys against plain Python, with all white space at either end; no higher-order function, which is interpreted, makes them."""
    lines = [a + core + b for core in ("", "x", "A b", "É Ü", "\x1cq", "\u00a0") for a in ("", *line_dedup.SPACE, " \t\r") for b in ("", *line_dedup.SPACE, "\x0b\x0c ")]
    rows = spark.createDataFrame([(t,) for t in lines], "t string").select("t", line_dedup.line_key(F.col("t")).alias("k")).collect()
    assert all(r["k"] == lower(r["t"].strip(" \t\n\x0b\x0c\r")) for r in rows) and len(rows) == len(lines)
    for made in (line_dedup.frequent_lines(documents(spark, ["a\nb"])), line_dedup.dedup_lines(documents(spark, ["a\nb"])).select("_ld_n_dropped")):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "xxhash64" in plan and "transform(" not in plan and "array_distinct" not in plan


def test_ngram_jaccard(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(400)}" for _ in range(60)]
    passage = [f"p{k}" for k in range(25)]
    texts = list(EDGES)
    for _ in range(60):  # copies of one text, each with its own changes: many pairs lie next to the threshold
        own = list(base)
        for k in rng.sample(range(60), rng.randrange(5)):
            own[k] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(own))
    texts += [" ".join([f"y{rng.randrange(10**6)}" for _ in range(30)] + passage) for _ in range(30)]  # one shared passage
    ids = rng.sample(range(1000), len(texts))
    docs = documents(spark, texts, ids)
    got = {r["doc_id"]: r for r in ngram_jaccard.jaccard_components(docs).collect()}
    sets = [shingles(t) for t in texts]
    want = components(sets, ids)
    assert {i: got[i]["component_id"] for i in ids} == want
    assert {i: got[i]["n_shingles"] for i in ids} == {i: len(s) for i, s in zip(ids, sets, strict=True)}
    kept = ngram_jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == set(want.values())
    assert ngram_jaccard.jaccard_components(docs.limit(0)).count() == 0


def test_language_id(spark):
    rows = [(k, t * (1 + k % 5), lang) for k, (t, lang) in enumerate([("the house and the river of the town ", "en"), ("das haus und der fluss von der stadt ", "de")] * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = language_id.learn(docs.where(~language_id.held_out(docs["doc_id"])))
    assert sorted(profiles) == ["de", "en"]
    found = language_id.identify(docs, profiles).collect()
    assert all(r["lang_pred"] == r["lang"] and 0 <= r["score"] <= 1 for r in found)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 !"), (4, "der fluss")], "doc_id long, text string")
    assert [r["lang_pred"] for r in language_id.identify(odd, profiles).orderBy("doc_id").collect()] == ["und", "und", "und", "de"]
    assert {r["lang_pred"] for r in language_id.identify(odd, {}).collect()} == {"und"}
    held = {r["doc_id"]: r["h"] for r in docs.select("doc_id", language_id.held_out(docs["doc_id"]).alias("h")).collect()}
    assert all(h == (zlib.crc32(str(k).encode()) % 4 == 2) for k, h in held.items())


def test_language_accuracy(spark):
    found = language_id.op6_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    judged_rows = found.where("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in judged_rows) >= 0.95 * len(judged_rows)


def test_unknown_languages_leave_the_pipeline(spark):
    """The stage's learning and predicting decide: texts in languages that no document is marked with go, though they have letters."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    foreign = ["Это русский текст без других слов", "漢字かな交じり文です", "Questo testo parla di cose italiane e altre", "qzxv kwj pfgh", "Dzisiaj jest ładna pogoda i idziemy na spacer do parku"]
    own = ["the house and the river of the town", "das haus und der fluss von der stadt"]
    rows = [(10**9 + k, t, None, "s", 1) for k, t in enumerate(foreign + own)]
    kept = corpus_pipeline.language_id(spark, docs.unionByName(spark.createDataFrame(rows, docs.schema)), "")
    assert {r["text"] for r in kept.where("source = 's'").collect()} == set(own)
    n = docs.where(r"text rlike '\\p{L}'").count()
    assert 0.99 * n <= kept.where("source <> 's'").count() <= n


def test_hilbert_curve_visits_neighbours():
    import numpy as np

    n = 8
    x, y, z = (a.ravel() for a in np.meshgrid(range(n), range(n), range(n), indexing="ij"))
    at = hilbert_shards.hilbert_index([x, y, z], 3)
    assert sorted(at) == list(range(n**3))
    order = np.argsort(at)
    steps = np.abs(np.diff(np.stack([x, y, z])[:, order], axis=1)).sum(axis=0)
    assert (steps == 1).all()


def test_hilbert_shards(spark):
    texts = EDGES + [f"text {k % 7}" for k in range(100)]
    out = hilbert_shards.hilbert_shards(documents(spark, texts)).collect()
    counts = {}
    for r in out:
        counts.setdefault(r["shard"], []).append(r["slot"])
        t = texts[r["doc_id"]]
        assert (r["size"], r["text_crc32"]) == (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    assert len(out) == len(texts) and len(counts) == 16
    assert max(map(len, counts.values())) - min(map(len, counts.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in counts.values())
    assert hilbert_shards.hilbert_shards(documents(spark, ["x"]).limit(0)).count() == 0


def test_piece_dropout(spark):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = [*EDGES, "▁ odd ▁▁ spaces", "tabs\tand\nlines \n\n", "The quick brown fox jumps over unbelievable segmentations."]
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = {r["doc_id"]: r["ids"] for r in piece_dropout.encode_texts(documents(spark, texts), path, dropout=0.0).collect()}
    for k, t in enumerate(texts):
        if t and "▁" not in t and len(t) < 1000 and not re.search(r"\s$|^\s|\s\s|\t", t):
            assert list(plain[k]) == model.encode(t)
    varied = piece_dropout.encode_texts(documents(spark, texts), path, dropout=0.3)
    assert {r["doc_id"]: r["text"] for r in piece_dropout.decode_ids(varied, path).collect()} == {k: t or "" for k, t in enumerate(texts)}
    again = {r["doc_id"]: r["ids"] for r in piece_dropout.encode_texts(documents(spark, texts), path, dropout=0.3).collect()}
    assert again == {r["doc_id"]: r["ids"] for r in varied.collect()}
    assert again[len(texts) - 1] != plain[len(texts) - 1]


def dropped(path, doc_id, text, dropout, seed):
    """Merge-dropout as stated, in plain Python: the best candidate of a chunk first, each drawn once."""
    import sentencepiece
    import xxhash

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    score = {model.id_to_piece(i): (-model.get_score(i), i) for i in plain}
    key, wide, out = xxhash.xxh3_64_intdigest(f"{doc_id}", seed), 2**64 - 1, []
    for place, chunk in enumerate(re.findall(r" *[^ \n]+| +|\n", " " + text) if text else []):
        parts, skipped, number = ["▁" if c == " " else "\0" if c == "▁" else c for c in chunk], set(), 0
        names = list(range(len(parts)))
        while True:
            found = [(score[a + b][0], n, k) for k, (a, b, n) in enumerate(zip(parts, parts[1:], names)) if a + b in score and (n, a, b) not in skipped]
            if not found:
                break
            _, n, k = min(found)
            x = (place * 0x9E3779B97F4A7C15 + number * 0xC2B2AE3D27D4EB4F & wide) ^ key
            for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
                x = (x ^ x >> 30) * factor & wide
            number += 1
            if x >> 32 < int(dropout * 2**32):
                skipped.add((n, parts[k], parts[k + 1]))
            else:
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
                del names[k + 1]
        for p in parts:
            out += [score[p][1]] if p in score else [model.piece_to_id(f"<0x{b:02X}>") for b in p.replace("\0", "▁").encode()]
    return out


def test_piece_dropout_by_brute_force(spark):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = [t for t in EDGES if len(t or "") < 1000] + ["▁ odd ▁▁ spaces", "The quick brown fox jumps over unbelievable segmentations.\n" * 4, "x" * 300 + "unsegmented" * 12, "Größe naïve 🙂 ok"]
    for dropout in (0.1, 0.5):
        got = {r["doc_id"]: r["ids"] for r in piece_dropout.encode_texts(documents(spark, texts), path, dropout=dropout, seed=5).collect()}
        for k, t in enumerate(texts):
            assert got[k] == dropped(path, k, t, dropout, 5), (dropout, t)


def test_piece_dropout_draws_for_each_occurrence(monkeypatch):
    import public_tokenizers

    model = piece_dropout.PieceModel(public_tokenizers.path("piece_bpe_32k.model"))
    encode = piece_dropout.Encoder(model, 0.1, 17)
    starts_word = [model.decode([i]).startswith(b" ") for i in range(model.size)]
    for word in ("to", "the", "was", "segmentations"):
        whole = encode.model.merge(" " + word).tolist()
        seen = []
        for doc_id, got in enumerate(encode(list(range(100)), [" ".join([word] * 40)] * 100)):
            got = got.tolist()
            assert model.decode(got) == b" " + " ".join([word] * 40).encode()
            starts = [k for k, i in enumerate(got) if starts_word[i]] + [len(got)]
            seen += [tuple(got[a:b]) for a, b in zip(starts, starts[1:])]
        assert len(seen) == 4000
        taken = int(encode.taken.data[encode.index[" " + word]])
        share = sum(s == tuple(whole) for s in seen) / 4000
        assert 0.9**taken - 0.02 < share < 0.9 ** max(1, taken // 3) + 0.02 < 1, word
    assert len(set(seen)) > 4
    texts = [None, "", " to  the\nwas " * 50, "segmentations " * 700, "a b" * 900, "z" * 100 + " end"] * 3
    want = [x.tolist() for x in encode(list(range(18)), texts)]
    monkeypatch.setattr(piece_dropout, "CHARS_AT_ONCE", 64)
    monkeypatch.setattr(piece_dropout, "OCCURRENCES", 7)
    monkeypatch.setattr(piece_dropout, "MAX_CHUNKS", 3)
    cold = piece_dropout.Encoder(model, 0.1, 17)
    assert [x.tolist() for x in cold(list(range(18)), texts)] == want


def test_token_files(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [*EDGES, "tabs\tand  spaces \n\n x\x1cy", "<|endoftext|> inside", "it's 12345 ok"] * 3
    ids = random.Random(4).sample(range(10_000), len(texts))
    files = token_files.write_token_files(documents(spark, texts, ids), f"file://{tmp_path}/t", path)
    got = {r["doc_id"]: r for r in token_files.read_token_files(spark, f"file://{tmp_path}/t", files).collect()}
    tokenizer, start = Tokenizer.from_file(path), 0
    for i, t in sorted(zip(ids, texts, strict=True)):
        own = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        data = b"".join(x.to_bytes(4, "little") for x in own)
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(own), zlib.crc32(data))
        start += len(own)
    assert token_files.read_token_files(spark, f"file://{tmp_path}/u", token_files.write_token_files(documents(spark, ["x"]).limit(0), f"file://{tmp_path}/u", path)).count() == 0


def test_blocks_round_trip():
    import io

    import numpy as np

    rng = np.random.default_rng(5)
    ids = [rng.integers(0, 2**k, n, dtype=np.uint32) for k, n in ((1, 1), (5, 5000), (16, 3000), (31, 1024), (32, 2049))] + [np.full(4000, 7, dtype=np.uint32)]
    stream = io.BytesIO()
    writer = token_files.Writer(stream)
    for k, own in enumerate(ids):
        writer.add([k], [len(own)], own)
    writer.close()
    reader = token_files.Reader(io.BytesIO(stream.getvalue()))
    assert all(np.array_equal(got, own) and k == d for k, (own, (d, _, got)) in enumerate(zip(ids, reader.documents(), strict=True)))
    whole = np.concatenate(ids)
    assert np.array_equal(reader.ids(1000, 7000), whole[1000:7000])


def test_digest_of_lines(spark):
    rows = line_dedup.op7_line_dedup(spark, SF).collect()
    assert all(len(r["kept_sha256"]) == 64 for r in rows)
    assert hashlib.sha256(b"").hexdigest() != rows[0]["kept_sha256"]


def test_clashing_columns(spark):
    docs = documents(spark, ["a b c d e f", "a b c d e f", None]).withColumnsRenamed({"source": "token"}).selectExpr("*", "1 AS score", "2 AS cls", "3 AS ids", "4 AS k1", "5 AS n")
    bench = spark.createDataFrame([(1, "z", 0)], "item_id long, text string, k int")
    assert decontaminate.drop_contaminated(docs, bench).columns == docs.columns
    assert line_dedup.dedup_lines(docs).columns[: len(docs.columns)] == docs.columns
    assert ngram_jaccard.keep_one(docs).columns == docs.columns
    assert language_id.keep_identified(docs).columns == docs.columns


def test_words_of_patterns_do_not_collide(spark):
    word = "a"
    while len(word) < 2048:  # the Thue-Morse word, which ties all polynomial hashes modulo a power of two
        word += word.translate(str.maketrans("ab", "ba"))
    texts = [word[:n].translate(t) for n in (1024, 2048) for t in (str.maketrans("", ""), str.maketrans("ab", "ba"))]
    got = [r["component_id"] for r in ngram_jaccard.jaccard_components(documents(spark, texts)).orderBy("doc_id").collect()]
    assert got == [0, 1, 2, 3]


@pytest.mark.parametrize("crowded", [0, 10**9])
def test_crowded_tokens_by_brute_force(spark, monkeypatch, crowded):
    """A group of near copies of one source, with and without links to it, through turns of pivots and small groups or without any."""
    monkeypatch.setattr(ngram_jaccard, "CROWDED", crowded)
    monkeypatch.setattr(ngram_jaccard, "BEFORE", 2)
    rng = random.Random(8)
    source = [f"w{k}" for k in range(60)]
    texts = []
    for k in range(150):
        own = list(source[: rng.choice([50, 55, 60])])
        for place in rng.sample(range(len(own)), rng.choice([0, 1, 1, 2, 2, 3])):
            own[place] = f"x{k}" if k % 3 else rng.choice("uv")
        texts.append(" ".join(own))
    ids = list(range(150))
    rng.shuffle(ids)
    want = components([shingles(t) for t in texts], ids)
    got = {r["doc_id"]: r["component_id"] for r in ngram_jaccard.jaccard_components(documents(spark, texts, ids)).collect()}
    assert got == want and 5 < len(set(want.values())) < 145


def test_turns_move_rows_of_crowded_tokens_only(spark, monkeypatch):
    """A crowded group beside small ones: links as by brute force, and turns leave the small groups' rows where they are."""
    monkeypatch.setattr(ngram_jaccard, "CROWDED", 6)
    seen, mixed = [], ngram_jaccard._mixed

    def counted(rows, joined):
        seen.append(rows.select("m").collect() if "m" in rows.columns else None)
        return mixed(rows, joined)

    monkeypatch.setattr(ngram_jaccard, "_mixed", counted)
    rng = random.Random(12)
    texts = []
    for group, size in [(0, 120), *[(g, 4) for g in range(1, 30)]]:
        source = [f"w{group}x{k}" for k in range(60)]
        for _ in range(size):
            own = list(source[: rng.choice([50, 55, 60])])
            for place in rng.sample(range(len(own)), rng.choice([0, 1, 2, 2, 3])):
                own[place] = rng.choice("uv")
            texts.append(" ".join(own))
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    got = {r["doc_id"]: r["component_id"] for r in ngram_jaccard.jaccard_components(documents(spark, texts, ids)).collect()}
    assert got == components([shingles(t) for t in texts], ids)
    assert seen[0] is None and len(seen) > 1 and all(r["m"] > 6 for r in seen[1])
