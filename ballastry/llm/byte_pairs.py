"""Byte-level BPE by a rank file, with a hierarchical bitmap as the queue of merge ranks.

A text is cut by the pattern into pre-tokens, and each is merged by itself: always the pair of neighbours whose joint bytes
have the lowest rank, the leftmost among equals. ``RankQueue`` holds the candidates. Each rank has a bucket for
the places in the linked list of parts where its pair starts; one bit a rank says whether its bucket has entries, and a bit in the level above
whether any of 64 words below has. Find-first-set from the top gives the next rank in as many steps as there are levels (3 for
50,257 ranks), however long the pre-token is. A merge makes the entries of its neighbours stale; they stay in their buckets and are
skipped when taken. A bucket is taken whole and its places are merged from left to right; if a merge offers a rank
below the bucket's, the rest of that pre-token goes back first. Many short pre-tokens share one run of the queue, with borders between them. A pre-token of n bytes so takes about n steps, where scans of all pairs take n squared.

Plan: one scan, no shuffle. Under the pattern ``AT_SPACES`` texts are first cut where white space follows other characters, which is cheaper than the pattern,
and only pieces that are new to the worker are cut by the pattern. A worker keeps the ids of up to ``MAX_KEPT`` short pieces and pre-tokens and starts that table anew beyond; texts of up to
``CHARS_AT_ONCE`` characters together are worked off at once, a longer one ``PIECES_AT_ONCE`` pre-tokens at a time, so only its ids (4 bytes each) and one part of it are held.

Defined results: a null text is encoded as the empty text, which has no ids and decodes to no bytes; null ids decode to null. Ids that are null
or have no bytes in the vocabulary fail the decoding. Rows that repeat an id give equal rows. An empty table gives an empty result. Other columns pass
through unless they are named ``ids`` or ``bytes`` (replaced).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain, filterfalse, islice
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ballastry.llm.common import table
from ballastry.llm.token_files import PIECES

MAX_KEPT = 900_000
KEPT_LENGTH = 64
CHARS_AT_ONCE = 1 << 20
PIECES_AT_ONCE = 1 << 16
BYTES_AT_ONCE = 1 << 17
#: Stands between pre-tokens; no UTF-8 text has it, and no token of several bytes may.
BORDER = b"\xff"


#: A pattern none of whose pre-tokens has white space after another character: so the borders of PIECES, which has the same white space, are borders of its own.
AT_SPACES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class RankQueue:
    """Empty buckets for places by rank, and bitmaps that find the lowest rank with places: a bit a rank, and a bit a word below.

    ``RankModel.merge`` works on them in place, as calls would take most of its time. Between its runs all are empty.
    """

    def __init__(self, ranks: int) -> None:
        words = -(-ranks // 64)
        self.low, self.mid = [0] * words, [0] * -(-words // 64)  # the top level is one number, which merge holds
        self.buckets: list[list[int] | None] = [None] * ranks


#: The value of each bit of a word.
BIT = [1 << k for k in range(64)]


class RankModel:
    """The ranks of a vocabulary file, its pattern, and bytes for decoding."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        if any(BORDER in token and len(token) > 1 for token in self.ranks):
            raise ValueError("a token has the byte 255, which no text has")
        self.pattern = regex.compile(pattern)
        size = max(self.ranks.values()) + 1
        self.longest = max(map(len, self.ranks))
        self.bytes: list[bytes | None] = [None] * size
        for token, rank in self.ranks.items():
            self.bytes[rank] = token
        self.decimals = np.array([b"%d," % rank for rank in range(size)])
        self.queue = RankQueue(size)
        self.at_spaces = pattern == AT_SPACES
        self.cut = PIECES if self.at_spaces else self.pattern
        self.kept: dict[str, bytes] = {}

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each pre-token; all are worked off in one queue, since no pair goes over a border."""
        look_up, longest = self.ranks.get, self.longest
        low, mid, buckets = self.queue.low, self.queue.mid, self.queue.buckets
        data = BORDER.join(pieces) + BORDER
        n, top = len(data), 0
        before, after = list(range(-1, n - 1)), list(range(1, n + 2))  # the part that starts at i ends at after[i]
        current = [-1] * n  # the rank that the part at i and its right neighbour have together
        offered = []
        for i in range(n - 1):
            rank = look_up(data[i : i + 2])
            if rank is not None:
                current[i] = rank
                offered.append((rank, i))
        while True:
            for rank, i in offered:
                bucket = buckets[rank]
                if bucket is None:
                    buckets[rank] = [i]
                    word = rank >> 6
                    low[word] |= BIT[rank & 63]
                    mid[word >> 6] |= BIT[word & 63]
                    top |= 1 << (word >> 6)
                else:
                    bucket.append(i)
            if not top:
                break
            a = (top & -top).bit_length() - 1  # find the first bit set, level by level
            bits = mid[a]
            b = a << 6 | (bits & -bits).bit_length() - 1
            bits = low[b]
            rank = b << 6 | (bits & -bits).bit_length() - 1
            places = buckets[rank]
            buckets[rank] = None
            low[b] = bits = bits & bits - 1
            if not bits:
                mid[a] = bits = mid[a] & mid[a] - 1
                if not bits:
                    top &= top - 1
            if len(places) > 1:
                places.sort()
            offered = []
            hold = -1  # up to here, a pair of a lower rank comes first
            for i in places:
                if current[i] != rank:
                    continue  # stale: one of its parts has been merged meanwhile
                if i < hold:
                    offered.append((rank, i))
                    continue
                gone = after[i]
                j = after[i] = after[gone]
                current[gone] = current[i] = -1
                before[j] = i
                end = after[j]
                found = look_up(data[i:end]) if end - i <= longest else None
                if found is not None:
                    current[i] = found
                    offered.append((found, i))
                    if found < rank:
                        hold = data.index(BORDER, i)
                h = before[i]
                if h >= 0:
                    found = look_up(data[h:j]) if j - h <= longest else None
                    if found is None:
                        current[h] = -1
                    else:
                        current[h] = found
                        offered.append((found, h))
                        if found < rank:
                            hold = data.index(BORDER, i)
        out, ids, i = [], [], 0
        while i < n:
            part = data[i : after[i]]
            i = after[i]
            if part == BORDER:
                out.append(ids)
                ids = []
            else:
                ids.append(self.ranks[part])
        return out

    def _merged(self, tokens: set[str]) -> Iterator[tuple[str, list[int]]]:
        held, size = [], 0
        for token in sorted(tokens):
            held.append(token)
            size += len(token)
            if size > BYTES_AT_ONCE:
                yield from zip(held, self.merge([t.encode() for t in held]), strict=True)
                held, size = [], 0
        if held:
            yield from zip(held, self.merge([t.encode() for t in held]), strict=True)

    def _keep_tokens(self, tokens: set[str]) -> None:
        for token in tokens:
            whole = self.ranks.get(token.encode())
            if whole is not None:
                self.kept[token] = whole.to_bytes(4, "little")
        for token, ids in self._merged(set(filterfalse(self.kept.__contains__, tokens))):
            self.kept[token] = pack(f"<{len(ids)}i", *ids)

    def _ids(self, cut: list[list[str]], whole: bool = False) -> Iterator[np.ndarray]:
        """The ids of some lists of pieces, which are pre-tokens if whole is true."""
        new = set(filterfalse(self.kept.__contains__, chain.from_iterable(cut)))
        if len(self.kept) + len(new) > MAX_KEPT:
            self.kept.clear()
            new = set(chain.from_iterable(cut))
        long = {p for p in new if len(p) > KEPT_LENGTH}
        if self.at_spaces and not whole:
            found = {piece: self.pattern.findall(piece) for piece in new}
            tokens = set(filterfalse(self.kept.__contains__, chain.from_iterable(found.values())))
            long |= {t for t in tokens if len(t) > KEPT_LENGTH}
            self._keep_tokens(tokens)
            self.kept.update([(piece, b"".join(map(self.kept.__getitem__, parts))) for piece, parts in found.items() if len(parts) > 1])
        else:
            self._keep_tokens(new)
        for pieces in cut:
            yield np.frombuffer(b"".join(map(self.kept.__getitem__, pieces)), "<i4")
        for piece in long:
            self.kept.pop(piece, None)

    def encode(self, texts: list[str | None]) -> Iterator[Iterable[np.ndarray]]:
        """For each text its ids, in parts. A text's parts are to be taken before the next text's."""
        held: list[list[str]] = []
        size = 0
        for text in texts:
            text = text or ""
            if held and size + len(text) > CHARS_AT_ONCE:
                yield from ([ids] for ids in self._ids(held))
                held, size = [], 0
            if len(text) > CHARS_AT_ONCE:
                yield self._in_parts(text)
            else:
                held.append(self.cut.findall(text))
                size += len(text)
        yield from ([ids] for ids in self._ids(held))

    def _in_parts(self, text: str) -> Iterator[np.ndarray]:
        tokens = (m.group() for m in self.pattern.finditer(text))
        while part := list(islice(tokens, PIECES_AT_ONCE)):
            yield from self._ids([part], True)

    def written(self, ids: np.ndarray) -> bytes:
        """The ids in decimals, each with a comma after it."""
        digits = self.decimals[ids].view(np.uint8)
        return digits[digits != 0].tobytes()

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


_kept: dict[tuple[str, str], RankModel] = {}


def model(path: str, pattern: str) -> RankModel:
    """The model of this worker."""
    if (path, pattern) not in _kept:
        _kept.clear()
        _kept[path, pattern] = RankModel(path, pattern)
    return _kept[path, pattern]


def encode_texts(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """docs (text and others) with the array ``ids``."""
    names = [c for c in docs.columns if c != "ids"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(vocabulary, pattern)
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                part = batch.slice(k, 200)
                parts = ([np.empty(0, np.int32), *ids] for ids in own.encode(part["text"].to_pylist()))
                found = [np.concatenate(p) for p in parts]
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found), pa.int32()))
                yield pa.RecordBatch.from_arrays([*[part[c] for c in names], ids], [*names, "ids"])

    fields = [docs.schema[c] for c in names]
    return docs.select(*names).mapInArrow(encode, T.StructType([*fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode_ids(encoded: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """encoded with the column ``bytes`` made from ``ids``; ids may be cut inside a character, so they need not be text."""
    names = [c for c in encoded.columns if c != "bytes"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(vocabulary, pattern)
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                part = batch.slice(k, 200)
                found = [own.decode(ids.values.to_pylist()) if ids.is_valid else None for ids in part["ids"]]
                yield pa.RecordBatch.from_arrays([*[part[c] for c in names], pa.array(found, pa.binary())], [*names, "bytes"])

    fields = [encoded.schema[c] for c in names]
    return encoded.select(*names).mapInArrow(decode, T.StructType([*fields, T.StructField("bytes", T.BinaryType())]))


def op11_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text."""
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path, pattern)
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                counts, names, texts = [], [], []
                for parts in own.encode(part["text"].to_pylist()):
                    n, of_ids, of_bytes = 0, hashlib.sha256(), hashlib.sha256()
                    for ids in parts:
                        if len(ids):
                            of_ids.update(b"," * (n > 0) + own.written(ids)[:-1])
                        of_bytes.update(own.decode(ids.tolist()))
                        n += len(ids)
                    counts.append(n)
                    names.append(of_ids.hexdigest())
                    texts.append(of_bytes.hexdigest())
                columns = [part["doc_id"], pa.array(counts, pa.int64()), pa.array(names, pa.string()), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.mapInArrow(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
