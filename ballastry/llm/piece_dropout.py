"""Encoding with a SentencePiece merge model under seeded merge-dropout, and lossless decoding.

A text gets the dummy leading space of the model, and is cut before every run of spaces and around
line feeds; no piece of the model crosses these cuts, so each chunk is merged by itself. The agenda
of a chunk holds its candidate merges, best piece first and leftmost among equals. A candidate taken
from the agenda is skipped if a keyed hash of (seed, document, place of the chunk, number of the candidate
among those taken) falls below the dropout rate: every occurrence of a word has its own draws, and every
run gives the same ids. With dropout 0 the merges are the model's own. Characters without a piece, and the space
symbol U+2581 where it stands in a text, become byte pieces, so decoding gives back the text exactly.

Agendas are worked off in numpy for many chunks at once: a column a chunk, and in each step the best
candidate of every column. A table keeps what short chunks become without skipped candidates and how many
candidates that takes; an occurrence for which none of those draws falls below the rate is looked up, any
other runs its own agenda. Chunks of more than ``LONG_CHUNK`` characters run theirs on a heap, one at a time.

Plan: one scan, no shuffle, no Python object a row in the output. A worker holds texts of about ``CHARS_AT_ONCE``
characters at a time and a table that starts anew at ``MAX_CHUNKS`` chunks of at most ``LONG_CHUNK`` characters.

Defined results: a null text is encoded as the empty text, which has no ids. Rows that repeat an id
and text get the same ids. A null doc_id is a key like any other. An empty table gives an empty
result. Other columns pass through unless they are named ``ids`` (replaced).
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ballastry.llm.common import table, tidy

SEED = 17
DROPOUT = 0.1
MAX_CHUNKS = 200_000
LONG_CHUNK = 48
WIDTHS = (4, 6, 8, 12, 16, 24, LONG_CHUNK)
CHARS_AT_ONCE = 1 << 19
OCCURRENCES = 1 << 17
SPACE = "▁"
CHUNKS = re.compile(r" *+[^ \n]++| ++|\n")
NONE = np.int32(2**31 - 1)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers of the ranges [start, start + count), one range after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


class PieceModel:
    """The pieces of a merge model, its pairs that merge, and bytes for decoding.

    A part of a chunk is a number: the piece's id, or ``size`` + code point for a character without a piece.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        surface: list[bytes] = []
        self.byte = np.zeros(256, dtype=np.int32)
        scores = {}
        for i in range(self.size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                surface.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                surface.append(b"")
            else:
                scores[piece] = (-model.get_score(i), i)
                surface.append(piece.replace(SPACE, " ").encode())
        self.bytes = np.frombuffer(b"".join(surface), dtype=np.uint8)
        self.byte_counts = np.array([len(s) for s in surface])
        self.byte_starts = np.cumsum(self.byte_counts) - self.byte_counts
        place = {s: k for k, s in enumerate(sorted({s for s, _ in scores.values()}))}
        rank = {i: place[s] for s, i in scores.values()}
        ids = {p: i for p, (_, i) in scores.items()}
        self.part_of = self.size + np.arange(0x110000, dtype=np.int32)  # by code point
        for piece, i in ids.items():
            if len(piece) == 1 and piece != SPACE:
                self.part_of[ord(piece)] = i
        self.part_of[ord(" ")] = ids[SPACE] if SPACE in ids else self.size + ord(" ")
        self.nobody = self.size + 0x110000

        def part(s: str) -> int | None:
            if s == SPACE:
                return int(self.part_of[ord(" ")])
            return ids.get(s, self.size + ord(s) if len(s) == 1 else None)

        pairs = {}
        for piece, i in ids.items():
            for k in range(1, len(piece)):
                a, b = part(piece[:k]), part(piece[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = (rank[i], i)
        self.pairs = pairs
        self.bits = max(4, (4 * len(pairs) - 1).bit_length())
        self.slots = np.full(1 << self.bits, -1, dtype=np.int64)
        self.merged = np.zeros((2, 1 << self.bits), dtype=np.int32)
        for key, found in pairs.items():
            at = int(self._slot(np.array([key]))[0])
            while self.slots[at] >= 0:
                at = (at + 1) & (len(self.slots) - 1)
            self.slots[at] = key
            self.merged[:, at] = found

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look_up(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks (NONE where two parts do not merge) and ids of the pieces that parts a and b make."""
        keys = a.astype(np.int64) << 32 | b
        at = self._slot(keys)
        there = self.slots[at]
        ranks, ids = np.where(there == keys, self.merged[0, at], NONE), self.merged[1, at]
        open_ = np.flatnonzero((there != keys) & (there >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.slots) - 1)
            there = self.slots[at[open_]]
            hit = open_[there == keys[open_]]
            ranks[hit], ids[hit] = self.merged[0, at[hit]], self.merged[1, at[hit]]
            open_ = open_[(there != keys[open_]) & (there >= 0)]
        return ranks, ids

    def spelled(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of parts and how many each has: one, or those of its bytes."""
        if not (parts >= self.size).any():
            return parts, np.ones(len(parts), dtype=np.int64)
        counts, out = np.ones(len(parts), dtype=np.int64), []
        for k in np.flatnonzero(parts >= self.size):
            counts[k] = len(chr(parts[k] - self.size).encode())
        flat = np.repeat(parts, counts)
        raw = b"".join([chr(p - self.size).encode() for p in parts[parts >= self.size].tolist()])
        flat[flat >= self.size] = self.byte[np.frombuffer(raw, dtype=np.uint8)]
        return flat, counts

    def merge(self, chunk: str, skipped=()) -> np.ndarray:
        """The ids of one chunk; the candidates whose numbers are in skipped are not merged."""
        parts: list[int | None] = self.part_of[np.frombuffer(chunk.encode("utf-32-le"), dtype=np.uint32)].tolist()
        n, pairs = len(parts), self.pairs
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = []

        def offer(i: int, j: int) -> None:
            found = pairs.get(parts[i] << 32 | parts[j])
            if found:
                heapq.heappush(agenda, (found[0], i, parts[i], parts[j], found[1]))

        for i in range(n - 1):
            offer(i, i + 1)
        taken = 0
        while agenda:
            _, i, a, b, made = heapq.heappop(agenda)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue  # one side has been merged meanwhile
            taken += 1
            if taken - 1 in skipped:
                continue
            parts[i], parts[j] = made, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                offer(i, k)
            if before[i] >= 0:
                offer(before[i], i)
        return self.spelled(np.array([p for p in parts if p is not None], dtype=np.int32))[0]

    def decode(self, ids) -> bytes:
        """The pieces' bytes, the dummy leading space among them."""
        ids = np.asarray(ids, dtype=np.int64)
        return self.bytes[ragged(self.byte_starts[ids], self.byte_counts[ids])].tobytes()


def draws(key: np.ndarray, place: np.ndarray, number: np.ndarray) -> np.ndarray:
    """32-bit draws for candidates by document key, place of the chunk and number of the candidate."""
    x = place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + number.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= key
    for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x ^= x >> np.uint64(30)
        x *= np.uint64(factor)
    return x >> np.uint64(32)


def merge_columns(model: PieceModel, parts: np.ndarray, limit: int = 0, key: np.ndarray | None = None, place: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Works off the agendas of many chunks.

    parts has a chunk a column, below ``model.nobody`` from its end on, which also fills the last row.
    Returns the parts left in each column (-1 elsewhere), and how many candidates each took.
    """
    height, n = parts.shape
    parts = np.ascontiguousarray(parts)
    out, taken_by = parts.copy(), np.zeros(n, dtype=np.int64)
    columns = np.arange(n)
    after = np.repeat(np.arange(1, height + 1, dtype=np.int8)[:, None], n, axis=1)
    before = np.repeat(np.arange(-1, height - 1, dtype=np.int8)[:, None], n, axis=1)
    before[0] = height - 1
    ranks, makes = model.look_up(parts[:-1].ravel(), parts[1:].ravel())
    slot = np.repeat(np.arange(height - 1, dtype=np.int32), n)
    first = np.full((height, n), NONE)
    first[:-1] = np.where(ranks < NONE, ranks * np.int32(64) + slot, NONE).reshape(height - 1, n)
    made = np.zeros((height, n), dtype=np.int32)
    made[:-1] = makes.reshape(height - 1, n)
    taken = np.zeros(n, dtype=np.int64)
    while n:
        best = first.min(axis=0)
        going = best < NONE
        if np.count_nonzero(going) * 4 <= n * 3:
            done = columns[~going]
            out[:, done], taken_by[done] = parts[:, ~going], taken[~going]
            on = np.flatnonzero(going)
            parts, after, before, first, made = (x.take(on, axis=1) for x in (parts, after, before, first, made))
            columns, taken, best, n = columns[on], taken[on], best[on], len(on)
            if not n:
                break
            r = np.arange(n)
        else:
            r = np.flatnonzero(going)
            best = best[r]
        i = (best & 63).astype(np.int64)
        at = i * n + r
        if limit:
            skip = draws(key[columns[r]], place[columns[r]], taken[r]) < limit
            first.ravel()[at[skip]] = NONE
            taken[r] += 1
            stay = ~skip
            i, r, at = i[stay], r[stay], at[stay]
        else:
            taken[r] += 1
        p_, f_, m_, a_, b_ = parts.ravel(), first.ravel(), made.ravel(), after.ravel(), before.ravel()
        j = a_[at].astype(np.int64) * n + r
        new = m_[at]
        p_[at], p_[j], f_[j] = new, -1, NONE
        k = a_[j].astype(np.int64)
        a_[at] = k
        right, left = k * n + r, b_[at].astype(np.int64)
        b_[right] = i
        ranks, makes = model.look_up(new, p_[right])
        f_[at], m_[at] = np.where(ranks < NONE, ranks * np.int32(64) + i.astype(np.int32), NONE), makes
        h = left * n + r
        ranks, makes = model.look_up(p_[h], new)
        f_[h], m_[h] = np.where(ranks < NONE, ranks * np.int32(64) + left.astype(np.int32), NONE), makes
    out[out >= model.nobody] = -1
    return out, taken_by


class Growing:
    """An array that grows at its end."""

    def __init__(self, dtype) -> None:
        self.data, self.n = np.empty(1024, dtype=dtype), 0

    def add(self, more: np.ndarray) -> None:
        need = self.n + len(more)
        if need > len(self.data):
            self.data = np.concatenate([self.data[: self.n], np.empty(max(need, self.n) , dtype=self.data.dtype)])
        self.data[self.n : need] = more
        self.n = need


class Encoder:
    """Encodes texts; keeps what short chunks become without skipped candidates."""

    def __init__(self, model: PieceModel, dropout: float, seed: int) -> None:
        self.model, self.limit, self.seed = model, int(dropout * 2**32), seed
        self._empty()

    def _empty(self) -> None:
        self.index: dict[str, int] = {}
        self.codes, self.ids = Growing(np.int32), Growing(np.int32)
        self.lengths, self.counts, self.taken = Growing(np.int64), Growing(np.int64), Growing(np.int64)
        self.code_starts, self.id_starts = Growing(np.int64), Growing(np.int64)

    def __call__(self, doc_ids: list[int | None], texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        held: list[tuple[int, int, list[str]]] = []
        size = 0
        for k, text in enumerate(texts):
            place = 0
            for part in _cut(" " + text) if text else ():
                chunks = CHUNKS.findall(part)
                held.append((k, place, chunks))
                place += len(chunks)
                size += len(part)
                if size > CHARS_AT_ONCE:
                    self._run(held, doc_ids, out)
                    held, size = [], 0
        self._run(held, doc_ids, out)
        return [own[0] if len(own) == 1 else np.concatenate(own or [np.empty(0, dtype=np.int32)]) for own in out]

    def _run(self, held: list[tuple[int, int, list[str]]], doc_ids: list[int | None], out: list[list[np.ndarray]]) -> None:
        if not held:
            return
        if len(self.index) > MAX_CHUNKS:
            self._empty()
        chunks = [c for _, _, own in held for c in own]
        self._learn({c for c in chunks if c not in self.index and len(c) <= LONG_CHUNK})
        at = np.fromiter(map(self.index.get, chunks, _minus_one()), dtype=np.int64, count=len(chunks))
        n = np.array([len(own) for _, _, own in held])
        keys = np.array([xxhash.xxh3_64_intdigest(f"{doc_ids[k]}", self.seed) for k, _, _ in held], dtype=np.uint64)
        key, place = np.repeat(keys, n), ragged(np.array([p for _, p, _ in held]), n)
        counts, ids = [], []
        for a in range(0, len(at), OCCURRENCES):
            b = min(a + OCCURRENCES, len(at))
            own = self._encoded(chunks[a:b], at[a:b], key[a:b], place[a:b])
            counts.append(own[0])
            ids.append(own[1])
        ends = np.concatenate([[0], np.cumsum(np.concatenate(counts))])[np.concatenate([[0], np.cumsum(n)])]
        flat = np.concatenate(ids)
        for (k, _, _), a, b in zip(held, ends[:-1], ends[1:], strict=True):
            out[k].append(flat[a:b])

    def _learn(self, new: set[str]) -> None:
        """Puts new chunks into the table."""
        for width, names in _by_width(sorted(new)):
            codes = np.frombuffer("".join(names).encode("utf-32-le"), dtype=np.uint32)
            lengths = np.array([len(c) for c in names])
            parts = self.model.part_of[codes]
            left, taken = merge_columns(self.model, _columns(parts, np.cumsum(lengths) - lengths, lengths, width, self.model.nobody))
            ids, counts = self._spelled(left)
            self.index.update(zip(names, range(len(self.index), len(self.index) + len(names)), strict=True))
            for grown, values in ((self.lengths, lengths), (self.counts, counts), (self.taken, taken)):
                grown.add(values)
            self.code_starts.add(self.codes.n + np.cumsum(lengths) - lengths)
            self.id_starts.add(self.ids.n + np.cumsum(counts) - counts)
            self.codes.add(parts)
            self.ids.add(ids)

    def _spelled(self, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all columns, one after the other, and their counts."""
        there = left.T >= 0
        ids, n = self.model.spelled(left.T[there])
        counts = there.sum(axis=1)
        if len(ids) > len(n):
            counts = np.add.reduceat(n, np.cumsum(counts) - counts)
        return ids, counts

    def _encoded(self, chunks: list[str], at: np.ndarray, key: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each occurrence, and all ids."""
        counts = np.where(at < 0, 0, self.counts.data[at])
        own: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # occurrences, their counts and ids
        for k in np.flatnonzero(at < 0).tolist():
            number = np.arange(3 * len(chunks[k]) if self.limit else 0)
            skipped = set(np.flatnonzero(draws(key[k : k + 1], place[k : k + 1], number) < self.limit).tolist())
            ids = self.model.merge(chunks[k], skipped)
            own.append((np.array([k]), np.array([len(ids)]), ids))
        if self.limit:
            taken = np.where(at < 0, 0, self.taken.data[at])
            where = np.repeat(np.arange(len(at)), taken)
            number = np.arange(len(where)) - np.repeat(np.cumsum(taken) - taken, taken)
            hit = np.zeros(len(at), dtype=bool)
            hit[where[draws(key[where], place[where], number) < self.limit]] = True
            hit = np.flatnonzero(hit)
            lengths = self.lengths.data[at[hit]]
            low = 0
            for width in WIDTHS:
                rows = hit[(lengths > low) & (lengths <= width)]
                low = width
                if len(rows):
                    parts = _columns(self.codes.data, self.code_starts.data[at[rows]], self.lengths.data[at[rows]], width, self.model.nobody)
                    left, _ = merge_columns(self.model, parts, self.limit, key[rows], place[rows])
                    ids, n = self._spelled(left)
                    own.append((rows, n, ids))
        plain = at >= 0
        for rows, n, _ in own:
            counts[rows] = n
            plain[rows] = False
        starts = np.cumsum(counts) - counts
        flat = np.empty(int(counts.sum()), dtype=np.int32)
        flat[ragged(starts[plain], counts[plain])] = self.ids.data[ragged(self.id_starts.data[at[plain]], counts[plain])]
        for rows, n, ids in own:
            flat[ragged(starts[rows], n)] = ids
        return counts, flat


def _minus_one() -> Iterator[int]:
    while True:
        yield -1


def _cut(text: str) -> Iterator[str]:
    """A text in parts of about CHARS_AT_ONCE characters, cut where chunks are."""
    start = 0
    while start < len(text):
        end = start + CHARS_AT_ONCE
        while 0 < end < len(text) and text[end - 1] == " ":  # a run of spaces is not cut
            end = text.find(" ", end + 1)
        if 0 < end < len(text) and text[end] != " ":
            end = text.find(" ", end)
        end = len(text) if end < 0 else min(end, len(text))
        yield text[start:end]
        start = end


def _by_width(names: list[str]) -> Iterator[tuple[int, list[str]]]:
    low = 0
    for width in WIDTHS:
        own = [c for c in names if low < len(c) <= width]
        low = width
        for k in range(0, len(own), OCCURRENCES):
            yield width, own[k : k + OCCURRENCES]


def _columns(parts: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int, nobody: int) -> np.ndarray:
    """(width + 1, chunks) parts, a chunk a column."""
    row = np.arange(width + 1)[:, None]
    inside = row < lengths
    return np.where(inside, parts[np.where(inside, starts + row, 0)], np.int32(nobody)).astype(np.int32)


_kept: dict[tuple, Encoder] = {}


def encoder(path: str, dropout: float, seed: int) -> Encoder:
    """The encoder of this worker's task."""
    if (path, dropout, seed) not in _kept:
        _kept.clear()
        _kept[path, dropout, seed] = Encoder(PieceModel(path), dropout, seed)
    return _kept[path, dropout, seed]


def encoded_batches(batches: Iterator[pa.RecordBatch], path: str, dropout: float, seed: int, rows: int = 200) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of the batches (doc_id, text and others) and the ids of their texts."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            part = batch.slice(k, rows)
            yield part, encoder(path, dropout, seed)(part["doc_id"].to_pylist(), part["text"].to_pylist())
    _kept.clear()  # the worker lives on, in stages that have no use for it


def encode_texts(docs: DataFrame, vocabulary: str, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """docs (doc_id, text and others) with the array ``ids``."""
    names = [c for c in docs.columns if c != "ids"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in encoded_batches(batches, vocabulary, dropout, seed):
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found), pa.int32()))
            yield pa.RecordBatch.from_arrays([*[part[c] for c in names], ids], [*names, "ids"])

    fields = [docs.schema[c] for c in names]
    return docs.select(*names).mapInArrow(tidy(encode), T.StructType([*fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode_ids(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """encoded with ``text`` made from ``ids``."""
    names = [c for c in encoded.columns if c != "text"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            model = encoder(vocabulary, 0.0, 0).model
            for k in range(0, batch.num_rows, 200):
                part = batch.slice(k, 200)
                texts = [model.decode(ids.values.to_numpy(zero_copy_only=False))[1:].decode() if ids.is_valid else None for ids in part["ids"]]
                yield pa.RecordBatch.from_arrays([*[part[c] for c in names], pa.array(texts, pa.string())], [*names, "text"])

    fields = [encoded.schema[c] for c in names]
    return encoded.select(*names).mapInArrow(decode, T.StructType([*fields, T.StructField("text", T.StringType())]))


def op3_piece_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (little-endian 32-bit) and lossless: decoding gave back the text."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in encoded_batches(batches, path, DROPOUT, SEED):
            model = encoder(path, DROPOUT, SEED).model
            counts = pa.array([len(ids) for ids in found], pa.int64())
            sums = pa.array([zlib.crc32(ids.astype("<i4").tobytes()) for ids in found], pa.int64())
            same = pa.array([model.decode(ids)[1:] == (t or "").encode() for ids, t in zip(found, part["text"].to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([part["doc_id"], counts, sums, same], ["doc_id", "n_tokens", "ids_crc32", "lossless"])

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.mapInArrow(tidy(digest), "doc_id long, n_tokens long, ids_crc32 long, lossless boolean")
