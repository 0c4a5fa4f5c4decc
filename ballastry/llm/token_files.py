"""Token ids in files of patched frame-of-reference blocks.

Documents are encoded in ascending doc_id order, each with an end id, and every range partition
writes one file. A file holds blocks of 1,024 ids: the block's minimum is subtracted, the rest is
packed at the width of the block's 90th percentile, and the high bits of what is wider go to an
exception list. A footer indexes the blocks' byte offsets and holds doc ids and lengths, so any
range of ids is read without what lies before it.

File: magic, blocks, footer (doc ids int64, id counts uint32, block offsets uint64), trailer
(docs, docs without id, ids, blocks, block size), magic. Block: minimum uint32, width uint8,
pad uint8, exceptions uint16, packed words uint32, exception positions uint16, high parts uint32.

Encoding: ``BYTES_AT_ONCE`` of texts at a time are cut at white space and between words and the punctuation after them, which are borders
between pre-tokens for a tokenizer without normalizer whose pre-tokenizer is the plain byte-level one. Equal pieces are looked up once, and each is encoded once while it
stays in a worker's table: a word of plain letters by the tokenizer's model alone, any other piece by the whole tokenizer.
The table is emptied at ``MAX_PIECES`` entries. Any other tokenizer encodes whole texts.

Plan: one range shuffle of (doc_id, text), then one task a file. Ranges are drawn by doc_id and a hash of the text, so rows without
doc_id, or with the same one, spread over files. The driver learns one number a
file, from which the starts follow. Files are written under another name in the shared folder and
renamed, so a repeated task leaves the same file. They are the operator's output, and stay.

Defined results: a null or empty text is the end id alone. Rows without doc_id come first. Rows
that repeat a doc_id are kept, in the order of a hash of their texts. An empty table gives no files and an
empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import json
import re
import string
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ballastry.llm.common import shared_dir, table

BLOCK = 1024
PERCENTILE = 90
MAX_PIECES = 1_200_000
BYTES_AT_ONCE = 4 << 20
LONG_PIECE = 64
END_ID = 0
MAGIC = b"PFOR0001"
TRAILER = struct.Struct("<QQQQQ")
HEAD = struct.Struct("<IBBH")
#: Borders before white space alone, for other operators. White space as the vocabulary's own pattern has it, which leaves out the four separators 1C to 1F.
PIECES = re.compile(r"[^\S\x1c-\x1f]*+[\S\x1c-\x1f]++|[^\S\x1c-\x1f]++")
#: ASCII punctuation, and the end of the letters and digits that all versions of Unicode agree on.
PUNCTUATION = string.punctuation
PLAIN = "\u0250"
#: One pre-token: letters that all versions of Unicode agree on, with a space before them or not.
LETTERS = re.compile(r" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")
#: Bytes to the characters that stand for them in a byte-level vocabulary.
SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b != 173]
BYTE_CHARS = dict(zip([*SHOWN, *(b for b in range(256) if b not in SHOWN)], [*SHOWN, *range(256, 512 - len(SHOWN))], strict=True))
#: What a byte of UTF-8 is: a space or newline, an ASCII letter or digit, punctuation, the first byte of a character that is surely
#: not white space (which has characters that start with C2, E1, E2 and E3), the first of two bytes of such a character, a later byte.
SPACE, WORD, MARK, FIRST, OF_TWO, LATER = (1 << k for k in range(6))
KINDS = np.zeros(256, dtype=np.uint8)
KINDS[[ord(" "), ord("\n")]] = SPACE
KINDS[list((string.ascii_letters + string.digits).encode())] = WORD | FIRST
KINDS[list(string.punctuation.encode())] = MARK | FIRST
KINDS[0xC3:0xE0] = OF_TWO | FIRST
KINDS[[0xE0, *range(0xE4, 0xF5)]] = FIRST
KINDS[0x80:0xC0] = LATER


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """(m, 1024) values below 2**width as (m, 32 * width) words."""
    groups = values.astype(np.uint32).reshape(-1, 32, 32)
    words = np.zeros((len(groups), 32, max(width, 1)), dtype=np.uint32)
    for i in range(32 if width else 0):
        word, shift = divmod(i * width, 32)
        words[:, :, word] |= groups[:, :, i] << np.uint32(shift)
        if shift + width > 32:
            words[:, :, word + 1] |= groups[:, :, i] >> np.uint32(32 - shift)
    return words.reshape(len(groups), -1)[:, : 32 * width]


def unpack(words: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(words), 32, 32), dtype=np.uint32)
    if width:
        groups, mask = words.reshape(len(words), 32, width), np.uint32(2**width - 1)
        for i in range(32):
            word, shift = divmod(i * width, 32)
            out[:, :, i] = groups[:, :, word] >> np.uint32(shift)
            if shift + width > 32:
                out[:, :, i] |= groups[:, :, word + 1] << np.uint32(32 - shift)
        out &= mask
    return out.reshape(len(words), BLOCK)


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """The blocks of ids, of which there are a multiple of 1,024."""
    values = ids.reshape(-1, BLOCK).astype(np.uint32)
    low = values.min(axis=1)
    rest = values - low[:, None]
    at = BLOCK * PERCENTILE // 100
    widths = np.frexp(np.partition(rest, at, axis=1)[:, at].astype(np.float64))[1]
    out: list[bytes] = [b""] * len(values)
    for width in np.unique(widths):
        rows = np.flatnonzero(widths == width)
        part = rest[rows]
        mask = np.uint32((1 << int(width)) - 1)
        words = pack(part & mask, int(width))
        high = (part >> np.uint32(width)) if width < 32 else np.zeros_like(part)
        for r, w, h, row in zip(rows, words, high, rows, strict=True):
            where = np.flatnonzero(h)
            out[r] = HEAD.pack(int(low[row]), int(width), 0, len(where)) + w.tobytes() + where.astype("<u2").tobytes() + h[where].astype("<u4").tobytes()
    return out


def decode_blocks(data: bytes, offsets: np.ndarray) -> np.ndarray:
    """The ids of consecutive blocks; offsets are their starts in data."""
    heads = [HEAD.unpack_from(data, o) for o in offsets]
    widths = np.array([h[1] for h in heads])
    out = np.empty((len(heads), BLOCK), dtype=np.uint32)
    for width in np.unique(widths):
        rows, size = np.flatnonzero(widths == width), 32 * int(width)
        words = np.stack([np.frombuffer(data, "<u4", size, offsets[r] + HEAD.size) for r in rows])
        part = unpack(words, int(width))
        for k, r in enumerate(rows):
            low, _, _, n = heads[r]
            if n:
                after = offsets[r] + HEAD.size + 4 * size
                where = np.frombuffer(data, "<u2", n, after)
                part[k, where] |= np.frombuffer(data, "<u4", n, after + 2 * n) << np.uint32(width)
            out[r] = part[k] + np.uint32(low)
    return out.reshape(-1)


class Writer:
    """Appends documents' ids to an open stream; close() writes the rest and the footer."""

    def __init__(self, stream) -> None:
        self.stream, self.at = stream, len(MAGIC)
        stream.write(MAGIC)
        self.rest = np.empty(0, dtype=np.uint32)
        self.offsets, self.doc_ids, self.counts, self.nulls, self.n = [], [], [], 0, 0

    def add(self, doc_ids: list[int | None], counts: list[int], ids: np.ndarray) -> None:
        self.doc_ids.append(np.array([0 if d is None else d for d in doc_ids], dtype="<i8"))
        self.nulls += sum(d is None for d in doc_ids)
        self.counts.append(np.array(counts, dtype="<u4"))
        self.n += len(ids)
        ids = np.concatenate([self.rest, ids])
        whole = len(ids) // BLOCK * BLOCK
        self._blocks(ids[:whole])
        self.rest = ids[whole:]

    def _blocks(self, ids: np.ndarray) -> None:
        for k in range(0, len(ids), 512 * BLOCK):
            for block in encode_blocks(ids[k : k + 512 * BLOCK]):
                self.offsets.append(self.at)
                self.stream.write(block)
                self.at += len(block)

    def close(self) -> None:
        if len(self.rest):
            self._blocks(np.concatenate([self.rest, np.full(BLOCK - len(self.rest), self.rest[-1], dtype=np.uint32)]))
        docs = sum(map(len, self.doc_ids))
        for part in [*self.doc_ids, *self.counts, np.array([*self.offsets, self.at], dtype="<u8")]:
            self.stream.write(part.tobytes())
        self.stream.write(TRAILER.pack(docs, self.nulls, self.n, len(self.offsets), BLOCK) + MAGIC)


class Reader:
    """Random access to the ids in a file, given as a seekable binary stream."""

    def __init__(self, stream) -> None:
        self.stream = stream
        end = stream.seek(0, 2)
        tail = self._read(end - TRAILER.size - len(MAGIC), end)
        if tail[TRAILER.size :] != MAGIC:
            raise ValueError("not a token file")
        docs, self.nulls, self.n, blocks, _ = TRAILER.unpack(tail[: TRAILER.size])
        foot = self._read(end - len(tail) - 12 * docs - 8 * (blocks + 1), end - len(tail))
        self.doc_ids = np.frombuffer(foot, "<i8", docs)
        self.counts = np.frombuffer(foot, "<u4", docs, 8 * docs)
        self.offsets = np.frombuffer(foot, "<u8", blocks + 1, 12 * docs).astype(np.int64)

    def _read(self, start: int, stop: int) -> bytes:
        self.stream.seek(int(start))
        return self.stream.read(int(stop) - int(start))

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop, from the blocks that hold them alone."""
        if stop <= start:
            return np.empty(0, dtype=np.uint32)
        first, last = start // BLOCK, (stop - 1) // BLOCK + 1
        data = self._read(self.offsets[first], self.offsets[last])
        return decode_blocks(data, self.offsets[first:last] - self.offsets[first])[start - first * BLOCK : stop - first * BLOCK]

    def documents(self, ids_at_once: int = 1 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start, ids) of every document, in file order."""
        ends = np.cumsum(self.counts, dtype=np.int64)
        k = 0
        while k < len(ends):
            start = int(ends[k] - self.counts[k])
            stop = max(k + 1, int(np.searchsorted(ends, start + ids_at_once, "right")))
            part = self.ids(start, int(ends[stop - 1]))
            for i in range(k, stop):
                a = int(ends[i] - self.counts[i])
                yield (None if i < self.nulls else int(self.doc_ids[i])), a, part[a - start : int(ends[i]) - start]
            k = stop


_tables: dict[str, tuple] = {}


def cut_at_spaces(tokenizer) -> bool:
    """Whether the borders of pieces are borders of a tokenizer's pre-tokens."""
    parts = json.loads(tokenizer.to_str())
    own = parts.get("pre_tokenizer") or {}
    return parts.get("normalizer") is None and own.get("type") == "ByteLevel" and not own.get("add_prefix_space") and own.get("use_regex", True)


def piece_starts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where pieces start in texts that lie one after the other as UTF-8; every border is one between pre-tokens.

    White space is a run of pre-tokens of its own: all of it but its last character, and that, which a space shares with what follows. So a
    border is before a space or newline that follows or precedes another character, after a newline before one, and where punctuation follows a letter or digit.
    """
    kinds = KINDS[data]
    start, first = np.zeros(len(data) + 1, dtype=bool), np.zeros(len(data) + 1, dtype=bool)
    first[:-1] = kinds & FIRST != 0
    begins = np.concatenate([[0], ends])
    first[begins] = False  # a text's last character precedes none
    space, before = kinds & SPACE != 0, kinds[:-1]
    other = before & (WORD | MARK) != 0
    other[1:] |= (before[1:] & LATER != 0) & (kinds[:-2] & OF_TWO != 0)
    start[:-1] = space & first[1:]
    start[1:-1] |= space[1:] & other
    start[1:-1] |= (data[:-1] == ord("\n")) & first[1:-1]
    start[1:-1] |= (kinds[1:] & MARK != 0) & (before & WORD != 0)
    start[begins] = True
    return np.flatnonzero(start[:-1])


class Pieces(dict):
    """The ids of pieces as little-endian bytes. A piece that is looked up for the first time is encoded then.

    The border between a letter or digit and the punctuation after it is a border between pre-tokens as well, so such a piece
    is put together from its word, which is often there, and its punctuation. The model, if given, is a byte-level one, and
    encodes words that are one pre-token.
    """

    def __init__(self, tokenizer, model=None) -> None:
        self.encode, self.model = tokenizer.encode, model

    def __missing__(self, piece: str) -> bytes:
        if self.model and LETTERS.fullmatch(piece):
            ids = as_bytes([t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(BYTE_CHARS))])
        else:
            word = piece.rstrip(PUNCTUATION)
            if word != piece and word[-1:] < PLAIN and word[-1:].isalnum():
                ids = self[word] + self[piece[len(word) :]]
            else:
                ids = as_bytes(self.encode(piece, add_special_tokens=False).ids)
        if len(piece) <= LONG_PIECE:
            self[piece] = ids
        return ids


def as_bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def piece_encoder(vocabulary: str):
    """An array of texts -> (id counts, ids), with a table of pieces that lasts as long as the worker."""
    if vocabulary not in _tables:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(vocabulary)
        # what the texts that are encoded whole contain: an added token, or anything
        added = [t.content for t in tokenizer.get_added_tokens_decoder().values()] if cut_at_spaces(tokenizer) else [""]
        _tables[vocabulary] = (tokenizer, added, Pieces(tokenizer, tokenizer.model))
    tokenizer, added, table_ = _tables[vocabulary]

    def in_pieces(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id counts, ids) of texts that lie one after the other, without end ids."""
        if not len(data):
            return np.zeros(len(ends), dtype=np.int64), np.empty(0, dtype=np.uint32)
        starts = piece_starts(data, ends)
        borders = pa.py_buffer(np.append(starts, len(data)).astype(np.int64))
        found = pa.LargeStringArray.from_buffers(len(starts), borders, pa.py_buffer(data)).dictionary_encode()
        ids_of = list(map(table_.__getitem__, found.dictionary.to_numpy(zero_copy_only=False)))
        sizes = np.fromiter(map(len, ids_of), np.int64, len(ids_of)) // 4
        which = found.indices.to_numpy()
        counts = sizes[which]
        stops = np.concatenate([[0], np.cumsum(counts)])
        places = np.repeat((np.cumsum(sizes) - sizes)[which] - stops[:-1], counts) + np.arange(stops[-1])
        return np.diff(stops[np.searchsorted(starts, ends)], prepend=0), np.frombuffer(b"".join(ids_of), "<u4")[places]

    def encode(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(id counts, ids) of one text after the other, with end ids, for some texts at a time."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        whole = np.zeros(len(texts), dtype=bool)  # the ids of these depend on the whole text
        for a in added:
            whole |= pc.match_substring(texts, a).to_numpy(zero_copy_only=False)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else [0]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        k = 0
        while k < len(texts):
            if len(table_) > MAX_PIECES:
                table_.clear()
            if whole[k]:
                ids = np.array([*tokenizer.encode(texts[k].as_py(), add_special_tokens=False).ids, END_ID], dtype=np.uint32)
                yield np.array([len(ids)]), ids
                k += 1
                continue
            stop = max(k + 1, int(np.searchsorted(offsets, offsets[k] + BYTES_AT_ONCE, "right")) - 1)
            stop = k + int(np.append(whole[k:stop], True).argmax())
            counts, ids = in_pieces(data[offsets[k] : offsets[stop]], offsets[k + 1 : stop + 1] - offsets[k])
            yield counts + 1, np.insert(ids, np.cumsum(counts), END_ID)
            k = stop

    return encode


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


def write_token_files(docs: DataFrame, folder: str, vocabulary: str) -> list[tuple[str, int]]:
    """Writes doc_id and text of docs to files in folder; (path, ids) of each file in order."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = piece_encoder(vocabulary)
        files, path = _filesystem(folder)
        context = TaskContext.get()
        name, writer = f"{path}/part-{context.partitionId():06d}.pfor", None
        own = f"{name}.{context.attemptNumber()}-{uuid.uuid4().hex}"
        try:
            for batch in batches:
                doc_ids = iter(batch["doc_id"].to_pylist())
                for counts, ids in encode(batch["text"]):
                    if writer is None:
                        files.create_dir(path, recursive=True)
                        writer = Writer(files.open_output_stream(own))
                    writer.add(list(islice(doc_ids, len(counts))), counts, ids)
            if writer is not None:
                writer.close()
                writer.stream.close()
                files.move(own, name)
                yield pa.RecordBatch.from_arrays([pa.array([context.partitionId()], pa.int32()), pa.array([writer.n], pa.int64())], ["part", "n"])
        except BaseException:
            if writer is not None:
                writer.stream.close()
                files.delete_file(own)
            raise

    order = ["doc_id", F.xxhash64("text"), "text"]
    ordered = docs.select("doc_id", "text").repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    done = ordered.mapInArrow(write, "part int, n long").collect()  # a row a file
    return [(f"part-{r['part']:06d}.pfor", r["n"]) for r in sorted(done, key=lambda r: r["part"])]


def read_token_files(spark: SparkSession, folder: str, files: list[tuple[str, int]]) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, a task a file."""
    starts, total = [], 0
    for name, n in files:
        starts.append((name, total))
        total += n

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _filesystem(folder)
        for batch in batches:
            for k in batch["id"].to_pylist():
                name, before = starts[k]
                with fs.open_input_file(f"{path}/{name}") as stream:
                    rows = [(d, before + a, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for d, a, ids in Reader(stream).documents()]
                for i in range(0, len(rows), 10_000):
                    columns = zip(*rows[i : i + 10_000], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not starts:
        return spark.createDataFrame([], schema)
    return spark.range(0, len(starts), 1, len(starts)).mapInArrow(read, schema)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    files = write_token_files(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(spark, folder, files)
