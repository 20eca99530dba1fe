"""Token ids in directly addressable codes.

Documents are encoded in ascending doc_id order (null first), each followed by the id 0, and written as
blocks. A block's ids are split into 8-bit chunks: level 0 has the low byte of every id, level 1 the next byte of
those ids that have more, and so on. Each level but the last has a bitmap of the ids that continue, with
a rank directory of one count per 512 bits, so that any single id is read with one rank per level and
without decoding others. The blocks are rows of a Parquet table in the shared folder; each row also
has its doc_ids and their lengths.

Encoding is that of the tokenizers library for a byte-level BPE file. A text of ASCII and the letters
U+00C0 to U+024F without apostrophes is cut into the pre-tokens of its pattern by vectorised rules; each distinct
pre-token is encoded once by the library and remembered. All other texts go to the library whole, and all texts do so
if the file has another pre-tokenizer, a normalizer or added tokens that are not special.

Null text counts as empty: its ids are just the end id. Special tokens' strings are ordinary text.
Repeated rows are written each; rows that share a doc_id (or have none) stand in the order of their texts' hashes. An empty table gives no blocks and no rows.
"""

from __future__ import annotations

import functools
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coffer.llm.store import Scratch
from coffer.llm.textkernel import byte_class, chunks, utf8
from coffer.llm.wordcache import WordCache

END_ID = 0
RANK_BITS = 512
BLOCK_IDS = 1 << 20
#: Pre-tokens that go to the library as one text.
JOINED = 2000
_SPACE = byte_class((0x20, 0x20), (0x09, 0x0D))
_CLASS = np.full(256, 2, dtype=np.int8)  # 0 letter, 1 digit, 2 other, 3 white space
_CLASS[_SPACE] = 3
_CLASS[byte_class((0x30, 0x39))] = 1
_CLASS[byte_class((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))] = 0
_HARD = byte_class((0x27, 0x27), (0xC0, 0xC2), (0xCA, 0xFF))


def _is_plain(file: dict) -> bool:
    """Whether a tokenizer file cuts texts by the byte-level pattern alone, so that pre-tokens can be encoded by themselves."""
    cut = file.get("pre_tokenizer") or {}
    return (
        file.get("normalizer") is None and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space", True) and cut.get("use_regex", True)
        and file.get("model", {}).get("type") == "BPE" and not file["model"].get("dropout") and all(x.get("special") for x in file.get("added_tokens", []))
        and not file.get("truncation") and not file.get("padding")
    )


class Encoder:
    """Ids of texts by a tokenizers file of byte-level BPE."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            self.plain = _is_plain(json.load(f))
        # In a byte-level vocabulary each character of a token stands for one byte.
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=np.int64)
        self.size[list(vocabulary.values())] = [len(x) for x in vocabulary]
        self.cache = WordCache(self._words)

    def _words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pre-tokens. Those that a space opens stay apart when they stand side by side, so many go as one
        text; where its ids belong is told by their sizes in bytes."""
        length = np.fromiter(map(len, words), np.int64, len(words))
        apart = np.fromiter((w[0] == 0x20 and len(w) > 1 and not _SPACE[w[1]] for w in words), bool, len(words))
        out: list = [None] * len(words)
        for k in range(0, len(words), JOINED):
            at = np.flatnonzero(apart[k : k + JOINED]) + k
            if len(at) == 0:
                continue
            ids = np.array(self.tokenizer.encode_batch_fast([b"".join([words[i] for i in at.tolist()]).decode()], add_special_tokens=False)[0].ids, dtype=np.int32)
            bounds, ends = np.cumsum(length[at]), np.cumsum(self.size[ids])
            cut = np.searchsorted(ends, bounds)
            if len(ends) and ends[-1] == bounds[-1] and (ends[cut] == bounds).all():
                cut = (cut + 1).tolist()
                for i, a, b in zip(at.tolist(), [0, *cut[:-1]], cut, strict=True):
                    out[i] = ids[a:b]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([words[i].decode() for i in rest], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, dtype=np.int32)
        return np.concatenate(out), np.fromiter(map(len, out), np.int64, len(out))

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids with end ids, and each row's number of them."""
        data, off = utf8(column)
        n_rows, size = len(off) - 1, len(data)
        hard = _HARD[data]
        pair = np.flatnonzero((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))) if size else np.zeros(0, np.int64)
        hard[pair] = True
        total = np.concatenate([[0], np.cumsum(hard)])
        slow = np.flatnonzero(total[off[1:]] > total[off[:-1]]) if self.plain else np.flatnonzero(np.diff(off))
        starts = self._starts(data, off)
        row = np.searchsorted(off, starts, "right") - 1
        ends = np.append(starts[1:], size)
        if len(slow):
            keep = ~np.isin(row, slow)
            starts, ends, row = starts[keep], ends[keep], row[keep]
        ids, per = self.cache.ids(data, starts, ends) if len(starts) else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        n = np.bincount(row, weights=per, minlength=n_rows).astype(np.int64)
        whole = [e.ids for e in self.tokenizer.encode_batch_fast(column.take(pa.array(slow)).to_pylist(), add_special_tokens=False)] if len(slow) else []
        fast_n = n.copy()
        n[slow] = [len(x) for x in whole]
        n += 1
        out = np.full(int(n.sum()), END_ID, dtype=np.uint32)
        begin = np.cumsum(n) - n
        owner = np.repeat(np.arange(n_rows), fast_n)
        out[np.arange(len(ids)) - np.repeat(np.cumsum(fast_n) - fast_n, fast_n) + begin[owner]] = ids
        for r, x in zip(slow.tolist(), whole, strict=True):
            out[begin[r] : begin[r] + len(x)] = x
        return out, n

    @staticmethod
    def _starts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Where pre-tokens start: at changes between letters, digits and others, where one space goes with
        what follows, and white space before it but the last character stands alone."""
        n = len(data)
        if n == 0:
            return np.zeros(0, np.int64)
        head = np.zeros(n + 1, dtype=bool)
        head[off] = True
        kind = _CLASS[data]
        before = np.concatenate([[-1], kind[:-1]])
        after = np.concatenate([kind[1:], [-1]])
        blank = kind == 3
        follows = (after != 3) & ~head[1:]  # something but white space comes next in this row
        start = head[:-1] | ((kind != before) & (before != 3)) | (~blank & (before == 3))
        start |= blank & follows
        # A single space opens the token that follows it.
        joined = blank & follows & (data == 0x20)
        start[1:] &= ~joined[:-1] | head[1:-1]
        return np.flatnonzero(start)


def pack(ids: np.ndarray) -> bytes:
    """The directly addressable code of ids below 2^32."""
    parts, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 255
        parts.append((rest & 255).astype(np.uint8).tobytes())
        if not more.any():
            break
        bits = np.packbits(more, bitorder="little")
        words = np.pad(more, (0, -len(more) % RANK_BITS)).reshape(-1, RANK_BITS).sum(1)
        parts += [bits.tobytes(), (np.cumsum(words) - words).astype("<u4").tobytes()]
        rest = rest[more] >> np.uint32(8)
    head = np.array([len(ids), len(parts), *map(len, parts)], dtype="<u4").tobytes()
    return head + b"".join(parts)


class Codes:
    """Reads a packed block: ``codes[i]`` for any single id, ``all()`` for the whole."""

    def __init__(self, blob: bytes):
        self.n, k = (int(x) for x in np.frombuffer(blob, "<u4", 2))
        sizes = np.frombuffer(blob, "<u4", k, 8).astype(np.int64)
        at, parts = 8 + 4 * k, []
        for size in sizes:
            parts.append(np.frombuffer(blob, np.uint8, int(size), at))
            at += int(size)
        self.chunk, self.bits = parts[0::3], parts[1::3]
        self.ranks = [p.view("<u4") if p.ctypes.data % 4 == 0 else np.frombuffer(p.tobytes(), "<u4") for p in parts[2::3]]

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level, chunk in enumerate(self.chunk):
            value |= int(chunk[i]) << (8 * level)
            if level == len(self.bits) or not self.bits[level][i >> 3] >> (i & 7) & 1:
                break
            a = i // RANK_BITS * RANK_BITS
            i = int(self.ranks[level][i // RANK_BITS]) + int(np.unpackbits(self.bits[level][a >> 3 : (i >> 3) + 1], bitorder="little")[: i - a].sum())
        return value

    def all(self) -> np.ndarray:
        out = self.chunk[-1].astype(np.uint32)
        for level in range(len(self.bits) - 1, -1, -1):
            more = np.unpackbits(self.bits[level], bitorder="little", count=len(self.chunk[level])).astype(bool)
            low = self.chunk[level].astype(np.uint32)
            low[more] |= out << np.uint32(8)
            out = low
        return out


@functools.cache
def encoder_of(path: str) -> Encoder:
    """One encoder in each Python worker, for all its tasks. Tasks find this function by its name; a table beside ``run`` would come with
    each task anew, and empty."""
    return Encoder(path)


def _writer(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        part, seq, start = TaskContext.get().partitionId(), 0, 0
        docs, ids, lens = [], [], []

        def out():
            flat = np.concatenate(ids)
            return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "first": start, "n_ids": len(flat), "doc_ids": docs, "lengths": np.concatenate(lens).tolist(), "codes": pack(flat)}], schema=_STORE)

        size = 0
        for piece in chunks(batches, "text"):
            x, n = encoder(piece.column(1))
            docs += piece.column(0).to_pylist()
            ids.append(x)
            lens.append(n)
            size += len(x)
            if size >= BLOCK_IDS:
                yield out()
                start, seq, size, docs, ids, lens = start + size, seq + 1, 0, [], [], []
        if docs:
            yield out()

    return run


_STORE = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("codes", pa.binary())])


def write_tokens(documents: DataFrame, tokenizer: str, scratch: Scratch) -> DataFrame:
    """Writes the blocks of all documents and gives their table: part and seq order them, first is a block's place in its part."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The hash tells rows of one doc_id apart, so that not even those fall into one partition together.
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = docs.repartitionByRange(n, *order).sortWithinPartitions(*order, "text")
    fields = "part int, seq int, first long, n_ids long, doc_ids array<long>, lengths array<long>, codes binary"
    return scratch.keep(ordered.mapInArrow(_writer(tokenizer), fields), "tokens", {"compression": "zstd", "parquet.block.size": 16 << 20})


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        col = {f.name: batch.column(j) for j, f in enumerate(batch.schema)}
        for r in range(batch.num_rows):
            ids = Codes(col["codes"][r].as_py()).all().astype("<u4")
            n = np.array(col["lengths"][r].as_py(), dtype=np.int64)
            at = np.cumsum(n) - n
            raw = memoryview(ids.tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * (a + k)]) for a, k in zip(at.tolist(), n.tolist(), strict=True)]
            base = col["first"][r].as_py() + col["before"][r].as_py()
            yield pa.RecordBatch.from_arrays([col["doc_ids"][r].values, pa.array(at + base), pa.array(n), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_tokens(store: DataFrame) -> DataFrame:
    """One row per document from the blocks: its place among all ids, its number of ids, and their checksum."""
    sums = store.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # one row per write task
    return store.join(before, "part").mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids_crc32 long")
