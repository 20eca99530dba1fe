"""Benchmark decontamination through an FM-index of each shard of training documents.

Words are runs of ASCII letters, digits and non-ASCII characters, with A-Z lower-cased. A benchmark
item gives all its windows of 13 consecutive words, or one window of all its words if it has
fewer. A document word inside an occurrence of any window is hit; a document is contaminated if
5 % of its words or more are hit.

Each task cuts its documents into shards of bounded size. A word that no benchmark item holds can
be in no occurrence, so a shard's text is the sequence of its runs of benchmark words, separated by
a mark. Of it a suffix order, the Burrows-Wheeler transform as a wavelet matrix, and suffix positions
at regular text places are built. All windows are searched backwards at once through wavelet ranks;
their occurrences are located by walking to the nearest sampled suffix; overlapping spans merge.

The benchmark is cut into blocks of bounded size. Usually there is one. Of several, each is broadcast by itself and searched in a
pass of its own, which writes the rows with hits and frees the block before the next; then a document's spans and
items are merged. So neither the driver nor a worker ever holds more than one block.

Null or empty text: no words, not contaminated. Null item text or item_id: no windows. An empty benchmark:
nothing is hit. Items that share an id are one item. Repeated rows give a row each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coffer.llm.store import Scratch
from coffer.llm.textkernel import ALNUM, U64, Words, chunks

WINDOW = 13
WORD = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
SAMPLE = 8
BLOCK_BYTES = 4 << 20
SHARD_WORDS = 2 << 20
SHARD_DOCS = 200_000
SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start:int,end:int>>, items array<string>"
_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()),
    ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("items", pa.list_(pa.string())),
])


class WaveletMatrix:
    """Rank and access over a sequence of small integers, one bit vector with counts per level."""

    def __init__(self, seq: np.ndarray, size: int):
        self.levels = max(1, int(size - 1).bit_length())
        self.n, self.cum, self.zeros = len(seq), [], []
        for level in range(self.levels - 1, -1, -1):
            bits = (seq >> level) & 1
            cum = np.zeros(self.n + 1, dtype=np.int32)
            np.cumsum(bits, out=cum[1:])
            self.cum.append(cum)
            self.zeros.append(self.n - int(cum[-1]))
            seq = np.concatenate([seq[bits == 0], seq[bits == 1]])

    def rank(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each end."""
        lo, hi = np.zeros_like(ends), ends
        for k in range(self.levels):
            bit = (symbols >> (self.levels - 1 - k)) & 1
            cum, z = self.cum[k], self.zeros[k]
            lo = np.where(bit, z + cum[lo], lo - cum[lo])
            hi = np.where(bit, z + cum[hi], hi - cum[hi])
        return hi - lo

    def access_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it stands before it."""
        symbols, lo, hi = np.zeros_like(at), np.zeros_like(at), at
        for k in range(self.levels):
            cum, z = self.cum[k], self.zeros[k]
            bit = cum[hi + 1] - cum[hi]
            symbols = symbols * 2 + bit
            lo = np.where(bit, z + cum[lo], lo - cum[lo])
            hi = np.where(bit, z + cum[hi], hi - cum[hi])
        return symbols, hi - lo


class FMIndex:
    """Of a text of integers from 1 below ``size``."""

    def __init__(self, text: np.ndarray, size: int, sample: int = SAMPLE):
        text = np.concatenate([text, [0]]).astype(np.int64)
        n = len(text)
        rank, width = text, 1
        order = np.argsort(rank, kind="stable")
        while True:
            ahead = np.zeros(n, dtype=np.int64)
            if width < n:
                ahead[: n - width] = rank[width:] + 1
            key = rank * (max(int(rank.max()), n) + 2) + ahead
            order = np.argsort(key, kind="stable")
            sorted_key = key[order]
            step = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
            rank = np.empty(n, dtype=np.int64)
            rank[order] = step
            width *= 2
            if step[-1] == n - 1:
                break
        bwt = text[order - 1]
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])
        self.tree = WaveletMatrix(bwt, size)
        self.n = n
        self.marked = order % sample == 0
        self.mark_rank = np.cumsum(self.marked) - 1
        self.sampled = order[self.marked]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix range of each row of patterns, all of one length."""
        lo = np.zeros(len(patterns), dtype=np.int64)
        hi = np.full(len(patterns), self.n, dtype=np.int64)
        alive = np.arange(len(patterns))
        for j in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[alive, j]
            both = self.tree.rank(np.concatenate([c, c]), np.concatenate([lo[alive], hi[alive]]))
            lo[alive] = self.less[c] + both[: len(c)]
            hi[alive] = self.less[c] + both[len(c) :]
            alive = alive[lo[alive] < hi[alive]]
            if len(alive) == 0:
                break
        return lo, np.maximum(lo, hi)

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Text positions of suffixes by their places in the order."""
        out, walked, open_ = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), np.arange(len(at))
        at = at.copy()
        while len(open_):
            hit = self.marked[at[open_]]
            done = open_[hit]
            out[done] = self.sampled[self.mark_rank[at[done]]] + walked[done]
            open_ = open_[~hit]
            if len(open_):
                c, r = self.tree.access_rank(at[open_])
                at[open_] = self.less[c] + r
                walked[open_] += 1
        return out


class Phrases:
    """The distinct windows of some benchmark items as rows of word numbers, by length; those of a window are its items' numbers."""

    def __init__(self, items: list[tuple[str, str | None]]):
        self.ids = sorted({i for i, _ in items})
        number = {x: k for k, x in enumerate(self.ids)}
        item = np.array([number[i] for i, _ in items], dtype=np.int64)
        words = Words(pa.array([t for _, t in items], pa.string()), ALNUM)
        self.vocabulary, inverse = np.unique(words.hash, return_inverse=True)
        flat, count = inverse.astype(np.int32) + 2, words.counts()
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for length in np.unique(np.minimum(count[count > 0], WINDOW)).tolist():
            rows = np.flatnonzero(count >= WINDOW if length == WINDOW else count == length)
            per = count[rows] - length + 1
            start = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per - words.first[rows], per)
            patterns, which = np.unique(np.lib.stride_tricks.sliding_window_view(flat, length)[start], axis=0, return_inverse=True)
            pair = np.unique(which.ravel() * len(self.ids) + np.repeat(item[rows], per))  # (window, item)
            bounds = np.searchsorted(pair, np.arange(len(patterns) + 1) * len(self.ids))
            self.by_length[length] = (patterns.astype(np.int64), bounds, pair % len(self.ids))
        self.shortest = min(self.by_length, default=0)

    def scan(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """Marks of hit words of a shard, and (row, item number) pairs."""
        hit = np.zeros(len(hashes), dtype=bool)
        if not self.by_length or len(hashes) == 0:
            return hit, []
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        known = self.vocabulary[at] == hashes
        begin, end = known.copy(), known.copy()
        begin[1:] &= ~known[:-1]
        end[:-1] &= ~known[1:]
        heads = first[:-1][first[:-1] < len(hashes)]
        begin[heads] = known[heads]
        tails = first[1:][first[1:] > 0] - 1
        end[tails] = known[tails]
        b, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
        long = e - b >= self.shortest
        b, e = b[long], e[long]
        if len(b) == 0:
            return hit, []
        size = e - b + 1  # one more for the mark that ends a run
        ends = np.cumsum(size)
        where = np.arange(ends[-1]) - np.repeat(ends - size, size) + np.repeat(b, size)
        where[ends - 1] = -1
        text = np.where(where >= 0, at[where] + 2, 1)
        index = FMIndex(text, len(self.vocabulary) + 2)
        change = np.zeros(len(hashes) + 1, dtype=np.int64)
        pairs = [np.zeros(0, np.int64)]
        for length, (patterns, bounds, items) in self.by_length.items():
            lo, hi = index.search(patterns)
            n = hi - lo
            which = np.repeat(np.arange(len(patterns)), n)
            if len(which) == 0:
                continue
            place = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            word = where[index.locate(place)]
            np.add.at(change, word, 1)
            np.add.at(change, word + length, -1)
            row = np.searchsorted(first, word, "right") - 1
            row, which = np.divmod(np.unique(row * len(patterns) + which), len(patterns))
            n = np.diff(bounds)[which]
            own = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - bounds[which], n)
            pairs.append(np.repeat(row, n) * len(self.ids) + items[own])
        hit = np.cumsum(change[:-1]) > 0
        found = np.unique(np.concatenate(pairs))
        return hit, list(zip((found // len(self.ids)).tolist(), (found % len(self.ids)).tolist(), strict=True))


def _flush(ids: list, hashes: list[np.ndarray], counts: list[np.ndarray], phrases: Phrases) -> pa.RecordBatch:
    h = np.concatenate(hashes) if hashes else np.zeros(0, U64)
    n = np.concatenate(counts)
    first = np.concatenate([[0], np.cumsum(n)])
    hit, pairs = phrases.scan(h, first)
    found: dict[int, set[str]] = {}
    for r, i in pairs:
        found.setdefault(r, set()).add(phrases.ids[i])
    total = np.concatenate([[0], np.cumsum(hit)])
    n_hit = total[first[1:]] - total[first[:-1]]
    digest, items, spans = [_NONE] * len(n), [[] for _ in n], [[] for _ in n]
    for r, names in found.items():
        items[r] = sorted(names)
        digest[r] = _digest(items[r])
        edge = np.flatnonzero(np.diff(np.concatenate([[0], hit[first[r] : first[r + 1]].astype(np.int8), [0]])))
        spans[r] = [{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)]
    return _batch(ids, n, n_hit, digest, spans, items)


def _digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


_NONE = _digest([])


def _batch(ids: list, n: np.ndarray, n_hit: np.ndarray, digest: list, spans: list, items: list) -> pa.RecordBatch:
    columns = (ids, n, n_hit, [len(x) for x in items], digest, (n_hit > 0) & (20 * n_hit >= n), spans, items)
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def _searcher(shared):
    """Rows of SCHEMA for rows (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, hashes, counts, size = [], [], [], 0
        for part in chunks(batches, "text"):
            words = Words(part.column(1), ALNUM)
            ids += part.column(0).to_pylist()
            hashes.append(words.hash)
            counts.append(words.counts())
            size += len(words.hash)
            if size >= SHARD_WORDS or len(ids) >= SHARD_DOCS:
                yield _flush(ids, hashes, counts, shared.value)
                ids, hashes, counts, size = [], [], [], 0
        if ids:
            yield _flush(ids, hashes, counts, shared.value)

    return run


def _filter(shared):
    """Passes the rows of documents that are not contaminated, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, hashes, counts, size = [], [], [], 0

        def out() -> Iterator[pa.RecordBatch]:
            rows = sum(p.num_rows for p in held)
            bad = _flush([None] * rows, hashes, counts, shared.value).column(5).to_pylist()
            at = 0
            for p in held:
                yield p.filter(pa.array([not x for x in bad[at : at + p.num_rows]], pa.bool_()))
                at += p.num_rows

        for part in chunks(batches, "text"):
            words = Words(part.column(part.schema.get_field_index("text")), ALNUM)
            held.append(part)
            hashes.append(words.hash)
            counts.append(words.counts())
            size += len(words.hash)
            if size >= SHARD_WORDS // 4:
                yield from out()
                held, hashes, counts, size = [], [], [], 0
        if held:
            yield from out()

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of SCHEMA from (doc_id, n_words, spans and items of several blocks)."""
    for batch in batches:
        n = batch.column(1).to_numpy()
        spans, items, n_hit = [], [], np.zeros(len(n), np.int64)
        for r, (s, i) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
            one: list[dict] = []
            for x in sorted((x["start"], x["end"]) for part in s or [] for x in part):
                if one and x[0] <= one[-1]["end"]:
                    one[-1]["end"] = max(one[-1]["end"], x[1])
                else:
                    one.append({"start": x[0], "end": x[1]})
            spans.append(one)
            items.append(sorted({x for part in i or [] for x in part}))
            n_hit[r] = sum(x["end"] - x["start"] for x in one)
        yield _batch(batch.column(0).to_pylist(), n, n_hit, [_digest(x) for x in items], spans, items)


def _items(benchmark: DataFrame, block_bytes: int) -> list[DataFrame]:
    """The benchmark's items in blocks of about ``block_bytes`` of text."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    return [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else items for k in range(n)]


def _phrases(block: DataFrame):
    return block.sparkSession.sparkContext.broadcast(Phrases([tuple(r) for r in block.collect()]))


def decontaminate(documents: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: counts, the hit spans in words, and the items that occur."""
    blocks = _items(benchmark, block_bytes)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if len(blocks) == 1:
        return docs.mapInArrow(_searcher(_phrases(blocks[0])), SCHEMA)
    # Rows equal in doc_id and text share a key and all results.
    scratch, keyed = Scratch(documents.sparkSession, "decontam"), docs.select(F.xxhash64("doc_id", "text").alias("doc_id"), "text")
    parts = []
    for block in blocks:
        shared = _phrases(block)
        parts.append(scratch.keep(keyed.mapInArrow(_searcher(shared), SCHEMA).where("n_hit > 0").select("doc_id", "spans", "items").dropDuplicates(["doc_id"]), "hits"))
        shared.destroy()  # one block at a time is in the workers' memory
    hits = documents.sparkSession.read.schema(parts[0].schema).parquet(*[p._coffer_path for p in parts])
    hits = hits.groupBy(F.col("doc_id").alias("key")).agg(F.collect_list("spans").alias("spans"), F.collect_list("items").alias("items"))
    sizes = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))).cast("long").alias("n_words"))
    return sizes.join(hits, "key", "left").select("doc_id", "n_words", "spans", "items").mapInArrow(_merged, SCHEMA)


def keep_clean(documents: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of documents that are not contaminated, unchanged."""
    blocks = _items(benchmark, block_bytes)
    if len(blocks) == 1:
        return documents.mapInArrow(_filter(_phrases(blocks[0])), documents.schema)
    key = F.xxhash64("doc_id", F.col("text").cast("string"))
    bad = decontaminate(documents.select(key.alias("doc_id"), "text"), benchmark, block_bytes).where("contaminated").select(F.col("doc_id").alias("__bad")).distinct()
    return documents.join(bad, key == F.col("__bad"), "left_anti")
