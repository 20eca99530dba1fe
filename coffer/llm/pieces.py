"""SentencePiece encoding and decoding over a relational lattice of pieces.

1. Texts are cut into segments that no piece crosses: between two characters that stand side by side in no
   piece, nothing can ever be merged. Distinct segments with their counts are one map-side aggregate.
2. Each distinct segment's substrings of bounded length are exploded and equi-joined to the piece table (the
   model's, of a size that is checked before it is broadcast), and the edges are grouped by segment.
3. A higher-order ``aggregate`` folds a segment's edges. The public model here is of the BPE kind: its scores
   are merge ranks, and the path of the best score sum (Viterbi) is often not its segmentation. So the fold
   is by rank: the best edge that spans exactly two present symbols merges first, the leftmost of
   equals, until none is left; the state is the set of symbol bounds, as bits. This gives the library's ids.
   ``viterbi_encode`` has the fold for models whose scores are log probabilities.
4. This lattice is folded for the ``frequent`` most frequent segments, which are nearly all occurrences, and goes
   out as a broadcast of bounded size. A segment beyond them stands in few texts, often in one: its text would have to be
   shuffled to its ids, which is most of the corpus. So it is folded where it stands, by the same rule over the
   same piece table (a heap of edges), as is a segment of over 60 characters, which has no room in the bits.

A character that is no piece becomes its UTF-8 bytes. Null text counts as empty and has no ids. U+2581
in a text is a space to such a model, so it decodes as one. Repeated rows give a row each.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coffer.llm.store import Scratch
from coffer.llm.textkernel import U64, chunks, utf8
from coffer.llm.wordcache import WordCache, segment_hashes

MARK = "▁"
LONG = 60
FREQUENT = 400_000
#: Other segments that a worker remembers at once.
REMEMBERED = 500_000
#: Words of a task whose edges are grouped in memory; beyond, they are sorted.
IN_MEMORY = 20_000
CHUNK = 1 << 20
#: A piece table of more entries is joined by a shuffle.
BROADCAST_PIECES = 1_000_000


class Known:
    """ids of segments, found by the segments' hashes."""

    def __init__(self, words: pa.Array, ids: pa.ListArray):
        data, off = utf8(words)
        self.keys = segment_hashes(data, off[:-1], off[1:])
        self.n = pc.list_value_length(ids).to_numpy(zero_copy_only=False).astype(np.int32)
        self.pool = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int32)


class Encoder:
    """Encodes in a worker: known segments are looked up, others folded and remembered for a while."""

    def __init__(self, pieces: Pieces, known: Known):
        self.pieces, self.known = pieces, known
        self.cache = WordCache(self._fold, limit=len(known.keys) + REMEMBERED)
        self._start()

    def _start(self) -> None:
        self.cache._add(np.where(self.known.keys == 0, U64(1), self.known.keys), self.known.pool, self.known.n.astype(np.int64))

    def _fold(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = [self.pieces.fold(w.decode()) for w in words]
        return np.fromiter(chain.from_iterable(ids), np.int32), np.fromiter(map(len, ids), np.int64, len(ids))

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and how many each has."""
        data, starts, ends, rows = self.pieces.cut(column)
        if self.cache.index.n > self.cache.limit:
            self.cache.clear()
            self._start()
        ids, per = self.cache.ids(data, starts, ends)
        return ids, np.bincount(rows, weights=per, minlength=len(column)).astype(np.int64)


class Pieces:
    """The piece table of a model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.text: list[bytes] = [b""] * n
        self.bytes = np.zeros(256, dtype=np.int32)
        table: dict[bytes, tuple[int, float]] = {}
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[1:-1], 16)] = i
                self.text[i] = bytes([int(piece[1:-1], 16)])
            elif not model.is_control(i) and not model.is_unknown(i) and not model.is_unused(i):
                self.text[i] = piece.replace(MARK, " ").encode()
                table[self.text[i]] = (i, model.get_score(i))
        self.table = table
        self.longest = max(len(x.decode()) for x in table)
        #: Whether two bytes stand side by side in a piece or in one character.
        self.joined = np.zeros((256, 256), dtype=bool)
        self.joined[:, 0x80:0xC0] = True
        for x in table:
            flat = np.frombuffer(x, np.uint8)
            self.joined[flat[:-1], flat[1:]] = True
        size = np.array([len(x) for x in self.text], dtype=np.int64)
        self.size, self.at = size, np.cumsum(size) - size
        self.pool = np.frombuffer(b"".join(self.text) or b"\0", np.uint8)

    def cut(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of the texts, each led by a space, and the segments' starts, ends and rows."""
        column = column.fill_null("")
        if pc.any(pc.match_substring(column, MARK)).as_py():
            column = pc.replace_substring(column, MARK, " ")
        led = pc.binary_join_element_wise(pa.scalar("", column.type), column, " ")
        column = pc.if_else(pc.equal(pc.binary_length(column), 0), pa.scalar("", column.type), led)
        data, off = utf8(column)
        n = len(data)
        start = np.zeros(n + 1, dtype=bool)
        if n:
            start[1:n] = ~self.joined[data[:-1], data[1:]]
            start[off] = True
        starts = np.flatnonzero(start[:n])
        return data, starts, np.append(starts[1:], n)[: len(starts)], np.searchsorted(off, starts, "right") - 1

    def segments(self, column: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Distinct segments of at most LONG characters with their counts."""
        data, starts, ends, _ = self.cut(column)
        keys, first, counts = np.unique(segment_hashes(data, starts, ends), return_index=True, return_counts=True)
        first, counts = first[short := _chars(data, starts[first], ends[first]) <= LONG], counts[short]
        size = ends[first] - starts[first]
        off = np.concatenate([[0], np.cumsum(size)])
        flat = data[np.arange(off[-1]) - np.repeat(off[:-1] - starts[first], size)]
        return pa.StringArray.from_buffers(len(first), pa.py_buffer(off.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))), counts

    def fold(self, text: str) -> list[int]:
        """The fold of one segment, with a heap of edges over linked symbols."""
        sym: list[str | None] = list(text)
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, int, str]] = []

        def push(a: int, b: int) -> None:
            if a >= 0 and b < n and (x := self.table.get((s := sym[a] + sym[b]).encode())):
                heapq.heappush(heap, (-x[1], a, b, s))

        for a in range(n - 1):
            push(a, a + 1)
        while heap:
            _, a, b, s = heapq.heappop(heap)
            if sym[a] is None or after[a] != b or b >= n or sym[b] is None or sym[a] + sym[b] != s:
                continue
            sym[a], sym[b] = s, None
            after[a] = after[b]
            if after[b] < n:
                before[after[b]] = a
            push(before[a], a)
            push(a, after[a])
        ids: list[int] = []
        for s in sym:
            if s is not None:
                x = self.table.get(s.encode())
                ids += [x[0]] if x else self.bytes[np.frombuffer(s.encode(), np.uint8)].tolist()
        return ids

    def decode(self, ids: np.ndarray, per: np.ndarray) -> list[bytes]:
        """The texts of rows of ids, without the leading space that encoding adds."""
        size = self.size[ids]
        ends = np.cumsum(size)
        flat = self.pool[np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size - self.at[ids], size)].tobytes()
        cut = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(per)])].tolist()
        return [flat[a + 1 : b] if flat[a : a + 1] == b" " else flat[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


_LOADED: dict[str, Pieces] = {}


def _pieces(path: str) -> Pieces:
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def _chars(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return lead[ends] - lead[starts]


def lattice_ids(words: DataFrame, model: str) -> DataFrame:
    """(word, n, ids) of distinct ``words`` (word, n) of at most LONG characters: substrings exploded, equi-joined to
    the pieces, grouped by word and folded by rank, all in Spark. Null or empty words have no row."""
    pieces = _pieces(model)
    table = words.sparkSession.createDataFrame([(x.decode(), i, -score) for x, (i, score) in pieces.table.items()], "known string, id int, r double").withColumn("key", F.xxhash64("known"))
    if len(pieces.table) <= BROADCAST_PIECES:
        table = F.broadcast(table)
    at = words.where("word <> ''").select("word", "n", F.explode(F.expr("sequence(0, length(word) - 1)")).alias("i"))
    spans = at.select("word", "n", "i", F.explode(F.expr(f"sequence(1, least(length(word) - i, {pieces.longest}))")).alias("len"))
    spans = spans.select("word", "n", "i", "len", F.expr("substring(word, i + 1, len)").alias("piece")).withColumn("key", F.xxhash64("piece"))
    # By a long key, which is probed faster than text; the texts are compared after it.
    same = [F.expr(f"if(piece = known, {c}, null)").alias(c) for c in ("id", "r")]
    edges = spans.join(table, "key", "left").select("word", "n", "i", "len", "piece", *same).where("id is not null or len = 1")
    edge = F.expr(
        "struct(r, i, shiftleft(1L, i) | shiftleft(1L, i + len) as need, shiftleft(1L, i + len) - shiftleft(1L, i + 1) as inner, id, if(id is null, hex(piece), null) as raw)"
    )
    lattice = edges.groupBy("word", "n").agg(F.collect_list(edge).alias("edges"))
    # State: bit k stands for a symbol bound before character k; the sign bit says that nothing is left to merge.
    # ``multi`` is bound by a lambda: as a column the optimizer would put its sort into every step.
    best = "get(filter(multi, e -> (m & e.need) = e.need and bit_count(m & e.inner) = 1), 0).inner"
    fold = f"aggregate(sequence(1, length(word)), shiftleft(1L, length(word) + 1) - 1, (m, s) -> if(m < 0, m, coalesce(m & ~{best}, m | (-9223372036854775807L - 1L))))"
    bound = f"get(transform(array(array_sort(filter(edges, e -> e.inner <> 0))), multi -> {fold}), 0)"
    folded = lattice.withColumn("mask", F.expr(f"{bound} & 9223372036854775807L"))
    symbols = "array_sort(transform(filter(edges, e -> (mask & e.need) = e.need and (mask & e.inner) = 0), e -> struct(e.i, e.id, e.raw)))"
    table_of_bytes = f"array({','.join(map(str, pieces.bytes.tolist()))})"
    as_bytes = f"transform(sequence(1, length(s.raw) div 2), k -> element_at({table_of_bytes}, cast(conv(substring(s.raw, 2 * k - 1, 2), 16, 10) as int) + 1))"
    return folded.select("word", "n", F.expr(f"flatten(transform({symbols}, s -> if(s.id is null, {as_bytes}, array(s.id))))").alias("ids"))


_BUCKET = "floor(log2(n) * 8)"


def _frequent(words: DataFrame, limit: int) -> DataFrame:
    """The most frequent words (word, n), ``limit`` at most: those from the least bucket of counts (eighths of powers of two) on that allows it."""
    total, least = 0, 1 << 30
    for bucket, k in sorted(((r["b"], r["k"]) for r in words.groupBy(F.expr(_BUCKET).alias("b")).agg(F.count("*").alias("k")).collect()), reverse=True):
        total += k
        if total > limit:
            break
        least = bucket
    return words.where(F.expr(_BUCKET) >= least)


def known_segments(documents: DataFrame, model: str, scratch: Scratch, frequent: int = FREQUENT) -> DataFrame:
    """(word, n, ids) of the most frequent segments of ``documents`` (doc_id, text), folded from their lattice."""

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text", CHUNK):
            words, counts = _pieces(model).segments(part.column(0))
            yield pa.RecordBatch.from_arrays([words, pa.array(counts, pa.int64())], names=["word", "n"])

    words = documents.select("text").mapInArrow(segments, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = scratch.keep(words, "words", {"compression": "zstd"})
    spark, key = documents.sparkSession, "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, str(IN_MEMORY))  # else edges are sorted from 128 words a task on
    try:
        return scratch.keep(lattice_ids(_frequent(words, frequent), model), "segments", {"compression": "zstd"})
    finally:
        spark.conf.set(key, old)
        scratch.drop(words)


def encode_checked(documents: DataFrame, model: str, frequent: int = FREQUENT) -> DataFrame:
    """Per document: doc_id, n_pieces, ids_crc32 (of little-endian 32-bit ids), ids, and whether decoding gives the text back."""
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    top = known_segments(docs, model, Scratch(spark, "pieces"), frequent).select("word", "ids").toArrow()
    known = spark.sparkContext.broadcast(Known(*(c.combine_chunks() for c in top.columns)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model)
        encoder = Encoder(pieces, known.value)
        for part in chunks(batches, "text", CHUNK):
            yield _rows(part, pieces, encoder)

    return docs.mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean, ids array<int>")


def _rows(part: pa.RecordBatch, pieces: Pieces, encoder: Encoder) -> pa.RecordBatch:
    """Ids, checksum and decoding of rows (doc_id, text)."""
    ids, per = encoder(part.column(1))
    back = pieces.decode(ids, per)
    data, off = utf8(part.column(1))
    raw, cut, flat = data.tobytes(), off.tolist(), memoryview(ids.astype("<u4").tobytes())
    bounds = np.concatenate([[0], np.cumsum(per)])
    same = [x == raw[a:b].replace(MARK.encode(), b" ") for x, a, b in zip(back, cut[:-1], cut[1:], strict=True)]
    crc = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids, pa.int32()))
    columns = [part.column(0), pa.array(per, pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_()), lists]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_pieces", "ids_crc32", "round_trip", "ids"])


def encode(documents: DataFrame, model: str) -> DataFrame:
    """doc_id and ids of each text."""
    return encode_checked(documents, model).select("doc_id", "ids")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and text of rows of ids; bytes that make no UTF-8 become U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                lists = part.column(1)
                per = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                texts = _pieces(model).decode(lists.flatten().to_numpy(zero_copy_only=False), per)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([t.decode(errors="replace") for t in texts], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def viterbi_encode(words: DataFrame, table: DataFrame, longest: int, penalty: float = -100.0) -> DataFrame:
    """(word, pieces): the path of the best score sum through each distinct word's lattice, all in Spark.

    ``words``: (word); ``table``: (piece, score). Substrings of at most ``longest`` characters are exploded and equi-joined to the
    table; a word's edges are gathered (their number is bounded by its length times ``longest``) and folded
    from left to right; a character without a piece costs ``penalty``. Ties go to the longer last piece. A null
    word is dropped, an empty one has no pieces."""
    distinct = words.select("word").where("word is not null").distinct()
    span = F.explode(F.expr(f"flatten(transform(sequence(1, length(word)), i -> transform(sequence(i, least(length(word), i + {longest} - 1)), j -> struct(i as i, j as j, substring(word, i, j - i + 1) as piece))))"))
    edges = distinct.where("word <> ''").select("word", span.alias("e")).select("word", "e.i", "e.j", "e.piece").join(table.select("piece", F.col("score").cast("double").alias("score")), "piece", "left")
    edges = edges.where("score is not null or i = j").withColumn("score", F.coalesce("score", F.lit(penalty)))
    lattice = edges.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("j", "i", "piece", "score"))).alias("edges"))
    # State k: the best score of the first k characters and the pieces that reach it; edges come by end, longest first.
    start = F.expr("transform(sequence(0, length(word)), k -> struct(if(k = 0, 0D, cast('-Infinity' as double)) as s, cast(array() as array<string>) as p))")
    fold = F.aggregate("edges", start, lambda acc, e: F.transform(acc, lambda st, k: F.when((k == e["j"]) & (F.element_at(acc, e["i"])["s"] + e["score"] > st["s"]), F.struct((F.element_at(acc, e["i"])["s"] + e["score"]).alias("s"), F.array_append(F.element_at(acc, e["i"])["p"], e["piece"]).alias("p"))).otherwise(st)))
    best = lattice.select("word", F.element_at(fold, -1)["p"].alias("pieces"))
    return best.unionByName(distinct.where("word = ''").select("word", F.expr("cast(array() as array<string>)").alias("pieces")))
