"""Exact top-k inner-product search through a pivot-distance index.

Vectors become integers floor(64 * x). With M the largest norm, (v, sqrt(M^2 - |v|^2)) and (q, 0)
have squared distance |q|^2 + M^2 - 2 q.v, so the best scores are the nearest neighbours.

Index: a vector's key is its nearest pivot and its distance to it. The rows are ranged over partitions by (pivot,
distance, id), so that equal or hot vectors never meet in one task, and cut along the sorted distance into annuli of at
most ``BLOCK`` vectors, packed in the smallest integers that hold them.

Search: queries are taken in blocks of about ``QUERIES``, those of neighbouring pivots together; a block is broadcast, and the index is scanned
where it lies, so vectors are shuffled once, for the index, and never in pairs. A first scan reads the
queries' own pivots and gives each query a k-th score. A second one reads the other pivots that can hold such
a score by the triangle inequality, and in them multiplies only annuli and queries that pass the same bound.
Scores are exact integers, ties go to the smaller vec_id: in floating point while M^2 fits in its digits, else
in 64-bit integers. A component or score beyond a long is an error, as in the SQL.

The pivots are a bounded sample (about the root of the number of vectors, ``PIVOTS`` at most, picked by hash); they affect speed only.

Vectors that are null, empty, hold null or non-finite components, or have a null vec_id take no part. Vectors of several
lengths: what a shorter one lacks counts as 0. Fewer than k candidates: all are returned. A vec_id in several rows: each
row is a candidate and a query of its own, and rows of its id are not its candidates. Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coffer.llm.store import Scratch

K = 20
PIVOTS = 1024
BLOCK = 512
QUERIES = 8192
TASK_BYTES = 16 << 20
_TOP = "query_row int, query_id long, vec_id long, score long"
_NONE = -(1 << 63)


def _lift(f: np.ndarray, top: float) -> np.ndarray:
    return np.sqrt(np.maximum(top - (f * f).sum(1), 0))


def _distances(f: np.ndarray, extra: np.ndarray, top: float, pivots: np.ndarray) -> np.ndarray:
    """From vectors with their last coordinate ``extra`` to lifted pivots."""
    square = (f * f).sum(1) + extra * extra
    dot = f @ pivots[:, :-1].T + extra[:, None] * pivots[:, -1]
    return np.sqrt(np.maximum(square[:, None] + (pivots * pivots).sum(1) - 2 * dot, 0))


def _dense(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of integers, filled with zeros to ``dim``."""
    flat = column.flatten().to_numpy()
    n = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(n), dim), dtype=np.int64)
    out[np.arange(dim) < n[:, None]] = flat
    return out


def _assigner(pivots: np.ndarray, top: float, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x = _dense(part.column(1), pivots.shape[1] - 1)
                f = x.astype(np.float64)
                dist = _distances(f, _lift(f, top), top, pivots)
                near = dist.argmin(1)
                home = _distances(f, np.zeros(len(f)), top, pivots).argmin(1)
                raw, width = x.astype(kind).tobytes(), x.shape[1] * np.dtype(kind).itemsize
                data = pa.array([raw[k * width : (k + 1) * width] for k in range(len(x))], pa.binary())
                columns = [part.column(0), pa.array(near, pa.int32()), pa.array(dist[np.arange(len(x)), near]), pa.array(home, pa.int32()), data]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "pivot", "dist", "home", "data"])

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Annuli of rows (vec_id, pivot, dist, data) that come in the order of pivot and distance."""
    held: list[tuple] = []

    def out() -> pa.RecordBatch:
        ids = np.array([r[0] for r in held], dtype="<i8")
        row = [[held[0][1]], [held[0][2]], [held[-1][2]], [ids.tobytes()], [b"".join(r[3] for r in held)]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.binary()), strict=True)], names=["pivot", "lo", "hi", "ids", "data"])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and (held[0][1] != row[1] or len(held) >= BLOCK):
                yield out()
                held = []
            held.append(row)
    if held:
        yield out()


def _keep(best_s: np.ndarray, best_i: np.ndarray, s: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of what is held and of new scores, by score and then smaller id. Absent: the least integer."""
    s = np.concatenate([best_s, s], axis=1)
    i = np.concatenate([best_i, np.broadcast_to(ids, (len(s), len(ids)))], axis=1)
    if s.shape[1] > 4 * k:
        cut = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        width = int((s >= cut[:, None]).sum(1).max())
        pick = np.argsort(~s, axis=1, kind="stable")[:, :width]
        s, i = np.take_along_axis(s, pick, 1), np.take_along_axis(i, pick, 1)
    order = np.lexsort((i, ~s), axis=1)[:, :k]
    return np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


def _scores(q: np.ndarray, v: np.ndarray, same: np.ndarray, top: float) -> np.ndarray:
    """Exact inner products of integer vectors; ``same`` marks pairs that are not scored."""
    if top < 2.0**24:
        s = (q.astype(np.float32) @ v.astype(np.float32).T).astype(np.int64)
    elif top < 2.0**53:
        s = (q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)
    else:
        s = q @ v.astype(np.int64).T  # right modulo 2^64
        if top >= 2.0**62:
            near = q.astype(np.float64) @ v.T.astype(np.float64)
            size = np.sqrt((q.astype(np.float64) ** 2).sum(1))[:, None] * np.sqrt((v.astype(np.float64) ** 2).sum(1))
            for i, j in np.argwhere((np.abs(near) + 1e-12 * size >= 2.0**63) & ~same).tolist():
                if abs(sum(a * b for a, b in zip(q[i].tolist(), v[j].tolist(), strict=True))) >= 1 << 63:
                    raise OverflowError("an inner product does not fit in a long")
    s[same] = _NONE
    return s


def _most(q2: np.ndarray, top: float, near: np.ndarray) -> np.ndarray:
    """The largest score at a distance of ``near`` at least, with slack for the rounding of sums as large as ``top``."""
    near = np.maximum(near * (1 - 1e-9) - 1e-6 * np.sqrt(1 + top), 0)
    return (q2 + top - near**2) / 2 + 1e-3 * (1 + q2) + 1e-5 * (q2 + top)


class Queries:
    """A block of queries, with their distances to the pivots and their k-th scores so far."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, home: np.ndarray, pivots: np.ndarray, top: float):
        self.ids, self.x, self.home = ids, x, home
        f = x.astype(np.float64)
        self.q2 = (f * f).sum(1)
        self.dist = _distances(f, np.zeros(len(f)), top, pivots)
        self.floor = np.full(len(ids), _NONE)

    def may(self, pivot: int, lo: float, hi: float, top: float) -> np.ndarray:
        """The largest score of each query in an annulus."""
        d = self.dist[:, pivot]
        return _most(self.q2, top, np.maximum(0, np.maximum(d - hi, lo - d)))


def _searcher(shared, top: float, kind: str, k: int, at_home: bool, scored):
    """Top k of each query over a task's annuli: those of its own pivot, or those of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: Queries = shared.value
        n, dim = queries.x.shape
        best_s, best_i = np.full((n, k), _NONE), np.full((n, k), np.iinfo(np.int64).max)
        products = 0
        for batch in batches:
            for pivot, lo, hi, ids, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                least = np.maximum(queries.floor, best_s[:, -1])
                use = np.flatnonzero((queries.may(pivot, lo, hi, top) >= least) & ((queries.home == pivot) == at_home))
                if len(use) == 0:
                    continue
                ids = np.frombuffer(ids, "<i8")
                v = np.frombuffer(data, kind).reshape(len(ids), dim)
                products += len(use) * len(ids)
                for a in range(0, len(use), 2048):
                    u = use[a : a + 2048]
                    s = _scores(queries.x[u], v, ids[None, :] == queries.ids[u][:, None], top)
                    better = np.flatnonzero((s >= least[u][:, None]).any(1))
                    if len(better):
                        best_s[u[better]], best_i[u[better]] = _keep(best_s[u[better]], best_i[u[better]], s[better], ids, k)
        if scored is not None:
            scored.add(products)
        row, _ = np.nonzero(best_s > _NONE)
        found = best_s > _NONE
        columns = [pa.array(row, pa.int32()), pa.array(queries.ids[row]), pa.array(best_i[found]), pa.array(best_s[found])]
        yield pa.RecordBatch.from_arrays(columns, names=["query_row", "query_id", "vec_id", "score"])

    return run


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _blocks(sizes: dict[int, int], room: int) -> tuple[dict[int, tuple[int, int]], int]:
    """For each pivot its first block of queries and over how many blocks its queries are spread; the number of blocks."""
    plan, block, held = {}, 0, 0
    for pivot in sorted(sizes):
        if held and held + sizes[pivot] > room:
            block, held = block + 1, 0
        parts = -(-sizes[pivot] // room)
        plan[pivot] = (block, parts)
        block, held = (block + parts, 0) if parts > 1 else (block, held + sizes[pivot])
    return plan, block + (held > 0)


def top_k(
    vectors: DataFrame, k: int = K, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = PIVOTS, queries: int = QUERIES, scored=None
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every``. ``scored``: an accumulator of the number of inner products."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    x = F.col(vector_col).cast("array<double>")
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).where("vec_id is not null and x is not null")
    v = v.where(F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & (F.size("x") > 0))
    large = F.raise_error(F.lit("a component does not fit in a long")).cast("long")
    v = v.select("vec_id", F.transform("x", lambda e: F.when((F.abs(e) >= 2.0**57) & (F.abs(e) < float("inf")), large).otherwise(F.floor(64 * e))).alias("x"))
    norm = F.aggregate("x", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double"))
    widest = F.aggregate("x", F.lit(0.0), lambda a, e: F.greatest(a, F.abs(e.cast("double"))))
    about = v.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("dim"), F.max(norm).alias("top"), F.max(widest).alias("wide")).first()
    if not about["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    n, dim, top = about["n"], about["dim"], float(about["top"])
    kind = next(t for t, most in (("<i2", 2**15), ("<i4", 2**31), ("<i8", float("inf"))) if about["wide"] < most)
    count = max(1, min(pivots, int(n**0.5)))
    share = min(1.0, 2 * count / n)
    pool = v.where(F.pmod(F.xxhash64("vec_id", "x"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(count).select("x").collect()
    centre = np.zeros((max(1, len(pool)), dim))
    for r, row in enumerate(pool):
        centre[r, : len(row["x"])] = row["x"]
    centre = np.unique(np.hstack([centre, _lift(centre, top)[:, None]]), axis=0)

    keyed = scratch.keep(v.mapInArrow(_assigner(centre, top, kind), "vec_id long, pivot int, dist double, home int, data binary"), "keyed")
    parts = max(1, n * dim * np.dtype(kind).itemsize // TASK_BYTES, min(n // 8192, spark.sparkContext.defaultParallelism))
    ranged = keyed.select("vec_id", "pivot", "dist", "data").repartitionByRange(int(parts), "pivot", "dist", "vec_id").sortWithinPartitions("pivot", "dist", "vec_id")
    index = scratch.keep(ranged.mapInArrow(_pack, "pivot int, lo double, hi double, ids binary, data binary"), "index")
    ask = keyed.where(F.col("vec_id") % every == 0)
    plan, n_blocks = _blocks({r["home"]: r["count"] for r in ask.groupBy("home").count().collect()}, queries)  # a row for each pivot
    if not n_blocks:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    first, spread = (F.create_map(*[F.lit(y) for p, x in plan.items() for y in (p, x[j])])[F.col("home")] for j in (0, 1))
    ask = scratch.keep(ask.select("vec_id", "home", "data", (first + F.pmod(F.xxhash64("vec_id", "data"), spread)).cast("int").alias("block")), "queries")
    reach = {r["pivot"]: (r["lo"], r["hi"]) for r in index.groupBy("pivot").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()}
    scratch.drop(keyed)

    def scan(block: Queries, wanted: list[int], at_home: bool) -> DataFrame:
        shared = spark.sparkContext.broadcast(block)
        found = index.where(F.col("pivot").isin(wanted)).mapInArrow(_searcher(shared, top, kind, k, at_home, scored), _TOP)
        out = scratch.keep(_first(found, k), "found")
        shared.unpersist()
        return out

    done = []
    for b in range(n_blocks):
        rows = ask.where(F.col("block") == b).toArrow()  # of bounded size
        x = np.frombuffer(b"".join(rows["data"].to_pylist()), kind).reshape(-1, dim).astype(np.int64)
        block = Queries(rows["vec_id"].to_numpy(), x, rows["home"].to_numpy(), centre, top)
        own = sorted(set(block.home.tolist()) & set(reach))
        near = scan(block, own, True)
        kth = near.where(F.col("rank") == k).select("query_row", "score").toArrow()
        block.floor[kth["query_row"].to_numpy()] = kth["score"].to_numpy()
        wanted = [p for p, (lo, hi) in reach.items() if ((block.may(p, lo, hi, top) >= block.floor) & (block.home != p)).any()]
        far = scan(block, wanted, False) if wanted else near.where("false")
        best = _first(near.drop("rank").unionByName(far.drop("rank")), k)
        done.append(scratch.keep(best.select("query_id", "rank", "vec_id", "score"), "top"))
        scratch.drop(near)
        if wanted:
            scratch.drop(far)
    return spark.read.schema(done[0].schema).parquet(*[d._coffer_path for d in done])
