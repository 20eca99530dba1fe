"""MinHash near-duplicates through an inverted join on signature coordinates.

A document is the set of its distinct 5-word shingles (white-space words, A-Z lower-cased; a text
of fewer words is one shingle). Two documents are linked if 100 * |A and B| >= 75 * |A or B|.

1. Each distinct set gets a signature of 64 independent minima. Rows of equal sets form a
   class with a number of its own, and only the class goes on: a group of exact copies costs one.
2. Representatives are posted under their (coordinate, value) pairs. A linked pair agrees in at
   least 32 of 64 coordinates (the chance of fewer, at a similarity of exactly 0.75, is about
   3 in a million), so it must meet among each side's 33 rarest pairs. Only this prefix is
   posted, and values of a single document are skipped: a passage that thousands share fills
   the common coordinates and is hardly ever posted.
3. In a posting list each member of a fitting set size meets the smallest one, its centre. Met pairs
   must agree in 32 coordinates (the count of collisions); then the link is confirmed on the full sets.
   So a group of near copies of any size is joined by its star.
4. What a list leaves in several components is settled on the sets themselves: their members are
   posted under their rarest shingles, of which a linked pair must share one (prefix filter), and lists
   that span components get 64 times the centres, spread by a hash, round by round, until a list is
   in one component or each member has been a centre, which is when there are as many centres as members. After the first such round
   the join itself also holds each pair against an exact bound: of 512 bits, each the parity of the set's shingles with that hash, at least as
   many shingles differ as bits do; such pairs go to the full sets without a look at their signatures. So no link is lost, and pairs that are joined already, or can't be linked, are not made.
5. Links between classes become components by star contraction; each round contracts only the roots known so far.

Null doc_id: the row is returned with its set size, linked with nothing, kept. Null text, or one
without words: set size 0, linked with nothing. A doc_id in several rows: each row has its own set and is returned by itself;
its rows with words are linked with one another, as they are one document, whether their texts are equal or not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coffer.llm.components import components
from coffer.llm.store import Scratch, only, small
from coffer.llm.textkernel import SPACED, U64, Words, chunks, distinct_per_row, mix, shingles, stream

COORDINATES = 64
MATCHES = 32
PERCENT = 75
SPREAD = 64
PARITIES = [f"f{k}" for k in range(8)]
_A = stream(COORDINATES, 1201) | U64(1)
_FEATURES = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("sig", pa.list_(pa.int64()))])


def _sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    words = Words(column, SPACED)
    return distinct_per_row(*shingles(words))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in chunks(batches, "text"):
        values, bounds = _sets(part.column(1))
        n = np.diff(bounds)
        full = np.flatnonzero(n)
        heads = bounds[:-1][full]
        h = np.zeros((2, len(n)), dtype=U64)
        sig = np.zeros((len(full), COORDINATES), dtype=np.int64)
        if len(full):
            h[0, full], h[1, full] = _set_keys(values, heads)
            values, buffer = mix(values), np.empty_like(values)
            for k in range(COORDINATES):
                low = np.minimum.reduceat(np.multiply(values, _A[k], out=buffer), heads)
                sig[:, k] = (low >> U64(8)).astype(np.int64) | (k << 56)
        offsets = np.zeros(len(n) + 1, dtype=np.int32)
        np.cumsum(np.where(n > 0, COORDINATES, 0), out=offsets[1:])
        yield pa.RecordBatch.from_arrays(
            [part.column(0), pa.array(n, pa.int64()), pa.array(h[0].view(np.int64)), pa.array(h[1].view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(sig.ravel()))],
            schema=_FEATURES,
        )


def _set_keys(values: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set, whatever its order."""
    return np.add.reduceat(mix(values ^ U64(0x51ED270B)), heads), np.add.reduceat(mix(values * U64(0xD6E8FEB86659FD93)), heads)


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of rows (rep, text, h1, h2) whose text is the class's."""
    for part in chunks(batches, "text"):
        values, bounds = _sets(part.column(1))
        full = np.flatnonzero(np.diff(bounds))
        if len(full) == 0:
            continue
        h1, h2 = (h.view(np.int64) for h in _set_keys(values, bounds[:-1][full]))
        mine = full[(h1 == part.column(2).to_numpy()[full]) & (h2 == part.column(3).to_numpy()[full])]
        data = values.tobytes()
        shingles = pa.array([data[8 * a : 8 * b] for a, b in zip(bounds[mine].tolist(), bounds[mine + 1].tolist(), strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(mine)), shingles], names=["rep", "shingles"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column(2), batch.column(3)
        ok = []
        for i in range(batch.num_rows):
            x, y = np.frombuffer(a[i].as_buffer(), U64), np.frombuffer(b[i].as_buffer(), U64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            ok.append(100 * both >= PERCENT * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], names=["a", "b", "linked"])


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            x = np.frombuffer(batch.column(1)[i].as_buffer(), U64)
            rep = pa.array(np.full(len(x), batch.column(0)[i].as_py(), dtype=np.int64))
            yield pa.RecordBatch.from_arrays([rep, pa.array(np.full(len(x), len(x), dtype=np.int64)), pa.array(x.view(np.int64))], names=["rep", "n", "token"])


def _parity_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """512 bits of each set (rep, shingles) as eight longs: whether an odd number of its shingles has that hash."""
    bits = 64 * len(PARITIES)
    for batch in batches:
        out = np.zeros((batch.num_rows, len(PARITIES)), dtype=np.int64)
        for i in range(batch.num_rows):
            at = (mix(np.frombuffer(batch.column(1)[i].as_buffer(), U64).copy()) & U64(bits - 1)).astype(np.int64)
            out[i] = np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(column)) for column in out.T)], names=["rep", *PARITIES])


def _slot(centres: int) -> Column:
    """The centre's place of a member in a list of ``size``: in a small list each member has its own."""
    return F.when(F.col("size") <= centres, F.col("rep")).otherwise(F.pmod(F.xxhash64("rep"), F.lit(centres))).alias("slot")


class _Linker:
    """Finds links in posting lists (rep, n, token, pos, size) and keeps the components they make."""

    def __init__(self, scratch: Scratch, classes: DataFrame, sets: DataFrame):
        self.scratch, self.sigs, self.sets = scratch, classes.select("rep", "sig"), sets
        self.roots: DataFrame | None = None
        self.tested: list[DataFrame] = []

    def rooted(self, posts: DataFrame) -> DataFrame:
        if self.roots is None:
            return posts.withColumn("root", F.col("rep"))
        return posts.join(small(self.roots, self.roots.withColumnRenamed("node", "rep")), "rep", "left").withColumn("root", F.coalesce("root", "rep"))

    def absorb(self, links: DataFrame) -> None:
        """Brings links (a, b) into the components."""
        if self.roots is not None and links.isEmpty():
            return
        if self.roots is not None:
            old = self.roots
            for k in "ab":
                links = links.join(small(old, old.select(F.col("node").alias(k), F.col("root").alias(f"r{k}"))), k, "left").withColumn(k, F.coalesce(f"r{k}", k)).drop(f"r{k}")
            links = self.scratch.keep(links, "between")
        new = self.scratch.keep(components(links, self.scratch), "contracted")
        if self.roots is not None:
            self.scratch.drop(links)
        if self.roots is None:
            self.roots = new
        elif not new.isEmpty():
            moved = old.join(small(new, new.select(F.col("node").alias("root"), F.col("root").alias("to"))), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
            self.roots = self.scratch.keep(moved.unionByName(new.join(small(old, old.select("node")), "node", "left_anti")), "roots")
            self.scratch.drop(new)  # but not the old roots, which lists may still read

    def step(self, lists: DataFrame, centres: int) -> DataFrame:
        """Meets each member of ``lists`` (rep, n, token, pos, root) with its list's centres of other components
        and returns the lists that still span components. Lists with parities meet only where these allow a link."""
        parities = [f for f in PARITIES if f in lists.columns]
        head = F.min(F.struct("rep", "n", "pos", "root", *parities)).alias("c")
        heads = lists.groupBy("token", _slot(centres)).agg(head)
        heads = heads.select("token", F.col("c.rep").alias("c"), *[F.col(f"c.{k}").alias(f"c{k}") for k in ["n", "pos", "root", *parities]])
        # From its first common shingle on, each side must hold enough for the overlap that a link needs.
        room = F.least(F.col("n") - F.col("pos"), F.col("cn") - F.col("cpos"))
        met = lists.join(small(lists, heads) if parities else heads, "token").where((F.col("croot") != F.col("root")) & ((100 + PERCENT) * room >= PERCENT * (F.col("n") + F.col("cn"))))
        if parities:
            differ = " + ".join(f"bit_count({f} ^ c{f})" for f in parities)
            met = met.where(f"{100 + PERCENT} * ({differ}) <= {100 - PERCENT} * (n + cn)")
        pairs = met.select(F.least("c", "rep").alias("a"), F.greatest("c", "rep").alias("b")).distinct()
        if self.tested:  # one scan of all, so that plans stay short
            tested = pairs.sparkSession.read.schema("a long, b long").parquet(*[t._coffer_path for t in self.tested])
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        two = lambda df, x: [df.select(F.col("rep").alias(k), F.col(x).alias(x + k)) for k in "ab"]
        if not parities:
            sa, sb = two(self.sigs, "sig")
            agree = F.size(F.array_intersect("siga", "sigb"))
            pairs = pairs.join(sa, "a").join(sb, "b").select("a", "b", (agree >= MATCHES).alias("close"))
        pairs = self.scratch.keep(pairs, "pairs")
        xa, xb = two(self.sets, "shingles")
        close = pairs if parities else pairs.where("close").select("a", "b")
        full = small(pairs, close).join(only(xa, "a", pairs, "a"), "a").join(only(xb, "b", pairs, "b"), "b").select("a", "b", "shinglesa", "shinglesb")
        found = self.scratch.keep(full.mapInArrow(_confirm, "a long, b long, linked boolean").where("linked").select("a", "b"), "links")
        self.tested.append(pairs)
        self.absorb(found)
        self.scratch.drop(found)
        now = self.rooted(lists.drop("root"))
        # A list is done when it lies in one component, or when each of its members was a centre.
        crowd = now.groupBy("token", _slot(centres)).agg(F.count("*").alias("k"), F.min("root").alias("lo"), F.max("root").alias("hi"))
        crowd = crowd.groupBy("token").agg(F.max("k").alias("k"), F.sum("k").alias("size"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi and k > 1").select("token", "size")
        crowd = self.scratch.keep(crowd, "crowd")  # dealt anew by the join, so a hot list can be split over tasks
        out = self.scratch.keep(now.drop("size").join(small(crowd), "token"), "lists")
        self.scratch.drop(crowd)
        return out


def near_duplicates(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "minhash")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    features = scratch.keep(docs.mapInArrow(_features, "doc_id long, n long, h1 long, h2 long, sig array<long>"), "features")
    key = ["h1", "h2", "n"]
    real = features.where("doc_id is not null and n > 0")
    classes = real.groupBy(*key).agg(F.min("doc_id").alias("doc"), F.first("sig").alias("sig")).withColumn("rep", F.monotonically_increasing_id())
    classes = scratch.keep(classes, "classes")
    repeated = _repeated(features)
    slim = scratch.keep(features.select("doc_id", *key), "keys")  # the signatures go on with the classes alone
    scratch.drop(features)
    features, real = slim, slim.where("doc_id is not null and n > 0")

    posts = _prefix(classes.select("rep", "n", F.explode("sig").alias("token")), scratch, F.lit(MATCHES - 1), F.lit(0))
    scarce = scratch.keep(classes.join(posts.select("rep").distinct(), "rep", "left_semi").select("doc", "rep", "h1", "h2"), "scarce")
    sets = only(docs, "doc_id", scarce, "doc").join(small(scarce), F.col("doc_id") == F.col("doc")).select("rep", "text", "h1", "h2").mapInArrow(_set_rows, "rep long, shingles binary")
    sets = scratch.keep(sets.groupBy("rep").agg(F.max("shingles").alias("shingles")) if repeated else sets, "sets")
    scratch.drop(scarce)

    linker = _Linker(scratch, classes, sets)
    unsized = F.lit(None).cast("long").alias("size")
    left = linker.step(linker.rooted(posts.select("*", unsized)), 1)
    scratch.drop(posts)
    if not left.isEmpty():
        open_ = sets.join(small(left, left.select("rep")), "rep", "left_semi")
        rows = open_.mapInArrow(_shingle_rows, "rep long, n long, token long")
        posted = _prefix(rows, scratch, F.ceil(F.col("n") * PERCENT / 100).cast("int") - 1, F.col("single") + F.col("at"))
        scratch.drop(left)
        lists, centres = linker.step(linker.rooted(posted.select("*", unsized)), 1), SPREAD
        scratch.drop(posted)
        if not lists.isEmpty():
            linker.sets = crowded = scratch.keep(sets.join(small(lists, lists.select("rep")), "rep", "left_semi").select("rep", "shingles"), "crowded")
            scratch.drop(sets)
            parities = crowded.mapInArrow(_parity_rows, ", ".join(f"{c} long" for c in ["rep", *PARITIES]))
            held = scratch.keep(small(lists).join(parities, "rep"), "lists")
            scratch.drop(lists)
            lists = held
        while not lists.isEmpty():
            following = linker.step(lists, centres)
            scratch.drop(lists)
            lists, centres = following, centres * SPREAD
    if repeated:
        rows = real.select(F.col("doc_id"), *key).join(classes.select(*key, "rep"), key)
        rows = scratch.keep(rows.select("doc_id", "rep").distinct(), "rows")
        linker.absorb(rows.join(rows.groupBy("doc_id").agg(F.min("rep").alias("a")), "doc_id").select("a", F.col("rep").alias("b")).where("a <> b"))

    member = classes.select(*key, "rep", "doc").join(linker.roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    least = member.groupBy("root").agg(F.min("doc").alias("component_id"))
    component = member.join(least, "root").select(*[F.col(k).alias(f"__{k}") for k in key], "component_id")
    same = [F.col(k) == F.col(f"__{k}") for k in key]
    out = features.select("doc_id", *key).join(component, same[0] & same[1] & same[2] & F.col("doc_id").isNotNull(), "left")
    root = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), root.alias("component_id"), F.coalesce(F.col("doc_id") == root, F.lit(True)).alias("kept"))


def _prefix(rows: DataFrame, scratch: Scratch, spare: Column, pos: Column) -> DataFrame:
    """Posts (rep, n, token, pos) of each rep's rarest tokens, of all that it shares with others but the ``spare`` most common. ``pos`` may use a token's place
    among them (at) and the number of tokens that the rep has alone (single), which come before all others."""
    common = scratch.keep(rows.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "common")  # written, so a hot token can be split
    ranked = rows.join(small(common), "token").groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t"))
    room = F.size("t") - spare
    short = F.transform(F.slice("t", F.lit(1), room), lambda x: x["token"])
    posts = ranked.where(room > 0).select("rep", "n", (F.col("n") - F.size("t")).alias("single"), F.posexplode(short).alias("at", "token"))
    posts = scratch.keep(posts.select("rep", "n", "token", pos.alias("pos")), "posts")
    scratch.drop(common)
    return posts


def _repeated(features: DataFrame) -> bool:
    """Whether some doc_id stands in several rows."""
    return not features.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").isEmpty()
