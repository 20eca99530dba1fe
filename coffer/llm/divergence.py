"""How the term use of each source departs from the other sources of its language.

Terms are runs of ASCII letters and of anything beyond ASCII, with A-Z lower-cased. A language keeps the terms that at
least ``least`` of its documents use. A group, or a whole language, gives a kept term the smoothed share
``p = 1 + floor(10**9 * (count + 1) / (N + V))`` and the departure of p from q is ``floor((p - q)**2 / q)``.

1. Terms are counted per chunk of texts in the worker, then by Spark with a map-side combine, so neither a hot source nor a
   common word is gathered anywhere.
2. Pairs of sources: a group that lacks a term gives it the group's baseline share. So the sum over all kept terms is the
   baselines' departure times V, plus corrections for the terms that one side uses (from the group's histogram of counts)
   and for those that both use (a join on the term). No term that neither uses is ever made into a row.
3. Top terms of a group: radix selection. Histograms of 16 bits of the value, highest first, find the value of rank
   ``top`` in four rounds; ties at that value are narrowed in the same way, two UTF-8 bytes of the term a round. Only the
   rows above the threshold, at most ``top`` a group, are ever sorted.

Null text, lang or source: ''. A group without kept terms has baseline shares only; in a language without kept terms all pairs have the
value 0 and there are no term rows. Repeated rows are documents of their own. Ties: by the item's UTF-8 bytes. Empty
table: no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coffer.llm.store import Scratch
from coffer.llm.textkernel import U64, Words, byte_class, chunks

LEAST = 3
TOP = 200
SCALE = 1_000_000_000
DIGIT_BITS = 16
DIGIT_BYTES = 2
LETTERS = byte_class((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_TERMS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
GROUP = ["lang", "source"]


def _strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The lower-cased byte spans as strings."""
    size = end - start
    offsets = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size)
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(_LOWER[data[at]]))


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) to the counts and document counts of the terms of each group in each chunk."""
    for part in chunks(batches, "text"):
        words = Words(part.column(2), LETTERS)
        if len(words.hash) == 0:
            continue
        group = pa.StructArray.from_arrays([part.column(0).dictionary_encode().indices, part.column(1).dictionary_encode().indices], names=["a", "b"])
        a, b = (group.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(2))
        group = a * part.num_rows + b
        # Rows numbered group by group, so that one order serves documents and groups.
        by_group = np.argsort(group, kind="stable")
        place = np.empty(len(by_group), dtype=np.uint16)
        place[by_group] = np.arange(len(by_group))
        row = words.rows()
        order = np.argsort(place[row], kind="stable")
        order = order[np.argsort(words.hash[order], kind="stable")]
        h, r = words.hash[order], row[order]
        g = group[r]
        new_term = np.ones(len(h), dtype=bool)
        new_term[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
        new_doc = new_term.copy()
        new_doc[1:] |= r[1:] != r[:-1]
        head = np.flatnonzero(new_term)
        first = order[head]
        rows = pa.array(r[head])
        counts = np.diff(np.append(head, len(h)))
        docs = np.add.reduceat(new_doc.astype(np.int64), head)
        terms = _strings(words.data, words.start[first], words.end[first])
        yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows), terms, pa.array(counts, pa.int64()), pa.array(docs)], schema=_TERMS)


def term_counts(documents: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents of the group that use the term."""
    filled = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in (*GROUP, "text")]
    rows = documents.select(*filled).mapInArrow(_count_terms, "lang string, source string, term string, n long, docs long")
    return rows.groupBy(*GROUP, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: str, total: str) -> Column:
    return F.expr(f"1 + ({SCALE} * cast({count} + 1 as decimal(20, 0))) div {total}")


def _departure(p: str, q: str) -> str:
    return f"((({p}) - ({q})) * (({p}) - ({q}))) div ({q})"


def _total(value: str) -> list[Column]:
    """Sums of the high and low bits of a long, which stay within a long."""
    return [F.sum(F.expr(f"shiftright({value}, 30)")).alias("high"), F.sum(F.expr(f"({value}) & 1073741823")).alias("low")]


def _pairs(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for each two sources of a language. ``cells``: (lang, source, term, n, p); ``groups``:
    (lang, source, total, v, p0), p0 null where the language keeps no term."""
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    every = groups.join(other, "lang").where("source <> item").select(*GROUP, "item", "v", "p0", "q0")
    base = _departure("p0", "q0")
    shares = cells.groupBy(*GROUP, "p").agg(F.count("*").alias("m"))
    corrections = [
        # Terms of the group, against the other's baseline; then the other way round.
        every.join(shares, GROUP).select(*GROUP, "item", F.expr(f"cast(m as decimal(38, 0)) * ({_departure('p', 'q0')} - {base})").alias("c")),
        every.join(shares.select("lang", F.col("source").alias("item"), F.col("p").alias("q"), "m"), ["lang", "item"]).select(
            *GROUP, "item", F.expr(f"cast(m as decimal(38, 0)) * ({_departure('p0', 'q')} - {base})").alias("c")
        ),
    ]
    mine = cells.join(groups.select(*GROUP, "p0"), GROUP).select("lang", "term", "source", "p", "p0")
    theirs = mine.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    both = f"{_departure('p', 'q')} - {_departure('p', 'q0')} - {_departure('p0', 'q')} + {base}"
    both = mine.join(theirs, ["lang", "term"]).where("source <> item").select(*GROUP, "item", F.expr(both).alias("d")).groupBy(*GROUP, "item").agg(*_total("d"))
    corrections.append(both.select(*GROUP, "item", F.expr("cast(high as decimal(38, 0)) * 1073741824 + low").cast("decimal(38,0)").alias("c")))
    summed = corrections[0].unionByName(corrections[1]).unionByName(corrections[2]).groupBy(*GROUP, "item").agg(F.sum("c").alias("c"))
    value = F.expr(f"cast(coalesce(cast(v as decimal(19, 0)) * ({base}), 0) + coalesce(c, 0) as bigint)")
    return every.join(summed, [*GROUP, "item"], "left").select(*GROUP, "item", value.alias("value"))


def _boundary(hist: DataFrame, carried: list[str], descending: bool) -> DataFrame:
    """The digit of each group's histogram (group, digit, c, need) at which the running count reaches ``need``, as (group,
    digit, c, before). A histogram has at most 2**16 digits a group. Groups that never reach it are left out."""
    order = F.col("digit").desc() if descending else F.col("digit").asc()
    running = F.sum("c").over(Window.partitionBy(*GROUP).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return hist.withColumn("upto", running).where("upto >= need and upto - c < need").select(*GROUP, *carried, "digit", "c", (F.col("upto") - F.col("c")).alias("before"))


def thresholds(scored: DataFrame, top: int, scratch: Scratch) -> DataFrame:
    """For each group with more than ``top`` rows of ``scored`` (lang, source, item, value; value >= 0): the value of rank
    ``top``, and UTF-8 bytes ``path`` and their number ``depth`` such that the first ``top`` rows are those of a greater value, and of that value those
    whose first ``depth`` bytes are at most ``path`` (which is shorter if it is an item's end)."""
    sizes = scored.groupBy(*GROUP).agg(F.count("*").alias("size")).where(F.col("size") > top)
    state = scratch.keep(sizes.select(*GROUP, F.lit(0).cast("long").alias("value"), F.lit(top).cast("long").alias("need")), "state")
    for shift in range(64 - DIGIT_BITS, -1, -DIGIT_BITS):
        known = state.withColumnRenamed("value", "high")
        at = scored.join(known, GROUP).where(F.expr(f"shiftright(shiftright(value, {shift}), {DIGIT_BITS}) = high"))
        hist = at.groupBy(*GROUP, "high", "need", F.expr(f"shiftright(value, {shift}) & {2**DIGIT_BITS - 1}").alias("digit")).agg(F.count("*").alias("c"))
        found = _boundary(hist, ["high", "need"], descending=True)
        state = scratch.keep(found.select(*GROUP, F.expr(f"shiftleft(high, {DIGIT_BITS}) | digit").alias("value"), (F.col("need") - F.col("before")).alias("need")), "state")
    ties = scored.join(state, [*GROUP, "value"]).select(*GROUP, "value", "need", F.encode("item", "UTF-8").alias("bytes"))
    ties = scratch.keep(ties, "ties")
    open_, done, length = state.withColumn("path", F.expr("cast('' as binary)")), [], 0
    while not open_.isEmpty():
        at = ties.drop("need").join(open_, [*GROUP, "value"]).where(F.expr(f"substring(bytes, 1, {length}) = path"))
        hist = at.groupBy(*GROUP, "value", "need", "path", F.expr(f"substring(bytes, {length + 1}, {DIGIT_BYTES})").alias("digit")).agg(F.count("*").alias("c"))
        found = _boundary(hist, ["value", "need", "path"], descending=False)
        found = scratch.keep(found.select(*GROUP, "value", "need", "before", "c", F.concat("path", "digit").alias("path")), "paths")
        done.append(found.where("before + c = need").select(*GROUP, "value", "path", F.lit(length + DIGIT_BYTES).alias("depth")))
        open_ = found.where("before + c > need").select(*GROUP, "value", (F.col("need") - F.col("before")).alias("need"), "path")
        length += DIGIT_BYTES
    out = state.select(*GROUP, "value", F.lit(None).cast("binary").alias("path"), F.lit(0).alias("depth")).limit(0) if not done else done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _leading(scored: DataFrame, top: int, scratch: Scratch) -> DataFrame:
    """The first ``top`` rows of each group."""
    at = thresholds(scored, top, scratch).select(*GROUP, F.col("value").alias("least"), "path", "depth")
    head = F.expr("least is null or value > least or (value = least and substring(encode(item, 'UTF-8'), 1, depth) <= path)")
    return scored.join(at, GROUP, "left").where(head).select(*GROUP, "item", "value")


def divergence(documents: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """One row per group, part and item: lang, source, part ('pair' or 'term'), item, value, rank."""
    scratch = Scratch(documents.sparkSession, "divergence")
    counts = scratch.keep(term_counts(documents), "counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least).drop("docs")
    kept = scratch.keep(kept, "kept")
    langs = kept.groupBy("lang").agg(F.sum("lang_n").alias("lang_total"), F.count("*").alias("v"))
    used = scratch.keep(counts.join(kept, ["lang", "term"]).select(*GROUP, "term", "n", "lang_n"), "used")
    totals = used.groupBy(*GROUP).agg(F.sum("n").alias("total"))
    groups = documents.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in GROUP]).distinct()
    groups = groups.join(totals, GROUP, "left").join(langs, "lang", "left").select(*GROUP, F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v"), "lang_total")
    groups = scratch.keep(groups.withColumn("p0", F.when(F.col("v") > 0, _share("0", "(total + v)"))), "groups")
    cells = used.join(groups.select(*GROUP, "total", "v", "lang_total"), GROUP)
    cells = cells.select(*GROUP, "term", _share("n", "(total + v)").alias("p"), _share("lang_n", "(lang_total + v)").alias("q"))
    cells = scratch.keep(cells, "cells")
    scored = cells.where("p > q").select(*GROUP, F.col("term").alias("item"), F.expr(_departure("p", "q")).alias("value"))
    parts = {"pair": _pairs(cells.select(*GROUP, "term", "p"), groups), "term": _leading(scored, top, scratch)}
    by = [k.withColumn("part", F.lit(name)) for name, k in parts.items()]
    rank = F.row_number().over(Window.partitionBy(*GROUP, "part").orderBy(F.desc("value"), "item"))
    return by[0].unionByName(by[1]).select(*GROUP, "part", "item", "value", rank.alias("rank"))
