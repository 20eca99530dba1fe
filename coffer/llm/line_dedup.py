"""Removal of repeated runs of lines by winnowing, in DataFrame functions only.

A document is its text split at line feeds. A line goes if it lies in a run of at least ``run`` lines that stands
earlier in the corpus, by (doc_id, text hash, line).

1. Winnowing: of each ``run`` consecutive line hashes the least (the last of equals) is selected. Equal runs select
   the same line, so each repeated run of that length holds a selected line: its fingerprint.
2. Fingerprints that stand once in the corpus are dropped by a count that is combined before the shuffle. Each other place
   of a fingerprint is joined to its first place.
3. The match is extended both ways, line hash by line hash, over the ``run`` - 1 lines on either side of which a run through the
   fingerprint can consist. Where that gives ``run`` lines or more, all of them stand earlier. A longer repeat is
   covered by the matches of its several fingerprints.
4. A place whose runs are not all those of the first place may repeat another earlier place of a common line. Its
   remaining runs meet under (fingerprint, hash of the run), again at the first place of each, so that places of a line that
   millions share are never paired with one another.

Null doc_id: such documents come after all others. Null text: null out, no lines. Empty text: one empty line.
Rows equal in doc_id and text count as one document and get the same result; of ties in doc_id the smaller text hash is
earlier. Empty table: no rows. Columns whose names begin with two underscores are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coffer.llm.store import Scratch

RUN = 3


def fingerprints(documents: DataFrame, run: int = RUN) -> DataFrame:
    """One row per selected line of (doc_id, text): doc_id, text_key, line, mark, and the hashes of the lines
    before it (``back``, nearest first) and after it (``ahead``) that a run through it can hold."""
    lines = F.transform(F.split("text", "\n", -1), lambda x: F.xxhash64(x))
    docs = documents.select("doc_id", F.xxhash64("text").alias("text_key"), lines.alias("h")).where(F.size("h") >= run)
    window = f"slice(h, i, {run})"
    chosen = F.expr(f"array_distinct(transform(sequence(1, size(h) - {run} + 1), i -> i + {run} - array_position(reverse({window}), array_min({window}))))")
    row = F.transform(
        chosen,
        lambda p: F.struct(
            p.cast("int").alias("line"), F.element_at("h", p.cast("int")).alias("mark"),
            F.reverse(F.slice("h", F.greatest(F.lit(1), p - run + 1), F.least(p - 1, F.lit(run - 1)))).alias("back"), F.slice("h", p + 1, F.lit(run - 1)).alias("ahead"),
        ),
    )
    return docs.select("doc_id", "text_key", F.explode(row).alias("w")).select("doc_id", "text_key", "w.*")


def _leading(test: str, run: int) -> Column:
    """How many of the ``run`` - 1 nearest lines pass ``test`` of their number k, up to the first that doesn't (or isn't there)."""
    return F.expr(f"coalesce(nullif(array_position(transform(sequence(0, {run - 2}), k -> coalesce({test}, false)), false), 0) - 1, {run - 1})").cast("int")


def repeated_lines(documents: DataFrame, run: int = RUN) -> DataFrame:
    """(doc_id, text_key, starts): the first lines, from 1, of each document's runs that stand earlier."""
    scratch = Scratch(documents.sparkSession, "lines")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    marks = fingerprints(docs, run)
    place = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col("text_key"), F.col("line"))
    head = F.min(F.struct(place.alias("place"), "back", "ahead")).alias("head")
    # Written, so that the join below deals both sides anew and a hot line's places can be split over tasks.
    heads = scratch.keep(marks.groupBy("mark").agg(head, F.count("*").alias("n")).where("n > 1").select("mark", "head"), "heads")
    met = marks.join(heads, "mark").where(place > F.col("head.place"))
    met = met.withColumns({
        "a": _leading("get(back, k) = get(head.back, k)", run), "b": _leading("get(ahead, k) = get(head.ahead, k)", run),
        # The runs that selected this line reach back over lines that are no smaller, ahead over larger ones.
        "l": _leading("get(back, k) >= mark", run), "r": _leading("get(ahead, k) > mark", run),
    })
    met = met.select("doc_id", "text_key", "line", "mark", "back", "ahead", "l", "r", (F.col("line") - F.col("a")).alias("lo"), (F.col("line") + F.col("b") - (run - 1)).alias("hi"))
    runs = F.expr("if(lo <= hi, sequence(lo, hi), cast(array() as array<int>))")
    other = F.expr(f"filter(sequence(line - l, line + r - {run - 1}), s -> s < lo or s > hi)")
    content = "concat(reverse(back), array(mark), ahead)"
    key = F.transform(other, lambda s: F.struct(s.alias("line"), F.xxhash64(F.slice(F.expr(content), s - F.col("line") + F.size("back") + 1, F.lit(run))).alias("key")))
    met = scratch.keep(met.select("doc_id", "text_key", "mark", runs.alias("starts"), key.alias("open")), "met")
    rest = met.select("doc_id", "text_key", "mark", F.explode("open").alias("o")).select("doc_id", "text_key", "mark", "o.line", "o.key")
    firsts = rest.groupBy("mark", "key").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("mark", "key", "first")
    firsts = scratch.keep(firsts, "firsts")
    later = rest.join(firsts, ["mark", "key"]).where(place > F.col("first")).select("doc_id", "text_key", "line")
    starts = met.select("doc_id", "text_key", F.explode("starts").alias("line")).unionByName(later)
    return starts.groupBy("doc_id", "text_key").agg(F.collect_set("line").alias("starts"))


def _spans(run: int) -> Column:
    """Overlapping runs merge into spans of lines."""
    span = "array<struct<a:int,b:int>>"
    last = f"s + {run - 1}"
    longer = f"concat(slice(acc.spans, 1, size(acc.spans) - 1), array(named_struct('a', element_at(acc.spans, -1).a, 'b', {last})))"
    another = f"concat(acc.spans, array(named_struct('a', s, 'b', {last})))"
    step = f"named_struct('end', {last}, 'spans', if(s <= acc.end, {longer}, {another}))"
    return F.expr(f"aggregate(sort_array(__starts), named_struct('end', 0, 'spans', cast(array() as {span})), (acc, s) -> {step}, acc -> acc.spans)")


def remove_repeated_lines(documents: DataFrame, run: int = RUN) -> DataFrame:
    """All columns of ``documents`` with the kept text, and __n_lines and __n_removed."""
    drop = repeated_lines(documents, run).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), F.col("starts").alias("__starts"))
    key = (F.col("doc_id").cast("long").eqNullSafe(F.col("__id"))) & (F.xxhash64(F.col("text").cast("string")) == F.col("__key"))
    joined = documents.join(drop, key, "left")
    lines = F.split(F.col("text").cast("string"), "\n", -1)
    # What is kept are the slices between the spans.
    kept = F.expr("""flatten(transform(sequence(0, size(__spans)), k -> slice(__lines,
        if(k = 0, 1, element_at(__spans, k).b + 1),
        greatest(0, if(k = size(__spans), size(__lines) + 1, element_at(__spans, k + 1).a) - if(k = 0, 1, element_at(__spans, k).b + 1)))))""")
    done = joined.withColumn("__lines", lines).withColumn("__spans", _spans(run))
    text = F.when(F.col("__starts").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    removed = F.coalesce(F.aggregate("__spans", F.lit(0), lambda a, s: a + s["b"] - s["a"] + 1), F.lit(0))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size("__lines"))
    keep = [F.col(c) if c != "text" else text.alias("text") for c in documents.columns]
    return done.select(*keep, n.cast("long").alias("__n_lines"), removed.cast("long").alias("__n_removed"))
