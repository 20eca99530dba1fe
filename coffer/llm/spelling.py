"""Groups of spelling variants: words one edit apart, each led to its far more frequent form.

Words are maximal runs of letters of ASCII and Latin-1, with A-Z lower-cased; in ``one_in`` of the runs (by a crc32 of document
and run) a character is deleted, which plants variants. Words of at least ``shortest`` characters that occur at least
``least`` times are compared; two are near if one insertion, deletion or replacement makes them equal.

Even-partition pigeonhole join: a word is cut into two even segments by its length. One edit leaves one of the two
untouched, so each word is indexed under (length, segment, its characters). It probes its own length at the same places, and
as the longer word of a pair the next shorter length, with the second segment shifted by one. Candidates are verified exactly and each
pair is kept once.

A segment that many words share ("inter...") would pair all of them. Such a list is not paired: the rest of its words, the gap that
must hold the edit, is cut into two even segments in turn, and so on until lists are short or the gap is one character, when
a list has at most one word per letter. So no pair is lost and none is made only because of a common beginning or end.

Null or empty text: no words. Null doc_id: its runs stay whole. Repeated rows count again. Ties of n: the smaller word in code-point order.
Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coffer.llm.store import Scratch
from coffer.llm.textkernel import chunks

SHORTEST = 7
LEAST = 2
ONE_IN = 31
RATIO = 10
#: Pairs that a list may make before its gap is cut again.
MOST_PAIRS = 4096
#: Distinct words that a worker holds before it sends their counts on.
HELD = 200_000


def _word_counts(shortest: int, one_in: int):
    # A run that is shorter by itself can't give a word.
    runs = re.compile(f"[a-zA-ZÀ-ÿ]{{{shortest},}}")

    def flush(held: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        crc = zlib.crc32
        for part in chunks(batches, "text"):
            for doc, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                if not text.is_valid:
                    continue
                found = Counter(runs.findall(text.as_buffer().to_pybytes().lower().decode()))  # bytes: only A-Z change
                head = None if doc is None else crc(f"{doc}:".encode())
                for run, n in found.items():
                    if head is not None:
                        h = crc(run.encode(), head)
                        if h % one_in == 0:
                            at = h % len(run)
                            run = run[:at] + run[at + 1 :]
                            if len(run) < shortest:
                                continue
                    held[run] = held.get(run, 0) + n
            if len(held) > HELD:
                yield flush(held)
                held = {}
        yield flush(held)

    return count


def word_counts(documents: DataFrame, shortest: int = SHORTEST, least: int = LEAST, one_in: int = ONE_IN) -> DataFrame:
    """(word, n) of all words with at least ``least`` occurrences."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_word_counts(shortest, one_in), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _entry(at: Column, to: Column, shift: int) -> Column:
    """What stands around the gap from ``at`` to ``to`` of the indexed word, which in a probe is ``shift`` longer."""
    around = F.concat(F.substring("word", F.lit(1), at), F.lit(" "), F.substring("word", to + F.lit(1 + shift), F.lit(2**31 - 1)))
    return F.struct((F.length("word") - F.lit(shift)).alias("size"), at.alias("at"), to.alias("to"), around.alias("around"))


def _cut(entries: DataFrame) -> DataFrame:
    """Each entry (word, shift, at, to) under the two halves of its gap, as (word, shift, key)."""
    middle = F.expr("cast((at + to) div 2 as int)")
    both = [F.when(F.col("shift") == s, F.array(_entry(F.col("at"), middle, s), _entry(middle, F.col("to"), s))) for s in (0, 1)]
    return entries.select("word", "shift", F.explode(F.coalesce(*both)).alias("key"))


def near_pairs(words: DataFrame, scratch: Scratch, most: int = MOST_PAIRS) -> DataFrame:
    """(a, b): all pairs of ``words`` (word) that are one edit apart, once: the shorter first, of equal lengths the smaller."""
    size = F.length("word")
    shifts = F.explode(F.when(size > 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("shift")
    todo = words.select("word", shifts).select("word", "shift", F.lit(0).alias("at"), (size - F.col("shift")).cast("int").alias("to"))
    found = []
    while True:
        entries = scratch.keep(_cut(todo), "entries")
        of = F.when(F.col("shift") == 0, 1).otherwise(0)
        lists = entries.groupBy("key").agg(F.sum(of).alias("same"), F.count("*").alias("all")).where("same > 0 and all > 1")
        pairs = F.expr("cast(same as double) * all")
        lists = scratch.keep(lists.select("key", ((pairs <= most) | F.expr("key.to - key.at <= 1")).alias("short")), "lists")
        rows = entries.join(lists, "key")
        base = rows.where("short and shift = 0").select("key", F.col("word").alias("a"))
        probe = rows.where("short").select("key", "shift", F.col("word").alias("b"))
        met = base.join(probe, "key").where("shift = 1 or a < b").select("a", "b", "key", "shift")
        # Outside the gap both words are equal; inside, a common beginning and end may leave one character at most.
        gap_a, gap_b = (F.substring(c, F.expr("key.at + 1"), F.expr("key.to - key.at") + (F.col("shift") if c == "b" else F.lit(0))) for c in "ab")
        met = met.select("a", "b", "shift", gap_a.alias("x"), gap_b.alias("y"))
        found.append(scratch.keep(met.where(_one_edit()).select("a", "b").distinct(), "pairs"))
        todo = rows.where("not short").select("word", "shift", F.col("key.at").alias("at"), F.col("key.to").alias("to"))
        if lists.where("not short").isEmpty():
            break
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def _one_edit() -> Column:
    """Whether y is x with one character replaced, or (shift 1) inserted."""
    replaced = "exists(sequence(1, greatest(length(x), 1)), k -> left(x, k - 1) = left(y, k - 1) and substr(x, k + 1) = substr(y, k + 1) and x <> y)"
    inserted = "exists(sequence(0, length(x)), k -> left(x, k) = left(y, k) and substr(x, k + 1) = substr(y, k + 2))"
    return F.expr(f"if(shift = 0, {replaced}, {inserted})")


def spelling_variants(documents: DataFrame, shortest: int = SHORTEST, least: int = LEAST, one_in: int = ONE_IN, ratio: int = RATIO) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    scratch = Scratch(documents.sparkSession, "spelling")
    words = scratch.keep(word_counts(documents, shortest, least, one_in), "words")
    pairs = scratch.keep(near_pairs(words.select("word"), scratch), "near")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other")))
    both = both.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    leads = -F.col("best.less") >= ratio * F.col("n")
    joined = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(leads, F.col("best.other")).alias("form"), F.when(leads, -F.col("best.less")).alias("form_n")
    )
    table = scratch.keep(joined, "forms")
    # A form occurs `ratio` times as often as its word, so a path is as short as the logarithm of the largest count; each round doubles its steps.
    step = scratch.keep(table.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = step.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        if step.join(onward, "root", "left_semi").isEmpty():
            break
        step = scratch.keep(step.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root")), "roots")
    out = table.join(step, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
