"""Personal data: base patterns, and identifiers found through contexts learnt by bootstrapping.

All in DataFrame functions. The base finds e-mail addresses, IP addresses, payment cards and phone numbers,
leftmost and without overlap per kind; matches that fail their check are dropped and not tried again.
The regular expressions are the contract's, with possessive quantifiers and run starts, which changes no
match but keeps them linear on very long texts.

The bootstrap's instances are candidates of a loose form: runs of digit groups over up to three separators, so a spaced phone
or card is one instance, and other white-space tokens that hold a digit or an @. A candidate is of the form of a kind if it
could be one written carelessly (``FORMS``). Those that touch a base span are seeds of its kind, with reliability 1.
The lexical patterns are the word before, the two words before and the word after a candidate, within ``near`` characters. Patterns and instances make a
graph of (kind, pattern, instance, count), on which ``rounds`` turns of aggregates and joins run. A pattern's reliability for a
kind is what its reliable instances weigh against the candidates that are of another kind or of no such form; those that are not
known yet speak neither way, but must not outweigh the known ones. An instance's reliability is that of its best pattern, and
instances that reach ``confidence`` support further patterns in the next turn. A pattern counts from ``support`` distinct
reliable instances on. At the end each candidate of a kind's form in the context of a pattern of ``confidence`` is a
span, without closing punctuation. Candidates that touch a base span are never added again.

Null or empty text: no spans. Rows equal in doc_id and text get equal results. Empty table: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coffer.llm.store import Scratch

KINDS = ["email", "ip", "card", "phone"]
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without a match of the guard has no match of the pattern.
GUARDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
CANDIDATE = r"(?<!\S)(?:[+(]?[0-9](?:[\x20().:/-]{0,3}+[0-9])*+\S*+|[^\s0-9@]*+[0-9@]\S*+)"
#: What a candidate without closing punctuation must match to be of a kind's form: careless or incomplete ways to write it.
FORMS = {
    "email": r"^[^\s@]+@[^\s@]+$",
    "ip": r"^[0-9]+(?:[.:-][0-9]+){3}$",
    "card": r"^(?:[0-9][\x20.:/-]{0,3}){11,18}[0-9]$",
    "phone": r"^[+(]?(?:[0-9][\x20().:/-]{0,3}){6,14}[0-9]$",
}
#: Context words are looked for among so many characters on each side (parameter ``near``).
NEAR = 80
#: Spans that are worked on at once in a text of many.
BLOCK = 64
SUPPORT = 5
CONFIDENCE = 0.8
ROUNDS = 3
_SPAN = "array<struct<s:int,e:int,v:string>>"


def _places(matches: str, pieces: str) -> Column:
    """Start, end and value of each match, from the lengths of the pieces between them. Running sums go over blocks of matches and then
    within each block, as an array that grows by one is copied at each step."""
    step = f"length(element_at({pieces}, k)) + length(element_at({matches}, k))"
    block = f"sequence(g * {BLOCK} + 1, least((g + 1) * {BLOCK}, size({matches})))"
    groups = f"sequence(0, cast((size({matches}) - 1) div {BLOCK} as int))"
    sums = f"transform({groups}, g -> aggregate({block}, 0, (acc, k) -> acc + {step}))"
    heads = f"aggregate({sums}, named_struct('at', 0, 'out', cast(array() as array<int>)), (acc, x) -> named_struct('at', acc.at + x, 'out', array_append(acc.out, acc.at)), acc -> acc.out)"
    inner = (
        f"aggregate({block}, named_struct('at', h, 'out', cast(array() as {_SPAN})), (acc, k) -> named_struct('at', acc.at + {step}, 'out', array_append(acc.out, "
        f"named_struct('s', acc.at + length(element_at({pieces}, k)), 'e', acc.at + {step}, 'v', element_at({matches}, k)))), acc -> acc.out)"
    )
    return F.expr(f"flatten(transform({heads}, (h, g) -> {inner}))")


def _touched(t: Column) -> Column:
    """The first kind with a base span that touches a candidate. A kind's spans are in order and apart, so in a text of many the first one that
    ends behind the candidate's start is found by halving."""
    few = F.get(F.filter("base", lambda b: (b["s"] < t["e"]) & (b["e"] > t["s"])), F.lit(0))["k"]

    def kind(n: int) -> Column:
        spans = F.col(f"base_{n}")
        upto = F.aggregate(F.array(*[F.lit(1 << k) for k in range(30, -1, -1)]), F.lit(0), lambda at, x: F.when(F.get(spans, at + x - 1)["e"] <= t["s"], at + x).otherwise(at))
        return F.when(F.get(spans, upto)["s"] < t["e"], F.lit(n))

    return F.when(F.size("base") <= BLOCK, few).otherwise(F.coalesce(*map(kind, range(len(KINDS)))))


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(d: Column) -> Column:
    """Whether a string of digits passes: from the right, every second one is doubled and its digits summed."""
    each = F.transform(F.sequence(F.lit(1), F.length(d)), lambda k: F.substring(F.reverse(d), k, F.lit(1)).cast("int"))
    total = F.aggregate(F.transform(each, lambda x, i: F.when(i % 2 == 1, F.when(x > 4, 2 * x - 9).otherwise(2 * x)).otherwise(x)), F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def _valid(kind: str, v: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(v, r"\."), lambda p: p.rlike(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        n = F.length(_digits(v))
        return n.between(13, 19) & _luhn(_digits(v))
    if kind == "phone":
        return F.length(_digits(v)).between(9, 15)
    return F.lit(True)


def base_spans(documents: DataFrame, near: int = NEAR) -> DataFrame:
    """doc_id, key (the text's hash), base (kind number, s, e, v) in order, and tokens (s, e, v, patterns)."""
    df = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    none = F.lit(None).cast("array<string>")
    empty = F.expr(f"cast(array() as {_SPAN})")
    names = [*KINDS, "token"]
    for k in names:
        guard, pattern = GUARDS.get(k, "[0-9@]"), PATTERNS.get(k, CANDIDATE)
        has = F.contains("text", F.lit("@")) if k == "email" else F.col("text").rlike(guard)
        df = df.withColumn(f"m_{k}", F.when(has, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none))
    for k in names:
        df = df.withColumn(f"p_{k}", F.when(F.size(f"m_{k}") > 0, F.split("text", PATTERNS.get(k, CANDIDATE), -1)).otherwise(none))
    df = df.drop("text")
    for k in names:
        df = df.withColumn(f"s_{k}", F.when(F.size(f"m_{k}") > 0, _places(f"m_{k}", f"p_{k}")).otherwise(empty))
    def checked(number: int, kind: str) -> Column:
        good = F.filter(f"s_{kind}", lambda x: _valid(kind, x["v"]))
        return F.transform(good, lambda x: F.struct(F.lit(number).alias("k"), x["s"].alias("s"), x["e"].alias("e"), x["v"].alias("v")))

    spans = [checked(n, k) for n, k in enumerate(KINDS)]
    def word(side: Column, pattern: str) -> Column:
        return F.lower(F.coalesce(F.nullif(F.regexp_extract(side, pattern, 1), F.lit("")), F.lit("#")))

    def contexts(i: Column) -> Column:
        left, right = F.right(F.get("p_token", i), F.lit(near)), F.left(F.get("p_token", i + 1), F.lit(near))
        return F.array(
            F.concat(F.lit("before:"), word(left, r"(\S++)\s*$")), F.concat(F.lit("two before:"), word(left, r"(\S++\s++\S++)\s*$")), F.concat(F.lit("after:"), word(right, r"^\s*(\S++)"))
        )

    tokens = F.transform("s_token", lambda x, i: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["v"].alias("v"), contexts(i).alias("patterns")))
    return df.select("doc_id", "key", F.concat(*spans).alias("base"), tokens.alias("tokens"))


def _forms(v: Column) -> Column:
    """The kinds of whose form a candidate is."""
    return F.array_compact(F.array(*[F.when(v.rlike(FORMS[k]), F.lit(n)) for n, k in enumerate(KINDS)]))


def learned_spans(found: DataFrame, scratch: Scratch, support: int = SUPPORT, confidence: float = CONFIDENCE, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, key, k, s, e): candidates that high-confidence patterns add."""
    each_kind = {f"base_{n}": F.filter("base", lambda b, n=n: b["k"] == n) for n in range(len(KINDS))}
    tokens = F.transform("tokens", lambda t: F.struct(t["s"].alias("s"), t["v"].alias("v"), t["patterns"].alias("patterns"), _touched(t).alias("seed")))
    # The base is looked up before the explode, which would copy it to each candidate.
    rows = found.where(F.size("tokens") > 0).withColumns(each_kind).select("doc_id", "key", F.explode(tokens).alias("t"))
    rows = rows.select("doc_id", "key", "t.s", F.regexp_replace("t.v", r"[.,;:!?)\]\"']++$", "").alias("v"), "t.patterns", "t.seed")
    rows = rows.withColumn("forms", F.when(F.col("seed").isNotNull(), F.array("seed")).otherwise(_forms(F.col("v"))))
    rows = scratch.keep(rows.withColumn("e", F.col("s") + F.length("v")), "instances")
    # The graph: a pattern, each instance that it extracts of a kind's form, and how often; and all candidates of a pattern.
    each = rows.select(F.explode("patterns").alias("pattern"), "v", "seed", "forms")
    every = each.groupBy("pattern").agg(F.count("*").alias("n_all"))
    graph = each.select("pattern", "v", "seed", F.explode("forms").alias("k")).groupBy("k", "pattern", "v").agg(F.count("*").alias("n"), F.max(F.col("seed").isNotNull().cast("double")).alias("r"))
    # Patterns without enough instances of a kind's form can never count, so only the others go on.
    room = graph.groupBy("k", "pattern").agg(F.count("*").alias("c")).where(F.col("c") >= support).select("k", "pattern")
    graph = graph.join(room.hint("merge"), ["k", "pattern"]).join(every.hint("merge"), "pattern")
    graph = scratch.keep(graph, "graph")

    def scored(graph: DataFrame) -> DataFrame:
        known = F.col("r") >= confidence
        p = graph.groupBy("k", "pattern").agg(
            F.sum(F.when(known, F.col("n") * F.col("r")).otherwise(0.0)).alias("good"), F.sum(F.when(known, 0).otherwise(F.col("n"))).alias("open"),
            (F.first("n_all") - F.sum("n")).alias("bad"), F.count_if(known).alias("c"),
        )
        return p.where((F.col("c") >= support) & (F.col("good") >= F.col("open"))).select("k", "pattern", (F.col("good") / (F.col("good") + F.col("bad"))).alias("p"))

    for _ in range(rounds):
        best = graph.join(scored(graph).hint("merge"), ["k", "pattern"]).groupBy("k", "v").agg(F.max("p").alias("q"))
        graph = graph.join(best.hint("merge"), ["k", "v"], "left").withColumn("r", F.greatest("r", F.coalesce("q", F.lit(0.0)))).drop("q")
        graph = scratch.keep(graph, "graph")
    strong = scratch.keep(scored(graph).where(F.col("p") >= confidence).select("k", "pattern"), "strong")
    new = rows.where("seed is null").select("doc_id", "key", "s", "e", F.explode("forms").alias("k"), "patterns")
    new = new.select("doc_id", "key", "s", "e", "k", F.explode("patterns").alias("pattern")).join(strong.hint("merge"), ["k", "pattern"])
    return new.select("doc_id", "key", "k", "s", "e").distinct()


def find_personal_data(documents: DataFrame, near: int = NEAR) -> DataFrame:
    """Per document: doc_id, base and all spans as arrays of (k, s, e), k as in KINDS. A context word of which more than ``near`` characters
    lie between is read as none."""
    scratch = Scratch(documents.sparkSession, "pii")
    found = scratch.keep(base_spans(documents, near), "base")
    more = learned_spans(found, scratch).groupBy("doc_id", "key").agg(F.collect_list(F.struct("k", "s", "e")).alias("more"))
    more = more.select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), "more")
    plain = F.transform("base", lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e")))
    both = found.join(more.hint("merge"), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("key") == F.col("__key")), "left").withColumn("base", plain)
    return both.select("doc_id", "base", F.array_sort(F.concat("base", F.coalesce("more", F.expr("cast(array() as array<struct<k:int,s:int,e:int>>)")))).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    name = lambda x: F.element_at(F.array(*[F.lit(k) for k in KINDS]), x["k"] + 1)
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", name(x), x["s"], x["e"])), ",")

    def count(number: int) -> Column:
        return F.size(F.filter("base", lambda x: x["k"] == number)).cast("long")

    counts = [count(n).alias(f"n_{k}") for n, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))
