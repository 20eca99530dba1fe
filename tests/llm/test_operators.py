"""Each operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, and against plain Python."""

import hashlib
import re
import zlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from coffer.llm import decontam, langid, licenses, line_dedup, minhash, passages, pieces, pii, token_store, topk
from coffer.llm.queries import tokenizer_file
from coffer.llm.store import Scratch

DATA = "/root/testdata/sf0.001"
WORDS = [f"w{k}" for k in range(400)]


def text(*numbers):
    return " ".join(WORDS[k % 400] + str(k // 400) for k in numbers)


LONG = text(*range(3000))
ROWS = [
    (1, text(*range(100))), (2, text(*range(100))), (3, text(*range(97), 900, 901, 902)), (4, None), (5, ""), (6, " \n\t"), (7, "one two"), (8, "One  two"), (9, LONG), (None, text(*range(100))), (7, "one two"),
    (10, text(*range(500, 600)) + "\nshared a\nshared b\nshared c\nend"), (11, "x\nshared a\nshared b\nshared c\ny"), (12, "日本語 \U0001f600 naïve " * 40), (13, "z" * 20000),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    clash = {c: F.lit(f"clash {c}") for c in ("n", "rep", "token", "key", "starts", "spans", "score", "value", "h1", "line", "f")}
    return df.withColumns(clash).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def test_near_duplicates(docs, empty):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect()}
    assert {(1, 96, 1, True), (2, 96, 1, False), (3, 96, 1, False), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True), (7, 1, 7, True), (8, 1, 7, False), (None, 96, None, True), (9, 2996, 9, True)} <= got
    assert minhash.near_duplicates(empty).count() == 0


def test_near_duplicates_group_of_partial_links(spark):
    """A chain in which only neighbours are linked, and a hot passage that links nothing."""
    hot = list(range(10000, 10060))
    rows = [(k, text(*range(12 * k, 12 * k + 100))) for k in range(20)] + [(100 + k, text(*hot, *range(20000 + 100 * k, 20000 + 100 * k + 40))) for k in range(60)]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in rows for w in [words(t)]}
    parent = {i: i for i in sets}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert got == {i: find(i) for i in sets}


def test_near_duplicates_of_crowds(spark, monkeypatch):
    """Clouds of near copies about the threshold; few centres a round, so that all rounds run."""
    monkeypatch.setattr(minhash, "SPREAD", 4)
    rng, rows = np.random.default_rng(5), []
    for cloud, size in enumerate((30, 60, 120, 300)):
        base = [f"c{cloud}w{k}" for k in range(size)]
        for k in range(50):
            t = list(base)
            for _ in range(rng.integers(0, 2 + size // 20)):
                t[rng.integers(0, size)] = f"e{rng.integers(0, 40 if k % 2 else 10**6)}"
            rows.append((1000 * cloud + k, " ".join(t[: size - int(rng.integers(0, 4))])))
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in rows for w in [words(t)]}
    root = {i: i for i in sets}
    for a, b in ((a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])):
        x, y = sorted((root[a], root[b]))
        root = {i: x if r == y else r for i, r in root.items()}
    assert 4 < len(set(root.values())) < len(rows) and got == root


def test_near_duplicates_of_one_id_with_two_texts(spark):
    a, b, c = text(*range(100)), text(*range(200, 300)), text(*range(400, 500))
    near = lambda t, k: t.rsplit(" ", 1)[0] + f" other{k}"
    rows = [(1, a), (1, b), (2, near(a, 1)), (3, near(b, 2)), (4, c), (4, c), (6, near(a, 3)), (6, near(c, 4)), (7, near(b, 5))]
    got = sorted((r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(k, 1) for k in (1, 1, 2, 3, 4, 4, 6, 6, 7)]  # 6 links the components of its two texts


def lines_kept(rows, run=3):
    """Plain Python: lines in no run of three that stands earlier."""
    docs, first, out = sorted((i, t.split("\n")) for i, t in rows), set(), {}
    for i, lines in docs:
        gone = set()
        for k in range(len(lines) - run + 1):
            window = tuple(lines[k : k + run])
            if window in first:
                gone |= set(range(k, k + run))
            first.add(window)
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def test_line_dedup_equals_plain_python(spark):
    """Few different lines, so that fingerprints are shared by many places in many contexts."""
    rng = np.random.default_rng(3)
    rows = [(int(k), "\n".join("abcdefgh"[x] for x in rng.integers(0, 2 + k % 7, rng.integers(1, 40)))) for k in range(150)]
    rows += [(1000, "\n".join(["same"] * 30)), (1001, "\n".join(["same"] * 9)), (1002, "\n\n\n\n\n"), (1003, "u\n\n\n\nv")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r["doc_id"]: r["text"] for r in line_dedup.remove_repeated_lines(df).collect()} == lines_kept(rows)
    marks = line_dedup.fingerprints(df)
    assert marks.count() < 0.8 * sum(max(0, t.count("\n") - 1) for _, t in rows)  # selected, not all runs


def test_line_dedup_needs_its_fingerprints(spark, monkeypatch):
    rows = [(1, "a\nb\nc\nd"), (2, "x\nb\nc\nd")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    real = line_dedup.fingerprints
    monkeypatch.setattr(line_dedup, "fingerprints", lambda d, run=3: real(d, run).withColumn("mark", F.monotonically_increasing_id()))
    assert {r["doc_id"]: r["text"] for r in line_dedup.remove_repeated_lines(df).collect()} == dict(rows)


def test_line_dedup(docs, empty):
    got = {r["doc_id"]: r for r in line_dedup.remove_repeated_lines(docs).collect()}
    assert got[11]["text"] == "x\ny" and got[11]["__n_removed"] == 3 and got[11]["n"] == "clash n"
    assert got[4]["text"] is None and got[5]["text"] == "" and got[10]["text"].endswith("end")
    assert line_dedup.remove_repeated_lines(empty).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 16)).round(2)
    x[100:160] = x[100]
    rows = [(int(k), [float(v) for v in r]) for k, r in enumerate(x)] + [(1000, None), (1001, [None] * 16), (1020, [float("nan")] * 16), (None, [0.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.top_k(df).collect())
    v = np.floor(64 * x).astype(int)
    want = []
    for q in range(0, 700, 20):
        s = v @ v[q]
        order = [k for k in np.lexsort((np.arange(700), -s)) if k != q][:20]
        want += [(q, n, int(k), int(s[k])) for n, k in enumerate(order, 1)]
    assert got == sorted(want)
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(few).collect()] == [(0, 1, 1, 64 * 128)]
    assert topk.top_k(df.where("vec_id = 1000")).count() == 0


def test_top_k_of_large_components(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 16)).round(2)
    x[7, 3], x[20, 3], x[21, 4], x[40] = 40000.0, -1e7, 1e7 + 0.3, x[40] * 1e4
    x[60, 9] = 5e9  # its norm, but none of its scores, is beyond a long
    df = spark.createDataFrame([(int(k), [float(v) for v in r]) for k, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.top_k(df).collect())
    v = [[int(e) for e in r] for r in np.floor(64 * x)]
    want = []
    for q in range(0, 300, 20):
        s = [(-sum(a * b for a, b in zip(v[q], v[k], strict=True)), k) for k in range(300) if k != q]
        want += [(q, n, k, -score) for n, (score, k) in enumerate(sorted(s)[:20], 1)]
    assert got == sorted(want)


def test_top_k_of_repeated_rows_ragged_lengths_and_blocks(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 8)) * 4
    x = [(centres[k % 12] + rng.normal(size=8) * 0.1)[: 8 if k % 10 else 5].round(3).tolist() for k in range(1200)]
    rows = [(k, v) for k, v in enumerate(x)] + [(40, x[40]), (41, x[41])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"pivot": F.lit("clash"), "score": F.lit("clash"), "block": F.lit(1)})
    v = [(k, [int(np.floor(64 * e)) for e in vec] + [0] * (8 - len(vec))) for k, vec in rows]
    want = []
    for i, q in v:
        if i % 20 == 0:
            s = sorted((-sum(a * b for a, b in zip(q, c, strict=True)), k) for k, c in v if k != i)
            want += [(i, n, k, -score) for n, (score, k) in enumerate(s[:20], 1)]
    scored = spark.sparkContext.accumulator(0)
    for queries in (16, 8192):
        assert sorted(tuple(r) for r in topk.top_k(df, queries=queries, scored=scored).collect()) == sorted(want)
    assert 0 < scored.value < 2 * 0.5 * 61 * 1202  # the bounds leave out most products of clustered vectors


def test_passages(spark, docs, empty):
    body = list(range(5000, 5070))
    near = [*body[:30], 9999, *body[31:]]
    rows = [(1, text(*range(80), *body, *range(100, 180))), (2, text(*range(200, 240), *body)), (3, text(*near, *range(300, 400))), (4, text(*range(600, 900))), (5, text(*body[:45], *range(900, 1000)))]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["source_doc_id"]) for r in got} >= {(2, 1), (3, 1)}
    assert not {4, 5} & ({r["doc_id"] for r in got} | {r["source_doc_id"] for r in got})
    assert (40, 110) in {(r["start_word"], r["end_word"]) for r in got if r["doc_id"] == 2}
    assert {r["doc_id"] for r in passages.repeated_passages(docs).collect()} == {2, 3, 9, 10}  # document 9 holds what 1 to 3 and 10 repeat
    assert passages.repeated_passages(empty).count() == 0


def test_passages_behind_a_head_that_holds_a_part(spark):
    """Documents 2 and 3, 5 and 6 ... share 50 words; an earlier one shares 45 of them."""
    rows, n = [], 20
    for k in range(n):
        body, own = list(range(1000 * k + 10000, 1000 * k + 10050)), lambda j: range(1000 * k + 10100 + 100 * j, 1000 * k + 10140 + 100 * j)  # noqa: B023, E731
        part = body[:45] if k % 2 else body[5:]
        rows += [(3 * k + 1, text(*own(0), *part, *own(1))), (3 * k + 2, text(*own(2), *body, *own(3))), (3 * k + 3, text(*own(4), *body, *own(5)))]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["source_doc_id"], r["start_word"], r["end_word"]) for r in got} == {(3 * k + 3, 3 * k + 2, 40, 90) for k in range(n)}


def test_passages_behind_many_pieces(spark):
    """Documents 100 and 101 share 90 words; 80 earlier ones hold pieces of 45 of them."""
    body = list(range(50000, 50090))
    rows = [(k, text(*range(1000 * k, 1000 * k + 30), *body[k % 46 : k % 46 + 45], *range(1000 * k + 100, 1000 * k + 130))) for k in range(1, 81) if k % 46 + 45 <= 90]
    rows += [(k, text(*range(1000 * k, 1000 * k + 40), *body, *range(1000 * k + 100, 1000 * k + 140))) for k in (100, 101)]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {(r["doc_id"], r["source_doc_id"]) for r in got}
    assert (101, 100) in found
    covered = {w for r in got if (r["doc_id"], r["source_doc_id"]) == (101, 100) for w in range(r["start_word"], r["end_word"])}
    assert len(covered & set(range(40, 130))) >= 50


def test_passages_of_repeated_ids_and_ties(spark):
    a, b = text(*range(120)), text(*range(7000, 7100))
    rows = [(1, a), (1, a), (2, a), (2, b), (3, b), (3, b), (4, text(*range(60), *range(60)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"key": F.lit(1), "c": F.lit("x"), "members": F.lit(2)})
    got = {(r["doc_id"], r["source_doc_id"]) for r in passages.repeated_passages(df).collect()}
    assert got >= {(2, 1), (3, 2), (4, 1)} and all(x != y for x, y in got)


def brute_passages(rows):
    """Plain Python: pairs of documents that share 50 words in a row, later one first."""
    seen, out = {}, set()
    for i, t in sorted(rows):
        w = words(t)
        mine = {tuple(w[k : k + 50]) for k in range(len(w) - 49)}
        for p in mine:
            out |= {(i, j) for j in seen.get(p, ())}
        for p in mine:
            seen.setdefault(p, []).append(i)
    return {i for i, _ in out}, out


def test_passages_cover_brute_force(spark):
    """Every document of the test table that repeats 50 words of an earlier one has a row, and its spans hold those words."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect() if r["text"]]
    later, _ = brute_passages(rows)
    got = {}
    for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r["doc_id"], []).append((r["start_word"], r["end_word"]))
    assert later and later <= set(got)


def test_passages_with_one_edit_are_all_met(spark):
    """Passages of 50 words with a word replaced, left out or put in at each place that leaves 50 matched words."""
    rows, n = [], 0
    for at in range(5, 45):
        for change in range(9):
            body = list(range(1000 * n, 1000 * n + 51))
            edited = [body[:at] + [1000 * n + 99] + body[at + 1 :], body[:at] + body[at + 1 :], body[:at] + [1000 * n + 99] + body[at:]][change % 3]
            rows += [(2 * n, text(*range(1000 * n + 100, 1000 * n + 130), *body, *range(1000 * n + 200, 1000 * n + 230))), (2 * n + 1, text(*range(1000 * n + 300, 1000 * n + 330), *edited, *range(1000 * n + 400, 1000 * n + 430)))]
            n += 1
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["source_doc_id"]) for r in got} == {(2 * k + 1, 2 * k) for k in range(n)}


@pytest.mark.parametrize("spread", [64, 2])
def test_passages_edited_behind_a_head_that_holds_a_part(spark, monkeypatch, spread):
    """Documents 2 and 3, 6 and 7 ... share 60 words of which one is replaced; earlier ones share two pieces of 28 of them."""
    monkeypatch.setattr(passages, "SPREAD", spread)
    rows, n = [], 12
    for k in range(n):
        at = 10_000 * (k + 1)
        body, own = list(range(at, at + 60)), lambda j: range(at + 1000 + 100 * j, at + 1040 + 100 * j)  # noqa: B023
        edited = [*body[:30], at + 99, *body[31:]]
        rows += [(4 * k, text(*own(0), *body[:29], *own(1), *body[31:], *own(2))), (4 * k + 1, text(*own(7), *body[:29], *own(8)))]
        rows += [(4 * k + 2, text(*own(3), *body, *own(4))), (4 * k + 3, text(*own(5), *edited, *own(6)))]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["source_doc_id"]) for r in got} == {(4 * k + 3, 4 * k + 2) for k in range(n)}


def test_passages_of_stretches_that_repeat_a_few_words(spark):
    """Every document that shares 50 words with another has a row with one such, whole stretches too, and a stretch has few posts whatever its length."""
    rng, rows = np.random.default_rng(5), []
    for k in range(160):
        pieces = []
        for _ in range(3):
            period, pool = int(rng.integers(1, 9)), int(rng.integers(0, 12))
            stretch = [40_000 + 100 * period + 10 * (pool % 2) + j % period for j in range(int(rng.integers(10, 130)))]
            pieces += [stretch, list(range(1000 * pool, 1000 * pool + int(rng.integers(3, 30)))), [int(x) for x in rng.integers(0, 2**20, 8)] if rng.random() < 0.5 else []]
        rows.append((k, text(*[x for p in pieces for x in p])))
    later, pairs = brute_passages(rows)
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(later) > 100 and later <= {r["doc_id"] for r in got}
    root = {k: k for k, _ in rows}
    for r in got:
        a, b = root[r["doc_id"]], root[r["source_doc_id"]]
        root = {k: min(a, b) if v in (a, b) else v for k, v in root.items()}
    assert all(root[i] == root[j] for i, j in pairs)
    for period in range(1, 8):
        batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": [text(*range(100, 130), *[k % period for k in range(5000)], *range(200, 230))]})
        assert sum(x.num_rows for x in passages._windows(iter([batch]))) < 80


def test_personal_data(spark, docs, empty):
    rows = [(1, "a@b.co_d@e.fg x 1.2.3.4.5.6.7.8 256.1.1.1"), (2, "é 4111 1111 1111 1111, +1 (523) 555-1055. +12"), (3, None), (3, None), (4, "9" * 3000 + " " + "a" * 5000 + "@b.c"), (None, "q@r.st")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"key": F.lit(1), "base": F.lit(2)})
    got = {(r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in pii.digest(pii.find_personal_data(df)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == {(1, 2, 2, 0, 0, sha("email:0:6,email:6:13,ip:16:23,ip:24:31")), (2, 0, 0, 1, 1, sha("card:2:21,phone:23:40")), (3, 0, 0, 0, 0, sha("")), (4, 1, 0, 0, 0, sha("email:3001:8005")), (None, 1, 0, 0, 0, sha("email:0:6"))}
    assert pii.find_personal_data(empty).count() == 0
    assert pii.find_personal_data(docs).count() == len(ROWS)


def test_personal_data_of_a_text_of_many_matches(spark):
    """100 000 candidates in one text, of which many are base spans of each kind; places and seeds as plain Python has them."""
    kinds = ["10.0.0.7", "x@y.zz", "+12 345 678 901,", "4111111111111111,", "77", "300.1.1.7"]
    t = " é ".join(kinds[k % 6] for k in range(100_000))
    got = pii.find_personal_data(spark.createDataFrame([(1, t), (2, t[:3000])], "doc_id long, text string")).collect()
    plain = ["x@y.zz", r"10\.0\.0\.7", "4111111111111111", r"\+12 345 678 901"]
    for r in got:
        full = t if r["doc_id"] == 1 else t[:3000]
        assert [tuple(x) for x in r["base"]] == [(k, m.start(), m.end()) for k, p in enumerate(plain) for m in re.finditer(p, full)]
        base, spans = ({tuple(x) for x in r[c]} for c in ("base", "spans"))
        assert base <= spans and all(full[b:e] == "300.1.1.7" and k == 1 for k, b, e in spans - base)


def test_bootstrap_learns_a_context(spark):
    rows = [(k, f"ping host 10.0.0.{k} now") for k in range(20)] + [(100, "ping host 300.1.1.7 today"), (101, "about 300.1.1.8 today")]
    got = {r["doc_id"]: r["spans"] for r in pii.digest(pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got[100] == "ip:10:19" and got[101] == ""


def test_bootstrap_finds_planted_identifiers(spark):
    """Seeds in contexts of their own, unseen forms in the same contexts, and the same forms elsewhere."""
    rng = np.random.default_rng(4)
    some = lambda: " ".join(f"{WORDS[k]}" for k in rng.integers(0, 10, 6)).replace("w", "v").translate(str.maketrans("0123456789", "abcdefghij"))
    phone = lambda: f"({rng.integers(200, 999)}) 555-{rng.integers(1000, 9999)}"
    rows = [(k, f"{some()} call +1 {phone()} soon {some()}") for k in range(30)] + [(100 + k, f"{some()} write jane{chr(97 + k % 26)}{chr(97 + k // 9)}@mail.example.com {some()}") for k in range(30)]
    rows += [(200 + k, f"{some()} serial {k + 100} {some()}") for k in range(30)]
    planted = [(300 + k, f"{some()} call {phone()} soon {some()}", "phone") for k in range(10)] + [(320 + k, f"{some()} write bob{chr(97 + k)}@intranet. {some()}", "email") for k in range(10)]
    decoys = [(400 + k, f"{some()} serial {phone()} {some()}") for k in range(5)] + [(420 + k, f"{some()} call {k} times {some()}") for k in range(5)]
    df = spark.createDataFrame(rows + [p[:2] for p in planted] + decoys, "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.digest(pii.find_personal_data(df)).collect()}
    texts = {p[0]: p[1] for p in planted}
    assert all(got[i]["spans"].split(":")[0] == kind for i, _, kind in planted)
    for i, t in texts.items():
        _, s, e = got[i]["spans"].split(":")
        assert t[int(s) : int(e)] == (re.search(r"\([0-9]+\) 555-[0-9]+", t) or re.search(r"bob\w+@intranet", t))[0]
    assert all(got[i]["spans"] == "" for i, _ in decoys) and all(got[i]["spans"] == "" for i in range(200, 230))
    assert all(got[i]["base_sha256"] == hashlib.sha256(b"").hexdigest() for i in texts)


def test_language(spark, docs, empty):
    d = spark.read.parquet(f"{DATA}/documents.parquet")
    got = langid.predict_languages(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in got)
    odd = {r["doc_id"]: r for r in langid.predict_languages(docs.withColumn("lang", F.when(F.col("doc_id") < 9, "xx").otherwise(F.lit(None).cast("string")))).collect()}
    assert odd[4]["lang_pred"] == odd[5]["lang_pred"] == odd[6]["lang_pred"] == "und" and odd[1]["lang_pred"] == "xx"
    assert langid.predict_languages(empty).count() == 0


def test_language_keeps_what_it_knows(spark):
    d = spark.read.parquet(f"{DATA}/documents.parquet")
    model = langid.fit(d, Scratch(spark, "t"))
    odd = spark.createDataFrame([(-1, "日本語のテキスト"), (-2, "xqzvkj qqxzj zzkqx wvxqj"), (-3, None), (-4, "123 456")], "doc_id long, text string")
    kept = {r["doc_id"] for r in langid.keep_identified(d.select("doc_id", "text").unionByName(odd), model).collect()}
    letters = {r["doc_id"] for r in d.collect() if any(c.isalpha() for c in r["text"] or "")}
    assert not kept & {-1, -2, -3, -4} and len(letters - kept) <= 0.02 * len(letters)


def test_language_equals_plain_python(spark):
    """The backoff score by dictionaries, on texts with known and unseen words."""
    import math
    from collections import Counter

    rows = [(k, ["ab abc zu", "über das haus ab", "the house of abc"][k % 3], ["de", "de", "en"][k % 3]) for k in range(1, 40)] + [(1000, "abd hausen theory xyz ABC", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    train = [r for r in rows if r[2] and zlib.crc32(str(r[0]).encode()) % 5]
    counts = {(lang, n): Counter() for lang in ("de", "en") for n in range(6)}
    for _, t, lang in train:
        for w in t.lower().split():
            counts[lang, 0][w] += 1
            for n in range(1, 6):
                for k in range(len(w) - n + 1):
                    counts[lang, n][w[k : k + n]] += 1
    types = {n: max(len(counts[x, n]) for x in ("de", "en")) for n in range(6)}
    log = lambda lang, n, x: math.log((counts[lang, n][x] + 0.5) / (sum(counts[lang, n].values()) + 0.5 * (types[n] + 1)))

    def score(w, lang):
        for n in (0, 5, 4, 3, 2, 1):
            parts = [w] if n == 0 else [w[k : k + n] for k in range(len(w) - n + 1)]
            known = [x for x in parts if any(counts[y, n][x] for y in ("de", "en"))]
            if known:
                return sum(log(lang, n, x) for x in known) / len(known)
        return 0.0

    got = {r["doc_id"]: r for r in langid.predict_languages(df).collect()}
    for i, t, _ in rows:
        total = {x: sum(score(w, x) for w in t.lower().split()) for x in ("de", "en")}
        best = max(sorted(total), key=total.get)
        assert got[i]["lang_pred"] == best
        assert abs(got[i]["score"] - 1 / sum(math.exp(total[x] - total[best]) for x in total)) < 1e-4


def test_decontamination(spark, docs, empty):
    items = [("a", text(*range(20))), ("b", "one two"), ("c", None), ("d", ""), ("e", text(*range(7000, 7020)))]
    bench = spark.createDataFrame(items, "item_id string, text string")
    for block in (1 << 20, 40):
        got = {r["doc_id"]: r for r in decontam.decontaminate(docs, bench, block).collect()}
        assert (got[1]["n_words"], got[1]["n_hit"], got[1]["items"], got[1]["contaminated"]) == (100, 20, ["a"], True)
        assert (got[8]["n_hit"], got[8]["items"]) == (2, ["b"]) and got[9]["n_hit"] == 20 and not got[9]["contaminated"]
        assert (got[4]["n_words"], got[4]["n_hit"], got[4]["contaminated"]) == (0, 0, False)
        assert [tuple(s) for s in got[1]["spans"]] == [(0, 20)]
        assert {r["doc_id"] for r in decontam.keep_clean(docs, bench, block).collect()} == {r["doc_id"] for r in got.values() if not r["contaminated"]}
    one, many = (sorted(map(str, decontam.decontaminate(docs, bench, b).collect())) for b in (1 << 20, 30))
    assert one == many
    assert decontam.decontaminate(docs, bench.where("false")).where("n_hit > 0").count() == 0
    assert decontam.decontaminate(empty, bench).count() == 0


def test_fm_index():
    rng = np.random.default_rng(2)
    t = np.tile(rng.integers(1, 5, 50), 8)
    index = decontam.FMIndex(t, 6)
    for n in (1, 3, 9):
        p = rng.integers(1, 6, (50, n))
        lo, hi = index.search(p)
        for row, a, b in zip(p, lo, hi, strict=True):
            want = [k for k in range(401 - n) if (t[k : k + n] == row).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_tokens_encoder_serves_all_tasks_of_a_worker(monkeypatch):
    from pyspark import TaskContext, cloudpickle

    made, init, path = [], token_store.Encoder.__init__, tokenizer_file("byte_bpe_50k.json")
    monkeypatch.setattr(token_store.Encoder, "__init__", lambda self, path: (made.append(path), init(self, path))[1])
    monkeypatch.setattr(TaskContext, "get", classmethod(lambda cls: type("Task", (), {"partitionId": lambda self: 0})()))
    task = cloudpickle.dumps(token_store._writer(path))
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["one two"]})
    first, second = (next(cloudpickle.loads(task)(iter([batch]))) for _ in range(2))
    assert first == second and len(made) <= 1


def test_tokens(spark, docs, empty):
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    odd = ["a  b\n\n c ", "don't 's x", "x\t\ty \n", "été ÷ 12ab34", "<|endoftext|>", " \n ", "!! 12 3a", "tab\t x"]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + k, t) for k, t in enumerate(odd)], "doc_id long, text string")).where("doc_id is not null").dropDuplicates(["doc_id"])
    got = {r["doc_id"]: tuple(r)[1:] for r in token_store.read_tokens(token_store.write_tokens(df, path, Scratch(spark, "t"))).collect()}
    at = 0
    for r in df.orderBy("doc_id").collect():
        ids = np.array([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        assert got[r["doc_id"]] == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert token_store.read_tokens(token_store.write_tokens(empty, path, Scratch(spark, "t"))).count() == 0


def test_codes_give_any_id():
    ids = np.random.default_rng(1).choice([3, 255, 256, 70000, 2**32 - 1], 3000)
    codes = token_store.Codes(token_store.pack(ids))
    assert (codes.all() == ids).all() and all(codes[k] == ids[k] for k in range(0, 3000, 11))
    assert len(token_store.Codes(token_store.pack(np.zeros(0, np.uint32)))) == 0


def test_pieces(docs, empty):
    import sentencepiece

    path = tokenizer_file("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    got = pieces.encode_checked(docs, path).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(ROWS) and all(r["round_trip"] for r in got)
    for i, t in ROWS:
        assert by[i]["ids"] == model.encode(t or "")
    back = {r["doc_id"]: r["text"] for r in pieces.decode(pieces.encode(docs, path), path).collect()}
    assert all(back[i] == (t or "") for i, t in ROWS)
    assert pieces.encode_checked(empty, path).count() == 0
    for frequent in (0, 20):  # most segments come by the join
        few = {r["doc_id"]: r["ids"] for r in pieces.encode_checked(docs, path, frequent).collect()}
        assert all(few[i] == by[i]["ids"] for i, _ in ROWS)


def test_pieces_equal_the_library_on_whole_texts(spark):
    import sentencepiece

    path = tokenizer_file("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in pieces.encode_checked(docs, path, 500).collect():
        assert r["ids"] == model.encode(texts[r["doc_id"]] or "") and r["round_trip"]


def test_viterbi_lattice(spark):
    table = {"a": -1.0, "b": -1.5, "ab": -2.0, "abc": -5.0, "c": -1.2, "bc": -2.1, "cab": -2.5}
    texts = ["abcab", "", "aaxb", "cab", None, "cab"]
    t = spark.createDataFrame(list(table.items()), "piece string, score double")
    got = {r["word"]: r["pieces"] for r in pieces.viterbi_encode(spark.createDataFrame([(x,) for x in texts], "word string"), t, 3).collect()}

    def best(w):
        if not w:
            return 0.0
        return max(table.get(w[-n:], -100.0 if n == 1 else float("-inf")) + best(w[:-n]) for n in range(1, min(3, len(w)) + 1))

    assert set(got) == {"abcab", "", "aaxb", "cab"}
    for w, p in got.items():
        assert "".join(p) == w and abs(sum(table.get(x, -100.0) for x in p) - best(w)) < 1e-9


def test_licences(spark):
    rows = [(1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/x.py", "code"), (3, "a/b/c/y.py", "code"), (4, "a/b/LICENSE", "Licensed under the Apache License, Version 2.0."), (5, "q.txt", None), (6, None, "code"),
            (7, "z/w.py", "This work is licensed under the GNU General Public License, version 3.\n" + text(*range(200))), (8, "z/v.py", ""), (8, "z/v.py", "")]
    df = spark.createDataFrame(rows, "file_id long, path string, text string")
    got = {r["file_id"]: (r["own"], r["licence"], r["inherited_from"]) for r in licenses.scan_licences(df).collect()}
    assert got == {1: ("MIT", "MIT", None), 2: (None, "Apache-2.0", "a/b"), 3: (None, "Apache-2.0", "a/b"), 4: ("Apache-2.0", "Apache-2.0", None), 5: (None, None, None), 6: (None, None, None), 7: ("GPL-3.0", "GPL-3.0", None), 8: (None, None, None)}
    assert licenses.scan_licences(df.where("false")).count() == 0


def test_licences_equal_plain_cosine(spark):
    """Units, TF-IDF and cosine by dictionaries, over wrapped headers, long lines and prose."""
    import math

    word = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
    templates = [(n, word.findall(t.lower())) for n in sorted(licenses.TEMPLATES) for t in licenses.TEMPLATES[n]]
    df = {}
    for _, ws in templates:
        for w in set(ws):
            df[w] = df.get(w, 0) + 1
    idf = lambda w: 1 + math.log(len(templates) / df[w]) if w in df else 1 + math.log(len(templates))

    def vector(ws):
        return {w: ws.count(w) * idf(w) for w in set(ws)}

    def best(t):
        lines = t.split("\n")
        blocks = [b for b in re.split(r"\n(?:[^0-9A-Za-z\x80-\U0010ffff\n]*\n)+", t)]
        found = []
        for unit in [*lines, *blocks, t]:
            v = vector(word.findall(unit.lower()))
            for n, ws in templates:
                u = vector(ws)
                dot = sum(x * u.get(w, 0) for w, x in v.items())
                if v:
                    found.append((round(dot / math.sqrt(sum(x * x for x in v.values()) * sum(x * x for x in u.values())), 6), n))
        top = max((s for s, _ in found), default=0)
        return (min(n for s, n in found if s == top), top) if top >= licenses.LEAST else (None, None)

    mpl = "// This Source Code Form is subject to the terms of the Mozilla Public\n// License, v. 2.0. If a copy of the MPL was not distributed with this\n// file, You can obtain one at https://mozilla.org/MPL/2.0/."
    bsd = licenses.TEMPLATES["BSD-3-Clause"][2]
    texts = [mpl, mpl + "\n\n" + text(*range(300)), text(*range(50)) + "\n" + mpl, bsd.replace(". ", ".\n"), "the MIT license\n", "BSD 3-Clause License", "version 2.0", "see the license", text(*range(500)), "", "\n\n",
             "Released under the MIT License. " * 200, "license " * 1000, licenses.TEMPLATES["GPL-3.0"][2], " ".join(licenses.TEMPLATES["MIT"]), "All rights reserved.\nx", "naïve 日本 license"]
    rows = [(k, f"d{k}/f", t) for k, t in enumerate(texts)]
    got = {r["file_id"]: (r["own"], r["score"]) for r in licenses.own_licences(spark.createDataFrame(rows, "file_id long, path string, text string")).collect()}
    for k, t in enumerate(texts):
        name, score = best(t)
        assert got[k][0] == name and (name is None or abs(got[k][1] - score) < 1e-5), t[:60]
    assert got[0][0] == got[1][0] == got[2][0] == "MPL-2.0" and got[3][0] == got[5][0] == "BSD-3-Clause" and got[11][0] == "MIT" and got[6][0] is None


def test_licence_files_and_reserved_rights(spark):
    bsd, gpl = licenses.TEMPLATES["BSD-3-Clause"][2], "GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n\n"
    body = "\n".join(text(*range(7 * k, 7 * k + 9)) for k in range(200))
    rows = [
        (1, "a/LICENSE", "Copyright (c) 2020, Someone\nAll rights reserved.\n\n" + bsd), (2, "a/x.c", "code"), (3, "g/COPYING.txt", gpl + body + "\n\nGNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007\n\n" + body),
        (4, "g/h/y.c", "code"), (5, "s/main.c", "Released under the MIT License.\n\n" + body), (6, "s/other.c", "code"), (7, "p/z.c", "All rights reserved.\n" + body), (8, "n/license_utils/q.c", "code"), (9, "n/LICENSE", body),
        (10, "r/f.c", "All rights reserved.\nReleased under the MIT License.\n" + body),
    ]
    got = {r["file_id"]: (r["own"], r["licence"], r["inherited_from"]) for r in licenses.scan_licences(spark.createDataFrame(rows, "file_id long, path string, text string")).collect()}
    assert got == {
        1: ("BSD-3-Clause", "BSD-3-Clause", None), 2: (None, "BSD-3-Clause", "a"), 3: ("GPL-3.0", "GPL-3.0", None), 4: (None, "GPL-3.0", "g"), 5: ("MIT", "MIT", None), 6: (None, None, None),
        7: ("Proprietary", "Proprietary", None), 8: (None, None, None), 9: (None, None, None), 10: ("MIT", "MIT", None),
    }


def test_licences_of_deep_paths_and_clashing_columns(spark):
    deep = "/".join(f"d{k}" for k in range(60))
    rows = [(1, "LICENSE", "Released under the MIT License."), (2, deep + "/x.py", "code"), (3, deep + "/y.py", "a" * 50000 + " code" * 3000), (4, "d0/COPYING", "Licensed under CC BY 4.0."), (5, "d0/COPYING", "Licensed under CC BY-SA 4.0.")]
    df = spark.createDataFrame(rows, "file_id long, path string, text string").withColumns({c: F.lit(1) for c in ("own", "dir", "d", "row_key", "n")})
    got = {r["file_id"]: (r["licence"], r["inherited_from"]) for r in licenses.scan_licences(df).collect()}
    assert got[2] == got[3] == ("CC-BY-4.0", "d0") and got[1] == ("MIT", None)


def near_components(rows):
    """Plain Python: component of each row by all pairs of full sets, where rows of one id are linked."""
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := words(t)) else set() for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a in range(len(rows)):
        for b in range(a):
            near = sets[a] and sets[b] and (100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) or (rows[a][0] is not None and rows[a][0] == rows[b][0]))
            if near and rows[a][0] is not None and rows[b][0] is not None:
                parent[find(a)] = find(b)
    return [find(k) for k in range(len(rows))]


def contaminated(t, items):
    """Plain Python: whether a twentieth of a text's words lie in windows of the items."""
    cut = lambda x: re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
    w, hit = cut(t), set()
    for item in items:
        v = cut(item)
        for n, windows in ((min(13, len(v)), {tuple(v[k : k + 13]) for k in range(max(1, len(v) - 12))}),) if v else ():
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
    return bool(hit) and 20 * len(hit) >= len(w)


def test_pipeline_stages_equal_plain_python(spark, tmp_path):
    """Nulls, repeated rows, ties, clashing columns, near copies, repeated lines and contaminated texts, stage by stage."""
    import corpus_pipeline
    import sentencepiece

    rng = np.random.default_rng(11)
    prose = lambda n: " ".join("".join(rng.choice(list("aeioubdkst"), 6)) for _ in range(n))
    bodies = [prose(120) for _ in range(40)]
    bench = [prose(30), prose(8), "", None]
    rows = [(k, t, "xx", "s") for k, t in enumerate(bodies)] + [(100 + k, " ".join([*t.split()[:-2], "other", "end"]), "xx", "s") for k, t in enumerate(bodies[:10])]
    rows += [(200, "l1\nl2\nl3\n" + prose(20), "xx", "s"), (201, prose(20) + "\nl1\nl2\nl3", "xx", "s"), (202, "l1\nl2\nl3", "xx", "s"), (203, None, "xx", "s"), (204, "", None, "s"), (205, "12 34", "xx", None)]
    rows += [(300, f"{prose(10)} {bench[0]} {prose(10)}", "xx", "s"), (301, f"{prose(400)} {bench[1]}", "xx", "s"), (None, bodies[3], None, "s"), (5, bodies[5], "xx", "s"), (6, prose(60), "xx", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({"n_chars": F.length("text"), "root": F.lit(1), "n": F.lit("x"), "rep": F.lit(2)})
    spark.createDataFrame([(f"i{k}", t) for k, t in enumerate(bench)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stages, keep = dict(corpus_pipeline.STAGES), Scratch(spark, "t")

    def after(name, now):
        out = keep.keep(stages[name](spark, now, str(tmp_path)))
        if name != "sentencepiece":
            assert out.schema.names == df.schema.names
        return out, sorted(((r["doc_id"], r["text"]) for r in out.select("doc_id", "text").collect()), key=str) if "text" in out.columns else out.collect()

    now, got = after("language_id", df)
    assert got == sorted(((i, t) for i, t, *_ in rows if t and re.search("[a-z]", t)), key=str)
    by_line = lines_kept([x for x in got if x[0] is not None and x[0] not in (5, 6)])  # ids of one text each
    now, got = after("line_dedup", now)
    assert {i: t for i, t in got if i in by_line} == {i: t for i, t in by_line.items() if t}
    assert 202 not in {i for i, _ in got} and [r["n_chars"] for r in now.where("doc_id = 201").collect()] == [len(by_line[201])]
    root = near_components(got)
    least = {c: min((got[k][0] for k in range(len(got)) if root[k] == c and got[k][0] is not None), default=None) for c in set(root)}
    want = [x for k, x in enumerate(got) if x[0] is None or x[0] == least[root[k]]]
    now, got = after("near_dedup", now)
    assert got == want
    want = [x for x in got if not contaminated(x[1], bench)]
    now, got = after("decontamination", now)
    assert got == want and 300 not in {i for i, _ in got} and 301 in {i for i, _ in got}
    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    _, got = after("sentencepiece", now)
    assert sorted(((r["doc_id"], tuple(r["ids"])) for r in got), key=str) == sorted(((i, tuple(model.encode(t))) for i, t in want), key=str)
    assert all(r["round_trip"] for r in got)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    sizes = [docs.count()]
    for _, stage in corpus_pipeline.STAGES:
        out = Scratch(spark, "t").keep(stage(spark, docs, DATA))
        if stage is not corpus_pipeline.encode_pieces:
            assert out.columns == docs.columns
        docs = out
        sizes.append(docs.count())
    assert all(a >= b for a, b in pairwise(sizes)) and sizes[-1] > 0.5 * sizes[0]
    assert docs.where("not round_trip").count() == 0
    nothing = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        nothing = stage(spark, nothing, DATA)
    assert nothing.count() == 0
