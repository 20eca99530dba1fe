"""Source divergence, spelling variants and the n-gram join on edge cases, planted cases and against plain Python."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from coffer.llm import divergence, minhash, ngram_join, passages, spelling, store
from coffer.llm.components import components
from coffer.llm.store import Scratch


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


def clashing(df):
    return df.withColumns({c: F.lit(f"clash {c}") for c in ("n", "rep", "key", "pos", "term", "item", "word", "value", "root", "band", "p", "q", "h1", "size")}).repartition(3)


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def divergence_by_hand(docs, least, top):
    terms = [(i, lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for i, (_, text, lang, source) in enumerate(docs)]
    groups, used = sorted({t[1:3] for t in terms}), defaultdict(set)
    for i, lang, _, words in terms:
        for w in words:
            used[lang, w].add(i)
    out = []
    for lang, source in groups:
        kept = [w for (k, w), d in used.items() if k == lang and len(d) >= least]

        def shares(of, lang=lang, kept=kept):
            c = Counter(w for _, k, s, words in terms if k == lang and of in (None, s) for w in words)
            total = sum(c[w] for w in kept)
            return c, {w: 1 + 10**9 * (c[w] + 1) // (total + len(kept)) for w in kept}

        (c, p), (_, q) = shares(source), shares(None)
        far = lambda a, b: (a - b) ** 2 // b
        pair = [(o, sum(far(p[w], x[w]) for w in kept)) for k, o in groups if k == lang and o != source for x in [shares(o)[1]]]
        term = [(w, far(p[w], q[w])) for w in kept if c[w] and p[w] > q[w]]
        for part, items, most in (("pair", pair, None), ("term", term, top)):
            items.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, value, k + 1) for k, (item, value) in enumerate(items[:most])]
    return sorted(out)


def test_divergence_equals_plain_python(spark, empty):
    rng = np.random.default_rng(5)
    words = [f"{a}{b}" for a in ("ab", "Ab", "abc", "é", "日本", "zz") for b in ("", "x", "xy", "ö", "q" * 9)]
    docs = [(k, " 1-".join(words[x] for x in rng.integers(0, len(words), rng.integers(0, 30)) // (1 + k % 3)), ["en", "de", None][k % 3], ["a", "b", "é", None][int(rng.integers(0, 4)) if k % 2 else 0]) for k in range(90)]
    docs += [(None, None, "en", "a"), (5, "", "xx", "a"), (5, "", "xx", "b"), (6, "only once", "yy", "c"), (7, "long " * 5000, "en", "b")]
    df = clashing(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"))
    for least, top in ((3, 200), (2, 4), (1, 1)):
        assert sorted(rows_of(divergence.divergence(df, least, top))) == divergence_by_hand(docs, least, top)
    assert divergence.divergence(empty).count() == 0


def test_divergence_threshold_with_ties_of_long_common_beginnings(spark):
    """Ties at the threshold are told apart by bytes far into the item, as one item is the beginning of another."""
    rng = np.random.default_rng(6)
    rows = [("l", s, "c" * int(k) + t, int(v)) for s in ("s", "t") for k in range(12) for t in ("", "é", "z", "日") for v in [rng.choice([0, 7, 2**40, 2**62])]]
    df = spark.createDataFrame(rows, "lang string, source string, item string, value long").repartition(4)
    for top in (1, 5, 17, 47, 48, 100):
        got = {(r["source"], r["item"]) for r in divergence._leading(df, top, Scratch(spark, "t")).collect()}
        assert got == {(r[1], r[2]) for s in ("s", "t") for r in sorted((r for r in rows if r[1] == s), key=lambda r: (-r[3], r[2].encode()))[:top]}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def variants_by_hand(docs, ratio=10):
    n = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{doc}:{run}".encode())
            if doc is not None and h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    by = {w: sorted((x for x in n if near(w, x)), key=lambda x: (-n[x], x)) for w in n}
    form = {w: x[0] if x and n[x[0]] >= ratio * n[w] else None for w, x in by.items()}

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w], root(w), n[w], len(by[w]), n[form[w]] if form[w] else None) for w in n)


def test_spelling_equals_plain_python(spark, empty):
    rng = np.random.default_rng(7)
    docs = []
    for k in range(300):
        base = "".join(rng.choice(list("abÉé"), 7))
        docs.append((k, " ".join([base] * int(rng.choice([1, 2, 25])) + [base[:3] + "b" + base[3:]] * 2 + ["Wonderful"] * 12)))
    docs += [(None, "wonderful Wonderful wanderful wanderful"), (1, None), (2, ""), (3, "z" * 30000 + " " + "z" * 30000 + " " + "z" * 29999 + " " + "z" * 29999), (4, "chain " + "chainings " * 2 + "chainingz " * 20 + "chainingzz " * 200)]
    df = clashing(spark.createDataFrame(docs, "doc_id long, text string"))
    want = variants_by_hand(docs)
    assert sorted(rows_of(spelling.spelling_variants(df)), key=str) == sorted(want, key=str)
    assert any(w[2] not in (w[0], w[1]) for w in want)  # a path of two steps
    assert spelling.spelling_variants(empty).count() == 0


@pytest.mark.parametrize("most", [1, 30, 4096])
def test_near_words_however_often_gaps_are_cut(spark, most):
    rng = np.random.default_rng(8)
    words = sorted({"".join(rng.choice(list("abc"), rng.integers(1, 8))) for _ in range(250)} | {"inter" + "".join(rng.choice(list("xyz"), 4)) for _ in range(60)})
    got = spelling.near_pairs(spark.createDataFrame([(w,) for w in words], "word string"), Scratch(spark, "t"), most)
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len(set(got)) and {frozenset(p) for p in got} == {frozenset((a, b)) for a in words for b in words if near(a, b)}


def similar_by_hand(rows):
    sets = []
    for doc, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append((doc, {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set()))
    parent = list(range(len(sets)))

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for i, (a, x) in enumerate(sets):
        for j, (b, y) in enumerate(sets[:i]):
            if a is not None and b is not None and x and y and (a == b or 100 * len(x & y) >= 90 * len(x | y)):
                parent[find(i)] = find(j)
    least = {}
    for i, (a, _) in enumerate(sets):
        if a is not None:
            least[find(i)] = min(a, least.get(find(i), a))
    return sorted(((a, len(x), None if a is None else least[find(i)]) for i, (a, x) in enumerate(sets)), key=str)


def check_similar(spark, rows, df=None):
    df = df or spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(rows_of(ngram_join.similar_documents(df)), key=str) == similar_by_hand(rows)


def test_ngram_join_edge_cases(spark, empty):
    a = " ".join(f"w{k}" for k in range(120))
    rows = [(1, a), (2, a.upper()), (3, a + " x"), (4, a.replace("w60", "y")), (5, None), (6, ""), (7, " \n"), (8, "one"), (9, "One"), (10, "one two"), (None, a), (4, "another text of the same id"), (11, "Another text of the same  id")]
    rows += [(20, "z" * 30000), (21, " ".join(f"v{k}" for k in range(6000))), (22, " ".join(f"v{k}" for k in range(5800)))]
    check_similar(spark, rows, clashing(spark.createDataFrame(rows, "doc_id long, text string")))
    assert ngram_join.similar_documents(empty).count() == 0


def test_ngram_join_of_crowds(spark, monkeypatch):
    """Clouds of near copies about the threshold, hot passages, and sizes across bands; also with tiny lists, so that all rounds run."""
    rng = np.random.default_rng(9)
    rows = []
    for cloud in range(4):
        base = [f"c{cloud}w{k}" for k in range((40, 66, 130, 260)[cloud])]
        for k in range(60):
            t = list(base)
            for _ in range(rng.integers(0, 1 + len(base) // 20)):
                t[rng.integers(0, len(t))] = f"e{rng.integers(0, 40 if k % 2 else 10**6)}"
            rows.append((1000 * cloud + k, " ".join(t[: len(t) - int(rng.integers(0, 4))])))
    hot = [f"h{k}" for k in range(50)]
    rows += [(9000 + k, " ".join(hot + [f"own{k}x{j}" for j in range(k % 12)])) for k in range(60)]
    check_similar(spark, rows)
    for name, value in (("SHORT", 2), ("SPREAD", 4), ("FREQUENT", 3)):
        monkeypatch.setattr(ngram_join, name, value)
    check_similar(spark, rows)


def test_ngram_join_crowded_pairs_are_made_once(spark, monkeypatch):
    """Members that share many lists meet once; with fewer lists than they have told, in each, and never less often than list by list."""
    rows = [(k, 100 + k % 3, key, 95 + (k + key) % 9, 40, k % 7) for k in range(40) for key in range(12) if (k * key) % 5]
    lists = spark.createDataFrame(rows, "rep long, n long, key long, room int, size long, root long")
    every = "rep < b and root <> broot"
    for centres, which in ((lists, every), (ngram_join._centres(lists, 8), "root <> broot")):
        plain, once = rows_of(ngram_join._pairs(lists, centres, which)), rows_of(ngram_join._pairs_once(lists, centres, which))
        assert set(plain) <= set(once) and len(plain) > 2 * len(set(plain))
        assert len(once) <= (1 if which == every else 2) * len(set(once))
    monkeypatch.setattr(ngram_join, "MOST_KEYS", 3)
    assert set(rows_of(ngram_join._pairs(lists, lists, every))) <= set(rows_of(ngram_join._pairs_once(lists, lists, every)))


def shuffles(monkeypatch):
    """The number of shuffles by which each table is made that is written from now on."""
    made, keep = [], Scratch.keep

    def counted(self, df, label="t", options=None):
        plan = df._jdf.queryExecution().executedPlan().toString()
        made.append((label, plan.count("Exchange hashpartitioning") - plan.count("ReusedExchange")))
        return keep(self, df, label, options)

    monkeypatch.setattr(Scratch, "keep", counted)
    return made


def test_components_of_small_tables_shuffle_once_a_table(spark, monkeypatch):
    """Paths, stars, doubled edges and loops against plain Python. Joins with small tables take no shuffle."""
    monkeypatch.setattr(store, "SMALL", 2 << 20)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rng = np.random.default_rng(3)
        edges = [(k, k + 1) for k in range(100, 140)] + [(200, k) for k in range(201, 240)] + [(7, 7)] + [tuple(map(int, rng.integers(300, 400, 2))) for _ in range(60)]
        edges += edges[:20]
        least = {x: x for e in edges if e[0] != e[1] for x in e}
        for _ in edges:
            for a, b in edges:
                if a != b:
                    least[a] = least[b] = min(least[a], least[b])
        scratch = Scratch(spark, "t")
        table = scratch.keep(spark.createDataFrame(edges, "a long, b long"), "links")
        made = shuffles(monkeypatch)
        assert sorted(rows_of(components(table, scratch))) == sorted(least.items())
        assert len(made) > 2 and max(n for _, n in made) == 1
        monkeypatch.setattr(store, "SMALL", 0)
        assert sorted(rows_of(components(table, scratch))) == sorted(least.items())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_ngram_join_crowded_rounds_read_each_text_once(spark, monkeypatch):
    """All rounds after the frequency index take their sets from one table and need few shuffles; results as by hand."""
    rows = []
    rng = np.random.default_rng(11)
    for k in range(50):
        t = [f"w{j}" for j in range(66)]
        for _ in range(rng.integers(0, 5)):
            t[rng.integers(0, 66)] = f"e{rng.integers(0, 40)}"
        rows.append((k, " ".join(t)))
    for name, value in (("SHORT", 2), ("SPREAD", 4), ("FREQUENT", 3)):
        monkeypatch.setattr(ngram_join, name, value)
    made = shuffles(monkeypatch)
    check_similar(spark, rows)
    labels = [label for label, _ in made]
    assert labels.count("pairs") > 1 and labels.count("sets") == 2 and labels.count("possible") == 1


def test_ngram_join_hot_passage_makes_no_pairs(spark, monkeypatch):
    """Members of long lists that differ too much are told apart by their bitmaps in the join, before a pair is written."""
    rows = [(k, " ".join([f"h{j}" for j in range(40)] + [f"own{k}x{j}" for j in range(40)])) for k in range(40)]
    counts, keep = [], Scratch.keep

    def counted(self, df, label="t", options=None):
        out = keep(self, df, label, options)
        if label in ("lists", "pairs"):
            counts.append((label, out.count()))
        return out

    monkeypatch.setattr(Scratch, "keep", counted)
    check_similar(spark, rows)
    assert counts[0][1] > 0 and counts[1] == ("pairs", 0)


def test_passages_are_verified_in_parts(spark, monkeypatch):
    """Pairs of more bytes than a part are verified part by part, and each part's regions go before the next; the rows are the same."""
    rows = [(k, " ".join([f"own{k}x{j}" for j in range(20)] + [f"p{k % 7}w{j}" for j in range(60)])) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    tables, keep = [], Scratch.keep

    def sized(self, df, label="t", options=None):
        out = keep(self, df, label, options)
        tables.append((label, out))
        return out

    monkeypatch.setattr(Scratch, "keep", sized)
    whole = sorted(rows_of(passages.repeated_passages(df)))
    assert len(whole) >= 53 and [label for label, _ in tables].count("regions") == 1
    monkeypatch.setattr(passages, "PART", next(t._coffer_bytes for label, t in tables if label == "pairs") // 2)
    tables.clear()
    assert sorted(rows_of(passages.repeated_passages(df))) == whole
    assert [label for label, _ in tables].count("regions") > 1


def test_passages_texts_are_read_for_few_parts_only(spark, monkeypatch):
    """However many bytes the pairs have, texts are read for a few parts; each has its regions once, and its pairs are verified in turns."""
    rows = [(k, " ".join([f"own{k}x{j}" for j in range(20)] + [f"p{k % 7}w{j}" for j in range(60)])) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = sorted(rows_of(passages.repeated_passages(df)))
    labels, keep = [], Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, d, label="t", options=None: labels.append(label) or keep(self, d, label, options))
    monkeypatch.setattr(passages, "PART", 100)
    monkeypatch.setattr(passages, "CARRIED", 1)
    assert sorted(rows_of(passages.repeated_passages(df))) == whole
    assert labels.count("regions") == 4 * labels.count("pairs") <= labels.count("checked")


def _plain_passages(a, b, shift):
    """(start, end, other start, other end, similarity) of runs of a that b repeats, and of exact runs on the diagonal that none of them holds."""
    first = {x: b.index(x) for x in set(b)}
    hits = [p for p, x in enumerate(a) if x in first]
    cuts = [0] + [i + 1 for i in range(len(hits) - 1) if hits[i + 1] - hits[i] > passages.GAP] + [len(hits)]
    todo, out, least = [hits[x:y] for x, y in zip(cuts, cuts[1:], strict=False) if y > x], [], passages.LEAST_WORDS - passages.SHINGLE + 1
    while todo:
        run = todo.pop()
        s, e, at = run[0], run[-1] + 1, [first[a[p]] for p in run]
        if e - s < least:
            continue
        p, q = set(a[s:e]), set(b[min(at) : max(at) + 1])
        similarity = len(p & q) / len(p | q)
        if similarity >= passages.SIMILARITY and max(at) + 1 - min(at) >= least:
            out.append((s, e, min(at), max(at) + 1, similarity))
        elif e - s > len(run):
            widest = max(range(len(run) - 1), key=lambda i: (run[i + 1] - run[i], -i))
            todo += [run[: widest + 1], run[widest + 1 :]]
    p = max(0, shift)
    while p < min(len(a), len(b) + shift):
        e = p
        while e < min(len(a), len(b) + shift) and a[e] == b[e - shift]:
            e += 1
        if e - p >= least and not any(y[0] <= p and e <= y[1] for y in out):
            out.append((p, e, p - shift, e - shift, 1.0))
        p = max(e, p + 1)
    return out


@pytest.mark.parametrize("at_once", [50, 3000, 1 << 20])
def test_passages_verification_equals_plain_python(monkeypatch, at_once):
    """Random edits, repeats, empty regions, slices of batches and places outside a region."""
    monkeypatch.setattr(passages, "_AT_ONCE", at_once)
    rng, rows, want = np.random.default_rng(9), [], []
    for i in range(400):
        size = int(rng.choice([4, 60, 1 << 40]))
        a = rng.integers(0, size, int(rng.integers(0, 300))).tolist()
        b = list(a)
        for _ in range(int(rng.integers(0, 9))):
            at, n = int(rng.integers(0, len(b) + 1)), int(rng.integers(1, 7))
            b[at : at + n * int(rng.integers(0, 2))] = rng.integers(0, size, n * int(rng.integers(0, 2))).tolist()
        b = [] if i % 40 == 0 else b
        la, lb, off = (int(x) for x in rng.integers([0, 0, -2], [50, 50, 3]))
        members = [{"c": la + int(rng.integers(0, len(a) + 3)), "key": int(k)} for k in range(rng.integers(0, 5))]
        rows.append({"a": 1000 + i, "b": i, "la": la, "lb": lb, "diagonal": la - lb + off, "hashes": 1, "members": members, "da": passages._packed(np.array(a, np.uint64)), "db": passages._packed(np.array(b, np.uint64))})
        found = _plain_passages(a, b, off)
        want += [(1000 + i, la + s, la + e + 4, i, lb + s2, lb + e2 + 4, x, 1, None) for s, e, s2, e2, x in found]
        want += [(1000 + i, m["c"], None, i, m["c"] - la + lb - off, None, None, None, m["key"]) for m in members if not any(x[0] <= m["c"] - la < x[1] for x in found)]
    kinds = [("a", pa.int64()), ("b", pa.int64()), ("la", pa.int32()), ("lb", pa.int32()), ("diagonal", pa.int32()), ("hashes", pa.int32())]
    kinds += [("members", pa.list_(pa.struct([("c", pa.int32()), ("key", pa.int64())]))), ("da", pa.binary()), ("db", pa.binary())]
    batch = pa.RecordBatch.from_pylist(rows, pa.schema(kinds))
    got = [tuple(r.values()) for x in passages._verify(iter([batch.slice(0, 150), batch.slice(150, 0), batch.slice(150)])) for r in x.to_pylist()]
    assert sum(x[8] is None for x in want) > 50 and sorted(got, key=str) == sorted(want, key=str)


def _left_over(monkeypatch, run):
    """The result's rows, and the labels of the tables that are still there."""
    there, keep, drop = {}, Scratch.keep, Scratch.drop

    def kept(self, df, label="t", options=None):
        out = keep(self, df, label, options)
        there[out._coffer_path] = label
        return out

    monkeypatch.setattr(Scratch, "keep", kept)
    monkeypatch.setattr(Scratch, "drop", lambda self, df: (there.pop(df._coffer_path), drop(self, df)))
    rows = sorted(rows_of(run()))
    return rows, list(there.values())


def _cloud():
    rng, rows = np.random.default_rng(11), []
    for k in range(50):
        t = [f"w{j}" for j in range(66)]
        for _ in range(rng.integers(0, 5)):
            t[rng.integers(0, 66)] = f"e{rng.integers(0, 40)}"
        rows.append((k, " ".join(t)))
    return rows


def test_near_duplicates_keep_no_used_tables(spark, monkeypatch):
    """Signatures, posts, lists and sets go once they are used; the rows are the same if keys are too many to be broadcast."""
    monkeypatch.setattr(minhash, "SPREAD", 4)
    df = spark.createDataFrame(_cloud(), "doc_id long, text string")
    rows, left = _left_over(monkeypatch, lambda: minhash.near_duplicates(df))
    assert len(rows) == 50 and not {"features", "common", "posts", "scarce", "links", "crowd", "between"} & {*left}
    monkeypatch.setattr(store, "KEYS", 0)
    assert sorted(rows_of(minhash.near_duplicates(df))) == rows


def test_ngram_join_keeps_no_used_tables(spark, monkeypatch):
    """As above for the n-gram join."""
    for name, value in (("SHORT", 2), ("SPREAD", 4), ("FREQUENT", 3)):
        monkeypatch.setattr(ngram_join, name, value)
    df = spark.createDataFrame(_cloud(), "doc_id long, text string")
    rows, left = _left_over(monkeypatch, lambda: ngram_join.similar_documents(df))
    assert len(rows) == 50 and not {"features", "classes", "common", "prefixes", "combinations", "sizes", "folded", "possible", "wanted", "tokens", "shared", "posts", "spans", "open", "links"} & {*left}
    monkeypatch.setattr(store, "KEYS", 0)
    assert sorted(rows_of(ngram_join.similar_documents(df))) == rows
