"""Queries of the training-data operators over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coffer.llm import decontam, divergence, langid, licenses, line_dedup, minhash, ngram_join, passages, pieces, pii, spelling, token_store, topk
from coffer.llm.store import Scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """The place of a public tokenizer's file; operators take it as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.remove_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"), F.sha2("text", 256).alias("kept_sha256"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_personal_data(table(spark, sf_dir, "documents")))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_languages(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans", "items")


def op8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = token_store.write_tokens(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), Scratch(spark, "tokens"))
    return token_store.read_tokens(store)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_checked(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model")).drop("ids")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files are the documents, under source / thousand of doc_id / doc_id."""
    path = F.concat(F.col("source"), F.lit("/"), F.floor(F.col("doc_id") / 1000).cast("string"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), path.alias("path"), "text")
    return licenses.scan_licences(files).withColumnRenamed("file_id", "doc_id")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = [op1_line_dedup, op2_topk, op3_minhash, op4_substring, op5_pii, op6_langid, op7_decontamination, op8_tokens, op9_sentencepiece, op10_licenses]
    return {f.__name__: f for f in (*ops, op11_divergence, op12_spelling, op13_ngram_join, pipeline)}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def oracle_sql() -> dict[str, str]:
    fold = f"translate(text, '{_UPPER}', '{_LOWER}')"
    return {
        "op1_line_dedup": """
            with l as (select doc_id, string_split(text, chr(10)) as ls from documents where text is not null),
            g as (select doc_id, unnest(range(1, len(ls) - 1)) as i, ls from l where len(ls) >= 3),
            r as (select doc_id, i, row_number() over (partition by ls[i], ls[i + 1], ls[i + 2] order by doc_id, i) as rn from g),
            gone as (select distinct doc_id, i + k as i from r, (values (0), (1), (2)) t(k) where rn > 1),
            each_line as (select doc_id, unnest(range(1, len(ls) + 1)) as i, unnest(ls) as line from l),
            kept as (select e.doc_id, count(*) as n_lines, count(x.i) as n_removed, coalesce(string_agg(e.line, chr(10) order by e.i) filter (where x.i is null), '') as t
                     from each_line e left join gone x on e.doc_id = x.doc_id and e.i = x.i group by e.doc_id)
            select doc_id, n_lines, n_removed, sha256(t) as kept_sha256 from kept""",
        "op2_topk": """
            with v as (select vec_id, [cast(floor(64 * cast(e as double)) as bigint) for e in embedding] as x from embeddings),
            s as (select q.vec_id as query_id, c.vec_id, cast(list_sum([q.x[i] * c.x[i] for i in range(1, len(q.x) + 1)]) as bigint) as score
                  from v q, v c where q.vec_id % 20 = 0 and q.vec_id <> c.vec_id),
            r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s)
            select query_id, rank, vec_id, score from r where rank <= 20""",
        "op3_minhash": f"""
            with recursive w as (select doc_id, regexp_extract_all(coalesce({fold}, ''), '[^\\x20\\x09-\\x0D]+') as ws from documents),
            s as (select distinct doc_id, case when len(ws) < 5 then array_to_string(ws, ' ') else array_to_string(ws[k:k + 4], ' ') end as g
                  from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) as k from w where len(ws) > 0)),
            n as (select doc_id, count(*) as n from s group by doc_id),
            p as (select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
            e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared >= 75 * (x.n + y.n - shared)),
            e2 as (select a, b from e union all select b, a from e),
            reach(a, b) as (select doc_id, doc_id from documents union select r.a, e2.b from reach r join e2 on e2.a = r.b),
            c as (select a as doc_id, min(b) as component_id from reach group by a)
            select c.doc_id, coalesce(n.n, 0) as n_shingles, component_id, c.doc_id = component_id as kept from c left join n on n.doc_id = c.doc_id""",
        "op7_decontamination": f"""
            with dw as (select doc_id, regexp_extract_all(coalesce({fold}, ''), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as ws from documents),
            bw as (select item_id, regexp_extract_all(coalesce({fold}, ''), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as ws from benchmark),
            bp as (select distinct item_id, ws[k:k + 12] as g, len(ws[k:k + 12]) as m from (select item_id, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) as k from bw where len(ws) > 0)),
            dp as (select doc_id, k, ws[k:k + m - 1] as g, m from (select doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) as k from dw, (select distinct m from bp) where len(ws) >= m)),
            hit as (select doc_id, k, dp.m, item_id from dp join bp on dp.m = bp.m and dp.g = bp.g),
            words as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(k, k + m)) as j from hit) group by doc_id),
            items as (select doc_id, count(*) as n_items, string_agg(i, ',' order by i) as t from (select distinct doc_id, cast(item_id as varchar) as i from hit) group by doc_id)
            select dw.doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(t, '')) as items_sha256,
                   coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated
            from dw left join words using (doc_id) left join items using (doc_id)""",
        "op11_divergence": f"""
            with d as (select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source,
                              regexp_extract_all(coalesce({fold}, ''), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as ws from documents),
            t as (select id, lang, source, term, count(*) as n from (select id, lang, source, unnest(ws) as term from d) group by all),
            c as (select lang, source, term, sum(n) as n, count(*) as docs from t group by all),
            k as (select lang, term, sum(n) as n from c group by all having sum(docs) >= 3),
            l as (select lang, sum(n) as total, count(*) as v from k group by lang),
            u as (select c.lang, c.source, c.term, c.n from c join k using (lang, term)),
            g as (select d.lang, d.source, coalesce(any_value(s.total), 0) as total from d left join (select lang, source, sum(n) as total from u group by all) s using (lang, source) group by all),
            p as (select g.lang, g.source, k.term, coalesce(u.n, 0) as n, 1 + (1000000000 * (coalesce(u.n, 0) + 1)) // (g.total + l.v) as p, 1 + (1000000000 * (k.n + 1)) // (l.total + l.v) as q
                  from g join l using (lang) join k using (lang) left join u using (lang, source, term)),
            f as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
            r as (select a.lang, a.source, 'pair' as part, b.source as item, cast(coalesce(f.value, 0) as bigint) as value
                  from g a join g b on a.lang = b.lang and a.source <> b.source left join f on f.lang = a.lang and f.source = a.source and f.item = b.source
                  union all select lang, source, 'term', term, cast(((p - q) * (p - q)) // q as bigint) from p where n > 0 and p > q),
            o as (select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as integer) as rank from r)
            select lang, source, part, item, value, rank from o where part = 'pair' or rank <= 200""",
        "op12_spelling": f"""
            with recursive tab as (select list(c order by i) as t from (select i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: if(c & 1 = 1, xor(c >> 1, 3988292384), c >> 1)) as c from range(256) r(i))),
            run as (select doc_id, run, count(*) as n from (select doc_id, unnest(regexp_extract_all(coalesce({fold}, ''), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) as run from documents) where length(run) >= 7 group by all),
            code as (select doc_id, run, n, hex(encode(doc_id || ':' || run)) as s from run),
            crc as (select doc_id, run, n, xor(4294967295, list_reduce(list_prepend(4294967295, [cast('0x' || substr(s, 2 * i + 1, 2) as bigint) for i in range(length(s) // 2)]),
                           lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) as h from code, tab),
            w as (select case when h % 31 = 0 then left(run, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, n from crc),
            v as (select word, cast(sum(n) as bigint) as n from w where length(word) >= 7 group by word having sum(n) >= 2),
            cut as (select word, i, left(word, i - 1) || substr(word, i + 1) as rest from (select word, unnest(range(1, length(word) + 1)) as i from v)),
            near as (select a.word, b.word as other from cut a join cut b on a.i = b.i and a.rest = b.rest and a.word <> b.word
                     union select cut.word, v.word from cut join v on cut.rest = v.word union select v.word, cut.word from cut join v on cut.rest = v.word),
            best as (select near.word, count(*) as n_near, first(near.other order by v.n desc, near.other) as form, max(v.n) as form_n from near join v on v.word = near.other group by near.word),
            led as (select v.word, v.n, coalesce(n_near, 0) as n_near, case when form_n >= 10 * v.n then form end as form, case when form_n >= 10 * v.n then form_n end as form_n from v left join best using (word)),
            path(word, here, k) as (select word, word, 0 from led union all select path.word, led.form, k + 1 from path join led on led.word = path.here where led.form is not null)
            select word, form, root, n, n_near, form_n from led join (select word, max_by(here, k) as root from path group by word) using (word)""",
        "op13_ngram_join": f"""
            with recursive w as (select doc_id, regexp_extract_all(coalesce({fold}, ''), '[^\\x20\\x09-\\x0D]+') as ws from documents),
            s as (select distinct doc_id, case when len(ws) < 3 then array_to_string(ws, ' ') else array_to_string(ws[k:k + 2], ' ') end as g
                  from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) as k from w where len(ws) > 0)),
            n as (select doc_id, count(*) as n from s group by doc_id),
            p as (select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
            e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared >= 90 * (x.n + y.n - shared)),
            e2 as (select a, b from e union all select b, a from e),
            reach(a, b) as (select doc_id, doc_id from documents union select r.a, e2.b from reach r join e2 on e2.a = r.b),
            c as (select a as doc_id, min(b) as component_id from reach group by a)
            select c.doc_id, coalesce(n.n, 0) as n_shingles, component_id from c left join n on n.doc_id = c.doc_id""",
    }
