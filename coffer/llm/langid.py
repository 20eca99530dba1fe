"""Language identification by words first, then by ever shorter character n-grams.

Words are runs of letters (ASCII letters, A-Z lower-cased, and all characters beyond ASCII). A known
word scores its log frequency in each language. An unseen word backs off to its 5-grams; if the
model holds none of them, to 4-grams, and so on to single characters; what is found is averaged. A text's
score for a language is the sum over all its words; the result is the softmax over languages,
tempered beyond 50 words so that it stays a graded confidence.

The classifier is fitted on a bounded sample of labelled rows: about ``sample`` per language, picked by
a hash of doc_id; their texts count whole, and all their words and n-grams make the model, so its size is
bounded by the sample and does not grow with the corpus. It comes to the driver as Arrow columns and is
broadcast as sorted arrays. Each row is scored whole.

``keep_identified`` drops a text that is ``und``, scores below ``least``, or of whose words less than ``covered`` are
known or hold a known n-gram of three characters or more: a language without labelled rows, or gibberish.

Null text, or text without any letter: ``und`` with score 0. No labelled row: all are ``und``. Rows
whose doc_id is null are scored as others, held_out is null. Equal scores: the language of smaller name. Repeated
rows give a row each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coffer.llm.store import Scratch
from coffer.llm.textkernel import U64, Powers, Words, byte_class, chunks, mix, stream

LETTERS = byte_class((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
NGRAM = 5
SAMPLE = 8000
FOLDS = 5
SMOOTH = 0.5
MIN_SCORE = 0.3
MIN_COVERED = 0.5
#: The shortest n-gram that tells a language's words from others.
TELLING = 3
_SEEDS = stream(NGRAM + 1, 555)


class Grams:
    """Character n-grams of some words of a chunk."""

    def __init__(self, words: Words, pick: np.ndarray):
        s, e = words.start[pick], words.end[pick]
        size = e - s
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - s, size)
        own = np.repeat(np.arange(len(pick)), size)
        first_byte = (words.data[at] & 0xC0) != 0x80
        self.at, self.own = at[first_byte], own[first_byte]
        n = np.bincount(self.own, minlength=len(pick))
        self.bound = np.cumsum(n)[self.own]
        self.end = e[self.own]
        self.words = words

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(word, hash) of each n-gram."""
        after = np.arange(len(self.at)) + n
        ok = after <= self.bound
        last = np.where(after < self.bound, np.append(self.at, np.zeros(n, np.int64))[after], self.end)[ok]
        begin = self.at[ok]
        total, (_, down) = self.words.total, Powers.upto(len(self.words.data) + 1)
        return self.own[ok], mix((total[last] - total[begin]) * down[begin]) ^ _SEEDS[n]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in chunks(batches, "text"):
        words = Words(part.column(0), LETTERS)
        langs = np.array(part.column(1).to_pylist(), dtype=object)
        rows = words.rows()
        for lang in dict.fromkeys(langs):
            mine = np.flatnonzero((langs == lang)[rows])
            keys, first, n = np.unique(words.hash[mine], return_index=True, return_counts=True)
            out = [(0, keys, n)]
            grams = Grams(words, mine[first])
            for k in range(1, NGRAM + 1):
                own, h = grams.of(k)
                u, inverse = np.unique(h, return_inverse=True)
                out.append((k, u, np.bincount(inverse, weights=n[own], minlength=len(u)).astype(np.int64)))
            for kind, u, c in out:
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(u), pa.string()), pa.array(np.full(len(u), kind, np.int32)), pa.array(u.view(np.int64)), pa.array(c.astype(np.int64))], names=["lang", "kind", "key", "n"])


class Model:
    """Log frequencies by language of words (kind 0) and n-grams (kind n). ``rows``: arrays of kinds, numbers of languages,
    keys and counts, one entry for each that occurs."""

    def __init__(self, langs: list[str], kinds: np.ndarray, which: np.ndarray, keys: np.ndarray, counts: np.ndarray):
        self.langs = langs
        self.tables: list[tuple[np.ndarray, np.ndarray]] = []
        for kind in range(NGRAM + 1):
            mine = np.flatnonzero(kinds == kind)
            known, inverse = np.unique(keys[mine].view(U64), return_inverse=True)
            table = np.zeros((len(known), len(langs)))
            table[inverse, which[mine]] = counts[mine]
            types = int((table > 0).sum(0).max(initial=0))
            self.tables.append((known, np.log((table + SMOOTH) / (table.sum(0) + SMOOTH * (types + 1))).astype(np.float32)))

    def find(self, kind: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known, values = self.tables[kind]
        if len(known) == 0:
            return np.zeros(len(keys), bool), np.zeros((len(keys), len(self.langs)), np.float32)
        at = np.searchsorted(known, keys)
        at[at == len(known)] = 0
        return known[at] == keys, values[at]

    def words(self, words: Words, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of some words by language, and whether each is covered."""
        hit, out = self.find(0, words.hash[pick])
        out = np.where(hit[:, None], out, 0)
        covered = hit.copy()
        left = np.flatnonzero(~hit)
        for n in range(NGRAM, 0, -1):
            if len(left) == 0:
                break
            own, h = Grams(words, pick[left]).of(n)
            ok, values = self.find(n, h)
            own, values = own[ok], values[ok]
            count = np.bincount(own, minlength=len(left))
            mean = np.stack([np.bincount(own, weights=values[:, k], minlength=len(left)) for k in range(len(self.langs))], axis=1) / np.maximum(count, 1)[:, None]
            out[left] = mean
            covered[left] |= (count > 0) & (n >= TELLING)
            left = left[count == 0]
        return out, covered


def _scorer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for part in chunks(batches, "text"):
            words = Words(part.column(1), LETTERS)
            n_rows = part.num_rows
            pred, score, share = ["und"] * n_rows, np.zeros(n_rows), np.zeros(n_rows)
            n = words.counts()
            if len(words.hash) and model.langs:
                _, first, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
                (each, known), rows = model.words(words, first), words.rows()
                share = np.bincount(rows, weights=known[inverse], minlength=n_rows) / np.maximum(n, 1)
                total = np.stack([np.bincount(rows, weights=each[inverse, k], minlength=n_rows) for k in range(len(model.langs))], axis=1)
                total /= np.maximum(1, n / 50)[:, None]
                odds = np.exp(total - total.max(1, keepdims=True))
                odds /= odds.sum(1, keepdims=True)
                best = odds.argmax(1)
                letter = np.zeros(n_rows, dtype=bool)
                plain = np.concatenate([[0], np.cumsum(LETTERS[words.data] & (words.data < 0x80))])
                letter = plain[words.offsets[1:]] > plain[words.offsets[:-1]]
                for r in np.flatnonzero(~letter & (n > 0)):
                    letter[r] = any(c.isalpha() for c in part.column(1)[int(r)].as_py())
                for r in np.flatnonzero(letter):
                    pred[r], score[r] = model.langs[best[r]], odds[r, best[r]]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(pred, pa.string()), pa.array(score), pa.array(share)], names=["doc_id", "held_out", "lang_pred", "score", "covered"])

    return run


def keep_identified(documents: DataFrame, model: Model, least: float = MIN_SCORE, covered: float = MIN_COVERED) -> DataFrame:
    """The rows, with all their columns, whose language is identified."""
    score = _scorer(documents.sparkSession.sparkContext.broadcast(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            text = batch.column(batch.schema.get_field_index("text"))
            none = pa.nulls(batch.num_rows, pa.int64())
            three = pa.RecordBatch.from_arrays([none, text, pa.nulls(batch.num_rows, pa.bool_())], names=["doc_id", "text", "held_out"])
            keep: list[bool] = []
            for out in score(iter([three])):
                keep += [p != "und" and s >= least and c >= covered for p, s, c in zip(*(out.column(k).to_pylist() for k in (2, 3, 4)), strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return documents.mapInArrow(run, documents.schema)


def fit(documents: DataFrame, scratch: Scratch, sample: int = SAMPLE) -> Model:
    """The model from training rows: text and lang of those with a doc_id whose crc32 is not a multiple of five."""
    fold = F.crc32(F.col("doc_id").cast("string")) % FOLDS
    train = documents.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    train = train.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold != 0))
    sizes = {r["lang"]: r["count"] for r in train.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], *[np.zeros(0, np.int64)] * 4)
    per_lang = lambda values: F.create_map(*[F.lit(x) for pair in zip(langs, values, strict=True) for x in pair])[F.col("lang")]
    picked = train.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < per_lang([int((1 << 30) * min(1.0, sample / sizes[x])) for x in langs]))
    counted = picked.select("text", "lang").mapInArrow(_count, "lang string, kind int, key long, n long")
    counted = counted.select(per_lang(range(len(langs))).alias("lang"), "kind", "key", "n").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    counted = scratch.keep(counted, "counts")
    rows = counted.toArrow()
    scratch.drop(counted)
    lang, kind, key, n = (c.to_numpy() for c in rows.columns)
    return Model(langs, kind, lang, key, n)


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, covered (the share of covered words)."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    id_ = F.col("doc_id").cast("long")
    held_out = F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0
    rows = documents.select(id_.alias("doc_id"), F.col("text").cast("string").alias("text"), held_out.alias("held_out"))
    return rows.mapInArrow(_scorer(shared), "doc_id long, held_out boolean, lang_pred string, score double, covered double")


def predict_languages(documents: DataFrame) -> DataFrame:
    return identify(documents, fit(documents, Scratch(documents.sparkSession, "langid")))
