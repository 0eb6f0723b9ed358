"""Language identification by multilingual mixture inference.

A byte trigram model of words is fitted for each language of the labelled rows. For a document, expectation-maximisation
estimates the proportions of the languages that its words are drawn from, given each word's likelihood in each language.
Language sets are nested by estimated proportion, from one language to all; the set of the best penalised likelihood
(half a log count for each further proportion, as BIC has it) is selected. The prediction is its largest proportion.

The fit reads at most ``max_rows`` labelled rows: those with the smallest hash of their id, a sample that is bounded at
any size of the table. Every document is predicted from its whole text; only ids and n-gram counts of the sample are
gathered. Inputs of a prediction are the text alone.

Edge cases: ``und`` with score 0 for a text that is null or has no letter; a table without labelled rows predicts
``und`` for all; a null doc_id is predicted like any row and not held out; ties go to the language first in order; repeated rows repeat.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_and_text, map_batches, read_documents

MAX_ROWS = 20_000
WORD = regex.compile(r"\p{L}+")
EDGE = 0x5F  # an underscore stands at both ends of a word
ROUNDS = 25


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Trigram codes (24 bits) of all words, one for each byte and one for the end; where each word's begin."""
    raw = [w.encode() for w in words]
    flat = np.frombuffer(b"".join([b"__" + b + b"_" for b in raw]), dtype=np.uint8).astype(np.int64)
    size = np.fromiter(map(len, raw), np.int64, len(raw)) + 3
    ends = np.cumsum(size)
    code = (flat[:-2] << 16) | (flat[1:-1] << 8) | flat[2:]
    keep = np.ones(len(code), dtype=bool)
    keep[ends[:-1] - 2] = False  # trigrams across two words
    keep[ends[:-1] - 1] = False
    return code[keep], np.r_[0, np.cumsum(size - 2)[:-1]]


class LanguageModels:
    """Word likelihoods under a trigram model with bigram and unigram back-off for each language."""

    def __init__(self, languages: list[str], codes: np.ndarray, counts: np.ndarray):
        """codes: observed trigrams, ascending. counts: for each, the number in each language."""
        self.languages, self.codes = languages, codes
        n = len(languages)
        c1, c2 = np.zeros((256, n)), np.zeros((1 << 16, n))
        np.add.at(c1, codes & 0xFF, counts)
        np.add.at(c2, codes & 0xFFFF, counts)
        ctx2 = np.zeros((1 << 16, n))
        np.add.at(ctx2, codes >> 8, counts)
        ctx1 = np.zeros((256, n))
        np.add.at(ctx1, (codes >> 8) & 0xFF, counts)
        p1 = (c1 + 0.05) / (c1.sum(axis=0) + 0.05 * 256)
        last = np.arange(1 << 16)
        p2 = (c2 + 2.0 * p1[last & 0xFF]) / (ctx1[last >> 8] + 2.0)
        p3 = (counts + 2.0 * p2[codes & 0xFFFF]) / (ctx2[codes >> 8] + 2.0)
        self.seen = np.log(p3)
        lone = 2.0 / (ctx2 + 2.0)
        self.back, self.lone = np.log(p2), np.log(lone)
        self.known: dict[str, int] = {}
        self.table = np.zeros((0, n))

    def log_likelihood(self, words: list[str]) -> np.ndarray:
        code, start = grams(words)
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        hit = self.codes[at] == code
        logp = np.where(hit[:, None], self.seen[at], self.back[code & 0xFFFF] + self.lone[code >> 8])
        return np.add.reduceat(logp, start, axis=0)

    def rows_of(self, words: set[str]) -> None:
        if len(self.known) > 150_000:
            self.known, self.table = {}, self.table[:0]
        fresh = [w for w in words if w not in self.known]
        if fresh:
            self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh)), strict=True))
            parts = [self.log_likelihood(fresh[k : k + 50_000]) for k in range(0, len(fresh), 50_000)]
            self.table = np.concatenate([self.table, *parts])

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        counted = [Counter(WORD.findall(t.lower())) for t in texts]
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        rows = [i for i, c in enumerate(counted) if c]
        if not rows or not self.languages:
            return out
        self.rows_of(set().union(*(counted[i] for i in rows)))
        known = self.known
        size = np.array([len(counted[i]) for i in rows])
        word = np.fromiter((known[w] for i in rows for w in counted[i]), np.int64, size.sum())
        weight = np.concatenate([np.fromiter(counted[i].values(), np.float64, len(counted[i])) for i in rows])
        logp = self.table[word]
        share, pick = self.infer(logp - logp.max(axis=1, keepdims=True), weight, size)
        for k, i in enumerate(rows):
            out[i] = (self.languages[pick[k]], float(share[k, pick[k]]))
        return out

    @staticmethod
    def infer(logp: np.ndarray, weight: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Proportions in the selected set, and the largest, of documents that have ``size`` distinct words each."""
        n, start, total = logp.shape[1], np.r_[0, np.cumsum(size)[:-1]], None
        like = np.exp(logp)
        total = np.add.reduceat(weight, start)

        def em(allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            share = allowed / allowed.sum(axis=1, keepdims=True)
            for step in range(ROUNDS + 1):
                mix = like * np.repeat(share, size, axis=0)
                norm = np.maximum(mix.sum(axis=1), 1e-300)
                if step == ROUNDS:
                    return share, np.add.reduceat(weight * np.log(norm), start)
                new = np.add.reduceat(mix * (weight / norm)[:, None], start, axis=0) / total[:, None]
                if np.abs(new - share).max() < 1e-4:
                    return new, np.add.reduceat(weight * np.log(norm), start)
                share = new

        share, value = em(np.ones((len(size), n)))
        rank = np.argsort(np.argsort(-share, axis=1, kind="stable"), axis=1, kind="stable")
        best, best_value = share, value - 0.5 * (n - 1) * np.log(np.maximum(total, 2))
        for k in range(n - 1, 0, -1):
            part, value = em((rank < k).astype(float))
            value = value - 0.5 * (k - 1) * np.log(np.maximum(total, 2))
            better = value >= best_value
            best, best_value = np.where(better[:, None], part, best), np.where(better, value, best_value)
        return best, np.argmax(best, axis=1)


def fit_languages(labelled: DataFrame, max_rows: int = MAX_ROWS) -> LanguageModels:
    """Models from rows (doc_id, text, lang) that have a text and a lang."""
    rows = labelled.where("text is not null and lang is not null")
    # ids are few and small: at most max_rows of them, so the join is a broadcast of bounded size
    chosen = rows.select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(max_rows).select("doc_id").distinct()
    sample = rows.join(F.broadcast(chosen), "doc_id").select("lang", "text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        langs, codes, counts = [], [], []
        texts: dict[str, Counter] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            texts.setdefault(lang, Counter()).update(WORD.findall(text.lower()))
        for lang, words in texts.items():
            if words:
                code, start = grams(list(words))
                weight = np.repeat(np.fromiter(words.values(), np.int64, len(words)), np.diff(np.r_[start, len(code)]))
                own, at = np.unique(code, return_inverse=True)
                codes.append(own)
                counts.append(np.bincount(at, weights=weight).astype(np.int64))
                langs += [lang] * len(own)
        if not langs:
            return None
        return pa.record_batch([pa.array(langs), pa.array(np.concatenate(codes)), pa.array(np.concatenate(counts))], ["lang", "code", "n"])

    # at most one row for each language and trigram code (24 bits, in practice a few ten thousand): bounded by alphabet
    got = map_batches(sample, "lang string, code bigint, n bigint", run).groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(set(got["lang"]))
    codes, at = np.unique(got["code"].to_numpy(dtype=np.int64), return_inverse=True)
    counts = np.zeros((len(codes), len(languages)))
    np.add.at(counts, (at, got["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(dtype=np.int64)), got["n"].to_numpy(dtype=float))
    return LanguageModels(languages, codes, counts)


def predict_texts(models: LanguageModels, texts: list[str], limit: int = 1_000_000) -> list[tuple[str, float]]:
    """(language, share) of each text, about ``limit`` characters at once."""
    got, at = [], 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and size < limit:
            size += len(texts[end])
            end += 1
        got += models.predict(texts[at:end])
        at = end
    return got


def predict_languages(docs: DataFrame, models: LanguageModels) -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = predict_texts(shared.value, batch.column(1).to_pylist())
        return pa.record_batch([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    return map_batches(id_and_text(docs), "doc_id bigint, lang_pred string, score double", run)


def keep_documents(docs: DataFrame, models: LanguageModels, min_score: float) -> DataFrame:
    """The rows of ``docs``, all columns, that have a language with a share of at least ``min_score``."""
    shared = docs.sparkSession.sparkContext.broadcast(models)
    at = docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = predict_texts(shared.value, [t or "" for t in batch.column(at).to_pylist()])
        return batch.filter(pa.array([lang != "und" and score >= min_score for lang, score in got], pa.bool_()))

    return map_batches(docs, docs.schema, run)


def held_out():
    """Whether a row is held out of the fit; a null doc_id is not."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    models = fit_languages(docs.where(~held_out()).select("doc_id", "text", "lang"))
    return predict_languages(docs, models).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
