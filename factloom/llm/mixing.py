"""Mixing to target weights with soft domain membership.

A classifier that is fitted on labelled rows predicts each document's posterior over domains. Every document then gets a
nonnegative rate so that the expected token totals of the domains, sum of rate x tokens x posterior, come close to their
targets in the least-squares sense. Projected gradient finds the rates: in each round Spark sums the expected totals, the
residual (one number a domain) goes back to the rows, and each row moves along its posterior and is projected to zero or
more. A row's rate depends on its posterior and on the residuals so far alone, so no rate is kept between rounds.
Rates start from ``prior`` x the token budget's share, and end as near to it as the targets allow. Steps are scaled by
tokens (a token counts the same in a long and a short document) and by the inverse Gram matrix of the rows that are not
held at zero, which makes a step of 1 the gradient step of that metric.

Every word of any length has log odds of each domain, those of its bucket among ``BUCKETS`` (CRC-32 of its bytes), so that
the model has one size whatever the texts. The fit reads at most ``max_rows`` labelled rows, those with the smallest hash
of their id. Labels: toxic rows are
domain ``toxic``, others ``good`` or ``plain`` by quality 1 or 0.

Edge cases: a null or empty text has no tokens and the posterior of no evidence; a null doc_id is predicted like any
row; without labelled rows every posterior is even; a domain that no labelled row is of has the posterior 0; an empty table gives an empty one; repeated rows repeat; a label
that is null counts as 0.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_and_text, map_batches, read_documents, stored, text_key

DOMAINS = ("good", "plain", "toxic")
#: Share of the token budget for each domain, and the budget as a share of all tokens.
TARGETS, BUDGET = {"good": 0.80, "plain": 0.18, "toxic": 0.02}, 0.6
MAX_ROWS, ROUNDS, TOLERANCE = 20_000, 40, 1e-5
#: Buckets of words (a power of two), and the labelled rows that must hold a word of a bucket before it has odds.
BUCKETS, LEAST_ROWS = 1 << 18, 3


def buckets_of(words: Iterable[str]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, map(str.encode, words)), np.int64) & (BUCKETS - 1)


def text_features(text: str, words: Counter) -> list[float]:
    """Shape of a text: length, case, marks, repeats."""
    n, chars = sum(words.values()), max(len(text), 1)
    sample = text
    upper = sum(map(str.isupper, words)) / max(len(words), 1)
    lines = sample.split("\n")
    return [np.log1p(n), upper, sum(sample.count(c) for c in "!?*&#$%") / chars, sum(sample.count(c) for c in "|{}[]<>=_/\\@") / chars, sum(sample.count(c) for c in "0123456789") / chars, len(words) / max(n, 1), max(words.values(), default=0) / max(n, 1), len(set(lines)) / len(lines), sample.count(" ") / chars, n / len(lines) / 20]


class DomainClassifier:
    """Softmax over the text's shape and its words' log odds of each domain (mean, most extreme few)."""

    def __init__(self, domains=DOMAINS):
        self.domains = domains
        self.odds, self.known_words = np.zeros((BUCKETS, len(domains)), np.float32), np.zeros(BUCKETS, bool)
        self.weights = None

    def features(self, text: str) -> np.ndarray:
        words = Counter(text.lower().split())
        at, times = buckets_of(words), np.fromiter(words.values(), float)
        found = self.known_words[at]
        k = len(self.domains)
        if not found.any():
            own = [0.0] * (3 * k)
        else:
            odds, times = self.odds[at[found]].astype(float), times[found]
            top = -np.sort(-odds, axis=0)[:3]
            own = [*(times @ odds / times.sum()), *top.max(axis=0), *(top.sum(axis=0) / 3)]
        return np.array([1.0, *text_features(text, words), *own])

    def weigh(self, counts: np.ndarray, buckets: np.ndarray, rows: np.ndarray) -> DomainClassifier:
        """Log odds of the words of each bucket. counts: rows of each domain that hold one, by bucket; rows: rows of each
        domain."""
        rows = np.maximum(rows.astype(float), 1)
        rate = (counts + 0.5) / (rows + 1)
        rest = (counts.sum(axis=1, keepdims=True) - counts + 0.5) / (rows.sum() - rows + 1)
        self.odds[buckets], self.known_words[buckets] = np.log(rate / rest), True
        return self

    def fit(self, x: np.ndarray, labels: np.ndarray) -> DomainClassifier:
        """Softmax weights from the features of labelled rows."""
        k = len(self.domains)
        y = np.eye(k)[labels]
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        self.mean[0], self.scale[0] = 0.0, 1.0
        x = (x - self.mean) / self.scale
        w, m, v = np.zeros((x.shape[1], k)), 0.0, 0.0
        for step in range(1, 401):
            z = x @ w
            p = np.exp(z - z.max(axis=1, keepdims=True))
            g = x.T @ (p / p.sum(axis=1, keepdims=True) - y) / len(x) + 1e-4 * w
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w -= 0.05 * m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        self.weights, self.known = w, y.any(axis=0)
        return self

    def posterior(self, text: str) -> np.ndarray:
        if self.weights is None:
            return np.full(len(self.domains), 1 / len(self.domains))
        z = np.clip((self.features(text) - self.mean) / self.scale, -8, 8) @ self.weights
        p = np.where(self.known, np.exp(z - z[self.known].max()), 0.0)
        return p / p.sum()


def word_rows(rows: DataFrame) -> DataFrame:
    """(bucket, n0, n1, ...: rows of each domain that hold a word of the bucket) over rows (text, domain)."""
    k = len(DOMAINS)

    def run(batches):
        counts = np.zeros((BUCKETS, k), np.int64)
        for batch in batches:
            for text, domain in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[np.unique(buckets_of(set(text.lower().split()))), domain] += 1
        at = np.flatnonzero(counts.any(axis=1))
        yield pa.record_batch([pa.array(at), *(pa.array(counts[at, i]) for i in range(k))], ["bucket", *(f"n{i}" for i in range(k))])

    found = rows.select("text", "domain").mapInArrow(run, ", ".join(["bucket bigint", *(f"n{i} bigint" for i in range(k))]))
    return found.groupBy("bucket").agg(*(F.sum(f"n{i}").alias(f"n{i}") for i in range(k)))


def fit_domains(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DomainClassifier:
    """The classifier of at most ``max_rows`` labelled ids, one text each. Word odds come from one half of them, weights
    from the other; the driver gets the counts of at most ``BUCKETS`` buckets and a row of features for each id, and no text."""
    rows = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("quality").alias("quality"))
    domain = F.when(F.col("toxic") == 1, 2).otherwise(F.when(F.col("quality") == 1, 0).otherwise(1))
    # at most max_rows ids: a broadcast of bounded size
    chosen = rows.select("doc_id", domain.alias("domain")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    found = id_and_text(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "domain").agg(F.min("text").alias("text"))
    sample = stored(found.withColumn("half", F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2))), "labelled")
    model, k = DomainClassifier(), len(DOMAINS)
    sizes = np.zeros(k)
    for r in sample.where("half = 0").groupBy("domain").count().collect():
        sizes[r["domain"]] = r["count"]
    # at most BUCKETS rows of four numbers
    counted = word_rows(sample.where("half = 0")).where(" + ".join(f"n{i}" for i in range(k)) + f" >= {LEAST_ROWS}").toArrow()
    model.weigh(np.stack([counted[f"n{i}"].to_numpy().astype(float) for i in range(k)], axis=1), counted["bucket"].to_numpy(), sizes)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = [shared.value.features(t).tolist() for t in batch.column(2).to_pylist()]
        return pa.record_batch([batch.column(0), batch.column(1), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "domain", "x"])

    got = sorted(map(tuple, map_batches(sample.where("half = 1").select("doc_id", "domain", "text"), "doc_id bigint, domain int, x array<double>", run).collect()))
    shared.destroy()
    return model.fit(np.array([g[2] for g in got]), np.array([g[1] for g in got])) if got else model


def posteriors(docs: DataFrame, model: DomainClassifier) -> DataFrame:
    """(doc_id, n_tokens, p array<double>, x: key of the text) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        p = [shared.value.posterior(t) for t in texts]
        return pa.record_batch([batch.column(0), pa.array([len(t.split()) for t in texts], pa.int64()), pa.array([x.tolist() for x in p], pa.list_(pa.float64())), batch.column(2)], ["doc_id", "n_tokens", "p", "x"])

    return map_batches(id_and_text(docs).select("doc_id", "text", text_key().alias("x")), "doc_id bigint, n_tokens bigint, p array<double>, x binary", run)


def rates_of(p: np.ndarray, start: float, moves: np.ndarray) -> np.ndarray:
    """Rates after the rounds so far. moves: for each round the direction that the residual gave."""
    rate = np.full(len(p), start)
    for move in moves:
        rate = np.maximum(rate - p @ move, 0.0)
    return rate


def fit_rates(table: DataFrame, targets: np.ndarray, start: float, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """The moves of projected-gradient rounds over (n_tokens, p) that bring the expected totals to ``targets``, up to the
    round of the least squared residual, and the residual after them."""
    k = len(targets)

    def sums(moves: np.ndarray) -> np.ndarray:
        """Expected totals at the rates so far, and the Gram matrix of the rows whose rate is not held at zero."""

        def run(batches):
            total = np.zeros(k + k * k)
            for batch in batches:
                if batch.num_rows:
                    n = batch.column(0).to_numpy().astype(float)
                    p = batch.column(1).flatten().to_numpy().reshape(-1, k)
                    rate = rates_of(p, start, moves)
                    total[:k] += p.T @ (n * rate)
                    total[k:] += (p.T @ (p * (n * (rate > 0))[:, None])).ravel()
            yield pa.record_batch([pa.array(range(len(total)), pa.int32()), pa.array(total)], ["i", "v"])

        got = table.select("n_tokens", "p").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        out = np.zeros(k + k * k)
        for r in got:
            out[r["i"]] = r["v"]
        return out

    moves, best, least = np.zeros((0, k)), (np.inf, 0), -targets
    for _ in range(rounds + 1):
        found = sums(moves)
        residual, gram = found[:k] - targets, found[k:].reshape(k, k)
        if (size := float(residual @ residual)) < best[0]:
            best, least = (size, len(moves)), residual
        if np.sqrt(best[0]) <= tolerance * max(np.abs(targets).sum(), 1e-9) or len(moves) == rounds:
            break
        metric = np.linalg.inv(gram + np.eye(k) * max(np.trace(gram) * 1e-6, 1e-9))
        moves = np.vstack([moves, metric @ residual])
    return moves[: best[1]], least


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, budget: float = BUDGET, relative: bool = False) -> DataFrame:
    """doc_id, n_tokens, p_good, p_plain, p_toxic, rate, rounds, residual, x (key of the text) of every row; rounds and residual
    (the length of what the expected totals miss, in tokens) are those of the whole fit.

    ``targets`` share ``budget`` x all tokens among the domains; with ``relative`` they are factors of the tokens that
    each domain has, whatever the budget."""
    table = stored(posteriors(docs, fit_domains(docs, labels)), "posteriors")
    have = table.agg(F.sum("n_tokens").alias("n"), *[F.sum(F.col("n_tokens") * F.col("p")[i]).alias(d) for i, d in enumerate(DOMAINS)]).first()
    total = float(have["n"] or 0)
    goal = np.array([targets.get(d, 0.0) * ((have[d] or 0.0) if relative else budget * total) for d in DOMAINS])
    start = float(goal.sum() / total) if total else 0.0
    moves, missed = fit_rates(table, goal, start) if total else (np.zeros((0, len(DOMAINS))), goal)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = batch.column(2).flatten().to_numpy().reshape(-1, len(DOMAINS))
        return pa.record_batch([batch.column(0), batch.column(1), *(pa.array(p[:, i]) for i in range(len(DOMAINS))), pa.array(rates_of(p, start, moves)), batch.column(3)], ["doc_id", "n_tokens", *(f"p_{d}" for d in DOMAINS), "rate", "x"])

    made = map_batches(table, "doc_id bigint, n_tokens bigint, p_good double, p_plain double, p_toxic double, rate double, x binary", run)
    return made.select("*", F.lit(len(moves)).alias("rounds"), F.lit(float(np.linalg.norm(missed))).alias("residual"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("x")
