"""Calls of outside models: a token bucket, retries, batches. Models are injected; stand-ins are deterministic."""

from __future__ import annotations

import hashlib
import json
import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions.display import env_or


class TokenBucket:
    """At most ``per_minute`` calls a minute; a refusal pauses all of them. One bucket a Python worker: for a limit over
    the whole cluster, coalesce before the call and divide."""

    def __init__(self, per_minute: int = 60, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.capacity, self.tokens, self.clock, self.sleep = per_minute, float(per_minute), clock, sleep
        self.at, self.until, self.refusals = clock(), 0.0, 0

    def take(self) -> None:
        while True:
            now = self.clock()
            self.tokens = min(self.capacity, self.tokens + (now - self.at) * self.capacity / 60)
            self.at = now
            wait = max(self.until - now, 0.0 if self.tokens >= 1 else (1 - self.tokens) * 60 / self.capacity)
            if wait <= 0:
                self.tokens -= 1
                return
            self.sleep(wait)

    def refused(self, retry_after: float | None = None) -> None:
        self.refusals += 1
        pause = min((2 ** min(self.refusals, 6) if retry_after is None else retry_after) + random.random(), 60)
        self.until = max(self.until, self.clock() + pause)


def hashed_embedding(text: str, dim: int = 64) -> list[float]:
    """A stand-in for an embedding model: signed hashed words, unit length. No measure of meaning."""
    v = [0.0] * dim
    for word in text.lower().split():
        h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
        v[h % dim] += 1.0 if h >> 63 else -1.0
    n = sum(x * x for x in v) ** 0.5
    return [x / n for x in v] if n else v


def embedder(embed: Callable[[list[str]], list[list[float]]] | None = None, batch: int = 100) -> Callable[[Column], Column]:
    """A column function that embeds texts ``batch`` at a time."""
    model = embed or (lambda texts: [hashed_embedding(t) for t in texts])

    @pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            texts = part.fillna("").tolist()
            yield pd.Series([v for k in range(0, len(texts), batch) for v in model(texts[k : k + batch])], dtype=object)

    return run


def with_retries(call: Callable, attempts: int = 3, pause: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """``call`` tried anew after a failure, each pause twice the last; the last failure is raised."""

    def run(*args):
        for attempt in range(attempts):
            try:
                return call(*args)
            except Exception:  # noqa: BLE001 - whatever a client raises
                if attempt + 1 == attempts:
                    raise
                sleep(pause * 2**attempt)

    return run


class ExtractionError(Exception):
    """Neither a structured reply nor text that could be read."""


def extractor_of(structured: Callable[[str], tuple[list[dict], tuple[int, int]]], as_text: Callable[[str], tuple[str, tuple[int, int]]], prompt: str = "") -> Callable:
    """An extractor of pages from a model's two ways of answering: objects, and if that fails text that holds JSON."""

    def run(pages: list[tuple[int, str]]) -> tuple[list[dict], tuple[int, int]]:
        asked = prompt + "\n\n".join(f"--- PAGE {n} ---\n{t}" for n, t in pages)
        try:
            return structured(asked)
        except Exception as first:  # noqa: BLE001 - any failure falls back to text
            said, used = as_text(asked)
            try:
                found = json.loads(said[said.index("{") : said.rindex("}") + 1])["facts"]
            except (ValueError, KeyError, TypeError) as e:
                raise ExtractionError(f"{first}; {e}") from e
            return [f for f in found if isinstance(f, dict)], used

    return run


def model_name(override: str | None, settings: dict[str, str], fallback: str) -> str:
    """The judge's model: the override, else JUDGE_MODEL, else TEXT_MODEL, else the fallback; blank ones do not count."""
    return env_or(override, env_or(settings.get("JUDGE_MODEL"), env_or(settings.get("TEXT_MODEL"), fallback)))


def embedded(texts: DataFrame, known: DataFrame, embed: Callable[[Column], Column], task: str | None = None) -> tuple[DataFrame, DataFrame]:
    """texts (text, ...) with their ``embedding``, and the rows (key, embedding) to add to the table of known ones: a text
    that is known for the task is not embedded again, and a new one once."""
    keyed = texts.withColumn("key", cache_key(F.col("text"), task))
    new = keyed.select("key", "text").dropDuplicates(["key"]).join(known.select("key"), "key", "left_anti")
    new = new.select("key", embed(F.col("text")).alias("embedding"))
    every = known.select("key", "embedding").unionByName(new)
    return keyed.join(every, "key", "left").drop("key"), new


def cache_key(text: Column, task: str | None = None) -> Column:
    """The key of an embedding in a table of known ones: task and text."""
    return F.sha2(F.concat(F.lit(f"{task}:" if task else ""), text), 256)
