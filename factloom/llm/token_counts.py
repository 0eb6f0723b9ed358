"""Token counts without ids: pieces are counted once per distinct pre-token of the corpus, joined to the pre-token
frequencies of each document and summed.

Pre-tokens are the runs between white space, which no piece and no special string of the vocabulary crosses. Tasks sum
their distinct pre-tokens before the shuffle, and each distinct one is then tokenized once. The counts of the most
frequent pre-tokens (at most ``FREQUENT``) are shared with every task, where they meet the frequencies of a document
at once; its other pre-tokens meet the table of all in a join, where no key is hot.

Edge cases: a null or empty text has 0 bytes and 0 tokens; texts of any length count whole; repeated rows repeat; an empty
table gives an empty one.
"""

from __future__ import annotations

import os
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_and_text, least_frequent, map_batches, read_documents, stored

#: White space of the vocabulary's normaliser (Unicode White_Space); str.split() would also cut at U+001C to U+001F.
WHITE = regex.compile(r"[\t-\r \x85\xa0  -     　]+")
ODD_WHITE = regex.compile(r"[\x1c-\x1f]")
FREQUENT, HELD = 100_000, 300_000  # pre-tokens that are shared; distinct ones that a task sums before it passes them on


def pre_tokens(text: str) -> list[str]:
    return text.split() if not ODD_WHITE.search(text) else [w for w in WHITE.split(text) if w]


@lru_cache(maxsize=2)
def tokenizer(tokenizer_file: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(tokenizer_file)
    out.no_truncation()
    out.no_padding()
    return out


def piece_table(rows: DataFrame, tokenizer_file: str) -> DataFrame:
    """(w, a: occurrences, n: pieces) of every distinct pre-token of the rows (text)."""

    def distinct(batches):
        held: Counter = Counter()

        def flush():
            out = pa.record_batch([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["w", "a"])
            held.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.update(pre_tokens(text))
                if len(held) > HELD:
                    yield flush()
        yield flush()

    def pieces(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, n = batch.column(0).to_pylist(), []
        for k in range(0, len(words), 5_000):
            n += map(len, tokenizer(tokenizer_file).encode_batch(words[k : k + 5_000], add_special_tokens=False))
        return pa.record_batch([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["w", "a", "n"])

    found = rows.select("text").mapInArrow(distinct, "w string, a bigint").groupBy("w").agg(F.sum("a").alias("a"))
    return stored(map_batches(found, "w string, a bigint, n bigint", pieces), "pieces")


def count_tokens(docs: DataFrame, tokenizer_file: str, limit: int = 2048, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every row."""
    rows = id_and_text(docs)
    table = piece_table(rows, tokenizer_file)
    least = least_frequent(table, frequent)
    some = table.where(F.lit(False) if least is None else F.col("a") >= least).select("w", "n").toArrow()
    shared = rows.sparkSession.sparkContext.broadcast(dict(zip(some["w"].to_pylist(), some["n"].to_pylist(), strict=True)))
    del some

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        get, texts, n, rare, times, sizes = shared.value.get, batch.column(1).to_pylist(), [], [], [], [0]
        for text in texts:
            freq = Counter(pre_tokens(text))
            pieces = np.fromiter((get(w, -1) for w in freq), np.int64, len(freq))
            own = np.fromiter(freq.values(), np.int64, len(freq))
            hit = pieces >= 0
            n.append(int(pieces[hit] @ own[hit]))
            if not hit.all():
                rare += [w for w, h in zip(freq, hit.tolist(), strict=True) if not h]
                times += own[~hit].tolist()
            sizes.append(len(rare))
        lists = pa.array(sizes, pa.int32())
        cols = [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64())]
        cols += [pa.ListArray.from_arrays(lists, pa.array(rare, pa.string())), pa.ListArray.from_arrays(lists, pa.array(times, pa.int64()))]
        return pa.record_batch(cols, ["doc_id", "n_bytes", "n", "words", "times"])

    part = map_batches(rows, "doc_id bigint, n_bytes bigint, n bigint, words array<string>, times array<bigint>", run)
    part = stored(part.withColumn("row", F.monotonically_increasing_id()), "part-counts")
    shared.destroy()  # what follows reads the written table
    rare = part.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("w"), F.col("x.times").alias("t"))
    seldom = table if least is None else table.where(F.col("a") < least)
    more = rare.join(seldom.select("w", F.col("n").alias("pieces")), "w").groupBy("row").agg(F.sum(F.col("t") * F.col("pieces")).alias("more"))
    both = part.drop("words", "times").join(more, "row", "left").withColumn("n_tokens", F.col("n") + F.coalesce("more", F.lit(0)))
    return both.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(read_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
