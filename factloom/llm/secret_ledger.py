"""Secret scans over a ledger of blobs: every version of every path is named by its content, and only pairs of a blob and a
rule version that the ledger does not hold yet are scanned.

The ledger is a Parquet folder that grows by one batch a run: a blob (SHA-256 of its text), the rule versions that have
now been tried on it, and what they found. A run that dies leaves no rows, so the next one scans the same pairs again.
Of all rows with one content, one is scanned where it stands; which, is decided on 40-byte names, so texts are not
shuffled but for rows that repeat an id and a text, and where more than ``BROADCAST_ROWS`` names are to be skipped.
Findings are joined back to all rows by blob; a blob with a third of all rows is a hot key of the names only, which the
skew join splits.

Spans are in code points, end exclusive. Edge cases: a null text counts as empty, and the empty blob has no findings; a
null doc_id is kept; repeated rows repeat; an empty table gives an empty result and an empty ledger batch. Other columns
of the input are not read. Matches are leftmost and non-overlapping within a rule; rules do not see each other.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, id_and_text, map_batches, read_documents, scratch_dir, stored


class Rule(NamedTuple):
    """A kind of secret. A match counts if its ``group`` has ``least`` characters; only texts with one of ``needles``
    (in lower case, over the ASCII letters) can match. A changed rule gets a new version."""

    kind: str
    pattern: str
    needles: tuple[str, ...] = ()
    group: int = 0
    least: int = 0
    flags: int = 0
    version: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"

    def spans(self, text: str, compiled: re.Pattern) -> list[tuple[int, int]]:
        return [m.span() for m in compiled.finditer(text) if m.end(self.group) - m.start(self.group) >= self.least]


#: The rules that findings must hold to; fixed values.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", ("password", "passwd", "secret", "token", "apikey", "api_key"), 2, 8, re.IGNORECASE | re.ASCII),
    Rule("access", r"AKIA[A-Z0-9]+", ("akia",), 0, 16),
    Rule("hex", r"[0-9a-f]{32,}"),  # runs are maximal, so this is [0-9a-f]+ without the short ones
)

#: Published forms of credentials; fixed values.
MORE = (
    Rule("private_key", r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]+-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----)?", ("private key-----",)),
    Rule("github", r"\bgh[pousr]_[A-Za-z0-9]{36,}", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("slack", r"\bxox[abprs]-[A-Za-z0-9-]{10,}", ("xox",)),
    Rule("google", r"\bAIza[0-9A-Za-z_-]{35}", ("aiza",)),
    Rule("stripe", r"\b[sr]k_live_[0-9A-Za-z]{16,}", ("k_live_",)),
    Rule("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", ("eyj",)),
    Rule("bearer", r"\bbearer\x20+[A-Za-z0-9._~+/-]{20,}=*", ("bearer ",), 0, 0, re.IGNORECASE | re.ASCII),
    Rule("url_login", r"\b[A-Za-z][A-Za-z0-9+.-]*://[^\s/:@]+:[^\s/:@]+@[^\s/@]+", ("://",)),
)
RULES = BASE + MORE

LEDGER = "blob binary, rules array<string>, found array<struct<rule: string, start: bigint, end: bigint>>"


def known_rules(spark: SparkSession, ledger: str) -> DataFrame:
    """(blob, known: names of the rules tried on it). A ledger that does not exist yet is empty."""
    rows = ledger_rows(spark, ledger).select("blob", F.explode("rules").alias("rule")).distinct()
    return rows.groupBy("blob").agg(F.collect_list("rule").alias("known"))  # as many as there are rule versions


def ledger_rows(spark: SparkSession, ledger: str) -> DataFrame:
    path = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(LEDGER).parquet(ledger) if there else spark.createDataFrame([], LEDGER)


def scanned(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Ledger rows of ``rows`` (blob, todo: names of rules, text)."""
    of = {r.name: r for r in rules}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        compiled = {n: re.compile(r.pattern, r.flags) for n, r in of.items()}
        found = []
        for todo, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            low, here = text.encode().lower(), []
            for name in todo:
                rule = of[name]
                if not rule.needles or any(n.encode() in low for n in rule.needles):
                    here += [{"rule": name, "start": a, "end": b} for a, b in rule.spans(text, compiled[name])]
            found.append(here)
        kind = pa.list_(pa.struct([("rule", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        return pa.record_batch([batch.column(0), batch.column(1), pa.array(found, kind)], ["blob", "rules", "found"])

    return map_batches(rows.select("blob", "todo", "text"), LEDGER, run)


def blob_of(text: str = "text") -> Column:
    return F.unhex(F.sha2(F.col(text), 256))


def to_scan(rows: DataFrame, names: DataFrame, known: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, todo, text) of one row of each blob that lacks a rule."""
    d = F.coalesce("doc_id", F.lit(-(2**63)))
    every = F.array(*[F.lit(r.name) for r in rules])
    per = names.groupBy("blob", d.alias("d")).agg(F.count("*").alias("n"))
    one = per.groupBy("blob").agg(F.min("d").alias("one"))
    todo = one.join(known, "blob", "left").withColumn("todo", F.array_except(every, F.coalesce("known", F.array().cast("array<string>"))))
    per, todo = stored(per, "ledger-names"), stored(todo.drop("known"), "ledger-todo")  # plain tables, so that the skew join can split a hot blob
    plan = per.join(todo, "blob").select("blob", "d", "n", "todo", ((F.col("d") == F.col("one")) & (F.size("todo") > 0)).alias("chosen"))
    plan = stored(plan, "ledger-plan")
    chosen, rest = plan.where("chosen"), plan.where("not chosen or n > 1").select(F.col("blob").alias("b"), F.col("d").alias("e"))
    few = lambda df: F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
    texts = rows.select(blob_of().alias("blob"), d.alias("d"), "text")

    # rows that repeat an id and a text: one of each is read
    repeated = texts.join(few(chosen.where("n > 1").select("blob", "d", "todo")), ["blob", "d"]).dropDuplicates(["blob"])
    single = chosen.where("n = 1").select("blob", "d", "todo")
    if single.where(F.size("todo") < len(rules)).limit(1).count() or single.count() <= BROADCAST_ROWS:
        alone = texts.join(few(single), ["blob", "d"])
    else:  # nearly all rows are new to all rules: what is not to be read is the smaller set
        alone = texts.join(few(rest), (F.col("blob") == F.col("b")) & (F.col("d") == F.col("e")), "left_anti").withColumn("todo", every)
    return alone.select("blob", "todo", "text").unionByName(repeated.select("blob", "todo", "text"))


def scan_versions(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, blob, spans (array of kind, start, end by start, then rule as listed) of every row of ``versions`` (doc_id, text);
    ``ledger`` names the folder of the ledger, which this brings up to date first."""
    spark, rows = versions.sparkSession, id_and_text(versions)
    names = stored(rows.select("doc_id", blob_of().alias("blob")), "blob-names")
    scanned(to_scan(rows, names, known_rules(spark, ledger), rules), rules).write.mode("append").parquet(ledger)

    listed = F.array(*[F.lit(r.name) for r in rules])
    hits = ledger_rows(spark, ledger).select("blob", F.explode("found").alias("f")).select("blob", "f.*")
    hits = hits.select("blob", "start", F.array_position(listed, F.col("rule")).alias("rank"), "end", F.split_part("rule", F.lit("@"), F.lit(1)).alias("kind")).where("rank > 0").distinct()
    of = stored(hits.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "end", "kind"))).alias("f")), "findings")  # of one text
    spans = F.transform(F.coalesce("f", F.array().cast("array<struct<start: bigint, rank: bigint, end: bigint, kind: string>>")), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return names.join(of, "blob", "left").select("doc_id", "blob", spans.alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op12_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = scan_versions(read_documents(spark, sf_dir), scratch_dir(spark, "ledger"))
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in BASE]))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return got.select("doc_id", *[count(r.kind) for r in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
