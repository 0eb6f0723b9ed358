"""Each query of the subpackage over a whole small table, against libraries, brute force or held-out rows."""

import hashlib
import os
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from factloom.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}


def rows_of(spark, name):
    got = QUERIES[name](spark, DATA).collect()
    found = {r["doc_id"]: r for r in got}
    assert len(found) == len(got)
    return found


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_encoding(spark, texts):
    public = pytest.importorskip("public_tokenizers")
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    got = rows_of(spark, "op1_piece_codec")
    assert set(got) == set(texts)
    for i, t in texts.items():
        ids = sp.encode(t, add_eos=True)
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(sp.decode(ids)))


def test_token_counts(spark, texts):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    got = rows_of(spark, "op7_token_counts")
    for i, t in texts.items():
        n = len(tokenizer.encode(t, add_special_tokens=False).ids)
        assert tuple(got[i]) == (i, len(t.encode()), n, n > 2048)


def test_simhash(spark, texts):
    from test_duplicates import brute_print, roots

    got = rows_of(spark, "op2_simhash")
    prints = {i: brute_print(t) for i, t in texts.items()}
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    ids = sorted(prints)
    want = roots(ids, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 3])
    assert {i: r["component_id"] for i, r in got.items()} == want


def test_passages(spark, texts):
    raw = {i: t.encode() for i, t in texts.items()}
    seen = Counter(hash(b[k : k + 200]) for b in raw.values() for k in range(len(b) - 199))
    for i, r in rows_of(spark, "op5_suffix_dedup").items():
        gone = bytearray(len(raw[i]))
        for k in range(len(raw[i]) - 199):
            if seen[hash(raw[i][k : k + 200])] > 1:
                gone[k : k + 200] = b"\1" * 200
        kept = bytes(b for b, g in zip(raw[i], gone, strict=True) if not g)
        assert (r["n_bytes"], r["n_removed"], r["kept_sha256"]) == (len(gone), sum(gone), hashlib.sha256(kept).hexdigest())
        assert r["n_spans"] == sum(g and not b for b, g in zip(b"\0" + gone, gone, strict=False))


def test_exact(spark, texts):
    low = {i: t.encode().lower() for i, t in texts.items()}
    groups = {}
    for i, t in low.items():
        groups.setdefault(t, []).append(i)
    want = {i: (i, max(groups[t]), len(groups[t]), i == max(groups[t]), hashlib.sha256(t).hexdigest()) for i, t in low.items()}
    assert {i: tuple(r) for i, r in rows_of(spark, "op10_exact_dedup").items()} == want


def test_languages_of_held_out_rows(spark):
    known = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = rows_of(spark, "op9_language_id")
    held = [i for i, r in got.items() if r["held_out"]]
    assert sorted(held) == sorted(i for i in known if zlib.crc32(str(i).encode()) % 5 == 0)
    judged = [i for i in held if known[i] is not None and got[i]["lang_pred"] != "und"]
    assert len(judged) > 20 and sum(got[i]["lang_pred"] == known[i] for i in judged) >= 0.97 * len(judged)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_scores_of_a_language_model(spark, texts):
    got = rows_of(spark, "op4_context_tree")
    assert set(got) == set(texts)
    held = [r for r in got.values() if r["held_out"]]
    # two hundred documents are few (counts of words alone do better here; on larger tables the tree does, see README)
    assert sum(r["bits_per_byte"] for r in held) / len(held) < 3
    assert all(r["score"] < 0 and r["n_known"] <= r["n_tokens"] for r in got.values())


def test_mixing_meets_its_targets(spark):
    from factloom.llm.mixing import BUDGET, TARGETS

    got = QUERIES["op3_mixing"](spark, DATA)
    assert got.where("rate < 0 or rate is null").count() == 0
    total = got.agg(F.sum("n_tokens")).first()[0]
    for domain, share in TARGETS.items():
        expected = got.agg(F.sum(F.col("rate") * F.col("n_tokens") * F.col(f"p_{domain}"))).first()[0]
        assert expected == pytest.approx(share * BUDGET * total, rel=0.01)
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    judged = got.join(labels, "doc_id").select((F.col("toxic") == 1).alias("toxic"), (F.col("p_toxic") > 0.5).alias("said")).collect()
    assert sum(r["toxic"] == r["said"] for r in judged) >= 0.9 * len(judged)


def test_fingerprints_and_licences(spark, texts):
    prints = rows_of(spark, "op6_syncmers")
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in prints.values())
    long = [r["near_edited"] for r in prints.values() if r["n_chars"] > 400]
    assert sum(long) / len(long) > 0.5
    assert set(rows_of(spark, "op8_license_scan")) == set(texts)


def test_sort_means(spark):
    import duckdb

    from factloom.llm.queries import SQL

    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{DATA}/embeddings.parquet'")
    want = con.execute(SQL["op11_sort_means"]).df().sort_values("vec_id")
    got = QUERIES["op11_sort_means"](spark, DATA).toPandas().sort_values("vec_id")
    assert got[want.columns.tolist()].values.tolist() == want.values.tolist() and got["cluster"].nunique() > 20


def test_secrets(spark, texts):
    from test_selection import brute_base

    for i, r in rows_of(spark, "op12_secret_ledger").items():
        base = brute_base(texts[i])
        kinds = Counter(k for k, _, _ in base)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == (kinds["assign"], kinds["access"], kinds["hex"])
        said = [":".join(map(str, s)) for s in base]
        assert r["base_sha256"] == sha(",".join(said)) and set(said) <= set(r["spans"].split(","))


def test_resampling(spark, texts):
    from test_selection import brute_draw

    target = [r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    got = rows_of(spark, "op13_resampling")
    assert sorted(repr(tuple(r)) for r in got.values()) == brute_draw(list(texts.items()), target, 10_000, 1, 20, 10, 2024)
    assert sum(r["rank"] is not None for r in got.values()) > 5
