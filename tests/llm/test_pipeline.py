"""The pipeline's stages on a small corpus with planted copies."""

import os

import pytest

import corpus_pipeline as cp

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    base = spark.read.parquet(f"{DATA}/documents.parquet")
    text = " ".join(f"the house{i} of word{i * i % 97}" for i in range(120))
    rows = [(10_001, text, "en", "s", 1), (10_002, text.upper(), "en", "s", 1), (10_005, text + " tail", "en", "s", 1), (10_003, None, None, None, None), (10_004, "12 34", None, "s", 1)]
    more = spark.createDataFrame(rows, base.schema)
    docs = base.unionByName(more)
    counts = [docs.count()]
    for k, (_, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, DATA)
        if k < len(cp.STAGES) - 1:
            assert out.columns == base.columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        counts.append(docs.count())
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if k == 0:
            assert not ids & {10_003, 10_004}
        if k == 1:
            assert 10_002 in ids and 10_001 not in ids
        if k == 2:
            assert 10_002 in ids and 10_005 not in ids
    assert counts == sorted(counts, reverse=True)


def small_world(spark, tmp_path, rows):
    """A data folder of documents, with columns whose names the operators use, and of labels."""
    docs = spark.createDataFrame([(i, t, "en" if t else None, "s", 1, "clash", 7) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, x string, rate int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    ids = [(i, i % 2, 0) for i, _ in rows if i is not None]
    spark.createDataFrame(ids, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_run_on_odd_tables(spark, odd, tmp_path):
    for name, rows in (("empty", []), ("odd", [*odd, *((100 + i, f"the quiet house by the river {i} " * 9) for i in range(30))])):
        (tmp_path / name).mkdir()
        folder = small_world(spark, tmp_path / name, rows)
        got = cp.run(spark, folder).collect()
        assert len(got) <= len(rows) and {r["doc_id"] for r in got} <= {i for i, _ in rows}
        if rows:
            # texts without letters leave, clean documents stay, and of equal ones the largest id
            assert not {1, 2, 3} & {r["doc_id"] for r in got}
            assert {100 + i for i in range(30)} <= {r["doc_id"] for r in got}
