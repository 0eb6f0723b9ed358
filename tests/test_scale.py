"""Algorithms for large inputs, each against the plain way to the same result."""

import os
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factloom.operators import entities, facts, in_order, jobs, nearest, packing, pages, reconcile, similarity, views
from factloom.plans import queries
from factloom.plans.schemas import TABLES


def empty(spark, name):
    return spark.createDataFrame([], TABLES[name])


def vectors(spark, x, name, ids=None):
    rows = [(int(i), v.tolist()) for i, v in zip(range(len(x)) if ids is None else ids, x, strict=True)]
    return spark.createDataFrame(rows, f"{name} bigint, {'q' if name == 'query' else 'v'} array<double>")


def brute(q, x, ids, k, same=True):
    u, w = q / np.linalg.norm(q, axis=1, keepdims=True), x / np.linalg.norm(x, axis=1, keepdims=True)
    d = np.round(1 - u @ w.T, 9)
    out = []
    for i in range(len(q)):
        order = [j for j in np.lexsort((np.arange(len(x)), d[i])) if same or j != ids[i]]
        out += [(int(ids[i]), int(j), r) for r, j in enumerate(order[:k], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def clustered():
    """60 clusters, a third of all rows copies of one vector."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(60, 24))
    x = centres[rng.integers(0, 60, 4000)] + 0.05 * rng.normal(size=(4000, 24))
    x[:1300] = x[0]
    return x


def test_neighbours_equal_brute_force_with_few_pairs(spark, clustered):
    x, ids = clustered, np.arange(0, 4000, 20)
    q = x[ids]
    asked, rows = vectors(spark, q, "query", ids), vectors(spark, x, "row")
    got = similarity.knn_join(asked, rows, [], "query", "row", 5, differ=("query", "row"))
    assert sorted((r["query"], r["row"], r["rank"]) for r in got.collect()) == brute(q, x, ids, 5, same=False)
    compared = spark.sparkContext.accumulator(0)
    null = F.lit(None).cast("string")
    plain = asked.where("query >= 1300").select(F.col("query").alias("qid"), null.alias("qx"), "q"), rows.select(F.col("row").alias("rid"), null.alias("rx"), "v")
    nearest.search(*plain, 5, compared=compared).count()
    assert 0 < compared.value < 0.1 * 135 * 4000
    near = nearest.search(*plain, None, 0.05).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert {(r["qid"], r["rid"]) for r in near} == {(i, j) for i in range(1300, 4000, 20) for j in np.flatnonzero(1 - u @ u[i] < 0.05).tolist()}


def test_neighbours_of_even_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2500, 64))
    ids = np.arange(0, 2500, 100)
    got = similarity.knn_join(vectors(spark, x[ids], "query", ids), vectors(spark, x, "row"), [], "query", "row", 7)
    assert sorted((r["query"], r["row"], r["rank"]) for r in got.collect()) == brute(x[ids], x, ids, 7)
    odd = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (3, [1.0]), (4, [1.0, 1.0]), (5, [1.0, 0.0]), (6, [])], "row bigint, v array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.1]), (2, None), (3, [0.0, 0.0])], "query bigint, q array<double>")
    assert [(r["query"], r["row"]) for r in similarity.knn_join(asked, odd, [], "query", "row", 2).orderBy("rank").collect()] in ([(1, 5), (1, 4)], [])
    assert similarity.knn_join(asked, odd.limit(0), [], "query", "row", 2).count() == 0
    assert similarity.knn_join(asked.limit(0), odd.where("row > 3"), [], "query", "row", 2).count() == 0
    assert similarity.nearest_one(asked, odd.where("row > 3 and row < 6"), "query", "row").first()["row"] == 5


def fact_table(spark, x, documents, entity):
    rows = [(f"f{i:05d}", f"d{documents[i]}", entity[i], "revenue", str(i), "FY2024", v.tolist()) for i, v in enumerate(x)]
    base = spark.createDataFrame(rows, "id string, document_id string, entity_id string, predicate string, value string, time_scope string, vector array<double>")
    return empty(spark, "facts").unionByName(base, allowMissingColumns=True)


def test_a_heavy_entity_meets_in_blocks(spark, clustered, monkeypatch):
    x = clustered[1300:2500]
    rng = random.Random(1)
    table = fact_table(spark, x, [rng.randrange(9) for _ in x], ["hot" if i % 3 == 0 else f"e{i % 40}" for i in range(len(x))])
    pairs = lambda **more: sorted((r["pair_a"], r["pair_b"]) for r in reconcile.candidate_pairs(table, table, 4, **more).select("pair_a", "pair_b").collect())
    want = pairs(heavy_pairs=10**9)
    monkeypatch.setattr(nearest, "BLOCK", 64)
    monkeypatch.setattr(reconcile, "BLOCK", 64)
    assert want and pairs(heavy_pairs=5000) == want
    by = 1 - F.aggregate(F.zip_with("a_vector", "b_vector", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) / F.sqrt(F.aggregate("a_vector", F.lit(0.0), lambda s, v: s + v * v) * F.aggregate("b_vector", F.lit(0.0), lambda s, v: s + v * v))
    assert pairs(heavy_pairs=5000, distance=by) == want
    hot = table.where("entity_id = 'hot'")
    largest, total = spark.sparkContext.accumulator(0, nearest.Largest()), spark.sparkContext.accumulator(0)
    reconcile.near_facts(hot, hot, 4, 0.35, largest).count()
    reconcile.near_facts(hot, hot, 4, 0.35, total).count()
    assert largest.value < 0.05 * 400 * 400 and total.value < 0.7 * 400 * 400


def loop(names, edges):
    lead, seen = [], set()
    for v, name in names:
        if (name is None or name not in seen) and not any(u in lead for u in edges.get(v, ())):
            lead.append(v)
            seen.add(name)
    return lead


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_leaders_equal_a_loop(spark, seed):
    rng = random.Random(seed)
    names = [(v, rng.choice([None, *"abcdefghijklmnop"])) for v in range(60)]
    edges = {v: [u for u in range(v) if rng.random() < 0.04] for v in range(60)}
    frame = spark.createDataFrame([(v, u) for v, us in edges.items() for u in us], "v bigint, u bigint")
    got = in_order.leaders(spark.createDataFrame(names, "v bigint, name string"), frame)
    assert sorted(r["v"] for r in got.collect()) == loop(names, edges)


def test_followers_in_order_equal_a_loop_and_make_no_near_pairs(spark, monkeypatch):
    """Several rounds and blocks, exact ties, copies, vectors without direction, a node of two rows. What is written stays
    below the near pairs, of which there are over 100,000."""
    monkeypatch.setattr(in_order, "BLOCK", 32)
    monkeypatch.setattr(in_order, "HEAD", 64 * 5)
    written, plain = [], in_order.kept
    monkeypatch.setattr(in_order, "kept", lambda df, name: written.append(plain(df, name)) or written[-1])
    rng = np.random.default_rng(3)
    x = rng.integers(-2, 3, size=(1500, 5)).astype(float)
    x[::50] = 0
    ids = rng.permutation(1500) * 3
    rows = [(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)]
    rows += [(int(ids[7]), [1.0, 0.0, 0.0, 0.0, -1.0]), (1, None), (2, [1.0, None, 0.0, 0.0, 1.0]), (4, [1.0, 2.0])]
    got = sorted(tuple(r) for r in in_order.followed(spark.createDataFrame(rows, "v bigint, q array<double>"), 0.5).collect())

    of = {}
    for i, v in rows:
        of.setdefault(i, []).append(np.array(v) if v and len(v) == 5 and None not in v and any(v) else None)
    total = lambda a: np.cumsum(a)[-1]
    apart = lambda a, b: 1.0 - total(a * b) / (np.sqrt(total(a * a)) * np.sqrt(total(b * b)))
    lead, near = [], {}
    for i in sorted(of):
        d = {(apart(a, b), u) for a in of[i] for u in lead for b in of[u] if a is not None and b is not None}
        near[i] = min(((c, u) for c, u in d if 1 - c >= 0.5), default=(0, i))[1]
        lead += [i] if near[i] == i else []
    assert got == sorted((i, near[i]) for i, _ in rows) and 10 < len(lead) < 200
    assert sum(df.count() for df in written) < 6000


def test_clusters_of_one_batch_are_decided_in_order(spark):
    """A sequential loop over the clusters, with the five nearest of what is stored and led so far."""
    rng = random.Random(4)
    words = {w: [round(rng.uniform(-1, 1), 3) for _ in range(4)] for w in ("acme", "apex", "bolt", "core", "dune", "echo")}
    names = [f"{rng.choice(list(words)).title()} {rng.choice('AB')}" for _ in range(14)]
    embed = lambda c: F.transform(F.array(*map(F.lit, range(4))), lambda i: sum((F.when(F.lower(c).contains(w), F.lit(v[0])).otherwise(0.0) * (i == 0).cast("double") + F.when(F.lower(c).contains(w), F.lit(v[1])).otherwise(0.0) * (i == 1).cast("double") + F.when(F.lower(c).contains(w), F.lit(v[2])).otherwise(0.0) * (i == 2).cast("double") + F.when(F.lower(c).contains(w), F.lit(v[3])).otherwise(0.0) * (i == 3).cast("double") for w, v in words.items()), F.lit(0.0))).cast("array<float>")
    confirm = lambda a, ca, b, cb: F.substring(a, -1, 1) == F.substring(b, -1, 1)
    rows = [(f"f{i:02d}", f"d{i // 2:02d}", '{"_entity":{"name":"%s","type":"company","context":"c"}}' % n, "q") for i, n in enumerate(names)]
    table = empty(spark, "facts").unionByName(spark.createDataFrame(rows, "id string, document_id string, qualifiers string, source_quote string"), allowMissingColumns=True)
    old = spark.createDataFrame([("old", "Bolt Z", [float(np.float32(v)) for v in words["bolt"]])], "id string, canonical_name string, embedding array<float>")
    stored = empty(spark, "entities").unionByName(old, allowMissingColumns=True)
    documents = table.select("document_id").distinct()
    got = jobs.resolve_documents(table, documents, stored, empty(spark, "entity_aliases"), embed, confirm)
    made = {r["id"]: r["canonical_name"] for r in got["entities"].collect()}
    of = {r["id"]: made[r["entity_id"]] for r in got["facts"].collect()}

    vec = lambda n: np.array(words[n.split()[0].lower()], dtype=np.float32).astype(float)
    cosine = lambda a, b: 1 - a @ b / (np.linalg.norm(a) * np.linalg.norm(b))
    entities = [("Bolt Z", vec("Bolt Z"))]
    want = {}
    for (i, *_), n in zip(rows, names, strict=True):
        near = sorted((round(cosine(vec(n), v), 9), k, e) for k, (e, v) in enumerate(entities) if cosine(vec(n), v) <= 0.2)
        match = next((e for _, _, e in near if e[-1] == n[-1]), None)
        if match is None and n not in [e for e, _ in entities]:
            entities.append((n, vec(n)))
        want[i] = match or n
    assert of == want and sorted(made.values()) == sorted(e for e, _ in entities)


def test_fact_types_of_one_batch(spark):
    """Of new descriptions that are near, the first is minted; odd white space around a description changes nothing."""
    types = empty(spark, "fact_types").select("id", "name", "description", "example_predicates", "embedding")
    asked = spark.createDataFrame([("a", "sales", "p", [1.0, 0.0]), ("b", "sales volume", "q", [0.99, 0.1]), ("c", "head count", "r", [0.0, 1.0]), ("d", "\t sales ", "s", [1.0, 0.0])], "idx string, description string, predicate string, q array<double>")
    linked = facts.link_fact_types(asked, types)
    one = linked.where("idx = 'b'").first()
    assert sorted((r["idx"], r["minted"]) for r in linked.collect()) == [("a", True), ("b", False), ("c", True)]
    after = {r["id"]: r for r in facts.types_after(types, linked).collect()}
    assert len(after) == 2 and after[one["type_id"]]["example_predicates"] == ["p", "q"]
    found = spark.createDataFrame([("d", i, x) for i, x in enumerate(["Revenue", "Revenue\n", " revenue", " REVENUE\t"], 1)], "document_id string, source_page int, fact_type_description string")
    loose = {c: F.lit("x") for c in ("predicate", "value", "raw_value", "unit", "currency", "time_scope", "entity_name", "entity_type", "entity_context", "source_quote")}
    found = found.withColumns({**loose, "qualifiers": F.lit("{}"), "confidence": F.lit(0.9), "via_vision": F.lit(False)})
    texts = spark.createDataFrame([("d", i, "x", 0) for i in range(1, 5)], "document_id string, page_number int, raw_text string, first_chunk_index int")
    rows, made = jobs.fact_rows(found, texts, empty(spark, "fact_types"), lambda c: F.when(c.isNotNull(), F.array(F.lit(1.0), F.lit(2.0)).cast("array<float>")))
    assert {r["fact_type_id"] for r in rows.collect()} == {r["id"] for r in made.collect()} and made.count() == 1


def test_lines_go_one_after_another():
    rng = random.Random(2)
    for _ in range(500):
        lines = list(dict.fromkeys("".join(rng.choice("ab ") for _ in range(rng.randint(1, 4))) for _ in range(6)))
        text = "".join(rng.choice("ab \n") for _ in range(60))
        want = text
        for line in lines:
            want = want.replace(line, "")
        assert pages.Remover(lines)(text) == want


def test_lines_come_with_the_pages_where_they_are_many(spark, monkeypatch):
    text = "Zeta header line\n{}\nAlpha footer line"
    df = spark.createDataFrame([(s, i, text.format(f"{s}{i % 3}")) for s in "xy" for i in range(6)] + [("z", 1, None), ("z", 2, "  ")], "document_id string, page_number int, text string")
    rows = lambda: sorted(map(repr, pages.deduplicate_pages(df).select("document_id", "page_number", "compacted_text", "canonical_page").collect()))
    want = rows()
    assert want[0] == "Row(document_id='x', page_number=0, compacted_text='x0', canonical_page=0)" and want[3].endswith("canonical_page=0)")
    monkeypatch.setattr(pages, "SHARED_BYTES", 10)
    assert rows() == want


def test_names_equal_brute_force(spark):
    rng = random.Random(9)
    base = ["Acme Corporation", "Globex International Holdings", "Initech", "Umbrella Limited", "甲 乙", "Stark Industries Co", "L.L.C. Works", "ab", "x"]

    def change(s):
        s = list(s)
        for _ in range(rng.randint(0, 4)):
            i = rng.randrange(len(s))
            s[i : i + 1] = rng.choice([[], [rng.choice("abcxyz")], [s[i], rng.choice("abc")]]) or ([] if len(s) > 1 else s[i : i + 1])
        return "".join(s)

    rows = [(rng.choice(["d", "e"]), i, change(rng.choice(base))) for i in range(160)] + [("d", 900, "丙"), ("d", 901, ""), ("d", 902, None)]
    names = spark.createDataFrame(rows, "document_id string, idx int, name string")
    got = {(r["document_id"], r["idx_a"], r["idx_b"]) for r in similarity.merging_names(names).collect()}
    a, b = (names.select("document_id", F.col("idx").alias(f"idx_{s}"), F.col("name").alias(s)) for s in "ab")
    want = a.join(b, "document_id").where("idx_a < idx_b").where(similarity.forms_merge(similarity.name_forms(F.col("a")), similarity.name_forms(F.col("b"))))
    assert got == {(r["document_id"], r["idx_a"], r["idx_b"]) for r in want.collect()} and len(got) > 50


def test_rare_grams_bound_the_pairs(spark):
    rng = random.Random(8)
    rows = [("d", i, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(20))) for i in range(20_000)]
    rows += [("d", 20_000 + i, s[:10] + "Q" + s[11:]) for i, (_, _, s) in enumerate(rows[:50])]
    strings = spark.createDataFrame(rows, "document_id string, idx int, s string")
    met = similarity.edit_candidates(strings, ["document_id"], 0.85)
    assert {(i, 20_000 + i) for i in range(50)} <= {(r["idx_a"], r["idx_b"]) for r in met.where("idx_b >= 20000").collect()}
    assert met.count() < 0.005 * len(rows) ** 2 / 2


def packed(costs, target, most):
    out, batch, total, n, closed = [], -1, 0, 0, True
    for c in costs:
        if c >= target or closed or total + c > target or n >= most:
            batch, total, n = batch + 1, 0, 0
        total, n, closed = total + c, n + 1, c >= target
        out.append(batch)
    return out


@pytest.mark.parametrize(("n", "block", "most"), [(3000, 64, 7), (3000, 100, None), (17, 64, 3), (65, 64, None)])
def test_a_long_document_is_packed_in_blocks(spark, monkeypatch, n, block, most):
    rng = random.Random(n)
    monkeypatch.setattr(packing, "BLOCK", block)
    frames = {s: [rng.choice([0, 100, 900, 2000, 30_000]) for _ in range(n + k)] for k, s in enumerate("ab")}
    df = spark.createDataFrame(pd.DataFrame([(s, i, t) for s, ts in frames.items() for i, t in enumerate(ts)] + [("short", 1, 5)], columns=["document_id", "page_number", "token_estimate"]))
    got = {(r["document_id"], r["page_number"]): r["batch"] for r in pages.pack_pages(df, target=20_000, most=most, long_scope=10).collect()}
    for s, ts in frames.items():
        costs = [max(400, int(1.5 * t + 0.5)) for t in ts]
        assert [got[s, i] for i in range(len(ts))] == packed(costs, 20_000, most or 2**31)
    assert got["short", 1] == 0


def test_a_judge_fails_a_pair_at_a_time(spark):
    f = [(f"f{i}", f"d{i}", "e", "revenue", str(i), "FY2024", f"quote {i}", i) for i in range(4)]
    base = spark.createDataFrame(f, "id string, document_id string, entity_id string, predicate string, value string, time_scope string, source_quote string, source_page int").withColumn("embedding", F.array(F.lit(1.0), F.lit(0.5)).cast("array<float>"))
    table = empty(spark, "facts").unionByName(base, allowMissingColumns=True)
    owners = empty(spark, "entities").unionByName(spark.createDataFrame([("e", "Acme")], "id string, canonical_name string"), allowMissingColumns=True)
    files = spark.createDataFrame([(f"d{i}", f"file{i}.pdf") for i in range(3)], "document_id string, filename string")
    embed = lambda c: F.when(c.isNotNull(), F.array(F.lit(1.0), F.lit(0.5)).cast("array<float>"))

    def call(a, b, docs):
        if {a["id"], b["id"]} == {"f0", "f1"}:
            raise ValueError("over quota")
        return "contradicts", 0.7, f"{a['source_quote']} p{a['source_page']} of {docs['a']}; {b['source_quote']} p{b['source_page']} of {docs['b']}"

    new = spark.createDataFrame([("d0",)], "document_id string")
    got = jobs.reconcile_documents(table, new, owners, empty(spark, "relationships"), embed, reconcile.judged_by(call), files=files)
    said = {r["fact_b_id"]: (r["relation_type"], round(r["confidence"], 2), r["method"], r["explanation"]) for r in got["relationships"].collect()}
    assert said == {
        "f1": ("uncertain", 0.2, "llm_judge", "LLM judge call failed: over quota"),
        "f2": ("contradicts", 0.7, "llm_judge", "quote 0 p0 of file0.pdf; quote 2 p2 of file2.pdf"),
        "f3": ("contradicts", 0.7, "llm_judge", "quote 0 p0 of file0.pdf; quote 3 p3 of Document B"),
    }


@pytest.mark.parametrize("block", [5, 10**6])
def test_short_quotes_are_searched_at_once(spark, block):
    texts = {1: "the cat sat on the mat", 2: "a cat", 3: None, 4: "", 5: "concatenate these", 6: "Cat"}
    quotes = {10: "cat", 11: "the mat", 12: "at", 13: "dog", 14: "cat"}
    made = facts.short_quotes_in_pages(spark.createDataFrame(list(quotes.items()), "q int, source_quote string"), spark.createDataFrame(list(texts.items()), "p int, page_text string"), "q", "p", block)
    assert sorted((r["q"], r["p"]) for r in made.collect()) == sorted((q, p) for q, s in quotes.items() for p, t in texts.items() if t and s in t)
    assert facts.short_quotes_in_pages(spark.createDataFrame([], "q int, source_quote string"), spark.createDataFrame(list(texts.items()), "p int, page_text string"), "q", "p", block).count() == 0


def test_copies_of_a_name_meet_as_one_class(spark, monkeypatch):
    names = [(i % 2, i, ("Hot Bolt", "hot bolts", "The Hot Bolt", "Cold Ring")[i % 4]) for i in range(240)]
    table, met = spark.createDataFrame(names, "document_id int, idx bigint, name string"), []
    plain = similarity.edit_candidates
    monkeypatch.setattr(similarity, "edit_candidates", lambda strings, *more: met.append(strings.count()) or plain(strings, *more))
    monkeypatch.setattr(similarity, "MEMBERS", 16, raising=False)
    got = sorted(tuple(r) for r in similarity.merging_names(table).select("document_id", "idx_a", "idx_b").collect())
    one = lambda n: n if n == "Cold Ring" else "bolt"
    assert got == sorted((d, i, j) for d, i, a in names for e, j, b in names if d == e and i < j and one(a) == one(b))
    assert met == [2 * 4]  # two forms of four classes


@pytest.mark.parametrize("seed", [1, 2])
def test_a_heavy_entity_meets_on_a_line(spark, monkeypatch, seed):
    """Numbers with many ties, one document with long runs: as all pairs have it, and without them."""
    rng = random.Random(seed)
    rows = [(i, rng.choice("ab"), 7 if 300 < i < 500 else rng.randrange(5), rng.choice([rng.randrange(40) / 4, rng.random() * 40, 0.1 + rng.random() * 1e-16])) for i in range(600)]
    f = spark.createDataFrame(rows, "id bigint, entity_id string, document_id int, vector double")
    f = f.select("*", *[F.lit("x").alias(c) for c in ("predicate", "value")], *[F.lit(None).cast("string").alias(c) for c in ("raw_value", "unit", "currency", "time_scope", "qualifiers", "fact_type_id")])
    pairs = lambda most: sorted(tuple(r) for r in reconcile.candidate_pairs(f, f, 4, None, 1.5, most, line=True).select("pair_a", "pair_b").collect())
    want = pairs(10**9)
    monkeypatch.setattr(reconcile, "near_in_blocks", None)
    assert want and pairs(0) == want


def test_pairs_within_a_limit_are_not_written(spark, monkeypatch, clustered):
    names, null = [], F.lit(None).cast("string")
    plain = nearest.kept
    monkeypatch.setattr(nearest, "kept", lambda df, name: names.append(name) or plain(df, name))
    rows = vectors(spark, clustered, "row")
    got = nearest.search(rows.select(F.col("row").alias("qid"), null.alias("qx"), F.col("v").alias("q")), rows.select(F.col("row").alias("rid"), null.alias("rx"), "v"), None, 0.05)
    assert got.where(F.lit(False)).count() == 0 and "visits" in names and "near" not in names
    few = pa.table({"qid": [1, 2], "qx": pa.array([None, None], pa.string()), "q": [[1.0, 0.0], [0.0, 1.0]]})
    many = pa.table({"rid": [9, 8, 7], "rx": pa.array([None] * 3, pa.string()), "v": [[1.0, 0.0], [1.0, 0.0], [0.0, 2.0]]})
    assert nearest.nearest_in_block(few, many, 1, None).to_pylist() == [{"qid": 1, "rid": 8, "distance": 0.0}, {"qid": 2, "rid": 7, "distance": 0.0}]


def test_neighbours_of_a_key_meet_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x, met = rng.normal(size=(600, 8)), []
    x[::7] = x[0]
    plain = nearest.meet
    monkeypatch.setattr(nearest, "BLOCK", 64)
    monkeypatch.setattr(similarity, "meet", lambda *a: met.append(1) or plain(*a), raising=False)
    key = F.pmod(F.col("row"), F.lit(3)).alias("key")
    rows = vectors(spark, x, "row").select("row", "v", key).unionByName(spark.createDataFrame([(900, [1.0], 0), (901, [0.0] * 8, 0), (902, None, 0)], "row bigint, v array<double>, key bigint"))
    asked = rows.where("row % 20 = 0 or row > 600").select("key", F.col("row").alias("query"), F.col("v").alias("q"))
    got = sorted((r["key"], r["query"], r["row"], r["rank"]) for r in similarity.knn_join(asked, rows, ["key"], "query", "row", 5, differ=("query", "row")).collect())
    want = []
    for j in range(0, 600, 20):
        own = np.arange(j % 3, 600, 3)
        want += [(j % 3, i, int(own[r]), n) for i, r, n in brute(x[[j]], x[own], [int(np.flatnonzero(own == j)[0])], 5, same=False) for i in [j]]
    assert met and got == sorted(want)


def test_facts_in_relationships_has_no_large_task(spark, tmp_path, monkeypatch):
    """With the few shuffle partitions of the session, a task's rows do not grow with the table."""
    spark.range(40_000).selectExpr("id div 4 AS l_orderkey", "cast(id % 4 + 1 AS int) AS l_linenumber", "id AS l_suppkey", "id AS l_partkey", "'R' AS l_returnflag", "1.0D AS l_quantity", "date'1995-01-01' AS l_shipdate", "0.1D AS l_discount").write.parquet(str(tmp_path / "lineitem.parquet"))
    monkeypatch.setattr(views, "TASK_ROWS", 1000)
    got = queries.QUERIES["facts_in_relationships"](spark, str(tmp_path))
    rows = got.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in rows) == 40_000 and max(r["n"] for r in rows) < 1500
    pairs = spark.createDataFrame([(1, 2), (2, 3), (None, 3)], "fact_a_id bigint, fact_b_id bigint")
    assert {r["id"] for r in views.facts_in(pairs, 3).collect()} == {r["id"] for r in views.facts_in(pairs).collect()} == {1, 2, 3, None}


def test_names_of_small_documents_are_not_cut_to_grams(spark, monkeypatch):
    """Documents of few names, of one more than few and of many: clusters as brute force has them, and tables written only
    for what is merged, for nodes and for the large documents."""
    monkeypatch.setattr(entities, "FEW", 4, raising=False)
    rng, rows = random.Random(6), []
    for d, n in (("a", 2), ("b", 4), ("c", 5), ("e", 12), ("f", 1)):
        names = ["".join(rng.choice("abcdefgh") for _ in range(10)) for _ in range(-(-n // 2))]
        rows += [(d, f"{d}{i:02d}", names[i // 2] + "xy"[i % 2]) for i in range(n)]
    rows += [(f"g{i}", f"g{i}", "".join(rng.choice("abcdefgh") for _ in range(10))) for i in range(40)]
    table = empty(spark, "facts").unionByName(spark.createDataFrame([(d, i, '{"_entity":{"name":"%s"}}' % n) for d, i, n in rows], "document_id string, id string, qualifiers string"), allowMissingColumns=True)
    folder = spark.conf.get("spark.checkpoint.dir")
    embed = lambda c: F.when(c.isNotNull(), F.array(F.lit(1.0)).cast("array<float>"))
    run = lambda facts: jobs.resolve_documents(facts, facts.select("document_id").distinct(), empty(spark, "entities"), empty(spark, "entity_aliases"), embed, lambda *_: F.lit(False))
    before = set(os.listdir(folder))
    got = run(table)
    grams = [x for x in set(os.listdir(folder)) - before if x.startswith("rare-grams")]
    assert sum(spark.read.parquet(f"{folder}/{x}").select("document_id", "idx").distinct().count() for x in grams) == 5 + 12
    made = {r["id"]: r["canonical_name"] for r in got["entities"].collect()}
    of = {}
    for r in got["facts"].collect():
        of.setdefault((r["document_id"], r["entity_id"]), []).append(r["id"])
    want = {}
    for d, i, n in rows:
        want.setdefault((d, n[:10]), []).append(i)
    assert sorted(map(sorted, of.values())) == sorted(want.values()) and len(made) == len(want)
    before = set(os.listdir(folder))
    got = run(table.where("document_id not in ('c', 'e')"))
    assert got["facts"].count() == 47 and not [x for x in set(os.listdir(folder)) - before if x.startswith(("rare-grams", "mentions", "forms", "clusters", "placed"))]
