"""The jobs on small tables, run twice; views, progress and sources around them."""

import json

import pytest
from pyspark.sql import functions as F

from factloom.functions import display, text
from factloom.operators import entities, facts, jobs, pages, quality, reconcile, views
from factloom.plans.schemas import TABLES
from factloom.sources import readers, sinks
from factloom.streaming import external, progress

RUN = "array<struct<fontName:string,height:double,str:string,transform:array<double>,width:double>>"


def empty(spark, name):
    return spark.createDataFrame([], TABLES[name])


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def items(*words):
    return [("f", 10.0, w, [1.0, 0.0, 0.0, 1.0, 5.0 * i, 700.0], 40.0) for i, w in enumerate(words)]


def test_parse(spark):
    found = [("d1", 1, items("Total", " ", "Revenue"), 600.0, None), ("d1", 2, None, None, "broken page"), ("d2", None, None, None, "no file")]
    decoded = spark.createDataFrame(found, f"document_id string, page_number int, items {RUN}, width double, error string")
    documents = spark.createDataFrame([("d1", "a.pdf", "pending"), ("d2", "b.pdf", "pending"), ("d3", "c.pdf", "done")], "id string, filename string, status string").withColumns({"page_count": F.lit(None).cast("int"), "error_message": F.lit(None).cast("string")})
    once = jobs.parse_pages(decoded, empty(spark, "page_chunks"), documents)
    assert rows_of(once["chunks"], "document_id", "page_number", "chunk_index", "raw_text", "is_low_text", "extraction_status") == [("d1", 1, 0, "Total Revenue", True, "pending")]
    assert rows_of(once["documents"], "id", "status", "page_count", "error_message") == [("d1", "parsed", 1, "Failed to persist 1 page(s): 2"), ("d2", "failed", 0, "no file"), ("d3", "done", None, None)]
    again = jobs.parse_pages(decoded, once["chunks"], once["documents"])
    assert rows_of(again["chunks"], "*") == rows_of(once["chunks"], "*") and rows_of(again["documents"], "*") == rows_of(once["documents"], "*")


def page_chunks(spark, rows):
    made = spark.createDataFrame([(f"{d}-{p}", d, p, 0, t, table, low) for d, p, t, table, low in rows], "id string, document_id string, page_number int, chunk_index int, raw_text string, is_table_heavy boolean, is_low_text boolean")
    made = made.withColumns({"needs_vision": F.col("is_low_text"), "extraction_status": F.lit("pending"), "token_estimate": F.ceil(F.length("raw_text") / 4).cast("int")})
    return empty(spark, "page_chunks").unionByName(made, allowMissingColumns=True)


def models():
    """The extractors (inner functions, which go to workers as they are)."""

    def said(page, value, confidence=0.9, **more):
        return {"confidence": confidence, "entity": {"name": "Acme Corp", "type": "company", "context": "a maker"}, "factTypeDescription": "company revenue", "predicate": "revenue", "value": value, "rawValue": value, "sourceQuote": f"revenue of {value}", "pageNumber": page} | more

    def read_pages(batch):
        if any("poison" in t for _, t in batch):
            raise ValueError("no answer")
        out = [said(n, t.split()[-1], 0.5 if "table" in t else 0.9) for n, t in batch if "revenue of" in t]
        return [*out, said(999, "1")], (10 * len(batch), 5)  # a fact of a page that was not asked for

    def look_at_pages(batch):
        return [said(None, "7", qualifiers={"seen": True}) | {"sourceQuote": "not on the page"} for _ in batch], (100, 1)

    return read_pages, look_at_pages


@pytest.mark.parametrize("looks", [False, True])
def test_extract(spark, looks):
    read_pages, look_at_pages = models()
    vision = look_at_pages if looks else None
    chunks = page_chunks(spark, [("d1", 1, "head\nrevenue of 5", False, False), ("d1", 2, "table revenue of 6", True, False), ("d1", 3, "poison", False, False), ("d1", 4, "head\nrevenue of 5", False, False), ("d1", 5, "scan", False, True), ("d1", 6, " ", False, False)])
    embed = external.embedder()
    old = spark.createDataFrame([("old", "d1"), ("kept", "d2")], "id string, document_id string")
    got = jobs.extract_documents(chunks, empty(spark, "facts").unionByName(old, allowMissingColumns=True), empty(spark, "fact_types"), read_pages, embed, vision)
    status = dict(rows_of(got["chunks"], "page_number", "extraction_status"))
    assert status == {1: "extracted", 2: "extracted", 3: "extraction_failed", 4: "extracted", 5: "extracted" if vision else "extraction_deferred", 6: "extracted"}
    made = rows_of(got["facts"].where("document_id = 'd1'"), "source_page", "value", "source_quote_valid", F.round("confidence", 2))
    want = [(1, "5", True, 0.9), (2, "6", True, 0.5), (4, "5", True, 0.9)]
    assert made == (sorted([*want, (2, "7", False, 0.9), (5, "7", False, 0.9)]) if vision else want)
    first = got["facts"].where("source_page = 1").first()
    assert json.loads(first["qualifiers"])["_entity"] == {"context": "a maker", "name": "Acme Corp", "type": "company"} and len(first["embedding"]) == 64
    assert got["facts"].where("id = 'kept'").count() == 1 and got["facts"].where("id = 'old'").count() == 0
    types = got["types"].collect()
    assert [(t["name"], t["description"], t["example_predicates"]) for t in types] == [("revenue", "company revenue", ["revenue"])] and first["fact_type_id"] == types[0]["id"]
    use = got["usage"].first()
    # one batch of three pages fails and is split in two and one; the poisoned page alone fails again
    assert (use["calls"], use["input_tokens"], use["output_tokens"]) == ((4, 220, 7) if vision else (2, 20, 5))
    again = jobs.extract_documents(chunks, got["facts"], got["types"], read_pages, embed, vision)
    assert rows_of(again["facts"], "id", "value", "fact_type_id") == rows_of(got["facts"], "id", "value", "fact_type_id")
    assert rows_of(again["types"], "id") == rows_of(got["types"], "id")


def resolve_input(spark):
    named = [("d1", "1", "Acme Corp", "a maker of tools"), ("d1", "2", "The Acme Corporation", None), ("d1", "3", "Globex", "oil"), ("d2", "4", "ACME CORP", "tools"), ("d2", "5", "Initech", "  "), ("d3", "6", "Old Name", "x"), ("d1", "7", "Acme Corp", None)]
    rows = [(d, i, json.dumps({"_entity": {"name": n, "type": "company", "context": c}}), f"quote {i}", None) for d, i, n, c in named]
    return empty(spark, "facts").unionByName(spark.createDataFrame(rows, "document_id string, id string, qualifiers string, source_quote string, entity_id string"), allowMissingColumns=True)


def test_resolve(spark):
    found = resolve_input(spark)
    documents = spark.createDataFrame([("d1",), ("d2",)], "document_id string")
    embed = external.embedder()
    known = spark.createDataFrame([("e1", "Globex International", "company", "oil", None), ("e2", "initech", "company", None, None)], "id string, canonical_name string, entity_type string, context_sample string, embedding array<float>")
    known = known.withColumn("embedding", F.when(F.col("id") == "e1", embed(F.lit("entity: Globex | oil"))))
    entities_before = empty(spark, "entities").unionByName(known, allowMissingColumns=True)
    aliases = spark.createDataFrame([("a1", "e1", "gone", "d1"), ("a2", "e1", "stays", "d3")], "id string, entity_id string, surface_form string, document_id string")
    aliases = empty(spark, "entity_aliases").unionByName(aliases, allowMissingColumns=True)
    same = lambda a, ca, b, cb: F.substring(a, 1, 4) == F.substring(b, 1, 4)
    got = jobs.resolve_documents(found, documents, entities_before, aliases, embed, same)
    names = {r["id"]: r["canonical_name"] for r in got["entities"].collect()}
    assert sorted(names.values()) == ["Acme Corp", "Globex International", "initech"]
    linked = {r["id"]: names.get(r["entity_id"]) for r in got["facts"].collect()}
    assert linked == {"1": "Acme Corp", "2": "Acme Corp", "3": "Globex International", "4": "Acme Corp", "5": "initech", "6": None, "7": "Acme Corp"}
    assert [(f, names[e], d) for f, e, d in rows_of(got["aliases"], "surface_form", "entity_id", "document_id")] == [("ACME CORP", "Acme Corp", "d2"), ("Acme Corp", "Acme Corp", "d1"), ("Globex", "Globex International", "d1"), ("Initech", "initech", "d2"), ("The Acme Corporation", "Acme Corp", "d1"), ("stays", "Globex International", "d3")]
    assert rows_of(got["results"], "document_id", "entities_resolved", "facts_linked") == [("d1", 2, 4), ("d2", 2, 2)]
    again = jobs.resolve_documents(got["facts"], documents, got["entities"], got["aliases"], embed, same)
    for name, key in (("facts", ("id", "entity_id")), ("entities", ("id",)), ("aliases", ("id", "entity_id"))):
        assert rows_of(again[name], *key) == rows_of(got[name], *key)


def test_reconcile(spark):
    rows = [("n1", "d1", "e", "revenue", "$4.2M", "FY2024"), ("n2", "d1", "e", "revenue", "9", "FY2024"), ("n3", "d1", None, "revenue", "9", None), ("o1", "d2", "e", "revenue", "4200000", "FY 24"), ("o2", "d2", "e", "staff count", "4", None), ("o3", "d3", "f", "revenue", "9", "FY2024")]
    base = spark.createDataFrame(rows, "id string, document_id string, entity_id string, predicate string, value string, time_scope string").withColumn("embedding", F.array(F.lit(1.0), F.lit(0.5)).cast("array<float>"))
    found = empty(spark, "facts").unionByName(base, allowMissingColumns=True)
    owners = empty(spark, "entities").unionByName(spark.createDataFrame([("e", "Acme"), ("f", "Globex")], "id string, canonical_name string"), allowMissingColumns=True)
    new = spark.createDataFrame([("d1",)], "document_id string")
    embed = lambda c: F.when(c.isNotNull(), F.array(F.lit(1.0), F.lit(0.5)).cast("array<float>"))
    judge = lambda pairs: pairs.withColumns({"relation_type": F.lit("contradicts"), "confidence": F.lit(0.8), "explanation": F.lit("said so")})
    got = jobs.reconcile_documents(found, new, owners, empty(spark, "relationships"), embed, judge)
    assert rows_of(got["relationships"], "fact_a_id", "fact_b_id", "relation_type", "method") == [("n1", "o1", "corroborates", "rule"), ("n2", "o1", "contradicts", "llm_judge")]
    c = got["counters"].first()
    assert (c["skipped_no_entity"], c["skipped_no_embedding"], c["pairs_evaluated"], c["rule_resolved"], c["judge_calls"], c["relationships_created"]) == (1, 0, 2, 1, 1, 2)
    again = jobs.reconcile_documents(found, new, owners, got["relationships"], embed, judge)
    assert again["relationships"].count() == 2 and again["counters"].first()["pairs_evaluated"] == 0
    mute = jobs.reconcile_documents(found, new, owners, empty(spark, "relationships"), embed)
    assert rows_of(mute["relationships"], "fact_a_id", "relation_type", "confidence", "method") == [("n1", "corroborates", pytest.approx(0.95), "rule"), ("n2", "uncertain", pytest.approx(0.2), "llm_judge")]
    everything = jobs.reconcile_documents(found, found.select("document_id").distinct(), owners, empty(spark, "relationships"), embed)
    assert everything["relationships"].count() == 2
    tables = {"documents": spark.createDataFrame([("d1",), ("d2",)], "id string"), "chunks": page_chunks(spark, [("d1", 1, "x", False, False)]), "facts": found, "relationships": got["relationships"], "aliases": spark.createDataFrame([("a", "d1")], "id string, document_id string")}
    after = jobs.delete_documents(tables, new)
    assert [after[k].count() for k in ("documents", "chunks", "facts", "relationships")] == [1, 0, 3, 0] and after["aliases"].first()["document_id"] is None


def test_candidates_take_k_before_predicates(spark):
    rows = [("n", "d1", "revenue", 0.0), ("a", "d2", "staff", 0.1), ("b", "d2", "revenue", 0.2)]
    base = spark.createDataFrame(rows, "id string, document_id string, predicate string, vector double").withColumn("entity_id", F.lit("e"))
    found = empty(spark, "facts").drop("embedding").unionByName(base, allowMissingColumns=True)
    distance = F.abs(F.col("a_vector") - F.col("b_vector"))
    for k, n in ((1, 0), (2, 1)):
        assert reconcile.candidate_pairs(found.where("id = 'n'"), found, k, distance, 1.0).count() == n


def test_fact_types(spark):
    types = spark.createDataFrame([("t2", "b", "sales", ["x"], [1.0, 0.0]), ("t1", "a", "sales", None, [1.0, 0.0]), ("t3", "c", "staff", [], [0.0, 1.0])], "id string, name string, description string, example_predicates array<string>, embedding array<double>")
    asked = spark.createDataFrame([(1, "sales", "p", [1.0, 0.0]), (2, " Sales", "other", [1.0, 0.0]), (3, "head count", "q", [0.1, 1.0]), (4, "dividend", "r", [0.7, 0.7])], "idx int, description string, predicate string, q array<double>")
    linked = facts.link_fact_types(asked, types)
    assert rows_of(linked, "description", "type_id", "minted") == [("dividend", None, True), ("head count", "t3", False), ("sales", "t1", False)]
    after = {r["id"]: (r["name"], r["example_predicates"]) for r in facts.types_after(types, linked).collect()}
    assert after.pop(next(k for k in after if len(k) == 64)) == ("r", ["r"])
    assert after == {"t1": ("a", ["p"]), "t2": ("b", ["x"]), "t3": ("c", ["q"])}


def test_loose_facts_and_mentions(spark):
    loose = [{"confidence": "0.9", "value": 5, "pageNumber": "3", "entity": None}, {"confidence": 0.4, "rawValue": "x", "unit": 7, "entity": {"name": "A"}, "viaVision": False, "pageNumber": 2, "qualifiers": "text"}]
    got = facts.read_facts(spark.createDataFrame([(json.dumps({"facts": loose}),)], "reply string"), default_page=F.lit(8), via_vision=True).collect()
    assert [(r["confidence"], r["entity_name"], r["entity_type"], r["value"], r["raw_value"], r["page_number"], r["unit"], r["via_vision"], r["qualifiers"]) for r in got] == [(0.0, "Unknown", "Unknown", "5", "", 8, None, True, "{}"), (0.4, "A", None, "", "x", 2, None, False, "{}")]
    rows = [("d", "1", 1, '{"_entity":{"name":" A ","type":" ","context":" "}}', "q"), ("d", "2", 2, '{"entity":{"type":"t"}}', ""), ("d", "3", 3, None, "q3")]
    found = facts.mentions(spark.createDataFrame(rows, "document_id string, id string, idx int, qualifiers string, source_quote string"))
    assert rows_of(found, "fact_id", "name", "type", "context") == [("1", "A", None, "q"), ("2", "Unknown Entity", "t", None), ("3", "Unknown Entity", None, "q3")]


def test_elections_and_links(spark):
    rows = [("d", f"f{i}", i, n, t, c) for i, (n, t, c) in enumerate([("Acme", " firm ", "  "), ("Acme", "firm", "short"), ("acme inc", "company", "a much longer context"), ("Acme", "company", None)])]
    r = entities.elect(spark.createDataFrame(rows, "document_id string, fact_id string, idx int, name string, type string, context string")).where("canonical_name = 'Acme'").first()
    assert (r["entity_type"], r["context"]) == ("firm", "short")
    names = spark.createDataFrame([("Acme", "n1"), ("ACME", "n2"), ("Globex", "n3")], "canonical_name string, new_id string")
    known = spark.createDataFrame([("e", "globex")], "id string, canonical_name string")
    assert rows_of(entities.insert_or_get(names, known), "canonical_name", "entity_id", "is_new") == [("ACME", "n1", True), ("Acme", "n1", True), ("Globex", "e", False)]
    asked = spark.createDataFrame([("q", "a", 0.9, 1, False), ("q", "b", 0.85, 2, True), ("r", "c", 0.7, 1, True)], "query string, entity_id string, similarity double, rank int, same boolean")
    assert rows_of(entities.first_confirmed(asked), "query", "entity_id") == [("q", "b")]
    linked = entities.link_facts(spark.createDataFrame([("1", None), ("2", None)], "id string, entity_id string"), spark.createDataFrame([("1", "e")], "fact_id string, entity_id string"), "spare")
    assert rows_of(linked, "id", "entity_id") == [("1", "e"), ("2", "spare")]


def test_pages_of_facts(spark):
    found = spark.createDataFrame([("d", 1, "a"), ("d", 3, "b")], "document_id string, source_page int, value string")
    twins = spark.createDataFrame([("d", 2, 1), ("d", 1, 1)], "document_id string, page_number int, canonical_page int")
    assert rows_of(facts.copy_to_duplicates(found, twins), "source_page", "value") == [(1, "a"), (2, "a"), (3, "b")]
    kept, dropped = facts.allowed_only(found, twins.select("document_id", F.col("canonical_page").alias("source_page")), ["document_id", "source_page"])
    assert rows_of(kept, "value") == [("a",)] and dropped.first()["dropped"] == 1
    numbered = spark.createDataFrame([("d", i) for i in range(1, 8)], "document_id string, page_number int")
    assert [r["group"] for r in pages.fixed_groups(numbered, "document_id", "page_number", 3).orderBy("page_number").collect()] == [0, 0, 0, 1, 1, 1, 2]
    halves = spark.createDataFrame([([1, 2, 3],), ([1],)], "b array<int>").select(pages.halves(F.col("b")).alias("h")).collect()
    assert [r["h"] for r in halves] == [[[1, 2], [3]], [[1], []]]


def test_views(spark):
    documents = spark.createDataFrame([(f"d{i:02}", f"f{i}", f"/p{i}", "done" if i % 2 else "parsing", i) for i in range(60)], "id string, filename string, file_path string, status string, uploaded_at int")
    recent = views.recent_documents(documents)
    assert recent.columns == ["id", "filename", "status", "uploaded_at"] and recent.first()["id"] == "d59" and recent.count() == 50
    assert views.documents_with_status(documents, spark.createDataFrame([("d00",)], "id string")).count() == 29
    pairs = spark.createDataFrame([(f"r{i}", "a", f"b{i}", i) for i in range(120)] + [("s", "c", "a", 500)], "id string, fact_a_id string, fact_b_id string, created_at int")
    cards = spark.createDataFrame([("c", "v")], "id string, value string")
    got = views.related_facts(pairs, "a", cards)
    assert got.count() == 100 and got.where("role = 'factA'").first()["other"]["value"] == "v" and got.where("other_id = 'b0'").count() == 0
    assert views.facts_in(pairs).count() == 122
    aliases = spark.createDataFrame([("1", "e", "B", "d01", 2), ("2", "e", "A", "zz", 1), ("3", "f", "C", "d01", 1)], "id string, entity_id string, surface_form string, document_id string, created_at int")
    assert [(r["surface_form"], r["filename"]) for r in views.aliases_of(aliases, documents, "e").collect()] == [("A", None), ("B", "f1")]
    assert views.facts_of_documents(spark.createDataFrame([("1", "d01"), ("2", "zz")], "id string, document_id string"), documents).count() == 1
    chunks = spark.createDataFrame([("d", s) for s in ("pending", "extracted", "extraction_failed")], "document_id string, extraction_status string")
    assert views.status_counts(chunks).first()[1:] == (3, 2, 1)


def test_display(spark):
    one = spark.range(1)
    show = lambda c: one.select(c.alias("x")).first()["x"]
    assert [show(display.format_eta(F.lit(ms))) for ms in (-5000, 4400, 7000, 120_000, 125_000, 3_720_000)] == ["almost done", "almost done", "≈ 7s left", "≈ 2m left", "≈ 2m 5s left", "≈ 1h 2m left"]
    assert show(display.format_eta(F.lit(None).cast("double"))) is None and show(display.format_eta(F.lit(float("inf")))) is None
    steps = ("upload", "parse", "extract", "resolve", "reconcile")
    states = lambda status, stage: [show(display.stage_state(F.lit(status), F.lit(stage).cast("string"), s)) for s in steps]
    assert states("failed", "extract") == ["done", "done", "failed", "pending", "pending"]
    assert states("resolving", "resolve") == ["done", "done", "done", "active", "pending"]
    assert states("pending", None) == ["done", "active", "pending", "pending", "pending"]
    assert states("done", None) == ["done"] * 5 and states("failed", None) == ["done"] + ["pending"] * 4
    assert show(display.stage_line(F.lit("failed"), "parse", F.lit(None), "Reading", F.lit(None).cast("string"))) == "Stage failed"
    assert display.close_event(1000) == (None, True) and display.close_event(4404) == ("Document not found", False) and not display.close_event(1006)[1]
    assert [show(display.upload_status(F.lit(m), F.lit(n))) for m, n in (("application/pdf", 5), ("text/plain", 5), ("application/pdf", 200 << 20))] == [201, 400, 413]
    assert (display.env_or(" ", "x"), display.env_or("y", "x"), display.env_or(None, "x")) == ("x", "y", "x")
    runs = spark.createDataFrame([([("Total", 0.0, 10.0, 2.0, 3.0), ("Revenue was", 5.0, 10.0, 30.0, 9.0), ("5 million", 40.0, 10.0, 20.0, 9.0)],)], "r array<struct<text:string,x:double,y:double,width:double,height:double>>")
    found = lambda q: [x["text"] for x in runs.select(display.matching_runs(F.col("r"), F.lit(q)).alias("x")).first()["x"]]
    assert found("REVENUE  was") == ["Total", "Revenue was"] and found("total") == ["Total"] and found("nothing") == [] and found("") == []
    assert found("Revenue was, 5 million!") == []
    assert tuple(runs.select(display.highlight(F.col("r")[0], 2.0, F.lit(100.0)).alias("x")).first()["x"]) == (0.0, 174.0, 4.0, 8.0)


def test_events(spark):
    good = {"status": "parsing", "progress": {"current": 1, "total": 2}}
    cases = [(good, True), ({"status": "parsing"}, False), (good | {"status": "nope"}, False), (good | {"progress": {"current": "1", "total": 2}}, False), (good | {"stage": "parse"}, True), (good | {"stage": "x"}, False), (good | {"stage": None}, False), (good | {"errorMessage": None}, True), (good | {"errorMessage": "e"}, True), (good | {"errorMessage": 5}, False), (good | {"elapsedMs": -1}, False), (good | {"elapsedMs": "5"}, False), (good | {"elapsedMs": 0}, True), ([], False)]
    df = spark.createDataFrame([(json.dumps(c), w) for c, w in cases] + [("not json", False), (None, False)], "j string, want boolean")
    assert [r["got"] for r in df.select(progress.is_valid_event(F.col("j")).alias("got")).collect()] == [r["want"] for r in df.collect()]
    made = df.limit(1).select(progress.progress_event("parsing", "parse", F.lit(1), F.lit(2), F.lit(-3)).alias("j"))
    assert made.select(progress.is_valid_event(F.col("j"))).first()[0] and '"elapsedMs":0' in made.first()["j"]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "files" / "deep").mkdir(parents=True)
    (tmp_path / "files" / "deep" / "a.pdf").write_bytes(b"one|two")
    (tmp_path / "files" / "b.pdf").write_bytes(b"bad")
    (tmp_path / "files" / "c.txt").write_bytes(b"no")

    def decode(content):
        if content == b"bad":
            raise ValueError("no pages")
        return [(i, t, 600, 800) for i, t in enumerate(content.decode().split("|"), 1)]

    found = readers.find_files(spark, str(tmp_path / "files"))
    assert found.count() == 2
    assert rows_of(readers.decode_pages(found, decode), "page_number", "raw_text", "error") == [(1, "one", None), (2, "two", None), (None, None, "ValueError: no pages")]
    assert spark.range(1).select(readers.data_url(F.lit("x").cast("binary")).alias("u")).first()["u"] == "data:image/png;base64,eA=="
    sinks.write_json_lines(spark.createDataFrame([(1, "é")], "k int, v string"), str(tmp_path / "lines"))
    assert rows_of(readers.read_json_lines(spark, str(tmp_path / "lines"), "k int, v string"), "k", "v") == [(1, "é")]
    sinks.write_summary(spark.createDataFrame([(2, "x")], "total int, name string"), str(tmp_path / "summary.json"))
    assert json.loads((tmp_path / "summary.json").read_text()) == {"total": 2, "name": "x"}
    rows = spark.createDataFrame([("d1", 1), ("d2", 2)], "document_id string, v int")
    sinks.append(rows, str(tmp_path / "t"), ["document_id"])
    sinks.replace_documents(rows.where("document_id = 'd1'").withColumn("v", F.lit(9)), str(tmp_path / "t"))
    assert rows_of(spark.read.parquet(str(tmp_path / "t")), "document_id", "v") == [("d1", 9), ("d2", 2)]
    changed = sinks.updated(rows, spark.createDataFrame([("d1", None)], "document_id string, v int"), "document_id", "v")
    assert rows_of(changed, "document_id", "v") == [("d1", None), ("d2", 2)]
    assert readers.healthy(spark) and readers.by_key(rows, document_id="d2").first()["v"] == 2


def test_calls_of_models(spark):
    now, slept = [0.0], []
    bucket = external.TokenBucket(60, clock=lambda: now[0], sleep=lambda s: (slept.append(s), now.__setitem__(0, now[0] + s)))
    for _ in range(62):
        bucket.take()
    assert sum(slept) == pytest.approx(2.0)
    bucket.refused(5.0)
    bucket.take()
    assert slept[-1] >= 5.0 or sum(slept) >= 7.0
    got = spark.createDataFrame([("a b",), (None,), ("a b",)], "t string").select(external.embedder(batch=2)(F.col("t")).alias("v")).collect()
    assert got[0]["v"] == got[2]["v"] and sum(x * x for x in got[0]["v"]) == pytest.approx(1.0) and set(got[1]["v"]) == {0.0}


def test_verdicts(spark):
    cases = [(True, " Revenue was 5 ", "... revenue was 5 ...", " 5 ", "correct"), (False, "a", "a", "a", "quoteWrong"), (True, "b", "text", "b", "quoteWrong"), (True, "some quote", "", "9", "valueWrong"), (None, "q", None, "", "correct")]
    df = spark.createDataFrame(cases, "valid boolean, quote string, chunk string, raw string, want string")
    assert [r["got"] for r in df.select(quality.verdict(*map(F.col, ("valid", "quote", "chunk", "raw"))).alias("got")).collect()] == [c[-1] for c in cases]


def test_replies_of_models(spark):
    said = ['{"relationType":"contradicts","confidence":"0.9"}', '{"relationType":"uncertain","confidence":0.9,"explanation":" "}', '{"relationType":"contradicts" broken}']
    got = spark.createDataFrame([(x,) for x in said], "v string").select(text.judge_reply(F.col("v")).alias("r")).collect()
    assert [(r["r"]["relation_type"], r["r"]["confidence"]) for r in got] == [("contradicts", 0.5), ("uncertain", 0.6), ("uncertain", 0.3)]
    assert got[1]["r"]["explanation"] == "Relationship classified by judge."
    answers = ['{"same":"true"} no', '{"same":true}', '{"same":false} YES', "YES"]
    assert [r[0] for r in spark.createDataFrame([(x,) for x in answers], "v string").select(text.confirm_reply(F.col("v"))).collect()] == [False, True, False, True]


def test_extractors_and_caches(spark, tmp_path):
    def fails(_):
        raise ValueError("no structure")

    slept = []
    tried = external.with_retries(fails, 3, 2.0, slept.append)
    with pytest.raises(ValueError):
        tried("x")
    assert slept == [2.0, 4.0]
    ask = external.extractor_of(fails, lambda p: ('Here: {"facts":[{"value":"1"},5]} done', (7, 3)))
    assert ask([(1, "page")]) == ([{"value": "1"}], (7, 3))
    with pytest.raises(external.ExtractionError):
        external.extractor_of(fails, lambda p: ("nothing", (1, 1)))([(1, "page")])
    assert external.model_name(" ", {"JUDGE_MODEL": "", "TEXT_MODEL": "t"}, "f") == "t" and external.model_name("o", {}, "f") == "o"
    texts = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id int, text string")
    known = spark.createDataFrame([("a", [9.0])], "text string, embedding array<double>").select(external.cache_key(F.col("text"), "query").alias("key"), "embedding")
    got, new = external.embedded(texts, known, lambda c: F.array(F.length(c).cast("double")), "query")
    assert rows_of(got, "id", "embedding") == [(1, [9.0]), (2, [1.0]), (3, [9.0])] and new.count() == 1
    events = spark.createDataFrame([("d", 1, "parsing"), ("d", 2, "failed"), ("d", 3, "parsing"), ("e", 1, "parsing")], "document_id string, event_id int, status string")
    assert rows_of(progress.until_final(events), "document_id", "event_id") == [("d", 1), ("d", 2), ("e", 1)]
    pairs = spark.createDataFrame([("acme corp", "the company", [0.8, 0.6, 0.0], [0.79, 0.61, 0.0]), ("a firm", "other", [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]), ("acme", "ACME", None, None)], "a string, b string, x array<double>, y array<double>")
    assert [r[0] for r in pairs.select(text.names_or_vectors_merge(*map(F.col, ("a", "b", "x", "y")))).collect()] == [True, False, True]


def test_audit(spark, tmp_path):
    from factloom.plans import audit

    found = spark.createDataFrame([("1", "d", 1, 0, "revenue", "5", "5", "revenue of 5", True)], "id string, document_id string, source_page int, source_chunk_index int, predicate string, value string, raw_value string, source_quote string, source_quote_valid boolean")
    empty(spark, "facts").unionByName(found, allowMissingColumns=True).write.parquet(str(tmp_path / "facts"))
    page_chunks(spark, [("d", 1, "a revenue of 5 was seen", False, False)]).write.parquet(str(tmp_path / "page_chunks"))
    audit.main("all", str(tmp_path), str(tmp_path))
    assert json.loads((tmp_path / "summary.json").read_text())["correct"] == 1


def test_profiles_and_totals(spark):
    rows = [("d", 1, 0, True, True, 10), ("d", 1, 1, False, False, 9000), ("d", 2, 0, False, True, 20), ("d", 3, 0, False, False, 6000)]
    chunks = spark.createDataFrame(rows, "document_id string, page_number int, chunk_index int, is_table_heavy boolean, is_low_text boolean, token_estimate int")
    r = quality.page_profile(chunks).first()
    assert (r["avg_tokens"], r["table_heavy"], r["low_text"], r["dense"]) == (pytest.approx(2010.0), [1], [2], [3])
    assert views.total(chunks, chunk_index=0, document_id=None) == 3
