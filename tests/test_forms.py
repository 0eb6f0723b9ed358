"""Stated cases of the functions behind queries over texts."""

import pytest

from factloom.operators import rules
from factloom.plans.queries import SIDE, STEPS

SAME = "Both documents report identical values of "
EQUAL = "Values are numerically equivalent after unit normalization: "
LOST = "LLM judge returned unstructured or unparseable response: "
NUMBERS = [
    ("50K", None, None, 50e3, None, "k", None), ("$4.2M", None, None, 4.2e6, "USD", "m", None), ("2.5 billion", None, None, 2.5e9, None, "billion", None), ("10 Cr", "crores", None, 1e8, None, "cr", None), ("5 Lakh", "lakhs", None, 5e5, None, "lakh", None), ("₹500", None, None, 500.0, "INR", None, None),
    ("N/A", None, None, None, None, None, None), ("Not available", "kg", "usd", None, None, None, None), ("", None, None, None, None, None, None), ("€100M", None, "USD", 1e8, "USD", "m", None), ("5", "kg", None, 5e3, None, "k", "kg"), ("12%", None, None, 12.0, None, "percent", "percent"), ("12", "pct", "eur", 12.0, "EUR", "percent", "percent"),
    ("250 bps", None, None, 2.5, None, "percent", "percent"), ("1,234,567", None, "inr", 1234567.0, "INR", None, None), ("7", "units", "chf", 7.0, "CHF", "units", "units"), ("3 thousand", "million", None, 3e3, None, "thousand", None), ("3", "million", None, 3e6, None, "million", None), ("(500)", None, None, 500.0, None, None, None),
    ("-3.5 bn", None, None, -3.5e9, None, "bn", None), ("40 dollars", None, None, 40.0, "USD", None, None), ("9 lacs", None, "rupees", 9e5, "INR", "lacs", None), ("'8 million'", None, None, 8e6, None, "million", None), ("2 monthly", None, None, 2.0, None, None, None), ("5 k m", None, None, 5e3, None, "k", None), ("6 mn and 2 trillion", None, "", 6e12, None, "trillion", None),
]
NORMAL = [
    ('  "1,000,000"  ', "1000000"), ("$4,200.50", "$4200.50"), ("50 bps", "0.5%"), ("150 basis points", "1.5%"), ("15 pct", "15%"), ("12  Percent", "12%"), ("1,2,3", "12,3"), ("", ""), (" A \u00a0 b ", "a b"), ("“Quoted”", "quoted"), ("+25 BPS", "0.25%"), ("about 5 percent of", "about 5% of"), (None, ""), ("percentage", "percentage"), ("'x", "x"), ("1,00,000 Cr", "100000 cr"),
]
PERIODS = [
    ("FY24", "FY2024"), ("FY 2024", "FY2024"), ("Fiscal year 2024", "FY2024"), ("2023-24", "FY2024"), ("FY23/24", "FY2024"), ("2024-03-31", "2024"), ("1998-99", "FY1999"), ("1999-00", "FY1900"), ("Q1 FY24", "FY2024"), ("1Q2024", "Q1-FY2024"), ("q3'24", "Q3-FY2024"), ("CY 2024", "CY2024"), ("in 2021", "2021"), ("Long  Ago", "long ago"), (None, ""), ("FY85", "FY1985"), ("2024-03", "FY2003"), ("fiscal ’19", "FY2019"), ("H1", "h1"),
]
NAMES = [
    ("Acme Corp", "Acme Corporation", True, "acme corp"), ("Apple Inc.", "Apple Records", False, "apple inc"), ("Google LLC", "Alphabet Inc.", False, "google llc"), ("The Acme Corporation", "acme corp", True, "acme corp"), ("", "x", False, ""), ("甲", "乙", True, ""), ("X L.L.C.", "X LLC", True, "x llc"), ("“Globex Limited”", "globex ltd", True, "globex ltd"), ("International Business", "International Busines", True, "international business"), ("Widget Company", "Gadget Company", True, "widget co"), ("Widget", "Gadget", False, "widget"), ("Foo P.L.C", "foo plc", True, "foo plc"), ("A-B Incorporated", "A B Inc", True, "a b inc"),
]
PREDICATES = [
    ("revenue", "net revenue", None, None, True), ("revenue", "director of operations", None, None, False), ("total_revenue", "total revenue", None, None, True), ("foo", "bar", "t1", "t1", True), ("foo", "bar", "t1", "t2", False), ("foo", "bar", None, None, False), ("employee count", "employees count", None, None, True), ("Gross Margin", "gross-margin", None, None, True), ("net income", "gross income", None, None, False),
]
#: a's and b's value, unit, currency, period, qualifiers; relation, confidence, escalate, explanation, reason. Predicate: revenue.
LADDER = [
    ("$4,200,000", None, None, "FY2024", None, "$4200000", None, None, "FY 24", None, "corroborates", 0.95, False, SAME + '"$4,200,000" for revenue.', None),
    ("$4.2M", None, None, "FY2024", None, "4200000", None, None, "FY2024", None, "corroborates", 0.95, False, EQUAL + '"$4.2M" matches "4200000" for revenue.', None),
    ("$1.5B", None, None, "FY2024", None, "$1500M", None, None, "FY2024", None, "corroborates", 0.95, False, EQUAL + '"$1.5B" matches "$1500M" for revenue.', None),
    ("100M", None, "USD", "FY2024", None, "100,000,000", None, "EUR", "FY2024", None, "reconciled", 0.9, False, "Values are numerically identical (100000000) but reported in different currencies: USD vs EUR.", None),
    ("$50", None, None, "FY2024", None, "50%", None, None, "FY2024", None, None, None, True, None, rules.SAME_PERIOD),
    ("5", None, None, "FY2023", None, "5", None, None, "FY2024", None, "reconciled", 0.9, False, 'Values differ ("5" vs "5") because they cover different time periods: "FY2023" vs "FY2024".', None),
    ("500", None, None, "FY2024", '{"geography":"NA"}', "650", None, None, "FY2024", '{"geography":"Europe"}', "reconciled", 0.9, False, 'Values differ ("500" vs "650") due to different geography qualifier: "NA" vs "Europe".', None),
    ("500", None, None, "FY2024", '{"n":5,"_entity":{"name":"a"}}', "650", None, None, "FY2024", '{"_entity":{"name":"b"}}', "reconciled", 0.9, False, 'Values differ ("500" vs "650") due to different n qualifier: "5" vs "undefined".', None),
    ("500", None, None, None, None, "650", None, None, "FY2024", None, None, None, True, None, rules.NO_PERIOD),
    ("500", None, None, "FY2024", None, "650", None, None, "FY2024", None, None, None, True, None, rules.SAME_PERIOD),
    ("good", None, None, None, None, "Good ", None, None, None, None, "corroborates", 0.95, False, SAME + '"good" for revenue.', None),
    ("5", "kg", None, "FY2024", None, "5.0", "litres", None, "FY2024", None, None, None, True, None, rules.SAME_PERIOD),
    ("5", "kg", None, "FY2024", None, "5", "litres", None, "FY2024", None, "corroborates", 0.95, False, SAME + '"5" for revenue.', None),
    ("500", None, None, None, '{"tags":["a"]}', "650", None, None, "FY2024", '{"tags":["b"]}', "reconciled", 0.9, False, 'Values differ ("500" vs "650") due to different tags qualifier: "["a"]" vs "["b"]".', None),
]
TIMES = [(7000.0, "≈ 7s left"), (4400.0, "almost done"), (-5000.0, "almost done"), (120000.0, "≈ 2m left"), (125000.0, "≈ 2m 5s left"), (3720000.0, "≈ 1h 2m left"), (None, None), (59499.0, "≈ 59s left"), (59500.0, "≈ 1m left"), (7200000.0, "≈ 2h 0m left")]
STATES = [
    ("failed", "extract", "done", "failed", "pending", "extract", "Stage failed"), ("resolving", "resolve", "done", "done", "pending", "resolve", "Complete"), ("pending", None, "active", "pending", "pending", "parse", "Waiting"), ("done", None, "done", "done", "done", "reconcile", "Complete"), ("failed", None, "pending", "pending", "pending", None, "Waiting"), ("parsing", "parse", "active", "pending", "pending", "parse", "Waiting"), ("reconciling", "reconcile", "done", "done", "active", None, "Complete"), ("extracting", "extract", "done", "active", "pending", None, "Reading facts"),
]
MENTIONS = [
    ('{"_entity":{"name":" Acme ","type":" company ","context":" a maker "}}', "q", "Acme", "company", "a maker"), ('{"_entity":{"name":" ","type":"","context":"  "}}', "q", "Unknown Entity", None, "q"), ('{"entity":{"name":"Globex"}}', "", "Globex", None, None), (None, "q", "Unknown Entity", None, "q"), ('{"_entity":{"type":"t"},"entity":{"name":"other"}}', None, "Unknown Entity", "t", None),
]
LOOSE = [
    ('{"confidence":0.4,"value":5,"pageNumber":2,"unit":"kg","entity":{"name":"A","type":"t"}}', 0.4, "5", "", 2, "kg", "A", "t", "{}"), ('{"confidence":"0.9","rawValue":"x","pageNumber":"3","unit":7}', 0.0, "", "x", 8, None, "Unknown", "Unknown", "{}"), ('{"entity":{"name":"B"},"qualifiers":{"k":1}}', 0.0, "", "", 8, None, "B", None, '{"k":1}'),
    ('{"entity":null,"qualifiers":"text","value":"v"}', 0.0, "v", "", 8, None, "Unknown", "Unknown", "{}"), ('{"qualifiers":[{"key":"k","value":"1"},{"key":"k","value":"2"}],"value":true}', 0.0, "true", "", 8, None, "Unknown", "Unknown", '{"k":"2"}'),
]
EVENTS = [
    ('{"status":"parsing","stage":"parse","progress":{"current":1,"total":2}}', True, False), ('{"status":"nope","progress":{"current":1,"total":2}}', False, False), ('{"status":"parsing","elapsedMs":-1,"progress":{"current":1,"total":2}}', False, False),
    ('{"status":"done"}', False, True), ('{"status":"failed","progress":{"current":0,"total":1},"errorMessage":"no file"}', True, True), ('{"status":"failed","progress":{"current":0,"total":1},"errorMessage":7}', False, True),
    ('{"status":"resolved","progress":{"current":1.5,"total":2e3},"errorMessage":null,"elapsedMs":0}', True, False), ('{"status":"resolved","progress":{"current":"1","total":2}}', False, False), ('{"status":"pending","progress":null}', False, False),
    ('{"status":"pending","stage":"upload","progress":{"current":1,"total":2}}', False, False), ('{"status":"pending","stage":null,"progress":{"current":1,"total":2}}', False, False), ('[1]', False, False), ("no JSON", False, False), (None, False, False),
    ('{"status":"reconciling","stage":"reconcile","elapsedMs":"5","progress":{"current":1,"total":2}}', False, False), ('{"status":"done","stage":"reconcile","elapsedMs":12.5,"progress":{"current":9,"total":9}}', True, True), ('{"status":5,"progress":{"current":1,"total":2}}', False, False),
]
REPLIES = [
    ('```json\n{"relationType":"contradicts","confidence":0.9,"explanation":"x","same":true}\n```', "contradicts", 0.9, "x", True), ('{"relationType":"uncertain","confidence":0.95,"explanation":"y"} NO', "uncertain", 0.6, "y", False),
    ("Answer: NO, they differ", "uncertain", 0.3, LOST + "Answer: NO, they differ", False), ("Yes, the same. No doubt.", "uncertain", 0.3, LOST + "Yes, the same. No doubt.", True), ('{"relationType":"reconciled","confidence":7,"explanation":" "}', "reconciled", 1.0, "Relationship classified by judge.", False),
    ('{"relationType":"corroborates","confidence":-1,"explanation":" a "}', "corroborates", 0.0, "a", False), ('{"relationType":"corroborates","confidence":"0.9","explanation":"b","same":"true"}', "corroborates", 0.5, "b", False), ('{"relationType":"other","confidence":0.9}', "uncertain", 0.3, LOST + '{"relationType":"other","confidence":0.9}', False),
    ('It is {"relationType":"contradicts","explanation":"c","same":false} YES', "contradicts", 0.5, "c", False), ('{"relationType":"contradicts" yes', "uncertain", 0.3, LOST + '{"relationType":"contradicts" yes', True), ("  ", "uncertain", 0.3, LOST, False), ("yesterday nothing", "uncertain", 0.3, LOST + "yesterday nothing", False),
]
RUNS = [
    ("Total|Revenue was|5 million", "REVENUE  was", "Total|Revenue was"), ("Total|Revenue was|5 million", "total", "Total"), ("Total|Revenue was|5 million", "nothing", ""), ("Total|Revenue was|5 million", "", ""), ("a|b|c|d|e", "b c", "a|b|c"), ("Net|profit,|after tax", "net profit after tax", ""), ("Net|profit-after|tax rose", "net profit-after tax", "Net|profit-after|tax rose"), ("one|two", "TWO", "one|two"), ("It rose by 5 per cent|last year.|Then it fell", "rose by 5 per cent last year", "It rose by 5 per cent|last year."),
]
UPLOADS = [("application/pdf", 5, 201), ("text/plain", 5, 400), (None, 5, 400), ("application/pdf", 104857600, 201), ("application/pdf", 104857601, 413)]
FILES = [("../../a?b.pdf", "a_b.pdf"), ("...", "document.pdf"), ("c:\\d\\e.pdf", "e.pdf"), ("", "document.pdf"), (".hidden.pdf", "hidden.pdf"), ("a:b|c.pdf", "a_b_c.pdf"), ("plain.pdf", "plain.pdf")]
VERDICTS = [
    (True, " Revenue was 5 ", "... revenue was 5 ...", " 5 ", "correct", "... revenue was 5 ..."), (False, "a", "a", "a", "quoteWrong", "a"), (True, "b", "text", "c", "quoteWrong", "text"), (True, "some quote", "", "9", "valueWrong", ""), (None, "q", None, "", "correct", None), (True, "x" * 5, "y" * 60 + "x" * 5 + "z" * 60, "XX", "correct", "y" * 50 + "x" * 5 + "z" * 50),
]

CASES = [
    ("parsed_numbers", "v string, u string, c string", NUMBERS),
    ("normal_forms", "v string", NORMAL),
    ("period_forms", "v string", PERIODS),
    ("name_pairs", "a string, b string", NAMES),
    ("predicate_pairs", "a string, b string, ta string, tb string", PREDICATES),
    ("rule_ladder", ", ".join(f"{s}_{c} string" for s in "ab" for c in SIDE), LADDER),
    ("eta_texts", "ms double", TIMES),
    ("stage_states", "status string, stage string", [(a, b, c, d, e, g) for a, b, c, d, e, _, g in STATES]),
    ("entity_mentions", "qualifiers string, source_quote string", MENTIONS),
    ("loose_facts", "fact string", LOOSE),
    ("checked_events", "j string", EVENTS),
    ("model_replies", "said string", REPLIES),
    ("highlighted_runs", "words string, quote string", RUNS),
    ("upload_answers", "mime string, size bigint", UPLOADS),
    ("file_names", "name string", FILES),
    ("quote_verdicts", "valid boolean, quote string, chunk string, raw string", VERDICTS),
]


@pytest.mark.parametrize("name,schema,rows", CASES, ids=[c[0] for c in CASES])
def test_cases(spark, name, schema, rows):
    step, outputs = STEPS[name]
    n = len(schema.split(", "))
    given = spark.createDataFrame([(i, *r[:n]) for i, r in enumerate(rows)], f"id bigint, {schema}")
    got = {r["id"]: tuple(r)[1:] for r in step(given).select("id", *outputs).collect()}
    assert [got[i] for i in range(len(rows))] == [tuple(r[n:]) for r in rows]
