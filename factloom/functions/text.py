"""Text functions. White space is Unicode white space, as web clients trim it; \\w, \\d and \\b stay ASCII."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import cosine_similarity

WHITE = "[\\s\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"
#: Quotes that are stripped at either end.
OPEN_QUOTES, CLOSE_QUOTES = "[\"'‘“]+", "[\"'’”]+"
#: Company suffixes and their short forms.
SUFFIXES = {"corporation": "corp", "incorporated": "inc", "limited": "ltd", "company": "co"}
DOTTED = {"l\\.l\\.c\\.?": "llc", "p\\.l\\.c\\.?": "plc"}
NAME_THRESHOLD, VECTOR_THRESHOLD, PREDICATE_THRESHOLD, TYPE_THRESHOLD = 0.85, 0.80, 0.7, 0.85


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body refers to it."""
    return F.transform(F.array(value), body)[0]


def kind_of(json: Column, path: str) -> Column:
    """The type of a value of a JSON variant, as Spark names it (VOID for null), or null where there is none."""
    return F.schema_of_variant(F.try_variant_get(json, path, "variant"))


def is_number(json: Column, path: str) -> Column:
    return F.coalesce(kind_of(json, path).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.lit(False))


#: The characters of WHITE.
WHITE_CHARS = " \t\n\x0b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE_CHARS))


def collapsed(c: Column) -> Column:
    return F.regexp_replace(c, f"{WHITE}+", " ")


def is_blank(c: Column) -> Column:
    """Null, empty or white space only; never null itself."""
    return F.coalesce(trimmed(c) == "", F.lit(True))


def normalize_value(c: Column) -> Column:
    """Canonical form of a value's text: quotes off, spaces collapsed, digit-group commas out, basis points as per cent."""
    s = trimmed(F.coalesce(c, F.lit("")))
    s = collapsed(F.regexp_replace(s, f"^{OPEN_QUOTES}|{CLOSE_QUOTES}$", ""))
    s = F.regexp_replace(trimmed(s), "(\\d),(\\d)", "$1$2")
    points = lambda s: F.regexp_extract(s, "(?i)^([+-]?\\d+(?:\\.\\d+)?)\\s*(?:bps|basis\\s*points)$", 1)
    as_percent = lambda n: F.concat(js_number(n.try_cast("double") / 100), F.lit("%"))
    plain = lambda s: F.lower(F.regexp_replace(s, "(?i)\\s*(?:percent|pct)\\b", "%"))
    return let(s, lambda s: let(points(s), lambda n: F.when(n != "", as_percent(n)).otherwise(plain(s))))


def js_number(c: Column) -> Column:
    """A double as the shortest plain decimal, without a trailing .0; no grouping."""
    plain = F.regexp_replace(F.format_string("%.12f", c), "\\.?0+$", "")
    return F.when(c == F.floor(c), F.format_string("%.0f", c)).otherwise(plain)


def normalize_name(c: Column) -> Column:
    s = F.regexp_replace(trimmed(c), f"^{OPEN_QUOTES}|{CLOSE_QUOTES}$", "")
    return trimmed(collapsed(s))


def comparison_form(c: Column) -> Column:
    """Lower-case name without a leading article, with short company suffixes and ASCII word characters only."""
    s = F.regexp_replace(F.lower(trimmed(c)), "^the\\s+", "")
    for long, short in SUFFIXES.items():
        s = F.regexp_replace(s, f"\\b{long}\\b", short)
    for long, short in DOTTED.items():
        s = F.regexp_replace(s, f"\\b{long}", short)
    return trimmed(collapsed(F.regexp_replace(s, "[^\\w\\s]", " ")))


def string_similarity(a: Column, b: Column) -> Column:
    """1 - Levenshtein distance over the longer length, of trimmed lower-case texts; two empty texts are alike."""
    x, y = F.lower(trimmed(a)), F.lower(trimmed(b))
    longest = F.greatest(F.length(x), F.length(y))
    return F.when(x == y, F.lit(1.0)).otherwise(1.0 - F.levenshtein(x, y) / longest)


def name_forms(c: Column) -> Column:
    """What names are compared by: struct<low, form>, the lower-case name and its comparison form."""
    plain = lambda low: low.rlike("^[a-z0-9]+$") & ~low.isin(*SUFFIXES)  # noqa: E731 - one word that no step of the form changes
    form = lambda low, n: F.when(plain(low), low).otherwise(comparison_form(n))
    return let(normalize_name(c), lambda n: let(F.lower(n), lambda low: F.struct(low.alias("low"), form(low, n).alias("form"))))


def forms_merge(x: Column, y: Column, threshold: float = NAME_THRESHOLD) -> Column:
    """Whether two names of these forms name one entity. Names without ASCII word characters are alike, as their forms are
    both empty. Lengths are compared first: they bound the similarity."""

    def alike(a: Column, b: Column) -> Column:
        longest, shortest = F.greatest(F.length(a), F.length(b)), F.least(F.length(a), F.length(b))
        return (a == b) | ((shortest >= threshold * longest) & (1.0 - F.levenshtein(a, b) / longest >= threshold))

    other = (x["form"] != x["low"]) | (y["form"] != y["low"])
    return (x["low"] != "") & (y["low"] != "") & (alike(x["low"], y["low"]) | (other & alike(x["form"], y["form"])))


def names_merge(a: Column, b: Column, threshold: float = NAME_THRESHOLD) -> Column:
    return let(F.struct(name_forms(a).alias("a"), name_forms(b).alias("b")), lambda s: forms_merge(s["a"], s["b"], threshold))


def names_or_vectors_merge(a: Column, b: Column, vector_a: Column, vector_b: Column, threshold: float = NAME_THRESHOLD, vector_threshold: float = VECTOR_THRESHOLD) -> Column:
    """Whether two names are alike, or their vectors, where both have one."""
    both = vector_a.isNotNull() & vector_b.isNotNull()
    return names_merge(a, b, threshold) | F.coalesce(both & (cosine_similarity(vector_a, vector_b) >= vector_threshold), F.lit(False))


def predicates_match(a: Column, b: Column, type_a: Column | None = None, type_b: Column | None = None, threshold: float = PREDICATE_THRESHOLD) -> Column:
    """Same fact type, same text, one's words within the other's, or similar text."""
    x, y = F.lower(trimmed(a)), F.lower(trimmed(b))
    words = lambda c: F.filter(F.split(c, "[\\s_-]+"), lambda w: w != "")
    wx, wy = words(x), words(y)
    inside = F.when(F.size(wx) <= F.size(wy), F.size(F.array_except(wx, wy)) == 0).otherwise(F.size(F.array_except(wy, wx)) == 0)
    alike = (x == y) | (inside & (F.size(wx) > 0) & (F.size(wy) > 0)) | (string_similarity(x, y) >= threshold)
    return alike if type_a is None else F.coalesce(type_a == type_b, F.lit(False)) | alike


def quote_is_valid(quote: Column, page: Column) -> Column:
    """A quote holds if it is not blank and its trimmed text stands on the page, case as it is."""
    q = trimmed(F.coalesce(quote, F.lit("")))
    return (q != "") & F.contains(F.coalesce(page, F.lit("")), q)


def quote_bucket(quote: Column) -> Column:
    n = F.length(trimmed(F.coalesce(quote, F.lit(""))))
    return F.when(n <= 100, "0-100").when(n <= 400, "101-400").when(n <= 1000, "401-1000").otherwise("1000+")


def page_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def estimate_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("int")


def squeezed(text: Column) -> Column:
    """Without blank lines beyond one, and trimmed."""
    return trimmed(F.regexp_replace(text, "\\n{3,}", "\n\n"))


def fact_embedding_input(entity: Column, predicate: Column, value: Column) -> Column:
    return F.format_string("fact: %s %s %s", entity, predicate, value)


def match_embedding_input(entity: Column, predicate: Column, value: Column) -> Column:
    parts = F.concat_ws(" ", *(F.when(~is_blank(c), trimmed(c)) for c in (entity, predicate, value)))
    return F.concat(F.lit("fact: "), parts)


def entity_embedding_input(name: Column, context: Column) -> Column:
    return F.when(is_blank(context), F.concat(F.lit("entity: "), name)).otherwise(F.concat(F.lit("entity: "), name, F.lit(" | "), trimmed(context)))


def batch_prompt(pages: Column) -> Column:
    """Pages array<struct<page_number, text>> as marked blocks."""
    return F.array_join(F.transform(pages, lambda p: F.concat(F.lit("--- PAGE "), p["page_number"].cast("string"), F.lit(" ---\n"), p["text"])), "\n\n")


def fact_type_decision(similarity: Column, threshold: float = TYPE_THRESHOLD) -> Column:
    return F.when(similarity >= threshold, "link").otherwise("mint")


def unfenced(reply: Column) -> Column:
    """A model's reply without the marks of a code block."""
    return trimmed(F.regexp_replace(trimmed(reply), "^```(?:json)?\\s*|\\s*```$", ""))


def judge_reply(reply: Column) -> Column:
    """struct<relation_type, confidence, explanation> of a judge's reply; what cannot be read is uncertain at 0.3. A
    confidence that is no number counts as missing."""
    text = trimmed(F.coalesce(reply, F.lit("")))

    def read(text: Column, block: Column) -> Column:
        value = lambda key, kind="string": F.try_variant_get(block, f"$.{key}", kind)
        kind = value("relationType")
        confidence = F.when(is_number(block, "$.confidence"), F.least(F.greatest(value("confidence", "double"), F.lit(0.0)), F.lit(1.0))).otherwise(0.5)
        confidence = F.when(kind == "uncertain", F.least(confidence, F.lit(0.6))).otherwise(confidence)
        said = trimmed(F.coalesce(value("explanation"), text))
        known = F.coalesce(kind.isin("corroborates", "contradicts", "reconciled", "uncertain"), F.lit(False))
        # What is said where the judge says nothing
        lost = F.concat(F.lit("LLM judge returned unstructured or unparseable response: "), F.substring(text, 1, 200))
        return F.struct(
            F.when(known, kind).otherwise("uncertain").alias("relation_type"),
            F.when(known, confidence).otherwise(0.3).alias("confidence"),
            F.when(known, F.when(said == "", "Relationship classified by judge.").otherwise(said)).otherwise(lost).alias("explanation"),
        )

    return let(text, lambda t: read(t, F.try_parse_json(F.regexp_extract(t, "(?s)\\{.*\\}", 0))))


def confirm_reply(reply: Column) -> Column:
    """Whether a reply confirms that two names are the same: its JSON says so (true or false, no text), or else its first
    YES or NO does."""
    block = F.try_parse_json(F.regexp_extract(reply, "(?s)\\{.*\\}", 0))
    word = F.upper(F.regexp_extract(reply, "(?i)\\b(yes|no)\\b", 1))
    return F.when(kind_of(block, "$.same") == "BOOLEAN", F.try_variant_get(block, "$.same", "boolean")).otherwise(word == "YES")


def safe_filename(name: Column) -> Column:
    """Last path part, no leading dots, no reserved characters; ``document.pdf`` if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(name, "^.*[/\\\\]", ""), "^\\.+", "")
    s = F.regexp_replace(s, "[/\\\\?%*:|\"<>]", "_")
    return F.when(is_blank(s), "document.pdf").otherwise(s)


def escaped_like(search: str) -> str | None:
    """The ILIKE pattern of a contains search; None if the search is blank."""
    s = search.strip()
    for c in "\\%_":
        s = s.replace(c, f"\\{c}")
    return f"%{s}%" if s else None


def stringified(context) -> str | None:
    """A context as text: text as it is, anything else as compact JSON."""
    return context if context is None or isinstance(context, str) else json.dumps(context, separators=(",", ":"), ensure_ascii=False)
