"""Language ID, context tree, mixing, licences, fingerprints."""

import hashlib
import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from factloom.llm import syncmers
from factloom.llm.context_tree import ContextTree, score_documents, summed
from factloom.llm.language_id import fit_languages, predict_languages
from factloom.llm.license_scan import TEMPLATES, LicenseScanner, bigrams, normalised, scan_licenses
from factloom.llm.mixing import fit_rates, mix, rates_of
from factloom.llm.syncmers import anchors, fingerprint_documents


def test_languages(spark, odd, make):
    en, fr = "the house and the river of stone", "la maison et le fleuve de pierre"
    rows = [(i, (en if i % 2 else fr) + f" {i}", "en" if i % 2 else "fr") for i in range(60)]
    models = fit_languages(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    got = {r["doc_id"]: r for r in predict_languages(make([(1, en), (2, fr), (3, None), (4, "12 + 3"), (5, " ".join([en] * 9 + [fr] * 3))]), models).collect()}
    assert [got[i]["lang_pred"] for i in range(1, 6)] == ["en", "fr", "und", "und", "en"]
    assert 0.6 < got[5]["score"] < 0.9 and got[3]["score"] == 0.0
    assert predict_languages(make(odd), models).count() == len(odd)
    none = fit_languages(spark.createDataFrame([], "doc_id bigint, text string, lang string"))
    assert {r["lang_pred"] for r in predict_languages(make(odd), none).collect()} == {"und"}


def brute_logs(texts, wanted, depth):
    """log10 probabilities of (context, byte) by recursion over the whole tree of dictionaries."""
    counts = {}
    for text in texts:
        data = b" " * depth + text
        for i in range(depth, len(data)):
            for d in range(depth + 1):
                for b in range(8):
                    bit = data[i] >> (7 - b) & 1
                    counts.setdefault((data[i - d : i], (1 << b) | data[i] >> (8 - b)), [0, 0])[bit] += 1
    under = {}
    for context, prefix in counts:
        if context:
            under.setdefault((context[1:], prefix), []).append((context, prefix))

    def block(n):
        return math.lgamma(n[0] + 0.5) + math.lgamma(n[1] + 0.5) - math.log(math.pi) - math.lgamma(sum(n) + 1)

    def weight(node):
        own = block(counts[node])
        if len(node[0]) == depth:
            return own
        rest = sum(map(weight, under[node]))
        return math.log(0.5 * math.exp(own) + 0.5 * math.exp(rest))

    def one(context, prefix):
        mixed, left = 0.0, 1.0
        for d in range(depth + 1):
            node = (context[depth - d :], prefix)
            if node not in counts:
                return mixed + left * estimate if d else 0.5
            estimate = (counts[node][1] + 0.5) / (sum(counts[node]) + 1)
            if d == depth:
                return mixed + left * estimate
            own, rest = block(counts[node]), sum(map(weight, under[node]))
            share = math.exp(own) / (math.exp(own) + math.exp(rest))
            below = (context[depth - d - 1 :], prefix)
            if below not in counts:
                return mixed + left * estimate
            mixed, left = mixed + left * share * estimate, left * (1 - share)

    out = []
    for context, byte in wanted:
        p = 1.0
        for b in range(8):
            q = one(context, (1 << b) | byte >> (8 - b))
            p *= q if byte >> (7 - b) & 1 else 1 - q
        out.append(math.log10(p))
    return out


def key(context, byte):
    return int.from_bytes(context, "big") << 8 | byte


@pytest.mark.parametrize("depth", [0, 2, 3, 6])
def test_context_tree_against_recursion(depth):
    texts = [b"abab abc\n", b"aab abab\n", b"ab\n"]
    seen = [(t2[i - depth : i], t2[i]) for t in texts for t2 in [b" " * depth + t] for i in range(depth, len(t2))]
    pairs = np.array([key(*x) for x in seen], dtype=np.int64)
    tree = ContextTree.of_pairs(*summed(pairs, np.ones(len(pairs), np.int64)), depth).spread()
    wanted = sorted({*seen, *((c, b) for c, _ in seen for b in b"a\nz")}) + [(b"zzzzzz"[:depth], 97), (b"zzzzza"[6 - depth :], 98)]
    got = tree.walk(np.array([key(*x) for x in wanted], dtype=np.int64))
    assert np.allclose(got, brute_logs(texts, wanted, depth), atol=1e-9)
    for context in {c for c, _ in wanted}:
        assert math.isclose(sum(10 ** tree.walk(np.array([key(context, b) for b in range(256)]))), 1.0, rel_tol=1e-9)


@pytest.mark.parametrize(("frequent_pairs", "depth"), [(1_000_000, 2), (5, 4), (0, 6)])
def test_scores_of_texts_against_recursion(make, frequent_pairs, depth):
    rows = [(i, t) for i, t in enumerate(["ab ab abc", "AAB abab", None, "ba", "abc  ba", "zz ab", "ab ab abc", "cab"] * 2)]
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    normal = [b" ".join([*(t or "").lower().encode().split(), b"\n"]) for _, t in rows]
    learnt = [t for t, h in zip(normal, held, strict=True) if not h]
    got = {r["doc_id"]: r["score"] for r in score_documents(make(rows), depth, frequent_pairs=frequent_pairs).collect()}
    assert any(held)
    alone = score_documents(make([r for r, h in zip(rows, held, strict=True) if h]), depth, frequent_pairs=frequent_pairs)
    assert all(math.isclose(r["bits_per_byte"], 8.0) for r in alone.collect())  # without training rows
    for i, text in enumerate(normal):
        data = b" " * depth + text
        want = sum(brute_logs(learnt, [(data[k - depth : k], data[k]) for k in range(depth, len(data))], depth))
        assert math.isclose(got[i], want, rel_tol=1e-9)


@pytest.mark.parametrize("frequent", [100_000, 3])
def test_scores(make, odd, frequent):
    rows = odd + [(30 + i, f"the river and the stone {i % 5}") for i in range(40)]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c, ends = Counter(), sum(not held(i) for i, _ in rows)
    for i, t in rows:
        if not held(i):
            c.update((t or "").encode().lower().split())
    n, v = sum(c.values()) + ends, len(c) + 1
    got = sorted(map(tuple, score_documents(make(rows), frequent=frequent).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6)).collect()), key=repr)
    want = []
    for i, t in rows:
        words = (t or "").encode().lower().split()
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words) + math.log10((ends + 0.5) / (n + 0.5 * (v + 1)))
        want.append((i, held(i), len(words) + 1, sum(c[w] > 0 for w in words) + 1, n, round(base, 6)))
    assert [g[:5] for g in got] == [w[:5] for w in sorted(want, key=repr)]
    assert all(math.isclose(g[5], w[5], rel_tol=1e-6) for g, w in zip(got, sorted(want, key=repr), strict=True))
    assert score_documents(make([])).count() == 0


def test_mixing(spark, make, odd):
    rows = odd + [(100 + i, "plain words of a river " * 5 if i % 3 else "you idiot fool " * 5) for i in range(90)]
    labels = spark.createDataFrame([(100 + i, 1, 0 if i % 3 else 1) for i in range(90)], "doc_id bigint, quality int, toxic int")
    got = mix(make(rows), labels, {"good": 1.0, "plain": 1.0, "toxic": 0.0}, relative=True)
    assert got.count() == len(rows) and got.where("rate < 0").count() == 0
    mean = {r["t"]: r["rate"] for r in got.where("doc_id >= 100").groupBy((F.col("doc_id") % 3 == 1).alias("t")).agg(F.avg("rate").alias("rate")).collect()}
    assert mean[True] < 0.3 < 0.8 < mean[False]
    assert mix(make([]), labels).count() == 0
    assert mix(make(odd), labels.limit(0)).count() == len(odd)


def least_miss(a, targets):
    """The least distance of a @ rates, rates >= 0, from the targets: of every few columns, those with nonnegative rates."""
    best = float(np.linalg.norm(targets))
    for size in range(1, len(targets) + 1):
        for columns in itertools.combinations(range(a.shape[1]), size):
            rates = np.linalg.lstsq(a[:, columns], targets, rcond=None)[0]
            if (rates >= 0).all():
                best = min(best, float(np.linalg.norm(a[:, columns] @ rates - targets)))
    return best


@pytest.mark.parametrize("targets", [(300.0, 100.0, 50.0), (0.0, 400.0, 0.0), (0.0, 0.0, 0.0), (5.0, 200.0, 100.0), (500.0, 0.0, 10.0)])
def test_rates_against_brute_force(spark, targets):
    # targets outside the cone of the posteriors cannot be met; the least miss is then the answer
    random = np.random.default_rng(1)
    p, n = random.dirichlet((0.6, 0.6, 0.6), 30), random.integers(1, 40, 30)
    table = spark.createDataFrame([(int(m), x.tolist()) for m, x in zip(n, p, strict=True)], "n_tokens bigint, p array<double>")
    targets = np.array(targets)
    moves, missed = fit_rates(table, targets, 0.5)
    rate = rates_of(p, 0.5, moves)
    assert (rate >= 0).all() and np.allclose((n * rate) @ p - targets, missed, atol=1e-6)
    assert np.linalg.norm(missed) <= least_miss((p * n[:, None]).T, targets) + 1e-2 * targets.sum() + 1e-3


def test_long_words_have_odds(spark, make):
    # nothing but words of over 100 characters tells these texts apart
    words = ["".join(random_letter(i * 7 + j) for j in range(150)) for i in range(2)]
    rows = [(i, " ".join(["the river of stone", words[i % 2]])) for i in range(200)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(200)], "doc_id bigint, quality int, toxic int")
    got = mix(make(rows), labels).collect()
    assert all((r["p_toxic"] > 0.5) == (r["doc_id"] % 2 == 1) for r in got)
    assert len({(r["rounds"], r["residual"]) for r in got}) == 1


def random_letter(i):
    return "abcdefghijklmnopqrstuvwxyz"[i * i % 26]


def test_licences(make, odd):
    rows = odd + [(40, "Prose here.\nReleased under the MIT License.\nMore."), (41, TEMPLATES["Apache-2.0"][1]), (42, "The license is a river.")]
    got = {r["doc_id"]: r for r in scan_licenses(make(rows)).collect()}
    assert (got[40]["license"], got[41]["license"], got[42]["license"]) == ("MIT", "Apache-2.0", None)
    scanner = LicenseScanner()
    for _, t in rows:  # pruning loses nothing
        for _, words in scanner.units(t or ""):
            own = bigrams(words)
            best = max((2 * len(own & b) / (len(own) + len(b)) for ts in TEMPLATES.values() for b in [bigrams(normalised(x)) for x in ts]), default=0) if own else 0
            found = scanner.best(words)
            assert (found[0] if found else 0) == (best if best >= scanner.threshold else 0)


def chained(*values):
    """XXH64 of several 64-bit values, each with the hash before it as its seed."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64(v.to_bytes(8, "little"), seed=seed).intdigest()
    return seed


def signed(x):
    return x - 2**64 if x >> 63 else x


def brute_anchors(text):
    """(position, anchor) of closed syncmers in plain Python: windows of eight tokens, inner substrings of three."""
    if not text:
        return []
    pieces = [p for run in text.split(" ") for p in ([run[i : i + 4] for i in range(0, len(run), 4)] or [""])]
    hashed = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in pieces]
    if len(hashed) < 8:
        return [(0, chained(*hashed) & 0xFFFFFFFF)]
    out = []
    for i in range(len(hashed) - 7):
        inner = [signed(chained(*hashed[j : j + 3])) for j in range(i, i + 6)]
        if min(inner) in (inner[0], inner[-1]):
            out.append((i, chained(*(inner[j] % 2**64 for j in (0, 3, 5))) & 0xFFFFFFFF))
    return out


def alike(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 1.0


@pytest.mark.parametrize("rows_a_bucket", [500, 2])
def test_fingerprints(spark, make, odd, monkeypatch, rows_a_bucket):
    monkeypatch.setattr(syncmers, "ROWS_A_BUCKET", rows_a_bucket)
    monkeypatch.setattr(syncmers, "SAMPLES", 1)
    monkeypatch.setattr(syncmers, "FAN", 2)
    wide = [(-(2**63), "the lowest id of all"), (2**63 - 1, "the highest id of all, far away"), (10**12, "x y z")]
    rows = [*dict.fromkeys(r for r in odd if r[0] is not None), *wide]
    got = {r["doc_id"]: r for r in fingerprint_documents(make(rows)).collect()}
    order = sorted(rows, key=lambda r: r[0])
    for k, (i, text) in enumerate(order):
        r, text, after = got[i], text or "", order[(k + 1) % len(order)][1] or ""
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut] if cut else text
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = brute_anchors(text), brute_anchors(edited), brute_anchors(after)
        own, other, third = ({h for _, h in x} for x in (a, b, c))
        assert (r["near_edited"], r["near_next"], r["aligned_edited"]) == pytest.approx((alike(own, other), alike(own, third), alike(a, b)))
        for name, found in (("fingerprint", own), ("edited_fingerprint", other)):
            assert r[name] == hashlib.sha256(",".join(map(str, sorted(found))).encode()).hexdigest()
    same = {r["fingerprint"] for r in fingerprint_documents(make([(1, "a b c d e"), (2, "a b c d e"), (None, "a b c d e"), (None, "a b c d e")])).collect()}
    assert len(same) == 1
    assert fingerprint_documents(make([])).count() == 0 and fingerprint_documents(make(odd)).count() == len(odd)


def test_anchors_do_not_depend_on_context(spark):
    passage = " ".join(f"w{i * i % 97}" for i in range(60))
    df = spark.createDataFrame([(passage,), ("some other words come first " + passage,)], "text string")
    a, b = [[(x["position"], x["anchor"]) for x in r[0]] for r in df.select(anchors(F.col("text"))).collect()]
    assert a == brute_anchors(passage) and 0.2 < len(a) / len(passage.split()) < 0.6
    # some, othe, r, word, s, come, firs, t
    assert {(p + 8, h) for p, h in a} <= set(b)
