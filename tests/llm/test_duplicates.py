"""Exact, near and passage duplicates against brute force."""

import hashlib
from collections import Counter
from itertools import combinations

import pytest
import xxhash

from factloom.llm.exact_dedup import digests, exact_duplicates, stream_state
from factloom.llm.simhash import near_duplicates, near_links
from factloom.llm.suffix_dedup import remove_repeats


def lowered(text):
    return (text or "").encode().lower()


@pytest.mark.parametrize("digest_bytes", [32, 1])
def test_exact(make, odd, digest_bytes):
    rows = odd + [(20 + i, f"text {i % 4}") for i in range(40)]
    groups = {}
    for i, t in rows:
        groups.setdefault(lowered(t), []).append(i)
    want = []
    for i, t in rows:
        g = groups[lowered(t)]
        keep = max((x for x in g if x is not None), default=None)
        want.append((i, keep, len(g), i == keep, hashlib.sha256(lowered(t)).hexdigest()))
    assert sorted(map(tuple, exact_duplicates(make(rows), digest_bytes).drop("x").collect()), key=repr) == sorted(want, key=repr)


def test_a_later_stream_goes_on_where_the_last_ended(spark, make, tmp_path):
    source, state = str(tmp_path / "digests"), str(tmp_path / "state")
    for rows in ([(1, "a"), (2, "b"), (3, "A")], [(4, "a"), (5, "c")]):
        digests(make(rows)).write.mode("append").parquet(source)
        got = {(r["keep_id"], r["n_rows"], r["n_bytes"]) for r in stream_state(spark, source, state).collect()}
    assert got == {(4, 3, 1), (2, 1, 1), (5, 1, 1)}
    assert len(list((tmp_path / "state" / "changes").glob("batch=*"))) == 2  # the second run read the new file alone


def test_exact_of_nothing(make):
    assert exact_duplicates(make([])).count() == 0


def brute_print(text):
    words = lowered(text).split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(ids, links):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_near(make, odd):
    base = odd[7][1]
    rows = odd + [(50 + i, base + f" tail{i % 5}") for i in range(12)]
    got = near_duplicates(make(rows)).collect()
    prints = {(r["doc_id"], r["fingerprint"]) for r in got}
    assert prints == {(i, f"{brute_print(t):016x}") for i, t in rows}
    known = {i: brute_print(t) for i, t in rows if i is not None}
    want = roots(known, [(a, b) for a, b in combinations(known, 2) if (known[a] ^ known[b]).bit_count() <= 3])
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == want
    assert len(got) == len(rows)
    assert near_duplicates(make([])).count() == 0


@pytest.mark.parametrize("tile", [2000, 3])
def test_links_of_buckets_in_tiles(spark, tile):
    prints = [(1 << (i % 40)) | (1 << ((i * 7) % 40)) for i in range(60)]
    prints = sorted(set(prints))
    classes = spark.createDataFrame([(p, i) for i, p in enumerate(prints)], "fp bigint, rep bigint")
    links = [tuple(r) for r in near_links(classes, 3, tile=tile).collect()]
    assert all((prints[a] ^ prints[b]).bit_count() <= 3 for a, b in links)
    every = [(a, b) for a, b in combinations(range(len(prints)), 2) if (prints[a] ^ prints[b]).bit_count() <= 3]
    assert roots(range(len(prints)), links) == roots(range(len(prints)), every)


@pytest.mark.parametrize("tile", [8192, 1])
def test_passages(make, odd, tile):
    passage = "".join(f"passage {i} of many. " for i in range(25))
    rows = odd + [(60 + i, f"start {i} " * 9 + passage[i : 400 - i] + f" end {i}" * 9) for i in range(8)] + [(80, passage[:199]), (81, "zz" + passage[:201]), (82, "ab" * 300)]
    once = "".join(f"only {i} here, " for i in range(40))
    rows += [(None, once), (None, once.replace("only", "here")), (None, passage), (80, passage), (82, once.replace("here", "there"))]
    seen = Counter(w for _, t in rows for w in windows((t or "").encode()))
    want = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = [False] * len(raw)
        for k, w in enumerate(windows(raw)):
            if seen[w] > 1:
                gone[k : k + 200] = [True] * 200
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        runs = sum(g and not before for g, before in zip(gone, [False, *gone], strict=False))
        want.append((i, len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    assert sorted(map(tuple, remove_repeats(make(rows), tile=tile).collect()), key=repr) == sorted(want, key=repr)
    assert remove_repeats(make([])).count() == 0


def windows(raw):
    return [raw[k : k + 200] for k in range(len(raw) - 199)]
