"""The pipeline's near stage against brute force over five-word shingle sets."""

import random
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as cp
from factloom.llm import near_sets
from factloom.llm.near_sets import near_groups, shingle_set, spanning_pairs
from factloom.llm.simhash import fingerprint


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_stage_finds_every_pair_at_the_threshold(make, odd):
    luck, texts = random.Random(7), []
    for group in range(60):
        words = [f"w{luck.randrange(5000)}" for _ in range(luck.randrange(60, 300))]
        texts.append(" ".join(words))
        for edits in (1, 2, 3, 4, 6):
            copy = list(words)
            for _ in range(edits):
                copy[luck.randrange(len(copy))] = f"new{luck.randrange(10**6)}"
            texts.append(" ".join(copy))
    rows = [*odd, *((100 + i, t) for i, t in enumerate(texts))]
    known = {(i, t): shingles(t) for i, t in rows if i is not None}
    parent = {k: k for k in known}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for (a, x), (b, y) in combinations(known.items(), 2):
        both = len(x & y)
        if x == y or 5 * both >= 4 * (len(x) + len(y) - both):
            a, b = sorted([root(a), root(b)], key=lambda k: (k[0], k[1] or ""))
            parent[b] = a
    want = sorted(i for i, t in rows if i is not None and root((i, t))[0] == i)
    kept = [r["doc_id"] for r in cp.near_stage(None, make(rows), "").collect()]
    assert sorted(i for i in kept if i is not None) == want and kept.count(None) == 1
    assert cp.near_stage(None, make([]), "").count() == 0


def test_spanning_pairs_against_all_pairs():
    luck = random.Random(3)
    base = [f"w{i}" for i in range(80)]
    sets = []
    for _ in range(120):
        words = list(base)
        for _ in range(luck.randrange(5)):
            words[luck.randrange(80)] = f"x{luck.randrange(10**6)}"
        sets.append(shingle_set(" ".join(words)))
    got = spanning_pairs(np.concatenate(sets).view(np.int64), np.cumsum([len(s) for s in sets]))
    part = list(range(120))
    for links in (got, [(i, j) for i, j in combinations(range(120), 2) if 9 * len(np.intersect1d(sets[i], sets[j])) >= 4 * (len(sets[i]) + len(sets[j]))]):
        own = list(range(120))
        for i, j in links:
            a, b = own[i], own[j]
            own = [min(a, b) if x in (a, b) else x for x in own]
        part, before = own, part
    assert part == before and len(got) == 120 - len(set(part)) and 1 < len(set(part)) < 120


def test_a_large_bucket_is_cut_into_chunks(make):
    luck = random.Random(5)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(luck.randrange(7)):
            words[luck.randrange(90)] = f"x{luck.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    whole, cut = ({r["doc_id"]: r["component_id"] for r in near_groups(make(rows), tile).collect()} for tile in (1000, 7))
    known = {i: shingles(t) for i, t in rows}
    own = {i: i for i in known}
    for i, j in combinations(known, 2):
        both = len(known[i] & known[j])
        if 5 * both >= 4 * (len(known[i]) + len(known[j]) - both):
            a, b = own[i], own[j]
            own = {k: min(a, b) if x in (a, b) else x for k, x in own.items()}
    assert whole == cut == own and 1 < len(set(own.values())) < 60


def test_simhash_blocks_link_near_texts_without_bands(make):
    """With bands that no two classes share, the pairs within the SimHash radius are still found and verified."""
    luck = random.Random(11)
    texts = []
    for _ in range(30):
        words = [f"w{luck.randrange(5000)}" for _ in range(400)]
        texts += [" ".join(words), " ".join([*words[:-1], "other"]), " ".join(words[:200]), " ".join([*words[:399], "end"])]
    docs = make(list(enumerate(texts)))
    prints = {r["c"]: r for r in near_sets.prints_of(docs).collect()}
    classes = near_sets.prints_of(docs).withColumn("bands", F.array("c"))
    got = {frozenset((r["a"], r["b"])) for r in near_sets.near_links(docs, classes).collect()}
    known = {c: shingles(texts[r["doc_id"]]) for c, r in prints.items()}
    close = {frozenset(p) for p in combinations(known, 2) if ((prints[p[0]]["fp"] ^ prints[p[1]]["fp"]) & (2**64 - 1)).bit_count() <= 3}
    good = {p for p in close for x, y in [[known[c] for c in p]] if 5 * len(x & y) >= 4 * len(x | y)}
    assert all(prints[c]["fp"] & (2**64 - 1) == fingerprint(texts[r["doc_id"]], 5) for c, r in prints.items())
    assert len(good) > 20 and got <= good

    def parts(links):
        own = {c: c for c in known}
        for a, b in (tuple(p) for p in links):
            a, b = own[a], own[b]
            own = {c: min(a, b) if x in (a, b) else x for c, x in own.items()}
        return own

    assert parts(got) == parts(good)
