"""Exact and near dedup against brute force."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
import xxhash

from veridelta.llm import exact_dedup, simhash
from veridelta.llm.components import components

SCHEMA = "doc_id long, text string, fp long, _t string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 7, "clash") for i, t in rows], SCHEMA).repartition(3)


def lowered(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def plain_fingerprint(text, words=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, radius=4):
    """Root (least place) of each, over all pairs within the radius."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(fps)), 2):
        if bin(fps[i] ^ fps[j]).count("1") <= radius:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(fps))]


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    base = [" ".join(rng.choices("abcdefghij", k=rng.randint(1, 60))) for _ in range(n // 3)]
    out = []
    for i in range(n):
        words = rng.choice(base).split()
        if rng.random() < 0.5:
            words[rng.randrange(len(words))] = "changed"
        out.append((i + 1, " ".join(words).upper() if rng.random() < 0.2 else " ".join(words)))
    return out + [(901, None), (902, ""), (903, " \t\n"), (904, "İ ÀÉ straße"), (905, "İ àé straße"), (906, "x " * 20_000)]


@pytest.mark.parametrize("direct", [simhash.DIRECT, 1])
def test_near_duplicates(spark, direct):
    rows = corpus()
    rows += rows[:2]  # repeated rows
    got = simhash.near_duplicates(docs(spark, rows), direct=direct).collect()
    want_fp = {i: plain_fingerprint(t) for i, t in rows}
    ids = sorted(want_fp)
    roots = plain_components([want_fp[i] for i in ids])
    want = {i: (f"{want_fp[i]:016x}", ids[r]) for i, r in zip(ids, roots)}
    assert sorted(r["doc_id"] for r in got) == sorted(i for i, _ in rows)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == want
    assert want[901] == ("0" * 16, 901) and want[903][1] == 901


def test_links_of_random_fingerprints(spark):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    fps = {0, (1 << 64) - 1}
    for c in centres:
        for _ in range(25):
            x = int(c)
            for b in rng.choice(64, rng.integers(0, 7), replace=False):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    want = plain_components(fps)
    nodes = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
    for direct in (8192, 2):
        found = components(simhash.links(nodes, direct=direct)).collect()
        root = {r["node"]: r["root"] for r in found}
        groups = {}
        for x, w in zip(fps, want):
            groups.setdefault(w, set()).add(root.get(simhash._signed(x), simhash._signed(x)))
        assert all(len(g) == 1 for g in groups.values()) and len(set.union(*groups.values())) == len(groups)


def test_masks_cover_every_pair():
    masks = simhash.covering_masks()
    assert len(masks) == 31
    rng = random.Random(0)
    for _ in range(3000):
        bits = rng.sample(range(64), rng.randint(0, 4))
        x = sum(1 << b for b in bits)
        assert any(not x & m for m in masks)


@pytest.mark.parametrize("few", [0, 60, 10**6])  # contracted to the end, at first, not at all
def test_components_of_a_long_chain(spark, few):
    edges = spark.range(500).selectExpr("id as a", "id + 1 as b").union(spark.createDataFrame([(1000, 1001), (5, 5)], "a long, b long"))
    found = {r["node"]: r["root"] for r in components(edges, few).collect()}
    assert len({found[i] for i in range(501)}) == 1 and found[1000] == found[1001] != found[0]


def test_keep_one_of_each_component(spark):
    rows = corpus(3) + [(None, "a null id"), (1, "another text of id 1, quite different from it all")]
    df = docs(spark, rows)
    found = {(r["doc_id"], r["text_hash"]): r["component_id"] for r in simhash.near_duplicates(df).collect()}
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    rows_kept = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert len(rows_kept) == len(set(rows_kept)) == len(set(found.values()))


def test_near_duplicates_of_nothing(spark):
    none = docs(spark, corpus()).limit(0)
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0
    only_null = spark.createDataFrame([(None, None), (None, None)], "doc_id long, text string")
    assert [r["component_id"] for r in simhash.near_duplicates(only_null).collect()] == [None, None]


def plain_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(lowered(t), []).append(i)
    out = []
    for i, t in rows:
        ids = groups[lowered(t)]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(lowered(t).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot_rows, share", [(64, 1000), (2, 20)])
def test_exact_duplicates(spark, monkeypatch, hot_rows, share):
    """The same result whether groups are salted or not."""
    monkeypatch.setattr(exact_dedup, "HOT_ROWS", hot_rows)
    monkeypatch.setattr(exact_dedup, "HOT_SHARE", share)
    rng = random.Random(2)
    rows = [(i, rng.choice(["Same", "same", "SAME", "İ", "i̇", "É", "é", "", None, f"t{i % 9}"])) for i in range(120)]
    rows += rows[:3] + [(None, "nulls"), (None, "nulls"), (None, "same"), (500, "long " * 30_000), (501, "LONG " * 30_000)]
    got = exact_dedup.exact_duplicates(docs(spark, rows))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_exact(rows)
    kept = [lowered(r["text"]) for r in exact_dedup.keep_one(docs(spark, rows)).collect()]
    assert sorted(kept) == sorted({lowered(t) for _, t in rows})


def test_exact_duplicates_of_nothing(spark):
    none = docs(spark, [(1, "x")]).limit(0)
    assert exact_dedup.exact_duplicates(none).count() == 0
    assert exact_dedup.keep_one(none).columns == none.columns


def test_equal_digests_alone_merge_nothing(spark, monkeypatch):
    """With a broken digest the whole texts still part the groups."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup.F, "sha2", lambda *_: F.lit("00"))
    got = exact_dedup.exact_duplicates(docs(spark, [(1, "a"), (2, "b"), (3, "A")])).collect()
    assert {r["doc_id"]: r["keep_id"] for r in got} == {1: 3, 2: 2, 3: 3}


def test_dedup_plans_stay_in_the_jvm(spark):
    plan = exact_dedup.exact_duplicates(docs(spark, [(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
