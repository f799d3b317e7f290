"""Near copies of five-word similarity 0.8 against brute force over all pairs."""

import random

import numpy as np
import pytest

from weftgraph.llm import near_copies
from weftgraph.llm.components import components


def brute(rows):
    """The class of each key by all pairs, and the linked pairs."""

    def shingles(t):
        ws = (t or "").encode().lower().split()
        return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()

    sets = {k: shingles(t) for k, t in rows}
    ks = sorted(sets)
    parent = {k: k for k in ks}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    linked = []
    for i, a in enumerate(ks):
        for b in ks[i + 1 :]:
            both = len(sets[a] & sets[b])
            if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                linked.append((a, b))
                a1, b1 = find(a), find(b)
                parent[max(a1, b1)] = min(a1, b1)
    return {k: find(k) for k in ks}, linked


@pytest.fixture(scope="module")
def rows(spark):
    """Real documents, copies with edits about the bound, and documents that share most of a template."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rng = random.Random(7)
    word = lambda: f"q{rng.randrange(10**6)}"
    at = 10**6
    for edits in [*range(1, 9)] * 6:  # a similarity from 0.97 to 0.6
        ws = [word() for _ in range(200)]
        rows.append((at, " ".join(ws)))
        for i in rng.sample(range(200), edits):
            ws[i] = word()
        rows.append((at + 1, " ".join(ws)))
        at += 2
    for n in range(10, 40):  # short texts and one word more
        ws = [word() for _ in range(n)]
        rows += [(at, " ".join(ws)), (at + 1, " ".join([*ws, word()]))]
        at += 2
    shared = [word() for _ in range(260)]
    for _ in range(60):
        rows.append((at, " ".join(shared + [word() for _ in range(rng.choice((20, 70, 200)))])))
        at += 1
    return [*rows, (at, None), (at + 1, ""), (at + 2, "Ein"), (at + 3, "EIN"), (at + 4, "a b"), (at + 4, "a b")]


def test_classes_are_those_of_similarity_four_fifths(spark, rows):
    want, linked = brute(rows)
    assert len(linked) > 200
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id bigint, text string, id int, f0 string")
    results = []
    for members, shingles in ((2000, 2_000_000), (8, 2_000_000), (2000, 3000), (3, 500)):
        got = near_copies.near_copies(df, members=members, shingles_a_task=shingles).collect()
        assert len(got) == len(rows)
        results.append({r["doc_id"]: r["component_id"] for r in got})
    # bounds of a task change nothing, no class joins what brute force keeps apart, and nearly all links are found
    assert all(r == results[0] for r in results)
    assert all(want[k] == want[c] for k, c in results[0].items())
    assert sum(results[0][a] == results[0][b] for a, b in linked) >= 0.97 * len(linked)
    kept = near_copies.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for c in results[0].values()})


def test_pairs_of_few_bits_in_one_bucket_all_meet(spark):
    """40 pairs at five bits that share a bucket with 400 strangers: found at every bound."""
    rng = np.random.default_rng(11)
    width, keys = near_copies.layout(480)
    chosen = near_copies.blocks(width, keys)[0]
    bits = rng.integers(0, 2, (440, near_copies.BITS), np.uint8)
    bits[:, chosen] = 1
    twins = bits[:40].copy()
    others = np.setdiff1d(np.arange(near_copies.BITS), chosen)
    for row in twins:
        row[rng.choice(others, 5, replace=False)] ^= 1
    fps = np.packbits(np.concatenate([bits, twins]), axis=1, bitorder="little").view(np.int64)
    df = spark.createDataFrame([(i, 100, *map(int, f)) for i, f in enumerate(fps)], "id bigint, n int, " + ", ".join(f"f{i} bigint" for i in range(8)))
    for members in (5000, 64, 16, 3):
        label = {r["node"]: r["label"] for r in components(near_copies.loose_links(df, members)).collect()}
        assert label == {i: i % 440 for i in [*range(40), *range(440, 480)]}


def test_recall_is_the_same_at_every_size():
    for n in (1, 1000, 200_000, 10**7, 10**9):
        width, keys = near_copies.layout(n)
        assert near_copies.blocks(width, keys).shape == (keys, width)
        assert (1 - (1 - near_copies.FLIP) ** width) ** keys <= near_copies.MISS


def test_odd_rows(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string, key_ int, nth_ int")
    assert near_copies.deduplicate(empty).count() == 0 and near_copies.near_copies(empty).count() == 0
    rows = [(None, "a b c", 1, 2), (None, "a b c", 1, 2), (1, None, 3, 4), (2, " ", 5, 6), (2, " ", 5, 6), (3, "x y", 7, 8), (4, "X  Y", 7, 8), (5, "w " * 50_000, 9, 9), (6, "w " * 60_000, 9, 9)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, key_ int, nth_ int")
    got = near_copies.deduplicate(df)
    assert got.columns == df.columns
    assert sorted((r["doc_id"] or 0) for r in got.collect()) == [0, 0, 1, 3, 5]


def test_no_pair_at_the_bound_is_left_out(spark):
    """Pairs of a similarity of four fifths exactly, of 45, 180 and 720 shingles: one part or many."""
    rng = random.Random(17)
    word = lambda: f"q{rng.randrange(10**9)}"
    rows = []
    for edits, pairs in ((1, 400), (4, 300), (16, 30)):
        for _ in range(pairs):
            ws = [word() for _ in range(45 * edits + 4)]
            other = list(ws)
            for i in range(edits):
                other[45 * i + 20] = word()
            rows += [(len(rows), " ".join(ws)), (len(rows) + 1, " ".join(other))]
    got = near_copies.near_copies(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {k: k - k % 2 for k, _ in rows}


def test_keys_of_every_pair_meet():
    """Random sets about the bound, parts of unequal size and any order: a shared key whose parities pass."""
    rng = np.random.default_rng(19)
    pairs = 0
    for trial in range(1500):
        x = np.unique(rng.integers(0, 1 << 63, rng.choice([7, 40, 110, 400, 1700]) + rng.integers(30), np.uint64) << np.uint64(1) >> np.uint64(rng.integers(8)))
        gone = rng.integers(x.size // 5 + 1)
        left = np.delete(x, rng.choice(x.size, gone, replace=False))
        y = np.unique(np.r_[left, rng.integers(0, 1 << 63, max(0, 5 * left.size // 4 - x.size), np.uint64)])
        if 9 * np.intersect1d(x, y).size < 4 * (x.size + y.size):
            continue
        pairs += 1
        often = np.unique(rng.choice(x, x.size // 2 * (trial % 2), replace=False))
        common = (often, rng.integers(4, 50, often.size))
        one, two = (dict(zip(g.tolist(), p, strict=True)) for g, p in (near_copies.first_keys(z, common) for z in (x, y)))
        assert any(np.bitwise_count(one[g] ^ two[g]).sum() <= near_copies._by_part(g, x.size + y.size) for g in one.keys() & two.keys())
    assert pairs > 1000


def test_links_between_two_trees_of_a_large_group(spark):
    """Windows of 100 numbers at steps of 10: 0 reaches 2 and 1 reaches 3 first, and only 2 and 3 link them."""
    rows = [(0, i, 100, list(range(at, at + 100))) for i, at in ((0, 0), (2, 10), (3, 20), (1, 30))]
    df = spark.createDataFrame(rows, "g bigint, id bigint, n int, hs array<bigint>")
    for most in (2, 3, 10):
        label = {r["node"]: r["label"] for r in components(near_copies.exact_links(df, most)).collect()}
        assert label == dict.fromkeys(range(4), 0)
