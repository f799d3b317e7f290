"""SimHash components and passage removal against brute force."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from weftgraph.llm import simhash, substring
from weftgraph.llm.components import components


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def brute_fp(t):
    ws = words(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    if not ws:
        return 0
    k = min(3, len(ws))
    hs = [xxh64_intdigest(" ".join(ws[i : i + k]).encode(), 42) for i in range(len(ws) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.fixture(scope="module")
def rows(spark):
    real = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    base = real[3][1].split()
    rng = random.Random(3)
    near = []
    for i in range(90):  # one tight group, so that a bucket is over its limit below
        ws = list(base)
        for _ in range(rng.randrange(3)):
            ws[rng.randrange(len(ws))] = f"zz{i}"
        near.append((5000 + i, " ".join(ws)))
    odd = [(9000, None), (9001, ""), (9002, "Ein"), (9003, "EIN"), (9004, "a b"), (9005, "Ä b C"), (9006, " \x0b"), (9002, "Ein")]
    return real + near + odd


def test_fingerprints_and_components(spark, rows):
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id bigint, text string, fp int")
    fps = {k: brute_fp(t) for k, t in rows}
    ks = sorted(fps)
    linked = [(a, b) for i, a in enumerate(ks) for b in ks[i + 1 :] if (fps[a] ^ fps[b]).bit_count() <= 2]
    want = brute_components(ks, linked)
    for bucket in (64, 3):
        got = simhash.near_duplicates(df, bucket=bucket).select("doc_id", simhash.hex16(F.col("fp")).alias("h"), "component_id").collect()
        assert len(got) == len(rows)
        assert {(r[0], r[1], r[2]) for r in got} == {(k, f"{fps[k]:016x}", want[k]) for k in ks}


def test_components_of_chain_and_hub(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}}


def brute_removed(docs):
    first = {}
    for k, t in docs:
        ws = words(t)
        for i in range(len(ws) - 49):
            w = tuple(ws[i : i + 50])
            first[w] = min(first.get(w, k), k)
    out = []
    for k, t in docs:
        ws, cut = words(t), set()
        for i in range(len(ws) - 49):
            if first[tuple(ws[i : i + 50])] < k:
                cut.update(range(i, i + 50))
        kept = " ".join(w for i, w in enumerate(ws) if i not in cut)
        out.append((k, len(ws), len(cut), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def passages():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(300)]
    fresh = lambda n: [rng.choice(vocab) for _ in range(n)]
    shared = [fresh(n) for n in (50, 51, 60, 200, 49)]
    docs = []
    for k in range(120):
        ws = []
        for _ in range(rng.randrange(1, 5)):
            ws += fresh(rng.randrange(0, 80))
            if rng.random() < 0.6:
                p = list(rng.choice(shared))
                if rng.random() < 0.3:
                    p[rng.randrange(len(p))] = "changed"
                ws += p * rng.choice((1, 1, 1, 2))
        docs.append((k, rng.choice((" ", "\n")).join(ws)))
    docs += [(200, "a " * 130), (201, "a " * 49), (202, "a " * 50), (203, "a b " * 80), (204, "b a " * 40), (205, None), (206, ""), (0, docs[5][1]), (207, docs[207 % 9][1])]
    return docs


@pytest.mark.parametrize("shard", [4096, 2])
def test_passages(spark, shard):
    docs = passages()
    df = spark.createDataFrame([(k, t, "x") for k, t in docs], "doc_id bigint, text string, start string")
    got = sorted(tuple(r) for r in substring.dedup_passages(df, shard=shard, with_text=False).collect())
    assert got == brute_removed(docs)
    if shard > 2:
        real = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
        df = spark.createDataFrame(real, "doc_id bigint, text string")
        assert sorted(tuple(r) for r in substring.dedup_passages(df, with_text=False).collect()) == brute_removed(real)


def test_automaton_statistics():
    rng = random.Random(1)
    for _ in range(200):
        seqs = [[rng.randrange(3) for _ in range(rng.randrange(12))] for _ in range(4)]
        sam = substring.Automaton()
        for s in seqs:
            sam.add(s)
        probe = [rng.randrange(4) for _ in range(15)]
        has = lambda p: any(s[i : i + len(p)] == p for s in seqs for i in range(len(s) - len(p) + 1))
        want = [max(n for n in range(i + 2) if n == 0 or has(probe[i - n + 1 : i + 1])) for i in range(len(probe))]
        assert list(sam.statistics(probe)) == want


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert simhash.near_duplicates(df).count() == 0 and substring.dedup_passages(df).count() == 0
