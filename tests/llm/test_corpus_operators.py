"""Decontamination, language identification, mixing, URL filters and the pipeline."""

import datetime as dt
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from weftgraph.llm import decontaminate, langid, mixing, quality, urls
from weftgraph.llm.queries import QUERIES, mixing_dims

SF = "/root/testdata/sf0.001"


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def shingles(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute_contained(docs, items):
    out = set()
    for i, t in items:
        want = shingles(t)
        for k, x in docs:
            n = len(want & shingles(x))
            if want and 10 * n >= 8 * len(want):
                out.add((k, i, n, len(want)))
    return out


def test_containment(spark):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    ws = words(items[0][1])
    for j, cut in enumerate((0, 2, len(ws) // 7, len(ws) // 4, len(ws) // 2)):
        docs.append((9000 + j, "Lead IN words " + " ".join(ws[cut:]).upper() + " and out"))
    docs += [(9100, None), (9101, ""), (9102, "a b c d e f"), (9102, "a b c d e f"), (None, items[1][1]), (9103, " ".join(x for _, x in items))]
    items += [(900, None), (901, "a b c"), (902, "a b c d e"), (903, "x x x x x x x x"), (902, "a b c d e")]
    d = spark.createDataFrame([(k, t, 1) for k, t in docs], "doc_id bigint, text string, hash int")
    i = spark.createDataFrame([(k, t, 1) for k, t in items], "item_id bigint, text string, doc_id int")
    got = {(r[0], r[2], r[3], r[4]) for r in decontaminate.contained(d.select("doc_id", "text"), i).collect()}
    assert got == brute_contained(docs, items) and len(got) > 10
    bad = {k for k, *_ in got}
    left = decontaminate.decontaminate(d, i).collect()
    assert sorted(map(str, (r["doc_id"] for r in left))) == sorted(str(k) for k, _ in docs if k not in bad)


def test_containment_without_broadcast_and_null_ids(spark):
    """Items over the bound of bytes, null ids, and items of very different sizes."""
    rng = np.random.default_rng(3)
    word = lambda: f"v{rng.integers(400)}"
    items = [(None if j % 5 == 0 else j, " ".join(word() for _ in range(int(rng.integers(5, 90))))) for j in range(25)]
    docs = [(None if j % 7 == 0 else j, " ".join([word() for _ in range(9)] + items[j % 25][1].split()[j % 3 :] + [word() for _ in range(j)])) for j in range(60)]
    d = spark.createDataFrame([(*x, "c") for x in docs], "doc_id bigint, text string, key_ string")
    i = spark.createDataFrame(items, "item_id bigint, text string")
    want = brute_contained(docs, items)
    for bound in (0, 1 << 20):
        got = {(r["doc_id"], r["item_id"], r["n_shared"], r["n_shingles"]) for r in decontaminate.contained(d, i, bound=bound).collect()}
        assert got == want and len(got) > 30
    assert decontaminate.decontaminate(d, i).columns == d.columns


def test_containment_of_nothing(spark):
    d, i = spark.createDataFrame([(1, "a b c d e f")], "doc_id bigint, text string"), spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.contained(d, i).count() == 0 and decontaminate.decontaminate(d.limit(0), i).count() == 0


def test_languages(spark):
    got = {r["doc_id"]: r for r in QUERIES["op7_language_id"](spark, "/root/testdata/sf0.01").collect()}
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert all(got[r["doc_id"]]["held_out"] for r in held) and sum(x["held_out"] for x in got.values()) == len(held)
    assert np.mean([got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held]) >= 0.97
    assert all(0 <= x["score"] <= 1 for x in got.values())


def test_language_cases(spark):
    rows = [(i, t, v) for i in range(40) for t, v in ((f"the and of with that {i}", "en"), (f"der die und nicht mit {i}", "de"), (f"le la les des et que {i}", "fr"))]
    rows = [(3 * i + j, t, v) for i, (j, t, v) in enumerate((i % 3, t, v) for i, t, v in rows)]
    odd = [(1000, None, "en"), (1001, "", None), (1002, "12 !!", "de"), (None, "und die", "de"), (1003, "the of and", None)]
    df = spark.createDataFrame(rows + odd, "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(df).collect()}
    assert [got[k] for k in (1000, 1001, 1002)] == ["und"] * 3 and got[1003] == "en" and got[None] == "de"
    assert {r["lang_pred"] for r in langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert {r["lang_pred"] for r in langid.identify(df.withColumn("lang", F.lit("xx"))).collect()} == {"und", "xx"}
    assert langid.identify(df.limit(0)).count() == 0


def test_features_do_not_depend_on_pieces(monkeypatch):
    text = "Grüße an die Welt, 12 fois là-bas! " * 20
    whole = langid.features(text)
    for size in (3, 7, 64):
        monkeypatch.setattr(langid, "_CHUNK", size)
        assert np.allclose(langid.features(text), whole)


def test_raking(spark):
    rng = np.random.default_rng(0)
    rows = [(i, "w " * int(rng.integers(1, 9)), f"s{rng.integers(3)}", ["en", "de", None][rng.integers(3)]) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")
    dims = {"source": F.col("source"), "lang": F.col("lang")}
    tokens = mixing.token_count(F.col("text"))
    targets = {
        "source": spark.createDataFrame([("s0", 0.5), ("s1", 0.3), ("s2", 0.2)], "value string, share double"),
        "lang": spark.createDataFrame([("en", 0.6), ("de", 0.3), (None, 0.1)], "value string, share double"),
    }
    drawn, at = mixing.mix(df, dims, tokens, targets, keep=0.4)
    got = [{n: r[at[n]] for n in at} for r in drawn.collect()]
    assert len(got) == len(rows)
    base = defaultdict(float)
    for r in got:
        base[r["source"], r["lang"]] += r["tokens"]
    w = brute_rake(base, [{"s0": 0.5, "s1": 0.3, "s2": 0.2}, {"en": 0.6, "de": 0.3, None: 0.1}])
    for r in got:
        k = r["source"], r["lang"]
        assert r["rate"] == pytest.approx(w[k] * sum(base.values()) / base[k], rel=1e-4)
    expected = sum(r["tokens"] * r["prob"] for r in got)
    assert expected == pytest.approx(0.4 * sum(base.values()), rel=1e-6)
    kept = sum(r["tokens"] for r in got if r["kept"])
    assert kept == pytest.approx(expected, rel=0.15)
    assert mixing.mixed(df, dims, tokens).columns == df.columns
    assert mixing.mixed(df.limit(0), dims, tokens).count() == 0


def test_raking_by_factors_is_raking_by_windows(spark, monkeypatch):
    rng = np.random.default_rng(2)
    cells = [(a, b, int(rng.integers(0, 50))) for a in ("x", "y", None) for b in ("p", "q", "r")]
    df = spark.createDataFrame(cells, "a string, b string, tokens bigint")
    targets = {"a": spark.createDataFrame([("x", 0.5), (None, 0.3), ("y", 0.2), ("zz", 0.0)], "value string, share double"), "b": mixing.tempered_targets(df, "b")}
    few = mixing.rake(df, targets)
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 2)
    many = mixing.rake(df, targets)
    of = lambda r: {(x["a"], x["b"]): x["w"] for x in r.cells.collect()}
    assert of(few) == pytest.approx(of(many), abs=1e-5) and few.off <= 1e-6 and many.off <= 1e-6 and len(of(few)) == sum(c > 0 for *_, c in cells)


def brute_rake(base, targets):
    w = {k: v / sum(base.values()) for k, v in base.items() if v}
    for _ in range(300):
        for axis, want in enumerate(targets):
            have = defaultdict(float)
            for k, v in w.items():
                have[k[axis]] += v
            w = {k: v * want.get(k[axis], 0) / have[k[axis]] for k, v in w.items()}
    return w


def brute_keywords(texts, lang):
    """Of the texts of one language."""
    df, n = defaultdict(int), len(texts)
    for t in texts:
        for x in set(re.findall(r"[^\W\d_]{5,}", (t or "").lower())):
            df[x] += 1
    weight = lambda k: np.log(n / k)
    ok = [(x, k) for x, k in df.items() if max(2, 0.02 * n) <= k <= 0.3 * n]
    return [(x, weight(k)) for x, k in sorted(ok, key=lambda p: (-p[1] * weight(p[1]), hashed(p[0], lang)))[: mixing.TOPICS]]


def hashed(word, lang):
    h = xxhash.xxh64_intdigest(word, 42)
    h = h if lang is None else xxhash.xxh64_intdigest(lang, h)
    return h - (1 << 64) if h >> 63 else h


def test_mixing_query(spark):
    """The registered query against plain Python: topics, tempered targets, raking, the scale of the draw."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r["doc_id"]: r for r in QUERIES["op9_mixing"](spark, SF).collect()}
    words_ = {v: brute_keywords([r["text"] for r in docs if r["lang"] == v], v) for v in {r["lang"] for r in docs}}
    learned = mixing.keywords(spark.read.parquet(f"{SF}/documents.parquet"))
    assert {v: [w for w, _ in own] for v, own in learned.items()} == {v: [hashed(w, v) for w, _ in own] for v, own in words_.items() if own}
    cell, tokens = {}, {}
    for r in docs:
        t = r["text"] or ""
        low = t.lower()
        hits = [len(re.findall(rf"(?<![^\W\d_]){re.escape(w)}(?![^\W\d_])", low)) * idf for w, idf in words_[r["lang"]]]
        cell[r["doc_id"]] = (r["source"], r["lang"], f"k{hits.index(max(hits)) + 1}" if max(hits, default=0) else None)
        tokens[r["doc_id"]] = len(re.findall(r"[^\x20\x09-\x0D]+", t))
    assert all(got[k]["n_tokens"] == tokens[k] and got[k]["topic"] == cell[k][2] for k in got) and len(got) == len(docs)
    base = defaultdict(float)
    for k, c in cell.items():
        base[c] += tokens[k]
    targets = []
    for axis in range(3):
        own = defaultdict(float)
        for c, v in base.items():
            own[c[axis]] += v
        powered = {v: x**mixing.TEMPER for v, x in own.items() if x}
        targets.append({v: x / sum(powered.values()) for v, x in powered.items()})
    w, n = brute_rake(base, targets), sum(base.values())
    rate = {c: w.get(c, 0) * n / base[c] if base[c] else 0.0 for c in base}
    lo, hi = 0.0, 1e9
    for _ in range(200):  # the factor by bisection
        c = (lo + hi) / 2
        lo, hi = (c, hi) if sum(v * min(1, c * rate[k]) for k, v in base.items()) < mixing.KEEP * n else (lo, c)
    for k, r in got.items():
        assert r["weight"] == pytest.approx(rate[cell[k]], abs=2e-4) and r["prob"] == pytest.approx(min(1, lo * rate[cell[k]]), abs=5e-4)


def test_mixing_names_and_impossible_targets(spark):
    kind = "doc_id bigint, text string, lang string, rate_ int, tokens_ int, prob_ int, kept_ int, dim_0 string, value_ string, w string"
    df = spark.createDataFrame([(i, "w " * (i + 1), "en" if i % 2 else None, *[0] * 4, *"abc") for i in range(20)] + [(None, None, None, *[0] * 4, *"abc")], kind)
    dims, tokens = {"lang": F.col("lang")}, mixing.token_count(F.col("text"))
    drawn, at = mixing.mix(df, dims, tokens)
    assert set(df.columns) < set(drawn.columns) and len(drawn.collect()) == 21 and not set(at.values()) & set(df.columns)
    assert mixing.mixed(df, dims, tokens).columns == df.columns
    never = {d: spark.createDataFrame([("en", x), (None, 1 - x)], "value string, share double") for d, x in (("a", 0.2), ("b", 0.7))}
    both = {"a": F.col("lang"), "b": F.col("lang")}
    with pytest.warns(UserWarning, match="off by"):
        mixing.mix(df, both, tokens, never, rounds=2)
    with pytest.raises(ValueError, match="off by"):
        mixing.mix(df, both, tokens, never, rounds=1, strict=True)


def test_urls(spark):
    day = lambda m, d: dt.date(2024, m, d)
    entries = [
        ("a.com", day(1, 10), "add"), ("a.com", day(2, 10), "remove"), ("a.com", day(3, 10), "add"), ("a.com", day(3, 10), "add"),
        ("x.a.com/p", day(1, 1), "add"), ("b.com", day(1, 5), "add"), ("b.com", day(1, 5), "remove"), ("com.", day(1, 1), "add"),
    ]
    caps = [(1, "http://a.com/", day(1, 9)), (2, "http://a.com", day(1, 10)), (3, "https://q.x.a.com:8080/p?z", day(2, 9)), (4, "http://a.com/p", day(2, 10)),
            (5, "HTTP://u:p@X.A.com/p/q", day(3, 11)), (6, "http://ba.com/", day(3, 11)), (7, "http://b.com", day(6, 1)), (8, None, day(6, 1)), (9, "junk", day(6, 1)), (10, "http://a.com", None), (2, "http://a.com", day(1, 10))]
    e = spark.createDataFrame(entries, "pattern string, day date, action string")
    c = spark.createDataFrame(caps, "page_id bigint, url string, fetched date").withColumn("pattern", F.lit("clash"))
    got = sorted((r["page_id"], r["n_matches"], r["pattern"], r["blocked"]) for r in urls.evaluate(c, e).collect())
    hit = {2: (1, "a.com"), 3: (1, "a.com"), 5: (2, "x.a.com/p")}
    assert got == sorted((k, hit.get(k, (0, None))[0], hit.get(k, (0, None))[1], k in hit) for k, *_ in caps)
    assert urls.evaluate(c, e.limit(0)).where("blocked").count() == 0 and urls.evaluate(c.limit(0), e).count() == 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, now = docs.columns, docs
    stages = []
    for name, f in corpus_pipeline.STAGES:
        now = spark.createDataFrame(f(spark, now, SF).collect(), f(spark, now, SF).schema)
        stages.append(now)
        if name != "shard_rows":
            assert now.columns == columns
    good, near, clean, mix, out = ({r["doc_id"]: r for r in s.collect()} for s in stages)
    passed = {r["doc_id"] for r in quality.apply_policy(quality.ledger(docs)).where("kept").collect()}
    assert set(good) == passed
    five = {k: (lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})(r["text"].encode().lower().split()) for k, r in good.items()}
    first = {k: k for k in five}

    def find(x):
        while first[x] != x:
            x = first[x]
        return x

    for a in sorted(five):
        for b in sorted(five):
            if a < b and 5 * len(five[a] & five[b]) >= 4 * len(five[a] | five[b]):
                x, y = find(a), find(b)
                first[max(x, y)] = min(x, y)
    assert set(near) == {find(k) for k in five}
    leaked = {k for k, *_ in brute_contained([(k, r["text"]) for k, r in near.items()], [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])}
    assert set(clean) == set(near) - leaked
    drawn = {r["doc_id"] for r in mixing.mixed(stages[2], mixing_dims(stages[2]), mixing.token_count(F.col("text"))).collect()}
    assert set(mix) == drawn and set(out) == set(mix)
    assert all(out[k]["text"] == mix[k]["text"] for k in out)
    run = corpus_pipeline.run(spark, SF)
    assert {(r["doc_id"]) for r in run.collect()} == set(out)


def test_stages_on_odd_tables(spark):
    """Empty tables, and columns named like those that stages make."""
    kind = "doc_id bigint, text string, lang string, source string, n_chars int, shard string, slot string, kept string, fail_bits string, n string, id string"
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(1, text, "en", "a", 1, *["x"] * 6), (1, text, "en", "a", 1, *["x"] * 6), (2, None, None, None, None, *[None] * 6), (3, "", "en", "b", 0, *["y"] * 6), (None, text + " more", None, None, 1, *["z"] * 6)]
    for df in (spark.createDataFrame([], kind), spark.createDataFrame(rows, kind)):
        now = df
        for name, f in corpus_pipeline.STAGES:
            before, now = now, f(spark, now, SF)
            assert sorted(now.columns) == sorted(before.columns)
        assert {r["doc_id"] for r in now.collect()} <= {1, None}
