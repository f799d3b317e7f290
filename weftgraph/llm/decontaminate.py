"""Operator 1: benchmark decontamination by size-partitioned MinHash containment search.

An item lies in a document if at least ``CONTAINMENT`` of the item's distinct word shingles do.
Documents are long and items short, so a sketch of the document says little; the sketch is taken
of the item. Items are partitioned by their number q of shingles, [2^p, 2^(p+1)). A partition's
items keep as many least hashes as its largest item needs: of q - ceil(tq) + 1 shingles one must be
in any document that holds t of them, and that number grows with q. Each partition has two
thresholds: the largest hash that it sketched, and the shingles that its smallest item needs.

A document of n distinct shingles probes only partitions whose smallest item fits into it, and only
with hashes up to the largest threshold of those. So every match is among the candidates, and each
candidate is verified by the exact containment of shingles, compared as text.

Words are runs of letters and digits, in lower case. Defined cases: null or short texts and items
with fewer words than a shingle have no shingles and match nothing; an item's repeated shingles
count once; a null id is an id like others, for documents and items; texts are read whole; repeated
rows of a document or an item match as one row; empty tables give an empty result; other columns
are not read, and pass through ``decontaminate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import let, small, stage, unused, window_hashes

WIDTH = 5
CONTAINMENT = 0.8
#: Sketch rows (24 bytes), candidates (32 bytes) and documents found up to which they are broadcast.
BROADCAST_ROWS = 500_000
#: Bytes of the items' shingles up to which they are broadcast to the documents found.
BROADCAST_BYTES = 64 << 20


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingles(ws: Column) -> Column:
    """Distinct shingles as text."""

    def spelled(w: Column) -> Column:
        n = F.size(w) - (WIDTH - 1)
        each = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(w, i, WIDTH), " "))
        return F.when(n >= 1, F.array_distinct(each)).otherwise(F.array().cast("array<string>"))

    return let(ws, spelled)


def needed(q: Column, containment: float) -> Column:
    """Shingles that must be shared: the least whole number that is at least t of q, exactly."""
    return F.ceil(q * F.lit(str(containment)).cast("decimal(6,4)")).cast("int")


def sketches(items: DataFrame, containment: float) -> DataFrame:
    """(iid, q, part, hash) of items (iid, words): the least hashes of each, as many as its partition by size keeps."""
    hashed = items.select("iid", F.array_distinct(window_hashes(F.col("words"), WIDTH)).alias("hs")).where(F.size("hs") > 0)
    q = F.size("hs")
    sized = hashed.select("iid", "hs", q.alias("q"), F.floor(F.log2(q.cast("double"))).cast("int").alias("part"))
    kept = sized.groupBy("part").agg(F.max(F.col("q") - needed(F.col("q"), containment) + 1).alias("kept"))
    # a row for each power of two
    return sized.join(F.broadcast(kept), "part").select("iid", "q", "part", F.explode(F.slice(F.sort_array("hs"), F.lit(1), F.col("kept"))).alias("hash"))


def partitions(sketched: DataFrame, containment: float) -> list[tuple[int, int]]:
    """(shingles that its smallest item needs, largest hash) of each partition: some twenty numbers at most."""
    of = sketched.groupBy("part").agg(F.min(needed(F.col("q"), containment)).alias("least"), F.max("hash").alias("top"))
    return sorted((r["least"], r["top"]) for r in of.collect())


def candidates(docs: DataFrame, sketched: DataFrame, containment: float) -> DataFrame:
    """Distinct (doc, tid, iid) that share a sketched shingle, of documents (doc, tid, text)."""

    def probes(hs: Column) -> Column:
        # distinct shingles may be fewer than these, so no partition is left out that a document could match
        top, most = F.lit(-(1 << 63)).cast("bigint"), -(1 << 63)
        for least, highest in partitions(sketched, containment):
            most = max(most, highest)
            top = F.when(F.size(hs) >= least, F.lit(most)).otherwise(top)
        return let(F.struct(hs.alias("hs"), top.alias("top")), lambda x: F.filter(x["hs"], lambda h: h <= x["top"]))

    each = docs.select("doc", "tid", F.explode(let(window_hashes(words(F.col("text")), WIDTH), probes)).alias("hash"))
    return each.join(small(sketched.select("hash", "iid"), BROADCAST_ROWS), "hash").select("doc", "tid", "iid").distinct()


def shared_shingles(found: DataFrame, texts: DataFrame, items: DataFrame, bound: int = BROADCAST_BYTES) -> DataFrame:
    """(doc, tid, iid, n_shared) of candidates (doc, tid, iid): how many of the item's shingles the document has.

    Items within ``bound`` bytes come to the documents; else each pair's item shingles meet the
    document's own, one row for each, and no document's array moves more than once.
    """
    of_item = stage(items.select("iid", shingles(F.col("words")).alias("want")).where(F.size("want") > 0))
    weight = of_item.agg(F.sum(F.aggregate("want", F.lit(0).cast("bigint"), lambda a, s: a + F.octet_length(s) + 24))).first()[0] or 0
    own = F.col("doc").eqNullSafe(F.col("d")) & (F.col("tid") == F.col("u"))
    if weight <= bound:
        by_doc = stage(found.groupBy(F.col("doc").alias("d"), F.col("tid").alias("u")).agg(F.collect_set("iid").alias("found")))
        wanted = texts.join(small(by_doc, BROADCAST_ROWS), own).dropDuplicates(["doc", "tid"])
        each = wanted.select("doc", "tid", shingles(words(F.col("text"))).alias("own"), F.explode("found").alias("iid"))
        return each.join(F.broadcast(of_item), "iid").select("doc", "tid", "iid", F.size(F.array_intersect("want", "own")).alias("n_shared"))
    some = stage(found.select(F.col("doc").alias("d"), F.col("tid").alias("u")).distinct())
    wanted = texts.join(small(some, BROADCAST_ROWS), own, "left_semi").dropDuplicates(["doc", "tid"])
    has = wanted.select(F.col("doc").alias("d"), F.col("tid").alias("u"), F.explode(shingles(words(F.col("text")))).alias("s"))
    asked = found.join(of_item, "iid").select("doc", "tid", "iid", F.explode("want").alias("shingle"))
    return asked.join(has, own & (F.col("shingle") == F.col("s"))).groupBy("doc", "tid", "iid").agg(F.count(F.lit(1)).cast("int").alias("n_shared"))


def contained(
    docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT,
    key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", bound: int = BROADCAST_BYTES,
) -> DataFrame:
    """(doc_id, tid, item_id, n_shared, n_shingles, containment) of every item that lies in a document.

    ``tid``, a hash of the text, tells rows of one key apart.
    """
    named = items.select(F.col(item_key).alias("item"), F.col(item_text).alias("item_text")).distinct()
    listed = stage(named.select("item", words(F.col("item_text")).alias("words"), F.monotonically_increasing_id().alias("iid")))
    texts = docs.select(F.col(key).alias("doc"), F.xxhash64(F.col(text)).alias("tid"), F.col(text).alias("text"))
    sketched = stage(sketches(listed, containment))
    shared = shared_shingles(stage(candidates(texts, sketched, containment)), texts, listed, bound)
    sizes = listed.select("iid", "item", F.size(shingles(F.col("words"))).alias("q"))
    q = F.col("q")
    return shared.join(small(stage(sizes), BROADCAST_ROWS), "iid").where(F.col("n_shared") >= needed(q, containment)).select(
        F.col("doc").alias(key), "tid", F.col("item").alias(item_key), F.col("n_shared").cast("bigint").alias("n_shared"),
        q.cast("bigint").alias("n_shingles"), (F.col("n_shared") / q).alias("containment"),
    ).distinct()


def decontaminate(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents in which no item lies, with all their columns."""
    k, t = unused("key_", docs), unused("tid_", docs)
    bad = contained(docs.select(key, text), items, containment, key, text).select(F.col(key).alias(k), F.col("tid").alias(t)).distinct()
    same = docs[key].eqNullSafe(F.col(k)) & (F.xxhash64(docs[text]) == F.col(t))
    return docs.join(small(stage(bad), BROADCAST_ROWS), same, "left_anti")
