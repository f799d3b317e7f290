"""Operator 8: near-duplicates by SimHash fingerprints and pigeonhole blocks.

A fingerprint of 64 bits is the bitwise majority of the hashes of a text's word shingles. Two that
differ in at most two bits agree in at least two of four blocks, so they meet in a bucket of one of
the six pairs of blocks; pairs that meet are verified. Only distinct fingerprints take part: copies
share one.

A bucket with many fingerprints would give pairs by the square of its size. Its members are linked
through midpoints instead: two fingerprints differ in at most two bits exactly if some value is at
most one bit from either, so each emits the 65 values within one bit of it, and equal values
link. That finds the same links in linear space.

Near copies at a similarity of 0.8 are farther apart than two bits; ``near_copies`` finds those.

Defined cases: a null text or one without words has fingerprint zero and is linked like any other;
one or two words are one shingle; texts are read whole; repeated rows each get a row; a null id is
never a component's name unless no other is there; an empty table gives an empty result; columns
other than key and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.llm.common import stage
from weftgraph.llm.components import components
from weftgraph.session import prepare

SEED = 42
BITS, BLOCKS, DISTANCE = 64, 4, 2
#: Fingerprints in a bucket up to which its pairs are joined.
BUCKET = 64
_STEP = 1 << 15


def fingerprint(text: str | None, width: int = 3) -> int:
    """The fingerprint of one text, as a signed 64-bit integer."""
    from xxhash import xxh64_intdigest

    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not ws:
        return 0
    width = min(width, len(ws))
    line = b" ".join(ws)
    stops = list(accumulate(len(w) + 1 for w in ws))
    m = len(ws) - width + 1
    starts = [0, *stops[: m - 1]]
    ones = np.zeros(64, np.int64)
    for at in range(0, m, _STEP):
        part = zip(starts[at : at + _STEP], stops[at + width - 1 : at + width - 1 + _STEP])  # noqa: B905
        h = np.array([xxh64_intdigest(line[a : b - 1], SEED) for a, b in part], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > m, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(key, ``fp``) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t, width) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["k", "fp"])

    prepare(docs.sparkSession)
    narrow = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    return narrow.mapInArrow(run, f"k {narrow.schema['k'].dataType.simpleString()}, fp bigint").withColumnRenamed("k", key)


def _keys(fp: Column) -> Column:
    """A key for each choice of blocks that must agree."""
    width = BITS // BLOCKS
    block = lambda i: F.shiftrightunsigned(fp, width * i).bitwiseAND(F.lit((1 << width) - 1))
    keys = []
    for n, chosen in enumerate(combinations(range(BLOCKS), BLOCKS - DISTANCE)):
        key = F.lit(n).cast("bigint")
        for i in chosen:
            key = F.shiftleft(key, width).bitwiseOR(block(i))
        keys.append(key)
    return F.array(*keys)


def links(distinct: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between distinct ``fp`` that differ in at most two bits.

    They connect all that any such link connects, whatever ``bucket`` is.
    """
    differ = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    keyed = distinct.select("fp", F.explode(_keys(F.col("fp"))).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = stage(keyed.join(sizes, "key"))
    cold = met.where(F.col("n") <= bucket).select("fp", "key")
    a, b = cold.withColumnRenamed("fp", "a"), cold.withColumnRenamed("fp", "b")
    found = a.join(b, "key").where((F.col("a") < F.col("b")) & (differ <= DISTANCE)).select("a", "b")

    hot = met.where(F.col("n") > bucket)
    flips = F.array(F.lit(0).cast("bigint"), *[F.lit(x if x < 1 << 63 else x - (1 << 64)).cast("bigint") for x in (1 << i for i in range(BITS))])
    near = hot.select("fp").distinct().select("fp", F.explode(F.transform(flips, lambda x: x.bitwiseXOR(F.col("fp")))).alias("mid"))
    # at most 65 fingerprints are within one bit of a value, so these groups are small
    stars = near.select("fp", F.min("fp").over(Window.partitionBy("mid")).alias("b")).where("fp <> b").select(F.col("fp").alias("a"), "b")
    return found.union(stars).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, bucket: int = BUCKET) -> DataFrame:
    """(key, ``fp``, ``component_id``) of each document; the component is named by its least key."""
    fps = stage(fingerprints(docs, key, text, width))
    distinct = stage(fps.groupBy("fp").agg(F.min(key).alias("least")))
    found = components(links(distinct, bucket))
    named = distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    # only fingerprints with links need the minimum of their component
    linked = named.where(F.col("label") != F.col("fp")).select("label").distinct()
    least = named.join(linked, "label").groupBy("label").agg(F.min("least").alias("first"))
    of = named.join(least, "label", "left").select("fp", F.coalesce("first", "least").alias("component_id"))
    return fps.join(of, "fp").select(key, "fp", "component_id")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
