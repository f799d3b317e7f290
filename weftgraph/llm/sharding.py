"""Operator 4: uniform shuffle into shards of exact size.

A communication matrix says how many rows each input partition sends to each shard. Its rows are
drawn one after the other from the multivariate hypergeometric law, which is the law of those
counts under a uniform permutation of all rows. Each partition is permuted locally, its rows are
dealt out by its row of the matrix, and each shard is permuted again. Only the counts of partitions
(a number for each task, as Spark's driver holds anyway) reach the driver, which draws a number for
each partition and shard: some 20 microseconds each, so 100,000 partitions and 64 shards take two
minutes.

Partition and place of a row are written with it, so both passes, any task that runs again, and
any later reading see the same ones, however files are split then.

Law ``rows``: sizes of shards differ by one at most.

Defined cases: null keys and texts are rows like others; repeated rows are told apart by their
place after sorting and are interchangeable; an empty table gives an empty result; columns of the
input pass through, and ``shard`` and ``slot`` replace columns of that name.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.llm.common import stage, unused

SEED = 20_240_501
SHARD = "shard"
#: Rows of a shard that one task permutes in the second step.
ROWS_A_TASK = 200_000
#: Matrix rows up to which the matrix is broadcast (8 shards: 64 bytes and overhead a row).
BROADCAST_ROWS = 100_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """Good ones among ``drawn`` of ``good + bad``, for numbers of any size.

    Inversion on the ratios of neighbouring probabilities, from the mode outwards; beyond 14
    deviations the rest is below the resolution of a double.
    """
    if drawn == 0 or good == 0:
        return 0
    if bad == 0:
        return drawn
    all_ = good + bad
    low, high = max(0, drawn - bad), min(good, drawn)
    mode = min(max((drawn + 1) * (good + 1) // (all_ + 2), low), high)
    spread = int(14 * (drawn * (good / all_) * (bad / all_) * max(1e-12, (all_ - drawn) / max(1, all_ - 1))) ** 0.5) + 30
    up = np.arange(mode, min(high, mode + spread), dtype=np.float64)
    down = np.arange(mode, max(low, mode - spread), -1, dtype=np.float64)
    rise = np.cumprod((good - up) * (drawn - up) / ((up + 1) * (bad - drawn + up + 1)))
    fall = np.cumprod(down * (bad - drawn + down) / ((good - down + 1) * (drawn - down + 1)))
    p = np.concatenate([fall[::-1], [1.0], rise])
    c = np.cumsum(p)
    k = int(np.searchsorted(c, rng.random() * c[-1], side="right"))
    return int(mode - len(fall) + min(k, len(p) - 1))


def communication_matrix(counts: list[int], shards: int, seed: int = SEED) -> list[list[int]]:
    """Rows that each partition sends to each shard, under a uniform permutation of all rows."""
    rng = np.random.default_rng(seed)
    n = sum(counts)
    room = [n // shards + (j < n % shards) for j in range(shards)]
    matrix = []
    for count in counts:
        left, row, others = count, [], sum(room)
        for j in range(shards):
            others -= room[j]
            k = hypergeometric(rng, room[j], others, left)
            row.append(k)
            left -= k
        room = [r - k for r, k in zip(room, row, strict=True)]
        matrix.append(row)
    return matrix


def _key(seed: int, cols: list[Column]) -> Column:
    return F.xxhash64(F.lit(seed), *cols)


def shard(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text", seed: int = SEED, rows_a_task: int = ROWS_A_TASK) -> DataFrame:
    """``docs`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 within the shard).

    Within a partition the order is by hash and content, never by arrival.
    """
    names = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    spark = docs.sparkSession
    own = {c: unused(f"{c}_", docs) for c in ("p", "first", "second", "crc", "place", "until", "block", "n", "s", "c", "before", "k")}
    ident = [F.col(key), F.crc32(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")), F.length(F.col(text).cast("string"))]
    local = docs.select(*names, F.spark_partition_id().alias(own["p"]), _key(seed, ident).alias(own["first"]), _key(seed + 1, ident).alias(own["second"]), ident[1].alias(own["crc"]))
    permuted = local.sortWithinPartitions(own["first"], key, own["crc"])
    rows = stage(permuted.withColumn(own["place"], F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).drop(own["first"]))
    counts = sorted(tuple(r) for r in rows.groupBy(own["p"]).agg(F.count(F.lit(1))).collect())
    matrix = communication_matrix([n for _, n in counts], shards, seed)
    until = spark.createDataFrame(
        [(p, [int(x) for x in np.cumsum(row)]) for (p, _), row in zip(counts, matrix, strict=True)], f"{own['p']} int, {own['until']} array<bigint>"
    )
    if len(counts) <= BROADCAST_ROWS:
        until = F.broadcast(until)
    sent = rows.join(until, own["p"]).withColumn(SHARD, F.size(F.filter(own["until"], lambda c: c <= F.col(own["place"]))))

    n = sum(c for _, c in counts)
    parts = max(1, -(-n // (shards * rows_a_task)))
    block, second = own["block"], own["second"]
    sent = sent.withColumn(block, F.pmod(F.col(second), F.lit(parts)).cast("int")).drop(own["p"], own["until"], own["place"])
    sizes = sent.groupBy(SHARD, block).agg(F.count(F.lit(1)).alias(own["n"]))
    before = sizes.select(
        F.col(SHARD).alias(own["s"]), F.col(block).alias(own["c"]),
        (F.sum(own["n"]).over(Window.partitionBy(SHARD).orderBy(block)) - F.col(own["n"])).alias(own["before"]),
    )
    place = F.row_number().over(Window.partitionBy(SHARD, block).orderBy(second, key, own["crc"])) - 1
    placed = sent.withColumn(own["k"], place)
    joined = placed.join(before, (F.col(SHARD) == F.col(own["s"])) & (F.col(block) == F.col(own["c"])))
    return joined.select(*names, F.col(SHARD).cast("int").alias(SHARD), (F.col(own["before"]) + F.col(own["k"])).cast("bigint").alias("slot"))
