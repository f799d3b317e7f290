"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.session import discard, shared_dir, small
from weftgraph.session import written as stage

__all__ = ["discard", "let", "prefix_sums", "shared_dir", "small", "stage", "table", "total", "unused", "window_hashes", "words"]

#: Separators between words: blank and the five ASCII control blanks.
BLANKS = r"[\x20\x09-\x0D]+"
BLANK_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times in ``body``.

    Column expressions have no local variables; a one-element ``transform`` is one, and keeps
    filter push-down from copying an expensive expression to each of its uses.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Words of a text, unchanged; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def window_hashes(ws: Column, width: int) -> Column:
    """Hashes of all runs of ``width`` words, in order; none for fewer words."""

    def hashed(w: Column) -> Column:
        columns = [w, *[F.slice(w, F.lit(j + 1), F.size(w)) for j in range(1, width)]]
        n = F.greatest(F.size(w) - (width - 1), F.lit(0))
        return F.transform(F.slice(F.arrays_zip(*columns), F.lit(1), n), lambda x: F.xxhash64(x))

    return let(ws, hashed)


def unused(name: str, *frames: DataFrame) -> str:
    """``name``, with underscores added until no column of the frames has it."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, v: a + v)


def prefix_sums(values: Column, block: int = 256) -> Column:
    """Inclusive running sums of an array<bigint>.

    Two levels (sums of blocks, then sums within a block), so an array of a million entries costs
    a few hundred additions an entry, not a million.
    """

    def run(v: Column) -> Column:
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(v) - 1) / block).cast("int")),
            lambda b: F.slice(v, b * block + 1, block),
        )

        def inner(bs: Column) -> Column:
            def offsets(sums: Column) -> Column:
                return F.flatten(
                    F.transform(
                        bs,
                        lambda x, b: let(
                            total(F.slice(sums, F.lit(1), b)),
                            lambda off: F.transform(x, lambda _, i: off + total(F.slice(x, F.lit(1), i + 1))),
                        ),
                    )
                )

            return let(F.transform(bs, total), offsets)

        return F.when(F.size(v) > 0, let(blocks, inner)).otherwise(F.array().cast("array<bigint>"))

    return let(values, run)
