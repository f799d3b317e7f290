"""Streams of file events: debounce by session windows, and merges by source for each batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftgraph.functions import predicates as P
from weftgraph.operators.docs import NOISE_DIRS
from weftgraph.operators.merge import merge_by_source


def relevant(events: DataFrame) -> DataFrame:
    """File events (path, kind, ts) that a rebuild can depend on: no reads, dot files, noise or unknown kinds."""
    return events.where(
        ~F.col("kind").isin("opened", "closed_no_write", "accessed") & ~F.col("path").rlike(r"(^|/)\.[^/]") & ~F.col("path").rlike(NOISE_DIRS) & P.classify_path(F.col("path")).isNotNull()
    )


def debounce(events: DataFrame, gap: str = "3 seconds", late: str | None = "1 minute", key: str | None = None) -> DataFrame:
    """Batches of events (start, end, n) that end when none follows for ``gap``; batch and stream alike.

    Without ``key`` all events are one sequence, as a watcher of one tree has it. Sums are taken
    before the sessions are merged, so such a key costs a row for each second with events.
    """
    if events.isStreaming:
        e = events.withWatermark("ts", late or "0 seconds")
        # a stream's sessions need a key, and a literal would be folded away
        by = [F.session_window("ts", gap), F.col(key) if key else (F.year("ts") * 0).alias("__all")]
        out = e.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
        return out.select(*([key] if key else []), F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
    by = [F.session_window("ts", gap)] + ([F.col(key)] if key else [])
    pre = events.groupBy("ts", *([key] if key else [])).agg(F.count(F.lit(1)).alias("k"))
    out = pre.groupBy(*by).agg(F.sum("k").alias("n"))
    return out.select(*([key] if key else []), F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def routing(batch: DataFrame) -> dict[str, bool]:
    """What a batch of events asks for: a rebuild for code or deletions, review for other files that are still there."""
    kind = P.classify_path(F.col("path"))
    gone = F.col("kind") == "deleted"
    r = batch.agg(F.max(((kind == "code") | gone).cast("int")), F.max(((kind != "code") & ~gone).cast("int"))).first()
    return {"rebuild": bool(r[0]), "review": bool(r[1])}


def maintain(stream: DataFrame, load: Callable[[], DataFrame], save: Callable[[DataFrame], None], checkpoint: str, keys: tuple[str, ...] = ("source_file",)) -> StreamingQuery:
    """Keep a table of rows current: each batch replaces the rows of the sources it has.

    ``load`` and ``save`` own the table's versions; ``save`` must be idempotent for a batch, as a
    batch runs again after a failure.
    """

    def apply(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            save(merge_by_source(load(), batch, keys))

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
