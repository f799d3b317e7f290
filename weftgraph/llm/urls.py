"""Operator 10: URL filters by a temporal list join.

A list is dated entries: on a day a pattern is added to it or removed. Entries of a pattern become
validity intervals, and an as-of join sets every capture against the intervals that hold at its
fetch time. Captures are first reduced to distinct (host, first path segment, day), so that a host
with a third of all captures costs its days.

Patterns are hosts (which cover their subdomains) or ``host/segment``. Defined cases: on one day a
removal outlasts an addition; a null or unreadable URL, or a null fetch time, matches nothing;
repeated captures each get a row; repeated entries count once; empty tables give an empty result
or no matches; ``pattern`` is the longest of several matches, ties the greatest; other columns of the
captures pass through, and those named like the three results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.llm.common import small, stage, unused

#: Intervals (about 60 bytes) up to which they are broadcast.
BROADCAST_ROWS = 200_000
FOREVER = "9999-12-31"


def host(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def segment(url: Column) -> Column:
    """The first segment of the path; empty if there is none."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]*)", 1)


def intervals(entries: DataFrame) -> DataFrame:
    """From (pattern, day, action: add or remove): (pattern, since, until), until being excluded."""
    daily = entries.groupBy("pattern", "day").agg(F.max("action").alias("action"))
    after = F.lead("day").over(Window.partitionBy("pattern").orderBy("day"))
    return daily.withColumn("until", F.coalesce(after, F.lit(FOREVER).cast("date"))).where("action = 'add'").select("pattern", F.col("day").alias("since"), "until")


def _patterns(h: Column, seg: Column) -> Column:
    """Every pattern that covers a host and path: the host and its parents, alone and with the segment."""
    labels = F.split(h, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    with_path = F.when(seg != "", F.array(F.concat(h, F.lit("/"), seg))).otherwise(F.array().cast("array<string>"))
    return F.concat(parents, with_path)


def evaluate(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: Column | None = None) -> DataFrame:
    """``captures`` with ``n_matches``, ``pattern`` (the most specific) and ``blocked``, as of the fetch day."""
    day = F.to_date(fetched if fetched is not None else F.col("fetched"))
    h, s, d = (unused(x, captures) for x in ("host_", "segment_", "day_"))
    keyed = captures.withColumns({h: host(F.col(url)), s: segment(F.col(url)), d: day})
    distinct = keyed.select(h, s, d).where(F.col(h).isNotNull() & F.col(d).isNotNull()).distinct()
    probes = distinct.select(h, s, d, F.explode(_patterns(F.col(h), F.col(s))).alias("pattern"))
    held = small(stage(intervals(entries)), BROADCAST_ROWS)
    best = F.max(F.struct(F.length("pattern"), F.col("pattern")))["pattern"]
    verdicts = (
        probes.join(held, "pattern").where((F.col(d) >= F.col("since")) & (F.col(d) < F.col("until")))
        .groupBy(h, s, d).agg(F.count(F.lit(1)).alias("n_matches"), best.alias("pattern"))
    )
    own = [c for c in captures.columns if c.lower() not in ("n_matches", "pattern", "blocked")]
    joined = keyed.select(*own, h, s, d).join(small(stage(verdicts), BROADCAST_ROWS), [h, s, d], "left")
    n = F.coalesce("n_matches", F.lit(0)).cast("bigint")
    return joined.select(*own, n.alias("n_matches"), "pattern", (n > 0).alias("blocked"))


def synthetic_list(pages: DataFrame, url: str = "url") -> DataFrame:
    """A dated list over the hosts of ``pages``, by rules on the MD5 of each host.

    The test tables have no list of their own. Hosts whose first digit is below 8 are added on a day
    of 2024 by the next two digits, and removed 90 days later if the fourth is below 8; hosts whose
    fifth is below 4 have their ``/en`` pages listed for good from March on; the two spam domains
    are listed all year.
    """
    hosts = pages.select(host(F.col(url)).alias("h")).where("h IS NOT NULL").distinct().withColumn("m", F.md5(F.col("h").cast("binary")))
    digits = F.conv(F.substr("m", F.lit(2), F.lit(2)), 16, 10).cast("int")
    start = F.date_add(F.lit("2024-01-01").cast("date"), digits)
    at = lambda i: F.substr("m", F.lit(i), F.lit(1))
    added = hosts.where(at(1) < "8").select(F.col("h").alias("pattern"), start.alias("day"), F.lit("add").alias("action"))
    removed = hosts.where((at(1) < "8") & (at(4) < "8")).select(F.col("h").alias("pattern"), F.date_add(start, 90).alias("day"), F.lit("remove").alias("action"))
    paths = hosts.where(at(5) < "4").select(F.concat("h", F.lit("/en")).alias("pattern"), F.lit("2024-03-01").cast("date").alias("day"), F.lit("add").alias("action"))
    spam = F.explode(F.array(F.lit("spam-farm.example.org"), F.lit("cheap-pills.example.com"))).alias("pattern")
    fixed = pages.sparkSession.range(1).select(spam, F.lit("2024-01-01").cast("date").alias("day"), F.lit("add").alias("action"))
    return added.union(removed).union(paths).union(fixed)
