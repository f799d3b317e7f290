"""Operator 3: secret scan with corpus-wide ownership frequency.

Candidates are found by pattern in whole texts. Their hashes are then counted by distinct
repositories and owners over the whole corpus: a value that several owners hold is a copied
example, one that stays with its owner looks live.

Defined cases: a null text is empty (no spans); a null owner or repository counts as one of its
own, apart from any real value; repeated rows each get a row and count once as a repository when their key is the same; equal
spans of several kinds all stay; an empty table gives an empty result; other columns are not read.
Values are hashed where they are found: no secret is written anywhere in plain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import let, prefix_sums, small, stage

#: Kind, pattern, group that holds the secret, least length of that group. In the order in which ties are listed.
KINDS = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
    ("vendor", r"gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 10),
)
BASE = ("assign", "access", "hex")

#: A value held by this many owners, or in this many repositories, is an example and not a live secret.
EXAMPLE_OWNERS = 3
EXAMPLE_REPOS = 10

#: Distinct example hashes (64 characters) up to which they are broadcast.
BROADCAST_ROWS = 100_000

_SPAN = "array<struct<start:bigint,rank:int,stop:bigint,hash:string>>"


def _spans(text: Column, rank: int) -> Column:
    """Spans of one kind, in code points.

    A split gives the pieces between matches and an extraction the matches; running sums of their
    lengths are the offsets. Both scan with the same leftmost non-overlapping search.
    """
    _, pattern, group, least = KINDS[rank]
    rx = F.lit(pattern)

    def located(found: Column) -> Column:
        value = F.regexp_extract_all(text, rx, F.lit(group)) if group else found

        def spans(pieces: Column, values: Column) -> Column:
            lengths = F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found, lambda p, m: (F.length(p) + F.length(m)).cast("bigint"))
            return let(
                prefix_sums(lengths),
                lambda stops: F.filter(
                    F.transform(
                        found,
                        lambda m, i: F.struct(
                            (F.get(stops, i) - F.length(m)).alias("start"),
                            F.lit(rank).alias("rank"),
                            F.get(stops, i).alias("stop"),
                            F.when(F.length(F.get(values, i)) >= least, F.sha2(F.get(values, i), 256)).alias("hash"),
                        ),
                    ),
                    lambda s: s["hash"].isNotNull(),
                ),
            )

        return let(
            F.struct(F.split(text, pattern).alias("p"), value.alias("v")),
            lambda pv: spans(pv["p"], pv["v"]),
        )

    return let(
        F.regexp_extract_all(text, rx, F.lit(0)),
        lambda found: F.when(F.size(found) > 0, located(found).cast(_SPAN)).otherwise(F.array().cast(_SPAN)),
    )


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    return F.concat_ws(
        ",",
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["stop"].cast("string"))),
    )


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", repo: str = "doc_id", owner: str = "source") -> DataFrame:
    """A row for each document: key, ``repo``, ``owner`` and its ``spans`` (start, rank of the kind, stop, SHA-256 of the value), sorted."""
    filled = F.coalesce(F.col(text), F.lit(""))
    every = let(filled, lambda t: F.sort_array(F.concat(*[_spans(t, rank) for rank in range(len(KINDS))])))
    return docs.select(
        F.col(key).alias("doc_id"),
        F.col(repo).cast("string").alias("repo"),
        F.col(owner).cast("string").alias("owner"),
        every.alias("spans"),
    )


def ownership(candidates: DataFrame) -> DataFrame:
    """From (hash, repo, owner): how many distinct repositories and owners hold each hash.

    Two levels, each summed before it is shuffled: a value in a third of all documents arrives as
    one row for each task and owner, not as its documents.
    """
    by_repo = candidates.groupBy("hash", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    by_owner = by_repo.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("n_repos"), F.sum("n").alias("n"))
    return by_owner.groupBy("hash").agg(
        F.count(F.lit(1)).alias("n_owners"), F.sum("n_repos").alias("n_repos"), F.sum("n").alias("n_found")
    )


def classify(
    docs: DataFrame, key: str = "doc_id", text: str = "text", repo: str = "doc_id", owner: str = "source",
    example_owners: int = EXAMPLE_OWNERS, example_repos: int = EXAMPLE_REPOS,
) -> DataFrame:
    """``scan`` with ``n_live`` and ``n_example``: spans by the class of their value over the corpus."""
    found = stage(scan(docs, key, text, repo, owner).withColumn("row", F.monotonically_increasing_id()))
    one = found.where(F.size("spans") > 0).select("row", "repo", "owner", F.explode("spans.hash").alias("hash"))
    examples = ownership(one).where((F.col("n_owners") >= example_owners) | (F.col("n_repos") >= example_repos)).select("hash")
    # a value that a third of all documents hold stays where its documents are: its hash comes to them
    of_each = one.select("row", "hash").join(small(stage(examples.withColumn("example", F.lit(True))), BROADCAST_ROWS), "hash", "left")
    of_row = of_each.groupBy("row").agg(F.count(F.when(F.col("example").isNull(), 1)).alias("n_live"), F.count(F.lit(1)).alias("k"))
    return found.join(of_row, "row", "left").select(
        "doc_id", "repo", "owner", "spans",
        F.coalesce("n_live", F.lit(0)).alias("n_live"),
        (F.coalesce("k", F.lit(0)) - F.coalesce("n_live", F.lit(0))).alias("n_example"),
    )


def digest(found: DataFrame) -> DataFrame:
    """Counts and digests of the spans of ``classify``."""
    of = {name: rank for rank, (name, *_) in enumerate(KINDS)}
    count = lambda name: F.size(F.filter("spans", lambda s: s["rank"] == of[name])).cast("bigint").alias(f"n_{name}")
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"),
        F.col("n_live").cast("bigint").alias("n_live"), F.col("n_example").cast("bigint").alias("n_example"),
    )
