"""Operator 9: mixing sources to target weights by iterative proportional fitting.

Tokens are summed by cell (one combination of source, language and topic). Raking scales the cells
to each set of target marginals in turn until all hold, and documents are then drawn with
probabilities in proportion to their cell's weight a token. Only cells are iterated on; documents
are read once for the sums and once to be drawn, and twice before that to learn topics.

Topics come from words that the corpus itself tells. In each language, words of middling document
frequency are counted over all its documents, and the most informative are its keywords, in order. A
document's topic is the place of the keyword that marks it most (its count times its inverse
document frequency). As a place and not a word, a topic can occur in every language: topics that
imply a language would set targets against each other that no weights can meet.

Defined cases: a null dimension is a value of its own, apart from every other; null or empty texts
have no tokens and no topic and follow their cell; the draw of a row depends on its key, its text
and the seed only, so repeated rows are drawn alike; targets of values that no document has are
ignored; targets that cannot hold together are met as far as the rounds go, with a warning, or an
error if ``strict``; an empty table gives an empty result; columns pass through, and those of the
input never clash with the five that ``mix`` adds, which take free names.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.llm.common import BLANKS, discard, let, small, stage, unused

SEED = 20_240_601
#: Target marginals are the corpus's own shares to this power: below 1, large shares shrink.
TEMPER = 0.7
#: Tokens to keep, as a share of all.
KEEP = 0.8
ROUNDS, TOLERANCE = 40, 1e-6
BROADCAST_ROWS = 100_000
#: Topics and languages that have them, least letters of a keyword, and the shares of its language's documents between which its frequency lies.
TOPICS, LANGS, LETTERS, RARE, COMMON = 12, 64, 5, 0.02, 0.3
#: Rounds of raking in one plan, where the cells are few.
UNROLL = 4


def token_count(text: Column) -> Column:
    """Words of a text, as its tokens: what blanks part, without the empty ends."""

    def counted(parts: Column) -> Column:
        empty = lambda i: F.when(F.element_at(parts, i) == "", 1).otherwise(0)
        return (F.size(parts) - empty(1) - F.when(F.size(parts) > 1, empty(-1)).otherwise(0)).cast("bigint")

    return let(F.split(F.coalesce(text, F.lit("")), BLANKS), counted)


def _found(text: Column, lang: Column) -> Column:
    """Hashes, with the language, of the runs of letters long enough for a keyword, in lower case."""
    runs = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(rf"\p{{L}}{{{LETTERS},}}+"), F.lit(0))
    return F.transform(runs, lambda w: F.xxhash64(w, lang))


def keywords(docs: DataFrame, text: str = "text", lang: str = "lang", topics: int = TOPICS, langs: int = LANGS) -> dict[str | None, list[tuple[int, float]]]:
    """(hash of a word and its language, inverse document frequency) of each language's topics, by frequency times its inverse over all its documents.

    At most ``topics`` words of the ``langs`` most frequent languages, ties by hash. Documents are
    counted by a 64-bit hash in one pass, summed before the counts move: a task sends each word once, as
    three numbers.
    """
    name = F.col(lang).cast("string")
    own = docs.select(F.xxhash64(name).alias("of"), F.array_distinct(_found(F.col(text), name)).alias("hs"))
    most = docs.groupBy(name.alias("l")).agg(F.count(F.lit(1)).alias("docs")).orderBy(F.desc("docs"), F.asc_nulls_first("l")).limit(langs)
    sizes = F.broadcast(stage(most.withColumn("of", F.xxhash64("l"))))  # langs rows
    counts = own.select("of", F.explode("hs").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max("of").alias("of")).where("n > 1")
    share = F.col("n") / F.col("docs")
    ranged = counts.join(sizes, "of").where((share >= RARE) & (share <= COMMON))
    told = ranged.withColumn("idf", F.log(F.col("docs") / F.col("n"))).withColumn("score", F.col("n") * F.col("idf"))
    nth = F.row_number().over(Window.partitionBy("l").orderBy(F.desc("score"), "h"))
    out: dict[str | None, list[tuple[int, float]]] = {}
    for r in told.withColumn("nth", nth).where(F.col("nth") <= topics).orderBy("l", "nth").collect():  # topics * langs rows at most
        out.setdefault(r["l"], []).append((r["h"], r["idf"]))
    return out


def _topic(text: Column, lang: Column, words: list[tuple[int, float]]) -> Column:
    hits = F.filter(_found(text, lang), lambda h: h.isin([h for h, _ in words]))

    def best(found: Column) -> Column:
        count = lambda w: F.size(F.filter(found, lambda h: h == w))
        each = [F.struct((count(w) * F.lit(idf)).alias("s"), F.lit(-i).alias("i")) for i, (w, idf) in enumerate(words)]
        return F.when(F.size(found) > 0, F.concat(F.lit("k"), (1 - F.array_max(F.array(*each))["i"]).cast("string")))

    return let(hits, best)


def topic(text: Column, lang: Column, words: dict[str | None, list[tuple[int, float]]]) -> Column:
    """``k1`` to ``kn``: the place of the keyword that marks a text most, of several the first; null if it has none."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, own in words.items():
        out = out.when(lang.cast("string").eqNullSafe(F.lit(name).cast("string")), _topic(text, lang.cast("string"), own))
    return out


def same(a: list[Column], b: list[Column]) -> Column:
    """Equality of several columns, null being a value like others."""
    out = F.lit(True)
    for x, y in zip(a, b, strict=True):
        out = out & x.eqNullSafe(y)
    return out


def tempered_targets(cells: DataFrame, dim: str, power: float = TEMPER) -> DataFrame:
    """(value, share) of one dimension of cells (dimensions, tokens): its own shares to a power, scaled to 1."""
    own = cells.groupBy(F.col(dim).alias("value")).agg(F.sum("tokens").alias("n")).where("n > 0")
    powered = own.select("value", F.pow(F.col("n").cast("double"), F.lit(power)).alias("w"))
    whole = powered.agg(F.sum("w")).first()[0] or 1.0
    return powered.select("value", (F.col("w") / F.lit(whole)).alias("share"))


@dataclass(frozen=True)
class Raked:
    """Cells with weight ``w``, the largest difference between a marginal and its target, and the rounds it took."""

    cells: DataFrame
    off: float
    rounds: int


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> Raked:
    """Cells (dimensions, tokens) with ``w``: shares of tokens whose marginals are the targets.

    Up to ``BROADCAST_ROWS`` cells are one partition, and a few rounds one plan of windows over it. More
    are raked by factors: a cell's weight is its tokens times a factor for each of its values, a step
    sums one dimension's marginal before anything moves and writes that dimension's factors anew.
    """
    few = cells.count() <= BROADCAST_ROWS
    own = cells.where("tokens > 0")
    for i, (d, t) in enumerate(targets.items()):
        goal = small(stage(t.select(F.col("value").alias(f"v{i}"), F.col("share").alias(f"to{i}"))), BROADCAST_ROWS)
        own = own.join(goal, F.col(d).eqNullSafe(F.col(f"v{i}")), "left").drop(f"v{i}").fillna(0.0, [f"to{i}"])
    whole = own.agg(F.sum("tokens")).first()[0] or 1
    own = stage((own.coalesce(1) if few else own).withColumn("w", F.col("tokens") / F.lit(float(whole))))
    found, off, took = (_by_windows if few else _by_factors)(own, list(targets), rounds, tolerance)
    return Raked(found.select(*cells.columns, "w"), off, took)


def _by_windows(own: DataFrame, dims: list[str], rounds: int, tolerance: float) -> tuple[DataFrame, float, int]:
    over = [Window.partitionBy(d) for d in dims]
    off, took = 0.0, 0
    while took < rounds:
        now = own.coalesce(1)
        for _ in range(min(UNROLL, rounds - took)):
            took += 1
            for i, o in enumerate(over):
                have = F.sum("w").over(o)
                now = now.withColumn("w", F.when(have > 0, F.col("w") * F.col(f"to{i}") / have).otherwise(0.0))
        was, own = own, stage(now.coalesce(1))
        discard(was)
        apart = F.greatest(F.lit(0.0), *[F.abs(F.sum("w").over(o) - F.col(f"to{i}")) for i, o in enumerate(over)])
        off = own.coalesce(1).select(apart.alias("off")).agg(F.max("off")).first()[0] or 0.0
        if off <= tolerance:
            break
    return own, off, took


def _by_factors(own: DataFrame, dims: list[str], rounds: int, tolerance: float) -> tuple[DataFrame, float, int]:
    factors = [stage(own.groupBy(F.col(d).alias(f"v{i}")).agg(F.first(f"to{i}").alias("to"), F.lit(1.0).alias(f"f{i}"), F.lit(0.0).alias("off"))) for i, d in enumerate(dims)]
    short = [f.count() <= BROADCAST_ROWS for f in factors]

    def weighed() -> DataFrame:
        out = own
        for i, d in enumerate(dims):
            f = factors[i].select(f"v{i}", f"f{i}")
            out = out.join(F.broadcast(f) if short[i] else f, F.col(d).eqNullSafe(F.col(f"v{i}"))).withColumn("w", F.col("w") * F.col(f"f{i}")).drop(f"f{i}")
        return out

    off, took = 0.0, 0
    while took < rounds:
        took, off = took + 1, 0.0
        for i in range(len(dims)):
            have = weighed().groupBy(F.col(f"v{i}").alias("v")).agg(F.sum("w").alias("have"))
            was = factors[i]
            met = was.drop("off").join(have, F.col(f"v{i}").eqNullSafe(F.col("v")), "left")
            changed = F.when(F.col("have") > 0, F.col(f"f{i}") * F.col("to") / F.col("have")).otherwise(0.0)
            factors[i] = stage(met.select(f"v{i}", "to", changed.alias(f"f{i}"), F.abs(F.coalesce("have", F.lit(0.0)) - F.col("to")).alias("off")))
            off = max(off, factors[i].agg(F.max("off")).first()[0] or 0.0)
            discard(was)
        if off <= tolerance:
            break
    return weighed(), off, took


def scale(cells: DataFrame, keep: float) -> float:
    """The factor c for which the sum of tokens * min(1, c * rate) over cells (tokens, rate) is ``keep`` of all tokens.

    A few passes over the cells: those that a factor takes whole are set aside and the rest is
    solved for again.
    """
    everything = cells.agg(F.sum("tokens")).first()[0] or 0
    c, goal = 0.0, keep * everything
    while True:
        whole = F.col("rate") * c >= 1
        taken, rest = cells.agg(F.sum(F.when(whole, F.col("tokens"))), F.sum(F.when(~whole, F.col("tokens") * F.col("rate")))).first()
        if not rest:
            return c
        new = (goal - (taken or 0)) / rest
        if new <= c * (1 + 1e-12):
            return c
        c = new


def mix(
    docs: DataFrame, dims: dict[str, Column], tokens: Column, targets: dict[str, DataFrame] | None = None,
    keep: float = KEEP, seed: int = SEED, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS, strict: bool = False,
) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with each dimension, ``tokens``, ``rate`` (weight a token, 1 on average), ``prob`` and ``kept``;
    and the names that those columns have, which are free ones."""
    plain = {d: f"dim_{i}" for i, d in enumerate(dims)}
    cells = stage(docs.select(*[x.cast("string").alias(plain[d]) for d, x in dims.items()], tokens.alias("tokens")).groupBy(*plain.values()).agg(F.sum("tokens").alias("tokens")))
    goals = {plain[d]: targets[d] if targets else tempered_targets(cells, plain[d]) for d in dims}
    raked = rake(cells, goals, rounds)
    fitted = raked.cells
    if raked.off > TOLERANCE:
        said = f"marginals are off by {raked.off:.3g} after {raked.rounds} rounds"
        if strict:
            raise ValueError(said)
        warnings.warn(said, stacklevel=2)
    n, w = fitted.agg(F.sum("tokens"), F.sum("w")).first()
    rated = stage(fitted.select(*plain.values(), "tokens", (F.col("w") / F.lit(w or 1.0) * F.lit(n or 1) / F.col("tokens")).alias("rate")))
    c = scale(rated, keep)
    names = {x: unused(f"{x}_", docs) for x in [*dims, "tokens", "rate", "prob", "kept"]}
    own = [names[d] for d in dims]
    dimmed = docs.withColumns({names[d]: x.cast("string") for d, x in dims.items()})
    theirs = [unused(f"cell_{x}", docs) for x in plain.values()]
    rates = rated.select(*[F.col(x).alias(y) for x, y in zip(plain.values(), theirs, strict=True)], F.col("rate").alias(names["rate"]))
    joined = dimmed.join(small(rates, BROADCAST_ROWS), same([F.col(x) for x in own], [F.col(x) for x in theirs]), "left").drop(*theirs)
    u = F.xxhash64(F.lit(seed), F.col(key), F.xxhash64(F.col(text))).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
    rate = F.coalesce(F.col(names["rate"]), F.lit(0.0))
    drawn = joined.withColumn(names["rate"], rate).withColumn(names["prob"], F.least(F.lit(1.0), F.col(names["rate"]) * c))
    return drawn.withColumn(names["tokens"], tokens).withColumn(names["kept"], u < F.col(names["prob"])), names


def mixed(docs: DataFrame, dims: dict[str, Column], tokens: Column, keep: float = KEEP, seed: int = SEED, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents drawn, with their own columns."""
    drawn, names = mix(docs, dims, tokens, keep=keep, seed=seed, key=key, text=text)
    return drawn.where(F.col(names["kept"])).select(*docs.columns)
