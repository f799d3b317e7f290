"""Operator 2: quality rules as a ledger of failure bits.

Every rule is evaluated once for each document. The ledger keeps what the rules measured and one
bit for each rule that failed; a policy is a versioned set of rules, so applying another policy or
asking what a rule costs (``ablation``) reads bits and never texts again.

Defined cases: a null text counts as empty (no words, so MIN_WORDS fails); texts of any length are
measured whole; repeated rows each get their own ledger row; an empty table gives an empty ledger;
columns of the input other than the key and the text are neither read nor able to clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import BLANK_CHARS, let, total, window_hashes, words

WINDOW = 5
SYMBOLS = r"[#*$%&|<>]"


def _neighbours_equal(of, xs: Column) -> Column:
    """Entries of a sorted array whose key equals that of the entry before or after."""
    return F.filter(
        xs,
        lambda x, k: F.coalesce(of(F.get(xs, k + 1)) == of(x), F.lit(False))
        | F.coalesce((k > 0) & (of(F.get(xs, F.greatest(k - 1, F.lit(0)))) == of(x)), F.lit(False)),
    )


def repeat_words(ws: Column) -> Column:
    """How many words lie in a 5-word window that occurs twice or more.

    Windows are hashed, and most texts are done when all hashes differ. Else a sort puts equal
    hashes side by side, and those windows are compared as strings, so that collisions cannot count.
    """
    none = F.lit(0).cast("bigint")
    n_windows = F.size(ws) - (WINDOW - 1)

    def covered(hs: Column) -> Column:
        pairs = F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("g"), i.alias("p"))))
        alike = let(pairs, lambda xs: _neighbours_equal(lambda x: x["g"], xs))
        spelled = F.sort_array(
            F.transform(alike, lambda x: F.struct(F.concat_ws(" ", F.slice(ws, x["p"] + 1, WINDOW)).alias("g"), x["p"].alias("p")))
        )
        starts = let(spelled, lambda xs: F.sort_array(F.transform(_neighbours_equal(lambda x: x["g"], xs), lambda x: x["p"])))
        width = F.lit(WINDOW).cast("bigint")
        return let(
            starts,
            lambda ps: total(F.transform(ps, lambda p, k: F.least(width, F.coalesce((F.get(ps, k + 1) - p).cast("bigint"), width)))),
        )

    found = let(window_hashes(ws, WINDOW), lambda hs: F.when(F.size(F.array_distinct(hs)) < F.size(hs), covered(hs)).otherwise(none))
    return F.when(n_windows >= 2, found).otherwise(none)


def measures(text: Column) -> Column:
    """One struct of all measurements of a text."""

    def of(t: Column, ws: Column, lines: Column) -> Column:
        return F.struct(
            F.size(ws).cast("bigint").alias("n_words"),
            F.length(F.array_join(ws, "")).cast("bigint").alias("word_chars"),
            F.regexp_count(t, F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
            repeat_words(ws).alias("n_repeat_words"),
            F.regexp_count(t, F.lit("[A-Z]")).cast("bigint").alias("n_upper"),
            F.size(lines).cast("bigint").alias("n_lines"),
        )

    lines = lambda t: F.filter(F.split(t, "\n"), lambda x: F.trim(x, F.lit(BLANK_CHARS)) != "")
    parts = lambda t: F.struct(t.alias("t"), words(t).alias("w"), lines(t).alias("l"))
    return let(let(F.coalesce(text, F.lit("")), parts), lambda x: of(x["t"], x["w"], x["l"]))


@dataclass(frozen=True)
class Rule:
    """A rule and its bit; ``_condition`` has what it tests."""

    name: str
    bit: int


#: Bits are never given to another rule.
RULES = (
    Rule("min_words", 0),
    Rule("repeated_windows", 1),
    Rule("symbols", 2),
    Rule("dup_lines", 3),
    Rule("word_length", 4),
    Rule("upper_case", 5),
)

#: Versioned policies: the rules each one applies.
POLICIES = {
    "base": ("min_words", "repeated_windows"),
    "v1": tuple(r.name for r in RULES),
}


def policy_mask(policy: str) -> int:
    bits = {r.name: r.bit for r in RULES}
    return sum(1 << bits[name] for name in POLICIES[policy])


def failure_bits(m: Column) -> Column:
    """The rules' bits for a struct of measurements."""

    def bits(x: Column) -> Column:
        out = F.lit(0).cast("bigint")
        for r in RULES:
            out = out.bitwiseOR(F.when(_condition(r, x), F.lit(1 << r.bit).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
        return out

    return let(m, bits)


def _condition(rule: Rule, m: Column) -> Column:
    v = {n: m[n] for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_lines")}
    return {
        "min_words": lambda: v["n_words"] < 10,
        "repeated_windows": lambda: v["n_repeat_words"] * 100 > v["n_words"] * 20,
        "symbols": lambda: v["n_symbols"] * 10 > v["n_words"] * 3,
        "dup_lines": lambda: (v["n_lines"] >= 6) & (v["n_dup_lines"] * 10 > v["n_lines"] * 3),
        "word_length": lambda: (v["word_chars"] > v["n_words"] * 20) | (v["word_chars"] < v["n_words"] * 2),
        "upper_case": lambda: v["n_upper"] * 10 > v["word_chars"] * 4,
    }[rule.name]()


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: key, measurements, ``fail_bits``."""
    measured = docs.select(F.col(key), measures(F.col(text)).alias("m"))
    return measured.select(key, "m.*", failure_bits(F.col("m")).alias("fail_bits"))


def passes(text: Column, policy: str = "v1") -> Column:
    """Whether a text passes a policy, as one expression, for use as a filter."""
    return failure_bits(measures(text)).bitwiseAND(F.lit(policy_mask(policy))) == 0


def apply_policy(led: DataFrame, policy: str = "v1") -> DataFrame:
    """The ledger with ``kept``: no rule of the policy failed. Reads bits only."""
    return led.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(policy_mask(policy))) == 0)


def ablation(led: DataFrame, policy: str = "v1") -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail only it, and kept without it.

    Bits are first counted by pattern (at most 2^rules rows, summed map-side), so the cost does not
    depend on how many rules are asked about.
    """
    mask = policy_mask(policy)
    patterns = led.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("bigint").alias("bit")) for r in RULES if r.name in POLICIES[policy]])
    each = patterns.select("bits", "n", F.explode(rules).alias("r"))
    n = F.col("n")
    rest = F.col("bits").bitwiseAND(F.bitwise_not(F.col("r.bit")))
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, n).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("r.bit"), n).otherwise(0)).alias("n_failed_alone"),
        F.sum(F.when(rest == 0, n).otherwise(0)).alias("n_kept_without"),
    )
