"""Operator 5: token counts by a two-tier lookup on the map side.

Tier one is a compact table from frequent pre-tokens to their length in tokens, broadcast once. The
pre-tokens are those most frequent in a bounded sample of the documents, so the table is bounded
whatever the corpus is. What misses it is encoded by the tokenizer and kept in a cache of the worker
process, bounded in entries. No pre-token is shuffled: tasks count those of the sample and hand
bounded lists to the driver. Neither tier can change a count; the sample decides the cost only.

Texts are cut into pre-tokens as the tokenizer's own pattern does, over all of Unicode. Characters
on which this Python and the tokenizer disagree (their Unicode tables have other versions) are found
by holding both against each other, and texts with such a character go to the tokenizer as a whole,
as do texts with one of its special strings.

Defined cases: a null text is empty (0 tokens); texts are counted whole; repeated rows each get a
row; an empty table gives an empty result; columns other than key and text are not read.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.session import prepare

TOKENIZER = "word_bpe_49k.json"
#: Documents in which frequent pre-tokens are counted, characters of each that are, and tasks that do so.
SAMPLE, SAMPLE_CHARS, SAMPLE_TASKS = 4_000, 20_000, 8
#: Entries of tier one, and longest pre-token there and in the caches.
FREQUENT, CACHE_CHARS = 65_536, 64
#: Entries that a worker's cache holds before it starts anew.
CACHE_ENTRIES = 400_000

# The pre-token pattern of the tokenizer file.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Code points that are compared; texts with others go to the tokenizer whole.
_COMPARED = 0x20000

_workers: dict[str, tuple] = {}


@cache
def _pretoken():
    import regex

    # blanks of the tokenizer's pattern: those of Unicode, without the four separators that Python adds
    return regex.compile(_PATTERN.replace(r"\s", r"\t-\r\x20\x85\xa0  -     　"))


def normal(text: str) -> str:
    """A text as the tokenizer normalises it, blanks aside: composed, then each character in lower case."""
    if text.isascii():
        return text.lower()
    # the tokenizer takes characters one by one, so a sigma at a word's end is one like others
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def pretokens(text: str) -> list[str]:
    return _pretoken().findall(normal(text))


@cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def special_strings(path: str) -> list[str]:
    with open(path, encoding="utf-8") as f:
        return [t["content"] for t in json.load(f)["added_tokens"]]


def odd_characters(path: str, upto: int = _COMPARED) -> str:
    """Characters that the tokenizer cuts or normalises in another way than ``pretokens`` does."""
    t, odd = _tokenizer(path), []

    def theirs(text: str) -> list[str]:
        return [w for w, _ in t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(text))]

    def ours(text: str) -> list[str]:
        return ["".join(map(_byte_sign, w.encode())) for w in pretokens(text)]

    def compare(chars: list[str]) -> None:
        # between letters, after a digit, and alone; a text of several tells at once whether all agree
        text = " ".join(f"a{c}a 1{c}. {c}" for c in chars)
        if theirs(text) != ours(text):
            if len(chars) == 1:
                odd.extend(chars)
            else:
                compare(chars[: len(chars) // 2])
                compare(chars[len(chars) // 2 :])

    for at in range(0x80, upto, 0x400):
        chars = [chr(i) for i in range(at, at + 0x400) if not 0xD800 <= i <= 0xDFFF]
        # what this Python does not know may compose or sort in ways that no single character shows
        odd += [c for c in chars if unicodedata.category(c) == "Cn"]
        compare([c for c in chars if unicodedata.category(c) != "Cn"])
    return "".join(sorted(odd))


@cache
def _byte_signs() -> list[str]:
    """The sign that stands for each byte: printable Latin signs for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(0x100 + rest.index(b)) for b in range(256)]


def _byte_sign(b: int) -> str:
    return _byte_signs()[b]


@dataclass(frozen=True)
class Whole:
    """Which texts go to the tokenizer as a whole: those with a special string or an odd character."""

    special: tuple[str, ...]
    odd: frozenset[str]

    @classmethod
    def of(cls, path: str) -> Whole:
        return cls(tuple(special_strings(path)), frozenset(odd_characters(path)))

    def __call__(self, text: str) -> bool:
        if any(s in text for s in self.special):
            return True
        if text.isascii():
            return False
        signs = set(text)
        # a dotted capital I in lower case ends in a mark, which may sort with a mark after it
        return ord(max(signs)) >= _COMPARED or not self.odd.isdisjoint(signs) or ("İ" in signs and bool(_MARKED.search(text)))


_MARKED = re.compile("İ[^\x00-\x7f]")


def frequent_pretokens(docs: DataFrame, key: str, text: str, most: int = FREQUENT) -> list[str]:
    """Pre-tokens that are most frequent in a sample: ``SAMPLE`` documents of least hash classes, ``most`` entries at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                counts.update(w for w in pretokens(t[:SAMPLE_CHARS]) if len(w) <= CACHE_CHARS)
        top = counts.most_common(most)
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["w", "n"])

    every = max(1, docs.count() // SAMPLE)
    picked = docs.where(F.pmod(F.xxhash64(key), F.lit(every)) == 0).select(F.col(text).cast("string").alias("t")).where("t IS NOT NULL")
    counts: Counter = Counter()
    for r in picked.repartition(SAMPLE_TASKS).mapInArrow(run, "w string, n bigint").collect():
        counts[r["w"]] += r["n"]
    return [w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:most]]


def lengths(words: list[str], path: str) -> dict[str, int]:
    return {w: len(e.ids) for w, e in zip(words, _tokenizer(path).encode_batch(words, add_special_tokens=False), strict=True)} if words else {}


def count_text(text: str, path: str, frequent: dict[str, int], whole: Whole) -> int:
    """Tokens of one text."""
    tokenizer = _tokenizer(path)
    cached = _workers.setdefault(path, {})
    if whole(text):
        return len(tokenizer.encode(text, add_special_tokens=False).ids)
    total, misses = 0, []
    first, second = frequent.get, cached.get
    for w in pretokens(text):
        n = first(w) or second(w)
        if n is None:
            misses.append(w)
        else:
            total += n
    if misses:
        own = lengths(list(dict.fromkeys(misses)), path)
        total += sum(map(own.__getitem__, misses))
        if len(cached) + len(own) > CACHE_ENTRIES:
            cached.clear()
        cached.update((w, n) for w, n in own.items() if len(w) <= CACHE_CHARS)
    return total


def token_counts(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", limit: int = 2048) -> DataFrame:
    """For each document: key, ``n_bytes``, ``n_tokens``, ``over_limit``. ``tokenizer``: path of its file, on every worker."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast((lengths(frequent_pretokens(docs, key, text), tokenizer), Whole.of(tokenizer)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        frequent, whole = shared.value
        for b in batches:
            texts = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()),
                    pa.array([count_text(t, tokenizer, frequent, whole) if t else 0 for t in texts], pa.int64()),
                ],
                names=["k", "n_bytes", "n_tokens"],
            )

    narrow = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    counted = narrow.mapInArrow(run, f"k {narrow.schema['k'].dataType.simpleString()}, n_bytes bigint, n_tokens bigint")
    return counted.select(F.col("k").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
