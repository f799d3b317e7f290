"""Operator 7: language identification by hierarchical discrimination.

A linear support vector machine first tells language families apart, then one-versus-one machines
separate the languages within the predicted family; votes decide, margins break ties. Features are
hashed character runs of one to three letters of the whole text.

The machines are fitted on a bounded sample: at most ``ROWS_A_LANG`` labelled rows of each of the
``LANGS`` most frequent languages, those with the least hash of their id. Rows are chosen by hash,
without their texts; only the texts of those chosen are read again. Prediction reads every row and
only its text.

Defined cases: a null text, or one without a letter, is ``und`` with score 0, and so is every text
if nothing was learned; with one language learned all other texts get it with score 1; repeated
rows get equal predictions and are learned once; of equally frequent languages the least names are
learned; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.llm.common import stage
from weftgraph.session import prepare

#: Labelled rows of a language that the fit reads at most.
ROWS_A_LANG = 800
#: Languages that are learned at most.
LANGS = 64
#: Parts in which a language's rows are cut down before they meet.
PARTS = 64
DIMS = 4096
_CHUNK = 1 << 20

# Families of languages by code. A code that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}


def _is_letter() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x10000)])


_LETTER: list[np.ndarray] = []


def features(text: str) -> np.ndarray:
    """Square roots of the shares of hashed runs of one, two and three characters, of length 1 in all.

    Characters other than letters count as one blank.
    """
    if not _LETTER:
        _LETTER.append(_is_letter())
    out = np.zeros(DIMS, np.float64)
    low = text.lower()
    for at in range(0, len(low), _CHUNK):
        # each piece begins with the end of the one before, so that runs across the cut count once
        c = np.frombuffer(low[max(0, at - 2) : at + _CHUNK].encode("utf-32-le", "surrogatepass"), np.uint32)
        c = np.where((c >= 0x10000) | _LETTER[0][np.minimum(c, 0xFFFF)], c, 32).astype(np.uint64)
        skip = min(2, at)
        run = np.zeros(0, np.uint64)
        for n in (1, 2, 3):
            run = c if n == 1 else run[:-1] * np.uint64(0x110000) + c[n - 1 :]
            own = run[max(0, skip - (n - 1)) :]
            h = ((own + np.uint64(n << 60)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)
            out += np.bincount(h.astype(np.int64), minlength=DIMS)
            if len(c) <= n:
                break
    out = np.sqrt(out)
    norm = np.linalg.norm(out)
    return (out / norm if norm else out).astype(np.float32)


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, epochs: int = 12, seed: int = 7) -> np.ndarray:
    """Weights (the last is the bias) of a linear SVM, by dual coordinate descent on the hinge loss."""
    rng = np.random.default_rng(seed)
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    w, a = np.zeros(x.shape[1]), np.zeros(len(x))
    q = np.einsum("ij,ij->i", x, x)
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            new = min(max(a[i] - (y[i] * (x[i] @ w) - 1) / q[i], 0.0), cost)
            if new != a[i]:
                w += (new - a[i]) * y[i] * x[i]
                a[i] = new
    return w


class Model:
    """Families, then languages: one-versus-one machines at both levels."""

    def __init__(self, x: np.ndarray, langs: list[str]) -> None:
        tags = np.array(langs)
        family = np.array([_FAMILY.get(v, v) for v in langs])
        self.families = {f: sorted(set(tags[family == f].tolist())) for f in sorted(set(family.tolist()))}
        self.top = self._machines(x, family, list(self.families))
        self.within = {f: self._machines(x[family == f], tags[family == f], own) for f, own in self.families.items()}

    @staticmethod
    def _machines(x: np.ndarray, tags: np.ndarray, names: list[str]) -> list[tuple[str, str, np.ndarray]]:
        out = []
        for a, b in combinations(names, 2):
            use = (tags == a) | (tags == b)
            out.append((a, b, fit_svm(x[use], np.where(tags[use] == a, 1.0, -1.0)).astype(np.float32)))
        return out

    @staticmethod
    def _decide(x: np.ndarray, names: list[str], machines: list[tuple[str, str, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Index of the name with most votes, and its least margin over another."""
        votes, least = np.zeros((len(x), len(names))), np.full((len(x), len(names)), np.inf)
        for a, b, w in machines:
            m = x @ w[:-1] + w[-1]
            for name, own in ((a, m), (b, -m)):
                j = names.index(name)
                votes[:, j] += own > 0
                least[:, j] = np.minimum(least[:, j], own)
        best = np.argmax(votes + np.tanh(np.clip(least, -20, 20)) / 4, axis=1)
        return best, least[np.arange(len(x)), best]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        families = list(self.families)
        f, margin = self._decide(x, families, self.top)
        langs = [""] * len(x)
        for j, name in enumerate(families):
            rows = np.flatnonzero(f == j)
            if len(rows):
                own, m = self._decide(x[rows], self.families[name], self.within[name])
                margin[rows] = np.minimum(margin[rows], m)
                for r, k in zip(rows.tolist(), own.tolist(), strict=True):
                    langs[r] = self.families[name][k]
        return langs, 1.0 / (1.0 + np.exp(-2.0 * np.clip(margin, -20, 20)))


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def held_out(key: Column) -> Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(3)) == 1


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", rows_a_lang: int = ROWS_A_LANG, langs: int = LANGS) -> Model | None:
    """A model from labelled rows that are not held out, at most ``rows_a_lang`` of each language."""
    prepare(docs.sparkSession)
    usable = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("lang")).where(
        F.col("lang").isNotNull() & F.col("k").isNotNull() & ~held_out(F.col("k")) & F.col("t").rlike(r"\p{L}")
    )
    known = usable.select("k", "lang", F.xxhash64("k").alias("h"), F.xxhash64("t").alias("u"))
    narrow = stage(known)
    most = narrow.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(langs).select("lang")
    order = ("h", "k", "u")
    in_part = F.row_number().over(Window.partitionBy("lang", F.pmod("h", F.lit(PARTS))).orderBy(*order))
    cut = narrow.join(F.broadcast(most), "lang").withColumn("r", in_part).where(F.col("r") <= rows_a_lang)
    first = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    chosen = stage(cut.withColumn("r", first).where(F.col("r") <= rows_a_lang).select("k", "lang", "u"))
    same = (usable["k"] == chosen["k"]) & (usable["lang"] == chosen["lang"]) & (F.xxhash64(usable["t"]) == chosen["u"])
    # langs * rows_a_lang rows of two numbers and a name at most
    sample = usable.join(F.broadcast(chosen), same, "left_semi").select("k", "lang", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            xs = [features(t).astype(np.float16).tobytes() for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(xs, pa.binary())], names=["k", "lang", "x"])

    kind = sample.schema["k"].dataType.simpleString()
    rows = sample.mapInArrow(run, f"k {kind}, lang string, x binary").collect()
    if not rows:
        return None
    rows = sorted({(r["lang"], r["k"], bytes(r["x"])) for r in rows})
    return Model(np.array([np.frombuffer(x, np.float16) for _, _, x in rows]).astype(np.float32), [v for v, _, _ in rows])


def predict(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ``lang_pred``, ``score``) of each document."""
    shared = prepare(docs.sparkSession).sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts = b.column(1)
            pred, score = ["und"] * len(texts), [0.0] * len(texts)
            rows = [i for i in range(len(texts)) if m is not None and has_letter(texts[i].as_py())]
            for at in range(0, len(rows), 256):
                part = rows[at : at + 256]
                langs, s = m.predict(np.array([features(texts[i].as_py()) for i in part]))
                for i, v, p in zip(part, langs, s.tolist(), strict=True):
                    pred[i], score[i] = v, p
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["k", "lang_pred", "score"])

    narrow = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    kind = narrow.schema["k"].dataType.simpleString()
    return narrow.mapInArrow(run, f"k {kind}, lang_pred string, score double").withColumnRenamed("k", key)


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, held_out, lang_pred, score) of each document, by a model of the rows that are not held out."""
    found = predict(docs, fit(docs, key, text, lang), key, text)
    return found.select(key, F.coalesce(held_out(F.col(key)), F.lit(False)).alias("held_out"), "lang_pred", "score")
