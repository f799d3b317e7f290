"""Operator 6: removal of repeated passages by suffix automata of reference shards.

A window is ``WINDOW`` consecutive words. Each window has an anchor: the least hash among the
8-word runs inside it. Equal windows have equal anchors, so an anchor that is in one document only
ends the matter for its windows. Consecutive windows with one anchor form a context.

* Where all contexts of an anchor are the same text, every document but the first loses it.
* Where they differ, the anchor's distinct contexts are a reference shard. In the order of their
  first documents each context is streamed through a suffix automaton of the earlier ones; where
  its matching statistics reach the window length, the spans go. Then it is added.
* An anchor with very many distinct contexts goes by windows instead, by a minimum over each.

Shards are sent to the documents that can match them, not to all: what is repeated grows with the
corpus, so a broadcast of all shards would neither be bounded nor linear. Words are compared by
64-bit hashes inside an automaton, where 50 in a row must agree; whole contexts and windows by 128
bits, so that among 10^14 of them a false match has a probability under 10^-10.

Defined cases: a null text has no words; texts are read whole; of equal keys neither is smaller,
so repeated rows of one key do not remove each other's windows; a null key is never smaller or
larger; keys are whole numbers, or texts of such; an empty table gives an empty result; columns other than key
and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import stage
from weftgraph.session import prepare

WINDOW = 50
RUN = 8
#: Distinct contexts of an anchor beyond which it goes by windows.
SHARD = 4096

_B = 0x9E3779B97F4A7C15 | 1


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _B, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_BASE = _powers(256)


def _mix(x: np.ndarray) -> np.ndarray:
    """A finaliser, so that the order of hashes has nothing of the polynomial left."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(ws: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, ws), np.uint64, len(ws))


def rolling(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` entries."""
    n = len(h) - width + 1
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out += h[j : j + n] * _BASE[j]
    return _mix(out)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    step, m = 1, x
    while 2 * step <= width:
        m = np.minimum(m[:-step], m[step:])
        step *= 2
    rest = width - step
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def contexts(h: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(anchor, first window, windows) of a document's word hashes."""
    if len(h) < WINDOW:
        return
    m = _sliding_min(rolling(h, RUN), WINDOW - RUN + 1)
    cuts = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
    ends = np.append(cuts[1:], len(m))
    yield from zip(m[cuts].view(np.int64).tolist(), cuts.tolist(), (ends - cuts).tolist(), strict=True)


class Automaton:
    """Suffix automaton of several word sequences."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, seq: list[int]) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for c in seq:
            if c in nxt[last]:
                q = nxt[last][c]
                if length[q] == length[last] + 1:
                    last = q
                    continue
                last = self._split(last, c, q)
                continue
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                link[cur] = q if length[q] == length[p] + 1 else self._split(p, c, q)
            last = cur

    def _split(self, p: int, c: int, q: int) -> int:
        nxt, link = self.next, self.link
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        self.length.append(self.length[p] + 1)
        link.append(link[q])
        link[q] = clone
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = clone
            p = link[p]
        return clone

    def statistics(self, seq: list[int]) -> Iterator[int]:
        """For each end, the length of the longest match that ends there."""
        state = long = 0
        for c in seq:
            while state and c not in self.next[state]:
                state = self.link[state]
                long = self.length[state]
            if c in self.next[state]:
                state = self.next[state][c]
                long += 1
            else:
                long = 0
            yield long



def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _scan(docs: DataFrame) -> DataFrame:
    """(anchor, ctx, doc_id, tid, start, n) of every context; ``tid``, a hash of the text, tells rows of one key apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for b in batches:
            cols: tuple[list, ...] = ([], [], [], [], [], [])
            for k, t, tid in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                h = word_hashes(_words(t)) if k is not None else np.zeros(0, np.uint64)
                raw = memoryview(h.tobytes())
                for anchor, at, n in contexts(h):
                    c = xxh3_128_digest(raw[8 * at : 8 * (at + n + WINDOW - 1)])
                    for col, v in zip(cols, (anchor, c, k, tid, at, n), strict=True):
                        col.append(v)
            types = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
            arrays = [pa.array(c, t) for c, t in zip(cols, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=["anchor", "ctx", "doc_id", "tid", "start", "n"])

    return docs.mapInArrow(run, "anchor bigint, ctx binary, doc_id bigint, tid bigint, start int, n int")


def _spell(docs: DataFrame) -> DataFrame:
    """From (doc_id, tid, text, want: anchor, start, n, hot): the word hashes of the wanted contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: tuple[list, ...] = ([], [], [], [], [], [])
            for k, tid, t, want in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                h = word_hashes(_words(t))
                for w in want:
                    piece = h[w["start"] : w["start"] + w["n"] + WINDOW - 1]
                    for col, v in zip(cols, (w["anchor"], k, tid, w["start"], w["hot"], piece.tobytes()), strict=True):
                        col.append(v)
            types = (*[pa.int64()] * 3, pa.int32(), pa.bool_(), pa.binary())
            arrays = [pa.array(c, t) for c, t in zip(cols, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=["anchor", "doc_id", "tid", "start", "hot", "seq"])

    return docs.mapInArrow(run, "anchor bigint, doc_id bigint, tid bigint, start int, hot boolean, seq binary")


def _shard_spans(group: list[tuple[int, int, int, bytes]]) -> Iterator[tuple[int, int, int, int]]:
    """(doc_id, tid, start, windows) to remove from the first documents of a shard's contexts."""
    sam, at = Automaton(), 0
    while at < len(group):
        doc, until = group[at][0], at
        while until < len(group) and group[until][0] == doc:
            until += 1
        seqs = [np.frombuffer(x[3], np.uint64).tolist() for x in group[at:until]]
        for (_, tid, start, _), seq in zip(group[at:until], seqs, strict=True):
            hits = [i - WINDOW + 1 for i, long in enumerate(sam.statistics(seq)) if long >= WINDOW]
            for i in hits:
                yield doc, tid, start + i, 1
        if until < len(group):
            for seq in seqs:
                sam.add(seq)
        at = until


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, doc_id, tid, start, seq) sorted by anchor and doc_id, shard after shard."""

    def batch(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "tid", "start", "n"])

    group, now, out = [], None, []
    for b in batches:
        for anchor, doc, tid, start, seq in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            if anchor != now:
                out += _shard_spans(group)
                group, now = [], anchor
            group.append((doc, tid, start, seq))
        yield batch(out)
        out = []
    yield batch(list(_shard_spans(group)))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window (hash, doc_id, tid, start) of the contexts of anchors that have too many."""
    from xxhash import xxh3_128_digest

    for b in batches:
        cols: tuple[list, ...] = ([], [], [], [])
        for doc, tid, start, seq in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            w = [xxh3_128_digest(seq[at : at + 8 * WINDOW]) for at in range(0, len(seq) - 8 * WINDOW + 1, 8)]
            for col, v in zip(cols, (w, [doc] * len(w), [tid] * len(w), range(start, start + len(w))), strict=True):
                col.extend(v)
        types = (pa.binary(), pa.int64(), pa.int64(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["w", "doc_id", "tid", "start"])


def spans(docs: DataFrame, shard: int = SHARD) -> DataFrame:
    """(doc_id, tid, start, n) of runs of windows to remove; ``docs`` has (doc_id, tid, text)."""
    place = ["doc_id", "tid", "start", "n"]
    rows = stage(_scan(docs.select("doc_id", "text", "tid")))
    anchors = rows.groupBy("anchor").agg(
        F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.min("ctx").alias("c0"), F.max("ctx").alias("c1")
    ).where("lo < hi").select("anchor", "lo", (F.col("c0") < F.col("c1")).alias("mixed"))
    shared = stage(rows.join(anchors, "anchor"))
    plain = shared.where("NOT mixed AND doc_id > lo").select(place)

    mixed = shared.where("mixed").select("anchor", "ctx", *place)
    first = mixed.groupBy("anchor", "ctx").agg(F.min("doc_id").alias("first"))
    placed = stage(mixed.join(first, ["anchor", "ctx"]))
    again = placed.where("doc_id > first").select(place)
    distinct = placed.where("doc_id = first").select("anchor", *place)
    sizes = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).select("anchor", (F.col("k") > shard).alias("hot"))
    want = distinct.join(sizes, "anchor").groupBy("doc_id", "tid").agg(F.collect_set(F.struct("anchor", "start", "n", "hot")).alias("want"))
    spelled = stage(_spell(docs.join(want, ["doc_id", "tid"]).select("doc_id", "tid", "text", "want")))

    cold = spelled.where("NOT hot").select("anchor", "doc_id", "tid", "start", "seq")
    by_shard = cold.repartition("anchor").sortWithinPartitions("anchor", "doc_id", "tid", "start").mapInArrow(_stream, "doc_id bigint, tid bigint, start int, n int")

    wide = spelled.where("hot").select("doc_id", "tid", "start", "seq").mapInArrow(_windows, "w binary, doc_id bigint, tid bigint, start int")
    least = wide.groupBy("w").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("w", "lo")
    by_window = wide.join(least, "w").where("doc_id > lo").select("doc_id", "tid", "start", F.lit(1).alias("n"))
    return plain.union(again).union(by_shard).union(by_window)


def kept_words(text: str | None, cut: list[dict] | None) -> tuple[int, int, list[bytes]]:
    """Words, removed words, and what stays of a text."""
    ws = _words(text)
    if not cut:
        return len(ws), 0, ws
    edge = np.zeros(len(ws) + 1, np.int64)
    for c in cut:
        edge[c["start"]] += 1
        edge[c["start"] + c["n"] + WINDOW - 1] -= 1
    keep = np.cumsum(edge[:-1]) == 0
    left = [w for w, k in zip(ws, keep.tolist(), strict=True) if k]
    return len(ws), len(ws) - len(left), left


def _finish(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [kept_words(t, c) for t, c in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            text = [b" ".join(x[2]) for x in done]
            cols = [b.column(0), pa.array([x[0] for x in done], pa.int64()), pa.array([x[1] for x in done], pa.int64())]
            cols.append(pa.array([x.decode("utf-8", "surrogatepass") for x in text] if with_text else [hashlib.sha256(x).hexdigest() for x in text], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "n_removed", "kept"])

    return run


def dedup_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", shard: int = SHARD, with_text: bool = True) -> DataFrame:
    """(key, n_words, n_removed, kept) of each document: the text that stays, or its SHA-256."""
    prepare(docs.sparkSession)
    narrow = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("tid"), F.col(text).cast("string").alias("text"))
    cut = spans(narrow, shard).groupBy("doc_id", "tid").agg(F.collect_set(F.struct("start", "n")).alias("cut"))
    return narrow.join(cut, ["doc_id", "tid"], "left").select("doc_id", "text", "cut").mapInArrow(
        _finish(with_text), "doc_id bigint, n_words bigint, n_removed bigint, kept string"
    ).withColumnRenamed("doc_id", key)
