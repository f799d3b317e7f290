"""Operator 8 on five-word shingles: near copies of a similarity of 0.8 or more.

Two texts are near copies if their sets of five-word shingles have a Jaccard similarity of at least
4/5. Such sets are too far apart for 64 bits (a bit differs with probability 0.15), so a text gets a
SimHash fingerprint of 512 bits: eight mixes of each distinct shingle's hash, majority by bit.

1. Pigeonhole blocks. Each fingerprint is split into blocks of ``w`` bits, by one order of its bits
   after another until there are enough blocks. A pair that differs in fewer bits than one order has
   blocks shares one for certain; beyond that a pair at similarity 0.8 exactly shares none with a
   probability of ``MISS``, and closer pairs with less. ``w`` grows with the logarithm of the
   number of distinct texts, so that strangers in a bucket stay few, and the number of blocks follows
   from ``w`` and ``MISS``: recall is the same at every size.
2. Hamming distance. Within a bucket (one block's value) only texts whose numbers of shingles are
   in ratio 4/5 are compared; those within ``DISTANCE`` of ``CHECKED`` bits are linked (more would
   travel with each block's key and spare little). A bucket gives a spanning forest, a row for each
   text, and never its pairs.
3. Keys without a miss. What blocks or bits leave out is found by shingles, for certain. Texts of n
   and m shingles at 4/5 differ in at most (n + m) / 9 of them. The hashes are cut into r parts (1,
   4, 16, ... so that a part holds up to ``PART`` of the shorter text's): in one part at least the
   texts differ in at most (n + m) / 9r shingles. There they share one of the first (n + m) / 9r + 1
   in one order of all shingles (rare ones first, which a sample tells; any order gives the same
   links), or both have no more than that many. Each of these is a key; it carries the parity of the
   part's shingles by ``PARITY`` bits, whose Hamming distance is never over the number of shingles
   that differ, so that strangers in a bucket are told apart and no pair at 4/5 is.
4. Exact similarity. Each component of the links of 2 and 3 is linked anew by the shingles themselves.

Groups over a bound (buckets in steps 2 and 3, components in step 4) are never gathered in one task:
their members are compared with a leader, round after round, which is one row for each member and
settles what is alike; what no leader reached meets all others in cells of bounded size. So do
members within twice the distance of a leader of another tree: by the triangle inequality a link
between two trees has such an end. A group of n near copies costs a multiple of n.

Defined cases: words are runs without blanks, ASCII letters in lower case; texts of equal words are
copies (told apart by 64-bit hashes, as shingles are), and all texts without words are copies of one
another, null ones too; a text under five words is one shingle; a row with a null key belongs to
no group; repeated rows count once; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.llm.common import small, stage, unused
from weftgraph.llm.components import components
from weftgraph.session import prepare

WIDTH, SEED = 5, 42
LONGS, CHECKED_LONGS = 8, 4
BITS, CHECKED = 64 * LONGS, 64 * CHECKED_LONGS
#: Probability that a bit of two fingerprints differs at similarity 0.8: the angle of two sets with cosine 8/9.
FLIP = math.acos(8 / 9) / math.pi
#: Probability that a pair at similarity 0.8 exactly shares no block.
MISS = 0.02
#: Bits up to which a pair is linked before the exact step: the mean at similarity 0.8 and four deviations.
DISTANCE = math.ceil(CHECKED * FLIP + 4 * math.sqrt(CHECKED * FLIP * (1 - FLIP)))
#: Shingles of a part at most (of the shorter text, by expectation), and bits of a part's parity.
PART, PARITY_LONGS = 96, 2
PARITY = 64 * PARITY_LONGS
#: Texts whose shingles are counted, one of so many but at least so many and at most so many, and the count that makes a shingle common.
SAMPLE, SAMPLE_LEAST, SAMPLE_MOST, OFTEN = 32, 4_000, 200_000, 4
#: Common shingles, the most frequent ones, that the order knows.
COMMON = 100_000
#: Members of a bucket or component that one task holds, and shingles of a component.
MEMBERS, SHINGLES = 2_000, 2_000_000
#: Leaders that a large group tries before the rest of it goes into cells.
ROUNDS = 4
#: Leaders (under 100 bytes in step 2; in step 3 those of components, with all their shingles) up to which they are broadcast.
LEADERS = 10_000
#: Rows (about 40 bytes) up to which keys and labels are broadcast.
BROADCAST_ROWS = 1_000_000
_STEP = 1 << 12
_FPS = [f"f{i}" for i in range(LONGS)]
_CHECKED = _FPS[:CHECKED_LONGS]
_PARITY = [f"p{i}" for i in range(PARITY_LONGS)]

_POWERS = np.array([pow(0x9E3779B97F4A7C15, j + 1, 1 << 64) for j in range(WIDTH)], np.uint64)
_MIXES = np.array([pow(0xD6E8FEB86659FD93, 2 * j + 1, 1 << 64) for j in range(LONGS)], np.uint64)
_known: dict[bytes, int] = {}


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(ws: list[bytes]) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text's words."""
    from xxhash import xxh3_64_intdigest

    if not ws:
        return np.empty(0, np.uint64)
    if len(_known) > 200_000:
        _known.clear()
    for w in set(ws):
        if w not in _known:
            _known[w] = xxh3_64_intdigest(w, SEED)
    c = np.array([_known[w] for w in ws], np.uint64)
    width = min(WIDTH, len(ws))
    h = np.zeros(len(ws) - width + 1, np.uint64)
    for j in range(width):
        h += c[j : j + h.size] * _POWERS[j]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    return np.unique(h)


def signature(ws: list[bytes]) -> int:
    """A signed 64-bit hash of a text's words."""
    from xxhash import xxh3_64_intdigest

    x = xxh3_64_intdigest(b" ".join(ws), SEED)
    return x - (1 << 64) if x >> 63 else x


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """The ``BITS`` bits of a set of shingles, as int64; zero for no shingles."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, hashes.size, _STEP):
        h = hashes[at : at + _STEP, None] * _MIXES
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(29)
        ones += np.unpackbits(h.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return np.packbits(2 * ones > hashes.size, bitorder="little").view(np.int64)


def layout(n: int, miss: float = MISS) -> tuple[int, int]:
    """Bits of a block and number of blocks for ``n`` distinct texts."""
    width = max(8, math.ceil(math.log2(n + 1)) - 6)
    return width, math.ceil(math.log(miss) / math.log(1 - (1 - FLIP) ** width))


def blocks(width: int, keys: int) -> np.ndarray:
    """The bits of each block: one order of all bits after another, cut into blocks."""
    rng = np.random.default_rng(SEED)
    of_order = BITS // width
    orders = [rng.permutation(BITS)[: of_order * width].reshape(of_order, width) for _ in range(-(-keys // of_order))]
    return np.concatenate(orders)[:keys]


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.uint64).view(np.int64), pa.int64())


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ``id``, ``n``, ``f0`` to ``f7``) of each document: hash of its words, number of shingles, fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, ns, fps = [], [], np.zeros((b.num_rows, LONGS), np.int64)
            for i, t in enumerate(b.column(1)):
                ws = words(t.as_py())
                s = shingles(ws)
                ids.append(signature(ws))
                ns.append(s.size)
                fps[i] = fingerprint(s)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.int64()), pa.array(ns, pa.int32()), *[pa.array(fps[:, j]) for j in range(LONGS)]], names=["k", "id", "n", *_FPS])

    prepare(docs.sparkSession)
    narrow = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    kind = narrow.schema["k"].dataType.simpleString()
    return narrow.mapInArrow(run, f"k {kind}, id bigint, n int, {', '.join(f'{f} bigint' for f in _FPS)}")


def bucketed(distinct: DataFrame, width: int, keys: int) -> DataFrame:
    """(g, id, n, checked bits) for each block of each fingerprint; ``g`` names block and value."""
    chosen = blocks(width, keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.uint64(1) << np.arange(width, dtype=np.uint64)
        salts = np.random.default_rng(SEED + 1).integers(1, 1 << 63, keys, np.uint64)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                fps = np.stack([b.column(2 + j).to_numpy() for j in range(LONGS)], axis=1)
                bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8), axis=1, bitorder="little")
                g = bits[:, chosen].astype(np.uint64) @ weights
                g = ((g + salts) * np.uint64(0x9E3779B97F4A7C15)) ^ salts  # one to one for each block
                out = [pa.array(np.repeat(b.column(j).to_numpy(), keys)) for j in range(2 + CHECKED_LONGS)]
                yield pa.RecordBatch.from_arrays([_signed(g.ravel()), *out], names=["g", "id", "n", *_CHECKED])

    return distinct.select("id", "n", *_FPS).mapInArrow(run, f"g bigint, id bigint, n int, {', '.join(f'{f} bigint' for f in _CHECKED)}")


def level(n: int) -> int:
    """The least k so that 4^k parts of ``n`` shingles have ``PART`` or fewer by expectation."""
    k = 0
    while PART << 2 * k < n:
        k += 1
    return k


def first_keys(s: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a text's sorted shingles and the parity of the part of each; its last four bits are a key's level.

    A pair's level is that of the shorter text, so a text has keys of all levels that a partner of
    4/5 of its size may ask for.
    """
    n, hashes, counts = s.size, *common
    if not n:
        return np.empty(0, np.uint64), np.empty((0, PARITY_LONGS), np.uint64)
    at = np.minimum(np.searchsorted(hashes, s), max(hashes.size - 1, 0))
    often = np.where(hashes[at] == s, counts[at], 0) if hashes.size else np.zeros(n, np.int64)
    bit = s & np.uint64(PARITY - 1)
    one_hot = np.where((bit >> np.uint64(6))[:, None] == np.arange(PARITY_LONGS, dtype=np.uint64), np.uint64(1) << (bit & np.uint64(63))[:, None], np.uint64(0))
    keys, parities = [], []
    for k in sorted({level(-(-4 * n // 5)), level(n)}):
        r = 1 << 2 * k
        other = 5 * n // 4 if n <= PART * r else PART * r  # shingles of the longest partner at this level
        differ = min((n + other) // 9 // r, n // 5)
        part = (s >> np.uint64(64 - 2 * k)).astype(np.int64) if k else np.zeros(n, np.int64)
        sizes = np.bincount(part, minlength=r)
        starts = np.cumsum(sizes) - sizes
        parity = np.zeros((r, PARITY_LONGS), np.uint64)
        parity[sizes > 0] = np.bitwise_xor.reduceat(one_hot, starts[sizes > 0])
        order = np.lexsort((s, often, part))
        first = order[np.arange(n) - starts[part] <= differ]
        keys.append(s[first] & ~np.uint64(15) | np.uint64(k))
        parities.append(parity[part[first]])
        short = np.flatnonzero(sizes <= differ)  # such parts may have no shingle in common
        if short.size and k:
            keys.append(short.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C10) + np.uint64(k))
            parities.append(parity[short])
    return np.concatenate(keys), np.concatenate(parities)


def part_keys(texts: DataFrame, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(g, id, n, parity) for each key of each text (t)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch() -> pa.RecordBatch:
            ids, ns, times, gs, ps = zip(*rows, strict=True)
            parity = np.concatenate(ps)
            columns = [_signed(np.concatenate(gs)), pa.array(np.repeat(np.array(ids, np.int64), times)), pa.array(np.repeat(np.array(ns, np.int32), times)), *[_signed(parity[:, j]) for j in range(PARITY_LONGS)]]
            return pa.RecordBatch.from_arrays(columns, names=["g", "id", "n", *_PARITY])

        rows, size = [], 0
        for b in batches:
            for t in b.column(0):
                ws = words(t.as_py())
                s = shingles(ws)
                g, p = first_keys(s, common)
                rows.append((signature(ws), s.size, g.size, g, p))
                size += g.size
                if size > 50_000:
                    yield batch()
                    rows, size = [], 0
        if rows:
            yield batch()

    return texts.mapInArrow(run, f"g bigint, id bigint, n int, {', '.join(f'{p} bigint' for p in _PARITY)}")


def common_shingles(texts: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, in order, and counts of shingles that are frequent in a sample of ``n`` texts (t); only an order of keys depends on them."""
    wanted = min(max(n // SAMPLE, SAMPLE_LEAST), SAMPLE_MOST)
    scale = 1 << 20
    of = texts.where(F.pmod(F.xxhash64("t"), F.lit(scale)) < math.ceil(scale * min(1.0, wanted / max(n, 1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0):
                yield pa.RecordBatch.from_arrays([_signed(shingles(words(t.as_py())))], names=["h"])

    counted = of.mapInArrow(run, "h bigint").groupBy("h").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= OFTEN)
    got = counted.orderBy(F.desc("c"), "h").limit(COMMON).toArrow()
    hashes, counts = got.column("h").to_numpy().astype(np.int64).view(np.uint64), got.column("c").to_numpy().astype(np.int64)
    order = np.argsort(hashes)
    return hashes[order], counts[order]


def trees(ids: np.ndarray, n: np.ndarray, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """(member, least member of its tree) for the members that any link reaches, breadth first.

    ``near(x, those)`` says which of the members ``those`` are linked to ``x``. Only members that
    nothing has reached yet are asked about, so alike members are settled by one comparison each.
    """
    by = np.argsort(n, kind="stable")
    size, left, found = n[by], np.ones(n.size, bool), []
    for start in range(n.size):
        if not left[start]:
            continue
        left[start], tree, reached = False, [by[start]], [start]
        while reached:
            x = reached.pop()
            lo, hi = np.searchsorted(5 * size, 4 * size[x]), np.searchsorted(4 * size, 5 * size[x], "right")
            those = lo + np.flatnonzero(left[lo:hi])
            if those.size:
                hit = those[near(by[x], by[those])]
                left[hit] = False
                reached += hit.tolist()
                tree += by[hit].tolist()
        if len(tree) > 1:
            root = int(min(ids[tree]))
            found += [(int(i), root) for i in ids[tree] if i != root]
    return found


def _by_distance(g: np.ndarray, both: np.ndarray) -> int:
    """Bits in which two fingerprints of one bucket may differ."""
    return DISTANCE


def _by_part(g: np.ndarray, both: np.ndarray) -> np.ndarray:
    """Bits in which the parities of one part may differ, for two texts of ``both`` shingles together."""
    return both // (9 << 2 * (g & 15))


def _hamming(g: np.ndarray, n: np.ndarray, bits: np.ndarray, bound: Callable) -> Callable[[int, np.ndarray], np.ndarray]:
    return lambda x, those: np.bitwise_count((bits[those] ^ bits[x]).view(np.uint64)).sum(axis=1, dtype=np.int64) <= bound(g[x], n[those] + n[x])


def _jaccard(n: np.ndarray, sets: list[np.ndarray]) -> Callable[[int, np.ndarray], np.ndarray]:
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum([s.size for s in sets])])
    marked = np.zeros(flat.max(initial=0) + 1, bool)

    def near(x: int, those: np.ndarray) -> np.ndarray:
        own = flat[starts[x] : starts[x + 1]]
        marked[own] = True
        both = np.array([np.count_nonzero(marked[flat[starts[y] : starts[y + 1]]]) for y in those])
        marked[own] = False
        return 9 * both >= 4 * (n[those] + n[x])

    return near


def _linked(pairs: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([a for a, _ in pairs], pa.int64()), "b": pa.array([b for _, b in pairs], pa.int64())})


def _columns(t: pa.Table, bits: list[str]) -> tuple[np.ndarray, ...]:
    g, ids, n = (t.column(c).to_numpy().astype(np.int64) for c in ("g", "id", "n"))
    return g, ids, n, np.ascontiguousarray(np.stack([t.column(f).to_numpy() for f in bits], axis=1))


def _hamming_trees(t: pa.Table, bits: list[str], bound: Callable) -> pa.Table:
    g, ids, n, rows = _columns(t, bits)
    return _linked(trees(ids, n, _hamming(g, n, rows, bound)))


def hamming_trees(t: pa.Table) -> pa.Table:
    return _hamming_trees(t, _CHECKED, _by_distance)


def parity_trees(t: pa.Table) -> pa.Table:
    return _hamming_trees(t, _PARITY, _by_part)


def jaccard_trees(t: pa.Table) -> pa.Table:
    one = {i: (n, h.values.to_numpy()) for i, n, h in zip(t.column("id").to_pylist(), t.column("n").to_pylist(), t.column("hs"), strict=True)}
    n = np.array([x for x, _ in one.values()], np.int64)
    return _linked(trees(np.array(list(one), np.int64), n, _jaccard(n, [h for _, h in one.values()])) if len(one) > 1 else [])


def _bucket_links(g: np.ndarray, ids: np.ndarray, n: np.ndarray, fps: np.ndarray, bound: Callable, members: int, each: int = 32) -> tuple[list[tuple[int, int]], list[int]]:
    """Links of whole buckets, given sorted by (g, n), and the names of buckets over ``members``, which get none.

    In buckets of up to ``each`` rows, all rows at once are held against the next, the one after it
    and so on; larger ones get trees.
    """
    firsts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    sizes = np.diff(np.r_[firsts, g.size])
    found, rows = [], np.flatnonzero(np.repeat(sizes <= min(each, members), sizes))
    for step in range(1, each):
        rows = rows[rows + step < g.size]
        rows = rows[(g[rows] == g[rows + step]) & (5 * n[rows] >= 4 * n[rows + step])]
        if not rows.size:
            break
        hit = rows[np.bitwise_count((fps[rows] ^ fps[rows + step]).view(np.uint64)).sum(axis=1, dtype=np.int64) <= bound(g[rows], n[rows] + n[rows + step])]
        a, b = ids[hit], ids[hit + step]
        found += zip(np.maximum(a, b).tolist(), np.minimum(a, b).tolist(), strict=True)
    for at, k in zip(firsts.tolist(), sizes.tolist(), strict=True):
        if each < k <= members:
            found += trees(ids[at : at + k], n[at : at + k], _hamming(g[at : at + k], n[at : at + k], fps[at : at + k], bound))
    return found, g[firsts[sizes > members]].tolist()


def _in_buckets(keyed: DataFrame, bits: list[str], bound: Callable, members: int) -> DataFrame:
    """(a, b, hot): links of buckets of up to ``members`` rows; for a larger one only a row with its name as ``hot``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(t: pa.Table) -> pa.RecordBatch:
            own, hot = _bucket_links(*_columns(t, bits), bound, members)
            none = [None] * len(hot)
            return pa.RecordBatch.from_arrays(
                [pa.array([*(a for a, _ in own), *none], pa.int64()), pa.array([*(b for _, b in own), *none], pa.int64()), pa.array([None] * len(own) + hot, pa.int64())], names=["a", "b", "hot"]
            )

        last = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([last, t]) if last is not None else t
            g = t.column("g").to_numpy()
            start = int(np.searchsorted(g, g[-1]))
            if start:
                yield solved(t.slice(0, start))
            last = t.slice(start, members + 1)  # more than that shows that it is over the bound, and is not needed
        if last is not None and last.num_rows:
            yield solved(last)

    dealt = keyed.repartition("g").sortWithinPartitions("g", "n", "id")
    return dealt.mapInArrow(run, "a bigint, b bigint, hot bigint")


Relation = Callable[[Callable[[str], Column], Callable[[str], Column]], Column]


def large_groups(rows: DataFrame, alike: Relation, close: Relation | None, payload: list[str], tree: Callable[[pa.Table], pa.Table], members: int, weight: Column, most: int) -> DataFrame:
    """Links (a, b) within the groups of (g, id, n, payload), for groups too large for one task.

    ``alike`` holds all members of a group against its leader, the least id that no leader has
    reached; trees that a leader is linked to become its own. After ``ROUNDS`` of them the open
    members meet each other and all others in cells, each of about ``members`` of either kind and
    ``most`` of ``weight``. Open are those that none has reached, and those ``close`` to the leader of
    another tree, that is as near as a member with a link to a member of that tree must be. Without
    ``close`` links between members of two trees may be left out.
    """
    state, found, leads = rows.withColumn("tree", F.lit(None).cast("bigint")).withColumn("by", F.array().cast("array<bigint>")), None, None
    for _ in range(ROUNDS):
        lead = stage(state.where("tree IS NULL").groupBy("g").agg(F.min_by(F.struct("id", "n", *payload), "id").alias("lead")))
        if lead.isEmpty():
            break
        own, other = (lambda c: F.col(c)), (lambda c: F.col("g") if c == "g" else F.col(f"lead.{c}"))
        ratio = lambda a, b: (b * F.col("n") >= a * F.col("lead.n")) & (b * F.col("lead.n") >= a * F.col("n"))
        linked = F.coalesce(ratio(4, 5) & alike(own, other), F.lit(False))
        border = F.coalesce(ratio(16, 25) & close(own, other), F.lit(False)) if close else F.lit(False)
        met = state.join(small(lead, LEADERS), "g", "left")
        seen = stage(met.select(*state.columns, linked.alias("linked"), border.alias("border"), F.col("lead.id").alias("leader")))
        new = seen.where("linked AND id <> leader").select(F.col("id").alias("a"), F.col("leader").alias("b"))
        found = new if found is None else found.union(new)
        led = lead.select("g", F.col("lead.id").alias("leader"))
        leads = led if leads is None else leads.union(led)
        joined = stage(seen.where("linked AND tree IS NOT NULL").select("g", F.col("tree").alias("old")).distinct())
        now = seen.join(small(joined.withColumnRenamed("g", "og"), BROADCAST_ROWS), (F.col("g") == F.col("og")) & (F.col("tree") == F.col("old")), "left")
        state = now.select(
            *rows.columns,
            F.when(F.col("linked") | F.col("old").isNotNull(), F.col("leader")).otherwise(F.col("tree")).alias("tree"),
            F.when(F.col("border") & ~F.col("linked"), F.concat("by", F.array("leader"))).otherwise(F.col("by")).alias("by"),
        )
    if found is None:
        return rows.sparkSession.createDataFrame([], "a bigint, b bigint")
    if close:
        at_end = state.select("g", F.col("id").alias("leader"), F.col("tree").alias("of")).join(small(stage(leads), BROADCAST_ROWS), ["g", "leader"]).distinct()
        between = state.where("tree IS NOT NULL AND size(by) > 0").select("g", "id", "tree", F.explode("by").alias("leader")).join(small(stage(at_end), BROADCAST_ROWS), ["g", "leader"])
        ends = stage(between.where("tree <> of").select("g", "id").distinct())
        state = state.join(small(ends.withColumn("end", F.lit(True)), BROADCAST_ROWS), ["g", "id"], "left").withColumn("open", F.col("tree").isNull() | F.col("end").isNotNull())
    else:
        state = state.withColumn("open", F.col("tree").isNull())
    state = stage(state.select(*rows.columns, "open"))
    rest, reached = state.where("open").drop("open"), state.where("NOT open").drop("open")
    open_ = stage(rest.groupBy("g").agg(F.greatest(F.ceil(F.count(F.lit(1)) / members), F.ceil(F.sum(weight) / most)).cast("int").alias("k")))
    if open_.isEmpty():
        return found
    settled = reached.join(open_.select("g"), "g", "left_semi").groupBy("g").agg(F.greatest(F.ceil(F.count(F.lit(1)) / members), F.ceil(F.sum(weight) / most)).cast("int").alias("m"))
    cells = stage(open_.join(settled, "g", "left").select("g", "k", F.coalesce("m", F.lit(0)).alias("m")))
    at = lambda k: F.pmod(F.xxhash64("id"), F.col(k)).cast("int")
    ours = rest.join(cells, "g").withColumn("i", at("k"))
    # an open member meets every chunk of open ones (a cell for each pair of chunks) and every settled chunk
    theirs = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda j: F.struct(F.least("i", j).alias("x"), F.greatest("i", j).alias("y")))
    across = F.when(F.col("m") > 0, F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda j: F.struct(F.col("i").alias("x"), (-1 - j).alias("y")))).otherwise(F.array().cast("array<struct<x:int,y:int>>"))
    mine = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: F.struct(i.alias("x"), (-1 - F.col("i")).alias("y")))
    dealt = ours.withColumn("c", F.explode(F.concat(theirs, across))).select(*rows.columns, "c.x", "c.y")
    other = reached.join(cells, "g").where("m > 0").withColumn("i", at("m")).withColumn("c", F.explode(mine)).select(*rows.columns, "c.x", "c.y")
    return found.union(dealt.union(other).groupBy("g", "x", "y").applyInArrow(tree, "a bigint, b bigint"))


def fewer(links: DataFrame) -> DataFrame:
    """Links that connect the same nodes: of each member's links one to the least, and links between those it had."""
    ends = links.groupBy("a").agg(F.collect_set("b").alias("bs")).withColumn("b", F.array_min("bs"))
    between = ends.select(F.explode("bs").alias("a"), "b").where("a <> b")
    return ends.select("a", "b").union(between).distinct()


def _same_bits(own: Callable[[str], Column], other: Callable[[str], Column]) -> Column:
    return sum((F.bit_count(own(f).bitwiseXOR(other(f))) for f in _CHECKED), F.lit(0)) <= DISTANCE


def _same_shingles(own: Callable[[str], Column], other: Callable[[str], Column]) -> Column:
    return 9 * F.size(F.array_intersect(own("hs"), other("hs"))) >= 4 * (own("n") + other("n"))


def _close_shingles(own: Callable[[str], Column], other: Callable[[str], Column]) -> Column:
    """Similarity 3/5: its complement is a metric, so two steps of 1/5 are 2/5 at most."""
    return 8 * F.size(F.array_intersect(own("hs"), other("hs"))) >= 3 * (own("n") + other("n"))


def _parity_distance(own: Callable[[str], Column], other: Callable[[str], Column]) -> Column:
    bits = sum((F.bit_count(own(p).bitwiseXOR(other(p))) for p in _PARITY), F.lit(0))
    return bits * F.pow(F.lit(4.0), own("g").bitwiseAND(F.lit(15)))


def _same_part(own: Callable[[str], Column], other: Callable[[str], Column]) -> Column:
    return 9 * _parity_distance(own, other) <= own("n") + other("n")


def _close_part(own: Callable[[str], Column], other: Callable[[str], Column]) -> Column:
    """Two steps by way of a text of up to 5/4 of the lesser."""
    return 18 * _parity_distance(own, other) <= 2 * (own("n") + other("n")) + 5 * F.least(own("n"), other("n"))


def loose_links(distinct: DataFrame, members: int = MEMBERS) -> DataFrame:
    """Links (a, b) of (id, n, fingerprint) within ``DISTANCE`` bits, of pairs that share a block."""
    keyed = bucketed(distinct, *layout(distinct.count()))
    return _links(keyed, _CHECKED, _by_distance, lambda rows: large_groups(rows, _same_bits, None, _CHECKED, hamming_trees, members, F.lit(1), members), members)


def part_links(texts: DataFrame, common: tuple[np.ndarray, np.ndarray], members: int = MEMBERS) -> DataFrame:
    """Links (a, b) of texts (t) that have every pair of similarity 4/5, and few others."""
    return _links(part_keys(texts, common), _PARITY, _by_part, lambda rows: large_groups(rows, _same_part, _close_part, _PARITY, parity_trees, members, F.lit(1), members), members)


def _links(keyed: DataFrame, bits: list[str], bound: Callable, in_large: Callable[[DataFrame], DataFrame], members: int) -> DataFrame:
    found = stage(_in_buckets(keyed, bits, bound, members))
    links = found.where("hot IS NULL").select("a", "b")
    hot = stage(found.where("hot IS NOT NULL").select(F.col("hot").alias("g")).distinct())
    if not hot.isEmpty():
        links = links.union(in_large(stage(keyed.join(small(hot, BROADCAST_ROWS), "g"))))
    return stage(fewer(links))


def _once(docs: DataFrame, named: DataFrame, distinct: DataFrame, key: str, text: str) -> DataFrame:
    """(t): the rows with a least key of a text, so each text at least once; the shorter list of keys goes to the documents."""
    least = stage(distinct.select(F.col("least").alias("__k")).distinct())
    others = stage(named.select(F.col("k").alias("__k")).distinct().join(least, "__k", "left_anti"))
    few, how = (others, "left_anti") if others.count() <= least.count() else (least, "left_semi")
    return docs.join(small(few, BROADCAST_ROWS), docs[key] == F.col("__k"), how).select(F.col(text).cast("string").alias("t"))


def _sets(docs: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """(g, id, n, hs): the shingles of the members (least, id, g), once for each row of a member's key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ws = [words(t) for t in b.column(0).to_pylist()]
            sets = [shingles(w).view(np.int64) for w in ws]
            yield pa.RecordBatch.from_arrays([pa.array([signature(w) for w in ws], pa.int64()), pa.array([s.size for s in sets], pa.int32()), pa.array(sets, pa.list_(pa.int64()))], names=["id", "n", "hs"])

    keys = wanted.select(F.col("least").alias("__k")).distinct()
    texts = docs.join(small(keys, BROADCAST_ROWS), docs[key] == F.col("__k"), "left_semi").select(F.col(text).cast("string").alias("t"))
    # a key may come with several texts; only the one that is a member has its id
    return texts.mapInArrow(run, "id bigint, n int, hs array<bigint>").join(small(wanted.select("id", "g"), BROADCAST_ROWS), "id").select("g", "id", "n", "hs")


def exact_links(members: DataFrame, most: int = MEMBERS, shingles_a_task: int = SHINGLES) -> DataFrame:
    """Links (a, b) of (g, id, n, hs) of similarity 4/5 within the groups ``g``."""
    large = members.groupBy("g").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("s")).where((F.col("k") > most) | ((F.col("s") > shingles_a_task) & (F.col("k") > 2)))
    large = stage(large.select("g"))
    few = members.join(small(large, BROADCAST_ROWS), "g", "left_anti")
    links = few.groupBy("g").applyInArrow(jaccard_trees, "a bigint, b bigint")
    if not large.isEmpty():
        rows = stage(members.join(small(large, BROADCAST_ROWS), "g"))
        links = links.union(large_groups(rows, _same_shingles, _close_shingles, ["hs"], jaccard_trees, most, F.col("n"), shingles_a_task))
    return stage(links.distinct())


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", members: int = MEMBERS, shingles_a_task: int = SHINGLES) -> tuple[DataFrame, DataFrame]:
    """Two tables: (key, ``id``) of each document with a key, and (``id``, least, first) of each distinct text.

    ``least`` is the least key of a text and ``first`` that of its class.
    """
    docs = docs.where(F.col(key).isNotNull()).select(key, text)
    named = stage(fingerprints(docs, key, text))
    distinct = stage(named.groupBy("id").agg(F.min("k").alias("least"), F.min("n").alias("n"), *[F.min(f).alias(f) for f in _FPS]))
    texts = _once(docs, named, distinct, key, text)
    parts = part_links(texts, common_shingles(texts, distinct.count()), members)
    loose = components(loose_links(distinct, members).union(parts))
    wanted = stage(distinct.select("id", "least").join(loose.select(F.col("node").alias("id"), F.col("label").alias("g")), "id"))
    found = components(exact_links(stage(_sets(docs, wanted, key, text)), members, shingles_a_task))
    of = wanted.select("id", "least").join(found, F.col("id") == F.col("node"))
    best = of.groupBy("label").agg(F.min("least").alias("first"))
    firsts = stage(of.join(best, "label").select("id", "first"))
    each = distinct.select("id", "least").join(firsts, "id", "left").select("id", "least", F.coalesce("first", "least").alias("first"))
    return named.select(F.col("k").alias(key), "id"), each


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", members: int = MEMBERS, shingles_a_task: int = SHINGLES) -> DataFrame:
    """(key, ``component_id``) of each document with a key: the least key of its class of near copies."""
    named, each = classes(docs, key, text, members, shingles_a_task)
    return named.join(each, "id").select(key, F.col("first").alias("component_id"))


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class, that of the least key, with all its columns; repeated rows of it once.

    Rows without a key belong to no class and stay.
    """
    named, each = classes(docs, key, text)
    keep = stage(each.where("least = first").select(F.col("least").alias("k")).distinct())
    keys = stage(named.groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("times")))
    gone = stage(keys.join(keep, "k", "left_anti").select("k"))
    name = unused("key_", docs)
    same = docs[key] == F.col(name)
    # the shorter list goes to the documents, and texts move only if neither is short
    if gone.count() <= keep.count():
        kept = docs.join(small(gone.withColumnRenamed("k", name), BROADCAST_ROWS), same, "left_anti")
    else:
        kept = docs.where(F.col(key).isNotNull()).join(small(keep.withColumnRenamed("k", name), BROADCAST_ROWS), same, "left_semi").unionByName(docs.where(F.col(key).isNull()))
    twice = stage(keys.where("times > 1").select(F.col("k").alias(name)))
    return once(kept, twice, key, text)


def once(docs: DataFrame, twice: DataFrame, key: str, text: str) -> DataFrame:
    """``docs`` with one row for each of the keys in ``twice``, that of the least hash of its text; no other text moves."""
    if twice.isEmpty():
        return docs
    nth = unused("nth_", docs)
    same = docs[key] == F.col(twice.columns[0])
    few = small(twice, BROADCAST_ROWS)
    order = Window.partitionBy(key).orderBy(F.xxhash64(F.col(text)))
    repeated = docs.join(few, same, "left_semi").withColumn(nth, F.row_number().over(order)).where(F.col(nth) == 1).drop(nth)
    return docs.join(few, same, "left_anti").unionByName(repeated)
