"""Exact Jaccard self-join on word shingles by partitioning the universe of hashes.

Sets of one size band [lo, hi] (hi < lo / 0.85 of the next) can only be similar to sets of the same band or
a neighbour's.  For a band, the range of hashes is cut into m segments.  Two similar sets differ in at
most H elements, so if m + d > H, d of the segments with a one-deletion neighbourhood (which catches one difference), the others as
they are, then at least one segment agrees (pigeonhole).  A set's signatures are its segments' subsets, and
for the d segments also those with one element left out.  Bands where similar sets are equal (H = 0) need none.

Allocation: m and d of a band minimise its signatures, of which those of one element, which
agree by accident most often, cost ``ACCIDENT`` times as much.  It depends on the sizes alone, so it is the same for any number of documents.
Segments in which two sets agree because there is nothing in them are not signatures: ``slack`` more segments make up for those that two sets can share, and a set that has more of
them than that (one in millions) does keep them.

Copies (equal sets) are one class.  Signatures meet as in ``exchange``, which tells sets of owners; owners become classes, and
sets of the same classes are one bucket.  In each bucket all classes are verified
against its smallest one, then twice those in other components against its hub (the one with the most links so far); classes of a bucket
that are then in different components are verified against each other, in blocks, by exact counts over an inverted list, unless sizes or histograms of their elements (bins for half of them or more, whose differences bound the sets')
rule a link out.  So every pair that shares a signature is verified, or linked by verified pairs, or ruled out.  Texts are
fetched for pairs only that the bounds leave.

Elements are 64-bit hashes of shingles; classes 64-bit sums of mixed elements.

Defined cases: null or empty text, or no words: an empty set, linked with nothing.  Fewer words than a
shingle: the whole sequence is the only element.  Rows with one doc_id are documents of their own for the
join; a null doc_id stays null.  doc_id is a number (or text of one).  Other columns are ignored.
"""

from __future__ import annotations

import functools
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import dropped, lean, mix, parts, signed, split_near, written
from .exchange import OWNERS, Outbox, buckets_for, exchanged
from .graph import components, merged

NO_ID = -(1 << 63)
BINS = 64
#: What a signature of one element costs, against any other.
ACCIDENT = 8.0
#: Bands reach sets of this many elements.
LARGEST = 1 << 31


def shingle_sets(texts: list[bytes | None], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word shingles of each text."""
    flat, n = words.distinct(*words.shingles(*words.plain()(texts), width))
    return np.split(flat, np.cumsum(n)[:-1]) if texts else []


def class_keys(flat: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Classes of the sets in a row (int64), which have n elements each; 0 for empty ones."""
    out = np.zeros(len(n), np.uint64)
    full = n > 0
    if len(flat):
        out[full] = mix(np.add.reduceat(mix(flat), (np.cumsum(n) - n)[full]) + n[full].astype(np.uint64))
    return signed(out)


def histogram_rows(flat: np.ndarray, n: np.ndarray) -> list[bytes]:
    """Of each set: counts (255 at most, which keeps the bound) of its elements' low bits, with half a bin or more for each element."""
    bins = np.maximum(BINS, 1 << np.ceil(np.log2(n // 2 + 1)).astype(np.int64))
    ends = np.cumsum(bins)
    at = np.repeat(ends - bins, n) + (flat & np.repeat(bins - 1, n).astype(np.uint64)).astype(np.int64)
    counts = np.minimum(np.bincount(at, minlength=int(bins.sum())), 255).astype(np.uint8).tobytes()
    return [counts[a:b] for a, b in zip((ends - bins).tolist(), ends.tolist())]


def histogram(elements: np.ndarray) -> bytes:
    return histogram_rows(elements, np.array([len(elements)]))[0]


def histograms(stored: list[bytes]) -> np.ndarray:
    """One row each, with as many bins as the smallest has."""
    bins = min(map(len, stored))
    return np.stack([np.frombuffer(h, np.uint8).reshape(-1, bins).sum(axis=0, dtype=np.int32) for h in stored])


def rare_excess(mean: float, chance: float) -> int:
    """The number that a Poisson variable exceeds with at most this chance."""
    if mean > 50:
        return math.ceil(mean + 6 * math.sqrt(mean))
    term = left = math.exp(-mean)
    k = 0
    while 1 - left > chance and k < 200:
        k += 1
        term *= mean / k
        left += term
    return k


@functools.cache
def bands_for(percent: int) -> Bands:
    return Bands(percent)


class Bands:
    """Size bands and their allocation for similarity of percent or more.  plans: segments, those with deletions, slack."""

    def __init__(self, percent: int, largest: int = LARGEST):
        self.percent = percent
        lows = [1]
        while lows[-1] <= largest:
            lows.append(100 * lows[-1] // percent + 1)
        lows.append(100 * lows[-1] // percent + 1)
        self.lows = np.array(lows, np.int64)
        self.plans = np.array([self.allocate(b) for b in range(len(lows) - 1)], np.int64)

    def differences(self, size_a, size_b):
        """Most elements in which two similar sets of these sizes (or their sum's bound) differ."""
        p = self.percent
        return (100 - p) * (size_a + size_b) // (100 + p)

    def allocate(self, b: int) -> tuple[int, int, int]:
        """(segments, those with deletions, slack) of the least cost."""
        low, high = int(self.lows[b]), int(self.lows[b + 1]) - 1
        next_high = 100 * (high + 1) // self.percent if b + 2 >= len(self.lows) else int(self.lows[b + 2]) - 1
        need = self.differences(high, next_high) + 1
        if need == 1:
            return 0, 0, 0
        # The smallest sets have too few elements for the rarest of chances.
        for chance in (1e-7, 1e-5, 1e-4, 1e-3, 1e-2):
            options = [self.option(low, high, need, share, chance) for share in (0, 1 / 16, 1 / 8, 1 / 4, 1 / 2, 3 / 4, 1)]  # of segments with deletions
            if best := min((x for x in options if x), default=None):
                return best[1:]
        return need, 0, 0

    @staticmethod
    def option(low: int, high: int, need: int, share: float, chance: float) -> tuple[float, int, int, int] | None:
        """(cost, segments, those with deletions, slack), so that a set has more of nothing than the slack with the given chance."""
        m = math.ceil(need / (1 + share))
        for _ in range(100):
            d = math.ceil(share * m)
            # What two sets may share of segments that have nothing, or of those with deletions one element at most (which count double).
            none = (1 - 1 / m) ** low
            thin = none + low / m * (1 - 1 / m) ** (low - 1)
            slack = rare_excess((m - d) * none, chance) + 2 * rare_excess(d * thin, chance)
            if m + d >= need + slack:
                size = high / m
                singles = (m - d) * size * math.exp(-size) + d * size * size * math.exp(-size)
                return m + d * size + (ACCIDENT - 1) * singles, m, d, slack
            m = max(m + 1, math.ceil((need + slack) / (1 + share)))
        return None

    def signatures(self, flat: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(signatures, places of their sets) of sorted sets in a row, of their own bands and of those below."""
        if not len(flat):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        band = np.searchsorted(self.lows, n, side="right") - 1
        mixed, out = mix(flat), []
        for below in (0, 1):
            plans = self.plans[np.maximum(band - below, 0)]
            m = np.where((band >= below) & (n > 0), plans[:, 0], 0)
            take = np.repeat(m > 0, n)
            if take.any():
                out.append(self.of_bands(flat[take], mixed[take], np.flatnonzero(m > 0), n[m > 0], m[m > 0], plans[m > 0, 1], plans[m > 0, 2], band[m > 0] - below))
        if not out:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*out))

    def of_bands(self, flat, mixed, sets, n, m, d, slack, band) -> tuple[np.ndarray, np.ndarray]:
        owner = np.repeat(np.arange(len(n)), n)
        segment = ((flat >> np.uint64(32)) * m[owner].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        new = np.ones(len(flat), bool)
        new[1:] = (segment[1:] != segment[:-1]) | (owner[1:] != owner[:-1])
        begins = np.flatnonzero(new)
        size, of, seg = np.diff(np.append(begins, len(flat))), owner[begins], segment[begins]
        total, salt = np.add.reduceat(mixed, begins), self.salt(band[of], seg)
        sigs, owners = [mix(total + salt)], [of]
        with_deletions = seg < d[of]
        if with_deletions.any():
            group = np.repeat(np.arange(len(begins)), size)
            each = np.flatnonzero((with_deletions & (size > 1))[group])
            sigs.append(mix(total[group[each]] - mixed[each] + salt[group[each]]))
            owners.append(owner[each])
        full = np.bincount(of[~with_deletions], minlength=len(n))
        thick = np.bincount(of[with_deletions & (size > 1)], minlength=len(n))
        for k in np.flatnonzero(m - d - full + 2 * (d - thick) > slack).tolist():  # keeps what has nothing
            there = np.zeros(m[k], bool)
            mine = of == k
            there[seg[mine]] = True
            single = seg[mine & (size == 1) & with_deletions]
            lack = np.concatenate([np.flatnonzero(~there), single])
            sigs.append(mix(self.salt(np.full(len(lack), band[k]), lack)))
            owners.append(np.full(len(lack), k))
        return np.concatenate(sigs), sets[np.concatenate(owners)]

    @staticmethod
    def salt(band: np.ndarray, segment: np.ndarray) -> np.ndarray:
        return mix(segment.astype(np.uint64) + ((band + 1).astype(np.uint64) << np.uint64(32)))


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def buckets_of(sets: DataFrame) -> DataFrame:
    """(sig, key, pivot) of the sets (``set, key``) of two classes or more, one bucket for each group of classes."""
    each = sets.distinct()
    names = each.groupBy("set").agg(F.count("*").alias("n"), F.min("key").alias("pivot"), F.expr("sum(cast(xxhash64(key) as decimal(38, 0)))").alias("a"), F.bit_xor(F.xxhash64("key", F.lit(7))).alias("b"))
    one = names.where("n > 1").groupBy("n", "pivot", "a", "b").agg(F.min("set").alias("set")).select("set", "pivot")
    return each.join(one, "set").select(F.col("set").alias("sig"), "key", "pivot")


def dealt(members_of: DataFrame, roots: DataFrame, facts: DataFrame, most_rows: int = 1024, most_elements: int = 250_000) -> DataFrame:
    """``sig, i, j, own, key, root`` and the facts of classes (``key, size, ...``) of buckets with several components.
    Block i meets block j >= i; each row goes to all pairs of blocks that have its own.  The rows of a bucket's largest
    component have blocks of their own, which come last and do not meet each other."""
    known = members_of.select("sig", "key").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    sized = known.join(facts.select("key", "size"), "key")
    by_root = sized.groupBy("sig", "root").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    top = F.max(F.struct("n", "root", "size"))
    sums = by_root.groupBy("sig").agg(F.count("*").alias("parts"), top.alias("top"), F.sum("n").alias("n"), F.sum("size").alias("size")).where("parts > 1")
    blocks = lambda n, size: F.ceil(F.greatest(n / most_rows, size / most_elements, F.lit(1))).cast("int")
    open_ = sums.select("sig", F.col("top.root").alias("top"), blocks(F.col("n") - F.col("top.n"), F.col("size") - F.col("top.size")).alias("few"), blocks(F.col("top.n"), F.col("top.size")).alias("many"))
    mine = known.join(open_, "sig").join(facts, "key").withColumn("hash", F.xxhash64("key"))
    is_top = F.col("root") == F.col("top")
    mine = mine.withColumn("own", F.when(is_top, F.col("few") + F.pmod("hash", "many")).otherwise(F.pmod("hash", "few")).cast("int"))
    others = mine.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(is_top, F.col("few") - 1).otherwise(F.col("few") + F.col("many") - 1))))
    return others.select("sig", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "key", "root", *[c for c in facts.columns if c != "key"])


def left_open(groups: list[tuple], rough, most: int = 1 << 18) -> list[tuple]:
    """Of several pairs of blocks, each ``(sig, i, j)`` and its rows ``own, key, root, text``, the rows that ``rough`` leaves a partner in another component.
    rough(texts) gives a function of two arrays of places in them, which tells the pairs that may be similar; ``most`` pairs are held at once."""
    size = np.array([len(held) for _, held in groups], np.int64)
    group = np.repeat(np.arange(len(groups)), size)
    i, j = (np.array([current[k] for current, _ in groups], np.int64)[group] for k in (1, 2))
    held = [r for _, some in groups for r in some]
    own, root = (np.array([r[k] for r in held], np.int64) for k in (0, 2))
    order = np.lexsort((own != i, group))  # of a pair of blocks the first one's rows come first
    held, i, j, own, root = [held[k] for k in order.tolist()], i[order], j[order], own[order], root[order]
    ends, firsts, places = np.cumsum(size)[group], np.bincount(group, own == i, len(groups)).astype(np.int64)[group], np.arange(len(held))
    begin = np.where(i == j, places + 1, ends - size[group] + firsts)
    n = np.where(own == i, ends - begin, 0)
    before, may, open_ = np.concatenate([[0], np.cumsum(n)]), rough([r[-1] for r in held]), np.zeros(len(held), bool)
    first = 0
    while first < len(held):
        last = max(first + 1, int(np.searchsorted(before, before[first] + most, side="right")) - 1)
        x = np.repeat(places[first:last], n[first:last])
        y = np.arange(before[first], before[last]) - np.repeat(before[first:last] - begin[first:last], n[first:last])
        apart = root[x] != root[y]
        x, y = x[apart], y[apart]
        found = may(x, y)
        open_[x[found]] = open_[y[found]] = True
        first = last
    bounds = np.concatenate([[0], np.cumsum(size)]).tolist()
    return [(current, [held[k] for k in range(a, b) if open_[k]]) for (current, _), a, b in zip(groups, bounds, bounds[1:]) if open_[a:b].any()]


def by_block(rows: DataFrame, result, schema: str, rough=None, load: int = 1 << 20) -> DataFrame:
    """Rows that result((sig, i, j), rows of own, key, root and facts, the last a text or binary) gives for each pair of blocks.
    With ``rough``, only rows that are ``left_open`` come to it; about ``load`` bytes of whole pairs of blocks go through that at once."""

    def rows_of(batches):
        import pyarrow as pa

        names = [c.split()[0] for c in schema.split(", ")]

        def told(found):
            return pa.RecordBatch.from_arrays([pa.array([int(r[k]) for r in found], pa.int64()) for k in range(len(names))], names)

        def results(groups):
            groups = [x for x in groups if len(x[1]) > 1]
            return [r for current, held in (left_open(groups, rough) if rough and groups else groups) for r in result(current, held)]

        groups, held = [], 0
        for batch in (p for whole in batches for p in parts(whole, whole.num_columns - 1)):
            found = []
            for r in zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns))):
                if not groups or r[:3] != groups[-1][0]:
                    if held >= load or not rough:
                        found += results(groups)
                        groups, held = [], 0
                    groups.append((r[:3], []))
                groups[-1][1].append(r[3:])
                held += len(r[-1]) + 64
            yield told(found)
        yield told(results(groups))

    return rows.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j").mapInArrow(lean(rows_of), schema)


def contested(rows: DataFrame, percent: int) -> DataFrame:
    """Of ``dealt`` rows with size and histogram, those that the bounds leave a partner in their pair of blocks."""

    def near(current, held):
        own = np.array([r[0] for r in held])
        key, root, size = (np.array([r[k] for r in held], np.int64) for k in (1, 2, 3))
        bins = histograms([r[4] for r in held])
        right, open_ = np.flatnonzero(own == current[2]), np.zeros(len(held), bool)
        for x in np.flatnonzero(own == current[1]).tolist():
            y = right[root[right] != root[x]]
            y = y[100 * np.minimum(size[y], size[x]) >= percent * np.maximum(size[y], size[x])]
            y = y[np.abs(bins[y] - bins[x]).sum(axis=1) * (100 + percent) <= (100 - percent) * (size[y] + size[x])]
            if len(y):
                open_[x] = open_[y] = True
        return [(*current, *held[x][:3]) for x in np.flatnonzero(open_).tolist()]

    return by_block(rows, near, "sig bigint, i bigint, j bigint, own bigint, key bigint, root bigint")


def linked_in_blocks(rows: DataFrame, sets, percent: int, rough=None) -> DataFrame:
    """Links (a, b) between the components in each pair of blocks; rows: ``sig, i, j, own, key, root, text``.
    Two similar sets share one of their rarest elements (as many as a similar set may lack, and one), so an inverted list of those
    of block j gives candidates, whose intersections are counted exactly; of the similar pairs a spanning forest is given, fewer than the rows that came.  rough: see ``left_open``."""

    def links(current, held):
        own = np.array([r[0] for r in held])
        found = sets([r[3] for r in held])
        size = np.array([len(x) for x in found], np.int64)
        _, local, often = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
        rank = np.empty(len(often), np.int64)
        rank[np.argsort(often, kind="stable")] = np.arange(len(often))
        owner, at = np.repeat(np.arange(len(held)), size), np.concatenate([[0], np.cumsum(size)])
        # Each set's elements, the rarest first.
        local = np.sort(owner * len(often) + rank[local]) - owner * len(often)
        rarest = size - -(-percent * size // 100) + 1
        first = np.arange(len(local)) - at[owner] < rarest[owner]
        mine = np.flatnonzero(first & (own[owner] == current[2]))
        mine = mine[np.argsort(local[mine], kind="stable")]
        posted, ends = owner[mine], np.cumsum(np.bincount(local[mine], minlength=len(often)))
        begins = np.concatenate([[0], ends[:-1]])
        _, part = np.unique(np.array([r[2] for r in held], np.int64), return_inverse=True)
        out, marked = [], np.zeros(len(often), bool)
        for x in np.flatnonzero(own == current[1]).tolist():
            terms = local[at[x] : at[x] + min(rarest[x], size[x])]
            lists = [posted[a:b] for a, b in zip(begins[terms].tolist(), ends[terms].tolist()) if a < b]
            near = np.unique(np.concatenate(lists)) if lists else np.zeros(0, np.int64)
            near = near[(part[near] != part[x]) & (100 * np.minimum(size[near], size[x]) >= percent * np.maximum(size[near], size[x]))]
            if not len(near):
                continue
            marked[local[at[x] : at[x + 1]]] = True
            starts = np.cumsum(size[near]) - size[near]
            both = np.add.reduceat(marked[local[np.repeat(at[near] - starts, size[near]) + np.arange(int(size[near].sum()))]], starts, dtype=np.int64)
            marked[local[at[x] : at[x + 1]]] = False
            for y in near[100 * both >= percent * (size[near] + size[x] - both)].tolist():
                if part[y] != part[x]:
                    part[part == part[y]] = part[x]
                    out.append((held[x][1], held[y][1]))
        return out

    return by_block(rows, links, "a bigint, b bigint", rough).distinct()


def texts_of(wanted: DataFrame, classes: DataFrame, documents: DataFrame) -> DataFrame:
    """``key, text`` of the wanted classes (``key``); documents: ``hash, text``.  A class's text is found by its hash, so equal rows come once,
    from each task once at most, and no id matters."""
    hashes = wanted.distinct().join(classes.select("key", "hash"), "key")
    near = split_near(documents, F.col("hash"), hashes.select("hash"))[1]
    return near.groupBy("hash").agg(F.first("text").alias("text")).join(hashes, "hash").select("key", "text")


def possible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and histograms of the classes leave."""
    facts = classes.select("key", "size", "histogram")
    sized = pairs
    for x in ("a", "b"):
        sized = sized.join(facts.select(F.col("key").alias(x), F.col("size").alias(f"size_{x}"), F.col("histogram").alias(f"bins_{x}")), x)
    sized = sized.where(f"100 * least(size_a, size_b) >= {percent} * greatest(size_a, size_b)")

    def near(batches):
        import pyarrow as pa

        for batch in batches:
            n, x, y = (batch.column(k).to_pylist() for k in (2, 3, 4))
            keep = [int(np.abs(np.subtract(*histograms([p, q]))).sum()) * (100 + percent) <= (100 - percent) * m for m, p, q in zip(n, x, y)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return sized.select("a", "b", (F.col("size_a") + F.col("size_b")).alias("n"), "bins_a", "bins_b").mapInArrow(lean(near), "a bigint, b bigint")


def verified(pairs: DataFrame, texts: DataFrame, sets, percent: int, salts: int = 16, rough=None) -> DataFrame:
    """The pairs (a, b) of classes whose sets are similar; sets(texts) gives sorted distinct elements (rough: see ``left_open``).
    b's texts come to a's, which is sent to each of ``salts`` parts of its pairs that has one."""
    dealt = pairs.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(salts)).cast("int"))
    others = dealt.join(texts.withColumnRenamed("key", "b"), "b").select("a", "part", F.lit(1).alias("side"), "b", "text")
    pivots = dealt.select("a", "part").distinct().join(texts.withColumnRenamed("key", "a"), "a").select("a", "part", F.lit(0).alias("side"), F.col("a").alias("b"), "text")

    def linked(batches):
        import pyarrow as pa

        pivot = b""
        for part in (p for batch in batches for p in parts(batch, 4)):
            a, b = (part.column(k).to_pylist() for k in (0, 3))
            is_pivot = part.column(2).to_numpy() == 0
            rows = [pivot, *part.column(4).to_pylist()]  # a part's first pairs may be of the last pivot before
            of = np.maximum.accumulate(np.where(is_pivot, np.arange(1, len(rows)), 0))
            pivot = rows[of[-1]]
            x, y = of[~is_pivot], np.flatnonzero(~is_pivot) + 1
            if rough:
                left = rough(rows)(x, y)
                x, y = x[left], y[left]
            wanted = np.unique(np.concatenate([x, y])).tolist()
            found = dict(zip(wanted, sets([rows[k] for k in wanted]))) if wanted else {}
            out = [(a[q - 1], b[q - 1]) for p, q in zip(x.tolist(), y.tolist()) if similar(found[p], found[q], percent)]
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return written(others.union(pivots).repartition("a", "part").sortWithinPartitions("a", "part", "side").mapInArrow(lean(linked), "a bigint, b bigint"), "links")


def restarted(buckets: DataFrame, roots: DataFrame, links: DataFrame) -> DataFrame:
    """Pairs (a, b) of each bucket's hub, the member with the most links so far, with its members in other components.
    (Near copies of one original are often similar to it only, so it gathers links from many buckets' pivots.)"""
    degrees = links.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count("*").alias("degree"))
    known = buckets.select("sig", "key").join(roots.withColumnRenamed("node", "key"), "key", "left").join(degrees, "key", "left").withColumn("root", F.coalesce("root", "key"))
    hub = F.max(F.struct(F.coalesce("degree", F.lit(0)).alias("degree"), F.xxhash64("key").alias("h"), F.col("key").alias("pivot"), F.col("root").alias("pivot_root")))
    open_ = known.groupBy("sig").agg(F.min("root").alias("x"), F.max("root").alias("y"), hub.alias("hub")).where("x != y").select("sig", "hub.pivot", "hub.pivot_root")
    pairs = known.join(open_, "sig").where("root != pivot_root")
    return pairs.select(F.least("key", "pivot").alias("a"), F.greatest("key", "pivot").alias("b")).distinct()


def resolve(buckets: DataFrame, classes: DataFrame | None, texts, sets, percent: int, turns: int = 2, rough=None) -> DataFrame:
    """``node, root`` of the classes linked to others.  First all of a bucket are verified against its pivot;
    in later turns against its hub, if still in different components; at last all of a bucket that still are, block by block.
    texts(wanted) gives ``key, text`` of the wanted classes (``key``); classes, if given, have sizes and histograms, which spare the texts without a partner this.
    rough, if given, spares most pairs of texts the exact comparison (see ``left_open``)."""

    def held(pairs: DataFrame) -> DataFrame:
        if classes is not None:
            pairs = written(possible(pairs, classes, percent), "possible")
        found = verified(pairs, texts(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()), sets, percent, rough=rough)
        if classes is not None:
            dropped(pairs)
        return found

    done = written(buckets.where("key != pivot").select(F.least("key", "pivot").alias("a"), F.greatest("key", "pivot").alias("b")).distinct(), "pairs")
    links = held(done)
    roots = components(links)
    # The pivots have been held against all of their buckets; what is left matters if it is two classes or more.
    buckets = buckets.where("key != pivot").select("sig", "key")
    for _ in range(turns):
        more = written(restarted(buckets, roots, links).join(done, ["a", "b"], "left_anti"), "pairs")
        if more.isEmpty():
            break
        new = held(more)
        links, done, roots = links.union(new), done.union(more), merged(roots, new)
    if classes is None:
        inside = texts(buckets.select("key").distinct())
        rows = dealt(buckets, roots, inside.select("key", F.octet_length("text").alias("size"), "text")).drop("size")
    else:
        open_ = written(contested(dealt(buckets, roots, classes.select("key", "size", "histogram")), percent), "open")
        rows = open_.join(texts(open_.select("key").distinct()), "key").select("sig", "i", "j", "own", "key", "root", "text")
    return merged(roots, written(linked_in_blocks(rows, sets, percent, rough), "links"))


FACTS = "doc_id bigint, size bigint, key bigint, hash bigint, histogram binary"


def join(documents: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of each row of ``doc_id, text``."""
    spark = documents.sparkSession
    rows = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64("text").alias("hash"), F.col("text").cast("binary").alias("text"))
    # A signature takes some 20 bytes of text.
    buckets = buckets_for(spark, int(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 20)
    schema = f"bucket int, base bigint, sigs binary, owners binary, set bigint, uid bigint, {FACTS}"

    def signed_rows(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
        kinds = {x.split()[0]: kinds[x.split()[1]] for x in schema.split(", ")}
        outbox, seen = Outbox(TaskContext.get().partitionId(), buckets), set()
        bands = bands_for(percent)

        def batch(n: int, **columns):
            columns["bucket"] = columns.get("bucket", np.arange(n, dtype=np.int32) % buckets)
            return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in kinds.items()], list(kinds))

        def flushed():
            messages, sets, uids = outbox.flush()
            if messages:
                yield batch(len(messages), **{c: [m[k] for m in messages] for k, c in enumerate(("bucket", "base", "sigs", "owners"))})
            if len(sets):
                yield batch(len(sets), set=sets, uid=uids)

        for given in batches:
            for part in parts(given, 2, 1 << 20):
                flat, size = words.distinct(*words.shingles(*words.plain()(part.column(2).to_pylist()), width))
                keys = class_keys(flat, size)
                new = np.zeros(len(keys), bool)
                if len(seen) > 500_000:
                    seen.clear()
                for k, (key, n) in enumerate(zip(keys.tolist(), size.tolist())):
                    if n and key not in seen:
                        seen.add(key)
                        new[k] = True
                some, n = flat[np.repeat(new, size)], size[new]
                sigs, owners = bands.signatures(some, n)
                if outbox.full(len(n)):
                    yield from flushed()
                uid, bins = np.full(len(keys), -1), [None] * len(keys)
                uid[new] = outbox.add(sigs, owners, len(n))
                for k, h in zip(np.flatnonzero(new).tolist(), histogram_rows(some, n)):
                    bins[k] = h
                yield batch(len(keys), uid=pa.array(uid, mask=~new), doc_id=part.column(0), size=size, key=pa.array(keys, mask=size == 0), hash=part.column(1), histogram=bins)
        yield from flushed()

    base = written(exchanged(rows.mapInArrow(lean(signed_rows), schema), buckets, FACTS), "sets")
    facts = base.where("set is null and key is not null")
    classes = facts.groupBy("key").agg(F.min(F.when(F.col("doc_id") != NO_ID, F.col("doc_id"))).alias("smallest"), F.first("hash").alias("hash"), F.first("size").alias("size"), F.first("histogram", ignorenulls=True).alias("histogram"))
    classes = written(classes, "classes")
    sets = base.where("set is not null").select("set", "uid").distinct().join(facts.where("uid is not null").select("uid", "key"), "uid").select("set", "key")
    buckets_ = written(buckets_of(sets), "buckets")
    texts = lambda wanted: texts_of(wanted, classes, rows.where("text is not null").select("hash", "text"))
    roots = resolve(buckets_, classes, texts, functools.partial(shingle_sets, width=width), percent)
    named = classes.select("key", "smallest").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    smallest = named.groupBy("root").agg(F.min("smallest").alias("component_id"))
    by_key = named.join(smallest, "root").select("key", "component_id")
    real = F.when(F.col("doc_id") != NO_ID, F.col("doc_id"))
    told = base.where("set is null").select("doc_id", "size", "key").join(by_key, "key", "left")
    return told.select(real.alias("doc_id"), F.col("size").alias("n_shingles"), F.when(F.col("key").isNull(), real).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(documents: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents, of each component only the one with the smallest doc_id (all its rows)."""
    later = join(documents.select("doc_id", "text"), width, percent).where("doc_id is not null and component_id < doc_id").select(F.col("doc_id").alias("later")).distinct()
    later = written(later, "later")
    stay, near = split_near(documents, F.col("doc_id").cast("long"), later)
    return stay.union(near.join(later, F.col("doc_id").cast("long") == F.col("later"), "left_anti").select(documents.columns))
