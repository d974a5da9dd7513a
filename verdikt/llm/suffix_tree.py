"""Language-model scores by a probabilistic suffix tree over words.

States are contexts of no, one or two words.  A context is retained if its next-word distribution diverges enough from
that of its longest retained suffix: the gain in log likelihood over the corpus must be more than half the log
of the number of tokens for each next word that it stores.  Next-word distributions are smoothed by absolute discounting; what is
discounted goes to the words not stored, in proportion to the suffix's distribution.  The root is
(c + 1) / (N + V + 1).  A word is scored in the longest retained suffix of what stands before it.

Counts are exact and cover every training token.  Words are 64-bit hashes; codes of pairs and triples have 20 bits more than N needs.  What is stored does not depend on shares of N:
a pair or triple that occurs ``LEAST`` times is stored if its own part of the gain pays that price, and the divergence test alone decides which contexts are retained.

Nothing is broadcast, and only N, V and a count of blocks come to the driver.  Documents are tokenised once, into blocks of some MB that are
written to the shared folder.  A block asks for its distinct words, pairs and triples: their codes (hashes) are dealt to buckets by range, each with the block's
count.  A bucket sums them and answers each block; one of the blocks that have a code is its owner.  Owners add each stored
pair or triple to its context's sums, which are dealt to buckets by the context and answered with the verdict.  So the counts and the tree are
distributed tables, and of a frequent code or context a bucket reads one entry from each block.  Triples are asked for only if both of their pairs
are stored, which loses none.

Defined cases: null or empty text: the end token alone.  A null doc_id is trained on.  Equal rows are documents
of their own with equal scores.  No training rows: every count is 0, N and V too.  Other columns are ignored.
``grow`` and ``Tree`` are the same tree in memory, for small tables of counts; tests hold the distributed one against it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import mix, packed, parts, unpacked, written

LEAST = 2
END = np.uint64(0xE4D0_0000_0000_0001)
DISCOUNT = 0.5
BLOCK = 8_000_000
#: Kinds of what blocks ask for: counts of words, pairs and triples; whether contexts of one and of two words are retained.
WORDS, PAIRS, TRIPLES, ONE, TWO = 1, 2, 3, 4, 5
ASKED = "kind tinyint, bucket int, block bigint, codes binary, a binary, b binary"
TOLD = "kind tinyint, bucket int, block bigint, told binary, distinct bigint"


def tokenised(rows: DataFrame) -> DataFrame:
    """Blocks of the documents (``doc_id, training, text``): their ids, training flags, begins, the hashes of their words, most frequent first, and of each token the place there."""
    ids = rows.schema["doc_id"].dataType.simpleString()

    def blocks(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in parts(batch, 2, BLOCK):
                training = part.column(1).to_numpy(zero_copy_only=False).astype(bool)
                hashes, n = [], []
                for some in parts(part, 2, 1 << 20):
                    h, counts = words.plain()(some.column(2).to_pylist())
                    hashes.append(np.insert(h, np.cumsum(counts), END))
                    n.append(counts + 1)
                n = np.concatenate(n)
                known, at, often = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
                order = np.argsort(-often, kind="stable")
                rank = np.zeros(len(order), np.uint32)
                rank[order] = np.arange(len(order), dtype=np.uint32)
                listed = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                columns = [pa.array([packed(x)], pa.binary()) for x in (training.view(np.uint8), np.concatenate([[0], np.cumsum(n)]), known[order], rank[at])]
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([int(n.sum())]), pa.array([int(n[training].sum())]), listed, *columns], "block n learned ids training begins known at".split())
                block += 1

    return written(rows.mapInArrow(blocks, f"block bigint, n bigint, learned bigint, ids array<{ids}>, training binary, begins binary, known binary, at binary"), "tokens", "zstd")


class Local:
    """A block's tokens, its distinct words, pairs and triples, and what is told of them (by kind, in the order of the codes).
    bits: of the codes of pairs and triples; z: the root's denominator; price: of a stored word."""

    def __init__(self, row: dict, buckets: int, told: dict[int, np.ndarray], bits: int, z: int = 0, price: float = 0.0):
        self.id, self.ids, self.buckets, self.told, self.bits, self.z, self.price = row["block"], row["ids"], buckets, told, bits, z, price
        self.begins = unpacked(row["begins"], np.int64)
        self.known, self.at = unpacked(row["known"], np.uint64), unpacked(row["at"], np.uint32).astype(np.int64)
        n = np.diff(self.begins)
        self.training = np.repeat(unpacked(row["training"], np.uint8).view(bool), n)
        self.place = np.arange(len(self.at)) - np.repeat(self.begins[:-1], n)
        self.second = np.flatnonzero(self.place >= 1)
        keys, pair = np.unique(self.at[self.second - 1] * len(self.known) + self.at[self.second], return_inverse=True)
        self.pair = np.zeros(len(self.at), np.int64)  # of each token but a document's first: its pair with the one before
        self.pair[self.second] = pair
        self.left, self.right = keys // max(1, len(self.known)), keys % max(1, len(self.known))
        self.pairs = self.code(self.known[self.left], self.known[self.right])
        self.orders: dict[int, np.ndarray] = {}

    def code(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return joined(a, b) >> np.uint64(64 - self.bits)

    def order(self, kind: int, codes: np.ndarray) -> np.ndarray:
        if kind not in self.orders:
            self.orders[kind] = np.argsort(codes)
        return self.orders[kind]

    def answer(self, kind: int, codes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(codes), self.told[kind].dtype)
        out[self.order(kind, codes)] = self.told[kind]
        return out

    def pays(self, n: np.ndarray, total: np.ndarray, given: np.ndarray) -> np.ndarray:
        """Which next words are stored: n times in a context of total, with a probability of given in its suffix."""
        often = n >= LEAST
        return often & (n * np.log(np.maximum(n - DISCOUNT, DISCOUNT) / np.maximum(1, total) / given) > self.price)

    def counts(self) -> None:
        """Counts of words and pairs are told; the triples whose pairs are stored."""
        self.n_word = np.abs(self.answer(WORDS, self.known))
        n = self.answer(PAIRS, self.pairs)
        self.n_pair = np.abs(n)
        self.stored_pair = self.pays(self.n_pair, self.n_word[self.left], (self.n_word[self.right] + 1) / self.z)
        self.own_pair = (n < 0) & self.stored_pair
        third = np.flatnonzero(self.place >= 2)
        third = third[self.stored_pair[self.pair[third - 1]]]
        self.asked_pairs = np.unique(self.pair[third - 1])  # contexts that may be retained
        last = self.stored_pair[self.pair[third]]
        self.third, self.bare = third[last], third[~last]
        keys, self.triple = np.unique(self.pair[self.third - 1] * max(1, len(self.pairs)) + self.pair[self.third], return_inverse=True)
        self.context, self.suffix = keys // max(1, len(self.pairs)), keys % max(1, len(self.pairs))  # places of both pairs
        self.triples = self.code(self.pairs[self.context], self.known[self.right[self.suffix]])

    def one(self) -> None:
        """Contexts of one word are told: what each gives to words not stored (log10; nan: not retained)."""
        self.rest_word = self.answer(ONE, self.known)
        n = self.answer(TRIPLES, self.triples)
        self.n_triple = np.abs(n)
        middle, last = self.left[self.suffix], self.right[self.suffix]
        self.given = np.where(np.isnan(self.rest_word[middle]), (self.n_word[last] + 1) / self.z, (self.n_pair[self.suffix] - DISCOUNT) / np.maximum(1, self.n_word[middle]))
        self.stored_triple = self.pays(self.n_triple, self.n_pair[self.context], self.given)
        self.own_triple = (n < 0) & self.stored_triple

    def ask(self, kind: int, codes: np.ndarray, n: np.ndarray):
        """Messages (ASKED) with codes and counts."""
        yield from self.dealt(kind, codes, lambda k: (n[k].astype(np.int64), np.zeros(0)))

    def ask_context(self, kind: int, codes: np.ndarray, total: np.ndarray, context: np.ndarray, n: np.ndarray, given: np.ndarray):
        """Messages with codes of contexts, and the sums of those that have stored words here: context (a place in codes), n and given of each."""
        n = n.astype(float)
        columns = [np.ones(len(n)), n, given, n * np.log(n - DISCOUNT), n * np.log(given)]
        sums = np.stack([total.astype(float), *(np.bincount(context, x, len(codes)) for x in columns)], axis=1)

        def entries(k):
            there = np.flatnonzero(sums[k, 1])
            return there.astype(np.int64), sums[k][there].T.ravel()

        yield from self.dealt(kind, codes, entries)

    def dealt(self, kind: int, codes: np.ndarray, entries):
        order = self.order(kind, codes)  # buckets are ranges of codes, so that sorted codes have small differences
        bits = 64 if kind in (WORDS, ONE) else self.bits
        some, begins = np.unique((codes[order] >> np.uint64(bits - 32)) * np.uint64(self.buckets) >> np.uint64(32), return_index=True)
        rows = [(int(b), packed(np.diff(codes[k], prepend=np.uint64(0))), *map(packed, entries(k))) for b, k in zip(some, np.split(order, begins[1:]))] if len(some) else []
        many = len(rows)
        yield batch_of("kind bucket block codes a b", np.full(many, kind, np.int8), np.array([r[0] for r in rows], np.int32), np.full(many, self.id, np.int64), *([r[k] for r in rows] for k in (1, 2, 3))) if many else None


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(mix(a + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0x9E3779B97F4A7C15) + b)


def numbers(words: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Places of words in a sorted table; -1 where there are none."""
    if not len(table):
        return np.full(len(words), -1, np.int64)
    at = np.minimum(np.searchsorted(table, words), len(table) - 1)
    return np.where(table[at] == words, at, -1)


def batch_of(names: str, *columns):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names.split())


def told(asked: DataFrame, price: float) -> DataFrame:
    """Answers (TOLD) of the buckets to each block, in the order of its codes.  Counts: negative for the owner of what is stored; contexts: what is left for words not stored (log10), or nan.
    ``distinct``: codes with a count, in the bucket's first row."""

    def verdicts(kind: int, held: list):
        codes = [np.cumsum(unpacked(r[3], np.uint64), dtype=np.uint64) for r in held]
        at = np.cumsum([0, *map(len, codes)])
        some, first, place = np.unique(np.concatenate(codes), return_index=True, return_inverse=True)
        if kind <= TRIPLES:
            n = np.bincount(place, np.concatenate([unpacked(r[4], np.int64) for r in held]), len(some)).astype(np.int64)
            distinct = int((n > 0).sum())
            out = (n if kind == WORDS else np.where(n >= LEAST, n, 0))[place]
            out[first[n >= LEAST]] *= -1
        else:
            own = place[np.concatenate([unpacked(r[4], np.int64) + a for r, a in zip(held, at)])]
            sums = np.concatenate([unpacked(r[5], float).reshape(6, -1).T for r in held])
            c = np.ones(len(some))
            c[own] = sums[:, 0]
            k, n, given, n_log_n, n_log_given = (np.bincount(own, sums[:, j], len(some)) for j in range(1, 6))
            left, left_given = 1 - (n - DISCOUNT * k) / c, 1 - given
            fine = (k > 0) & (left > 0) & (left_given > 1e-9)
            ratio = np.log(np.where(fine, left, 1) / np.where(fine, left_given, 1))
            gain = n_log_n - n * np.log(c) - n_log_given + (c - n) * ratio
            out, distinct = np.where(fine & (gain > price * k), ratio / math.log(10), np.nan)[place], 0
        for j, r in enumerate(held):
            yield (*r[:3], packed(out[at[j] : at[j + 1]]), 0 if j else distinct)

    def rows_of(batches):
        held, current = [], None

        def told_of(found):
            columns = list(zip(*found))
            return batch_of("kind bucket block told distinct", *(np.array(x, t) for x, t in zip(columns[:3], (np.int8, np.int32, np.int64))), list(columns[3]), np.array(columns[4], np.int64))

        for batch in batches:
            for r in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if r[:2] != current:
                    if held:
                        yield told_of(list(verdicts(current[0], held)))
                    held, current = [], r[:2]
                held.append(r)
        if held:
            yield told_of(list(verdicts(current[0], held)))

    return asked.repartition("kind", "bucket").sortWithinPartitions("kind", "bucket", "block").mapInArrow(rows_of, TOLD)


def by_block(tokens: DataFrame, answers: list[DataFrame], made: tuple, result, schema: str) -> DataFrame:
    """Arrow batches that result(block) gives for each block with all answers to it.  made: buckets, bits, z, price."""
    names = ["ids", "training", "begins", "known", "at"]
    rows = tokens.select("block", F.lit(0).cast("tinyint").alias("kind"), F.lit(0).alias("bucket"), F.lit(None).cast("binary").alias("told"), *names)
    for x in answers:
        rows = rows.union(x.select("block", "kind", "bucket", "told", *(F.lit(None).cast(tokens.schema[c].dataType).alias(c) for c in names)))

    def rows_of(batches):
        row, held, kinds = None, {}, {WORDS: np.int64, PAIRS: np.int64, TRIPLES: np.int64, ONE: np.float64, TWO: np.float64}

        def whole():
            buckets, *more = made
            block = Local(row, buckets, {k: np.concatenate([unpacked(x, t) for x in held[k]]) if k in held else np.zeros(0, t) for k, t in kinds.items()}, *more)
            return [x for x in result(block) if x is not None]

        for batch in batches:
            for k in range(batch.num_rows):
                kind = batch.column(1)[k].as_py()
                if kind == 0:
                    if row:
                        yield from whole()
                    row, held = {"block": batch.column(0)[k].as_py(), "ids": batch.column(4)[k].values} | {c: batch.column(j)[k].as_py() for j, c in enumerate(names[1:], start=5)}, {}
                else:
                    held.setdefault(kind, []).append(batch.column(3)[k].as_py())
        if row:
            yield from whole()

    return rows.repartition("block").sortWithinPartitions("block", "kind", "bucket").mapInArrow(rows_of, schema)


@dataclass
class Tree:
    """words: sorted hashes; root: log10 numerators; of each order: states (sorted), what a state gives to words not
    stored (log10), and log10 probabilities of stored codes (sorted)."""

    words: np.ndarray
    root: np.ndarray
    log_z: float
    states: list[np.ndarray]
    rest: list[np.ndarray]
    codes: list[np.ndarray]
    logs: list[np.ndarray]

    def scores(self, h: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each token: base and score without the part of words outside the dictionary, and whether it is known."""
        at = numbers(h, self.words)
        root = np.append(self.root, 0.0)  # the last one is for words that are not there
        base = root[at] - self.log_z
        score = base.copy()
        place = np.arange(len(h)) - np.repeat(begins[:-1], np.diff(begins))
        before = at.copy()
        for k, (states, rest, codes, logs) in enumerate(zip(self.states, self.rest, self.codes, self.logs), start=1):
            if not len(states):
                continue
            where = np.flatnonzero(place >= k)
            context = np.zeros(len(where), np.int64)
            fine = np.ones(len(where), bool)
            for j in range(k, 0, -1):
                word = before[where - j]
                fine &= word >= 0
                context = (context << 20) | np.maximum(word, 0)
            where, context = where[fine], context[fine]
            state = numbers(context, states)
            where, context, state = where[state >= 0], context[state >= 0], state[state >= 0]
            stored = np.where(at[where] >= 0, numbers((context << 20) | np.maximum(at[where], 0), codes), -1)
            score[where] = np.where(stored >= 0, logs[np.maximum(stored, 0)], rest[state] + score[where])
        return base, score, root[at] > 0


def grow(words: np.ndarray, counts: np.ndarray, total: int, distinct: int, stored: tuple) -> Tree:
    """Retain contexts by the divergence test."""
    z = total + distinct + 1
    root = (counts + 1) / z
    tree = Tree(words, np.log10(counts + 1.0), math.log10(z), [], [], [], [])
    pair_totals = dict(zip(stored[0].tolist(), stored[1].tolist()))
    price = 0.5 * math.log(max(2, total))

    def parent(codes: np.ndarray, order: int) -> np.ndarray:
        """Probability of each code's last word in its context without the first word."""
        p = root[codes & ((1 << 20) - 1)]
        if order == 2 and tree.states:
            pair = codes & ((1 << 40) - 1)
            at, state = numbers(pair, tree.codes[0]), numbers(pair >> 20, tree.states[0])
            p = np.where(state >= 0, p * 10 ** tree.rest[0][np.maximum(state, 0)] if len(tree.rest[0]) else p, p)
            p = np.where(at >= 0, 10 ** tree.logs[0][np.maximum(at, 0)] if len(tree.logs[0]) else p, p)
        return p

    pairs = np.zeros(0, np.int64)  # that are stored
    for order in (1, 2):
        codes, n = stored[2 * order - 2], stored[2 * order - 1]
        if order == 2:
            both = (numbers(codes >> 20, pairs) >= 0) & (numbers(codes & ((1 << 40) - 1), pairs) >= 0)
            codes, n = codes[both], n[both]
        total = counts[codes >> 20] if order == 1 else np.array([pair_totals[c] for c in (codes >> 20).tolist()])
        pays = n * np.log((n - DISCOUNT) / total / parent(codes, order)) > price if len(codes) else np.zeros(0, bool)
        codes, n = codes[pays], n[pays]
        pairs = codes if order == 1 else pairs
        states, begin = np.unique(codes >> 20, return_index=True)
        ends = np.append(begin[1:], len(codes))
        total_of = counts[states] if order == 1 else np.array([pair_totals.get(s, 0) for s in states.tolist()])
        given = parent(codes, order) if len(codes) else np.zeros(0)
        kept, rest, kept_codes, logs = [], [], [], []
        for s, a, b, c in zip(states.tolist(), begin.tolist(), ends.tolist(), np.asarray(total_of).tolist()):
            if c < n[a:b].sum():
                continue
            p = (n[a:b] - DISCOUNT) / c
            left, left_given = 1 - p.sum(), 1 - given[a:b].sum()
            if left <= 0 or left_given <= 1e-9:
                continue
            gain = (n[a:b] * np.log(p / given[a:b])).sum() + (c - n[a:b].sum()) * math.log(left / left_given)
            if gain > price * (b - a):
                kept.append(s)
                rest.append(math.log10(left / left_given))
                kept_codes.append(codes[a:b])
                logs.append(np.log10(p))
        tree.states.append(np.array(kept, np.int64))
        tree.rest.append(np.array(rest))
        tree.codes.append(np.concatenate(kept_codes) if kept else np.zeros(0, np.int64))
        tree.logs.append(np.concatenate(logs) if kept else np.zeros(0))
    return tree


def score(documents: DataFrame, training) -> DataFrame:
    """doc_id, training, n_tokens, n_known, train_tokens, base_score, score; training: a Column, true for rows to learn from."""
    rows = documents.select("doc_id", training.alias("training"), F.col("text").cast("binary").alias("text"))
    tokens = tokenised(rows)
    every, total = (int(x or 0) for x in tokens.agg(F.sum("n"), F.sum("learned")).first())
    buckets = max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), every >> 20)
    price, bits = 0.5 * math.log(max(2, total)), min(64, 20 + max(20, every.bit_length()))

    def first(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                block = Local({c: batch.column(j)[k].values if c == "ids" else batch.column(j)[k].as_py() for j, c in enumerate(batch.schema.names)}, buckets, {}, bits)
                learned = block.training.astype(float)
                yield from filter(None, block.ask(WORDS, block.known, np.bincount(block.at, learned, len(block.known))))
                yield from filter(None, block.ask(PAIRS, block.pairs, np.bincount(block.pair[block.second], learned[block.second], len(block.pairs))))

    counted = written(told(tokens.select("block", "ids", "training", "begins", "known", "at").mapInArrow(first, ASKED), price), "counts", "zstd")
    distinct = int(counted.where(F.col("kind") == WORDS).agg(F.sum("distinct")).first()[0] or 0)
    z = total + distinct + 1
    made = (buckets, bits, z, price)

    def second(block):
        block.counts()
        own = block.own_pair
        yield from block.ask_context(ONE, block.known, block.n_word, block.left[own], block.n_pair[own], (block.n_word[block.right[own]] + 1) / z)
        yield from block.ask(TRIPLES, block.triples, np.bincount(block.triple, block.training[block.third].astype(float), len(block.triples)))

    states = written(told(by_block(tokens, [counted], made, second, ASKED), price), "states", "zstd")

    def third(block):
        block.counts()
        block.one()
        own = block.own_triple
        context, given = block.context[own], block.given[own]
        asked = block.asked_pairs
        yield from block.ask_context(TWO, block.pairs[asked], block.n_pair[asked], np.searchsorted(asked, context), block.n_triple[own], given)

    longer = written(told(by_block(tokens, [counted, states], made, third, ASKED), price), "states", "zstd")

    def scored(block):
        import pyarrow as pa

        block.counts()
        block.one()
        rest_pair = np.full(len(block.pairs), np.nan)
        rest_pair[block.asked_pairs] = block.answer(TWO, block.pairs[block.asked_pairs])
        base = (np.log10(block.n_word + 1.0) - math.log10(z))[block.at]
        value = base.copy()
        rest, n = block.rest_word[block.left], block.n_pair
        one = np.where(block.stored_pair, np.log10(np.maximum(n - DISCOUNT, DISCOUNT) / np.maximum(1, block.n_word[block.left])), rest + base_of(block, z))
        one = np.where(np.isnan(rest), base_of(block, z), one)
        value[block.second] = one[block.pair[block.second]]
        rest, n = rest_pair[block.context], block.n_triple
        two = np.where(block.stored_triple, np.log10(np.maximum(n - DISCOUNT, DISCOUNT) / np.maximum(1, block.n_pair[block.context])), rest + one[block.suffix])
        two = np.where(np.isnan(rest), one[block.suffix], two)
        value[block.third] = two[block.triple]
        rest = rest_pair[block.pair[block.bare - 1]]
        value[block.bare] += np.where(np.isnan(rest), 0, rest)
        begin, sums = block.begins[:-1], [np.add.reduceat(x, block.begins[:-1]) for x in ((block.n_word[block.at] > 0).astype(np.int64), base, value)]
        yield pa.RecordBatch.from_arrays([block.ids, pa.array(block.training[begin]), pa.array(np.diff(block.begins)), pa.array(sums[0]), pa.array(np.full(len(begin), total)), pa.array(sums[1]), pa.array(sums[2])], "doc_id training n_tokens n_known train_tokens base_score score".split())

    ids = documents.schema["doc_id"].dataType.simpleString()
    return by_block(tokens, [counted, states, longer], made, scored, f"doc_id {ids}, training boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def base_of(block: Local, z: int) -> np.ndarray:
    """Of each pair: the root's log10 probability of its second word."""
    return np.log10(block.n_word[block.right] + 1.0) - math.log10(z)
