"""Operators of the training-data pipeline: brute force, round trips, edge cases."""

import hashlib
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from verdikt.llm import bpe, chat, decontaminate, exchange, html, line_dedup, ngram_join, packing, quality, suffix_tree, token_store, toxicity, words  # noqa: E402
from verdikt.llm.common import mix  # noqa: E402

LONG = " ".join(f"word{k % 977}x{k}" for k in range(30_000))
BASE = [f"tok{k}" for k in range(60)]


def texts():
    near = BASE.copy()
    near[30] = "other"
    return [(1, " ".join(BASE)), (2, " ".join(near)), (3, " ".join(BASE)), (4, ""), (5, None), (6, "one two"), (7, "One  TWO"), (8, LONG), (9, LONG), (9, "again other text"), (None, " ".join(BASE)), (10, "é日本 ✓\n\n x")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, "en", 7) for d, t in texts()], "doc_id long, text string, key string, uid int")


def empty(docs):
    return docs.where("false")


def test_chat(spark):
    rows = [(1, 0, "user", "[INST]"), (1, 1, "user", "a[\\INST]\\"), (1, 2, "assistant", None), (1, 3, "assistant", "[\\\\/INST]</s>é😀"), (1, 3, "assistant", "[\\\\/INST]</s>é😀"), (1, 4, None, "x[BODY]"), (2, None, "system", "s"), (None, 1, "user", "")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.parse_chats(chat.format_chats(frame)).collect()}
    assert [tuple(t) for t in got[1].turns] == [(r or "", t or "") for c, _, r, t in rows if c == 1]
    assert got[1].loss_texts == ["", "[\\\\/INST]</s>é😀", "[\\\\/INST]</s>é😀"] and got[2].loss_texts == []
    assert chat.format_chats(frame.where("false")).count() == 0


def test_toxicity(spark):
    good = [(k, f"calm words number {k} here", 0) for k in range(40)]
    bad = [(100 + k, f"you are an idiot number {k} here", 1) for k in range(40)]
    frame = spark.createDataFrame([(k, t) for k, t, _ in good + bad], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in good + bad] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(frame, labels)
    assert model.score("an 1d10t") > 0.5 > model.score("") and model.score("an іdiоt") > 0.5 and model.score("fine") < 0.3
    odd = spark.createDataFrame([(1, None), (1, ""), (None, LONG), (2, "IDIOT!")], "doc_id long, text string")
    assert [r.score >= 0.3 for r in toxicity.score(odd, model).collect()] == [False, False, False, True]
    assert toxicity.fit(frame, labels.where("toxic = 0")).score("idiot") == 0.0
    assert toxicity.reject(odd, model).count() == 3 and toxicity.score(odd.where("false"), model).count() == 0


def test_ngram_join(docs):
    got = sorted(((r.doc_id or 0), r.n_shingles, r.component_id) for r in ngram_join.join(docs).collect())
    assert (1, 57, 1) in got and (3, 57, 1) in got and (0, 57, 1) in got
    assert (2, 57, 1) in got  # 53 of 61 shingles
    assert (4, 0, 4) in got and (5, 0, 5) in got and (6, 1, 6) in got and (7, 1, 6) in got and (8, 29997, 8) in got
    assert ngram_join.join(empty(docs)).count() == 0
    kept = [r.doc_id for r in ngram_join.keep_one(docs).collect()]
    assert 1 in kept and 3 not in kept and None in kept and ngram_join.keep_one(docs).columns == docs.columns


def test_join_against_brute_force(spark):
    r = np.random.default_rng(5)
    rows = []
    for k in range(60):
        words = [f"w{x}" for x in r.integers(0, 10_000, r.integers(5, 120))]
        rows.append(words)
        for _ in range(3):
            copy = words.copy()
            for at in r.integers(0, len(copy), r.integers(0, 4)):
                copy[at] = f"z{r.integers(0, 9)}"
            rows.append(copy)
    sets = [{tuple(w[i : i + 4]) for i in range(len(w) - 3)} for w in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    frame = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(rows)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.join(frame).collect()} == {k: find(k) for k in range(len(rows))}


@pytest.mark.parametrize("percent", [85, 80])
def test_signatures_of_similar_sets(percent):
    """Any two sets within the bound share a signature, with deletions in use too, and copies that lack segments."""
    r = np.random.default_rng(3)
    bands = ngram_join.bands_for(percent)
    assert (bands.plans[:40, 1] > 0).any()
    pairs = []
    for _ in range(1500):
        n = int(r.integers(2, 40) if r.random() < 0.7 else r.integers(40, 900))
        x = np.unique(r.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2) + np.uint64(1))
        drop = int(r.integers(0, max(2, int(0.22 * n))))
        y = np.unique(np.concatenate([x[drop // 2 :], r.integers(0, 2**63, drop - drop // 2).astype(np.uint64)]))
        if r.random() < 0.1:  # all in one part of the universe: most segments are empty
            x, y = x >> np.uint64(9), y >> np.uint64(9)
        if len(x) and len(y) and ngram_join.similar(x, y, percent) and not np.array_equal(x, y):
            pairs += [x, y]
    assert len(pairs) > 500
    sigs, owners = bands.signatures(np.concatenate(pairs), np.array([len(x) for x in pairs]))
    of = [set(sigs[owners == k].tolist()) for k in range(len(pairs))]
    assert all(a & b for a, b in zip(of[::2], of[1::2]))


def test_words_and_shingles():
    """Equal hashes for equal words or shingles and no others, wherever they stand."""
    texts = [b"The cat", None, b"", b" the\tCAT sat\non the  mat the cat sat on the mat", b"\xc3\xa9t\xc3\xa9 the", b"x" * 3000 + b" the"]
    split = [(t or b"").lower().split() for t in texts]
    hashes, counts = words.plain()(texts)
    assert counts.tolist() == [len(w) for w in split]
    flat = [w for t in split for w in t]
    assert len(set(zip(flat, hashes.tolist()))) == len(set(flat)) == len(set(hashes.tolist()))
    for width in (1, 3, 4):
        shingles = [[tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else [] for w in split]
        got, n = words.shingles(hashes, counts, width)
        assert n.tolist() == [len(x) for x in shingles]
        flat = [x for t in shingles for x in t]
        assert len(set(zip(flat, got.tolist()))) == len(set(flat)) == len(set(got.tolist()))
        found, sizes = words.distinct(got.copy(), n)
        assert sizes.tolist() == [len(set(x)) for x in shingles] and len(found) == sum(sizes)


def test_exchange(spark):
    """Against brute force: the sets are those of all owners that share a signature, also of hot ones, whose owners come in part from blocks."""
    r = np.random.default_rng(2)
    sigs = [np.unique(np.where(r.random(40) < 0.3, r.integers(0, 60, 40), r.integers(0, 10**6, 40))).astype(np.uint64) for _ in range(400)]
    sigs = [mix(x) for x in sigs]
    told, messages, at, uid_of = [], [], 0, {}
    for block in range(4):
        outbox = exchange.Outbox(block, 5)
        some = sigs[at : at + 100]
        uids = outbox.add(np.concatenate(some), np.repeat(np.arange(100), [len(x) for x in some]), 100)
        uid_of |= dict(zip(uids.tolist(), range(at, at + 100)))
        rows, sets, owners = outbox.flush()
        messages += rows
        told += zip(sets.tolist(), owners.tolist())
        at += 100
    for b in range(5):
        told += zip(*(x.tolist() for x in exchange.shared([m[1:] for m in messages if m[0] == b])))
    got = {}
    for s, u in told:
        got.setdefault(s, set()).add(uid_of[u])
    want = {}
    for k, x in enumerate(sigs):
        for s in x.tolist():
            want.setdefault(s >> 16, set()).add(k)
    assert max(map(len, want.values())) > 50
    assert {frozenset(x) for x in got.values() if len(x) > 1} == {frozenset(x) for x in want.values() if len(x) > 1}


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder(name):
    from tokenizers import Tokenizer

    odd = ["", "  a  b   c \n\n d\te  ", "don't we'll 'tis x's", ".", "a b\x1cd e", "é x  ́", "<|endoftext|> a", "(826) 1.2.3", "ΣΑΣ, İst. ﬁ", "\r\n a\r\nb \n \n c", "日本 テ。", "a'S 'RE", "%%%abc*** '''s''t", LONG]
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    tokenizer.encode_special_tokens = True
    for _ in range(2):
        ids, n = bpe.Encoder(public_tokenizers.path(name)).encode([t.encode() for t in odd])
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [e.ids for e in tokenizer.encode_batch(odd, add_special_tokens=False)]


def test_token_store(spark, docs, tmp_path):
    path, tokenizer = str(tmp_path / "s"), public_tokenizers.path("word_bpe_49k.json")
    token_store.write(docs, path, tokenizer, end=2, shard_ids=1000)
    rows = token_store.read(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted([d for d, _ in texts()], key=lambda d: (d is not None, d))
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))
    two = bpe.Encoder(tokenizer).encode([b"one two"])[0].tolist() + [2]
    assert next(r for r in rows if r.doc_id == 6).ids_crc32 == zlib.crc32(np.array(two, "<u4").tobytes())
    found = token_store.lookup(spark, path, [6, 9, 12345]).collect()
    assert sorted(r.doc_id for r in found) == [6, 9, 9] and next(r.ids for r in found if r.doc_id == 6) == two


def test_suffix_tree(docs):
    got = suffix_tree.score(docs, F.coalesce(F.col("doc_id") != 2, F.lit(True))).collect()
    tokens = [((t or "").encode().lower().split() + [b"\n"], d != 2) for d, t in texts()]
    c = {}
    for words, training in tokens:
        for w in words if training else ():
            c[w] = c.get(w, 0) + 1
    n, v = sum(c.values()), len(c)
    want = sorted((len(w), sum(c.get(x, 0) > 0 for x in w), round(sum(math.log10((c.get(x, 0) + 1) / (n + v + 1)) for x in w), 6)) for w, _ in tokens)
    assert sorted((r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want and {r.train_tokens for r in got} == {n}
    assert suffix_tree.score(docs, F.lit(False)).where("n_known > 0").count() == 0


def test_suffix_tree_grows_with_the_input(spark):
    """A context that occurs four times in 120,000 tokens is retained; equal documents have equal scores."""
    filler = " ".join(f"f{k % 60_000}" for k in range(120_000))
    rows = [(0, filler), *((k, "alpha beta gamma delta") for k in range(1, 5)), (7, "alpha beta gamma delta"), (8, "delta gamma beta alpha")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in suffix_tree.score(frame, F.col("doc_id") < 5).collect()}
    assert got[7].score > got[7].base_score + 8 and got[7].score == got[1].score and got[8].score < got[8].base_score


def test_suffix_tree_against_memory(spark, monkeypatch):
    """Distributed counts, contexts and scores in many blocks: as of ``grow`` over exact counts of all pairs and triples that occur twice."""
    import xxhash

    r = np.random.default_rng(11)
    follow = r.integers(0, 60, (60, 3))
    rows = []
    for d in range(150):
        words = [int(r.integers(0, 60)), int(r.integers(0, 60))]
        for _ in range(int(r.integers(0, 120))):
            a, b, kind = words[-2] % 60, words[-1] % 60, r.random()
            words.append(int(follow[b, 0] if kind < 0.5 else follow[(b + 7 * a) % 60, 1] if kind < 0.9 else r.integers(0, 9000)))
        rows.append((d, " ".join(f"w{w}" for w in words)))
    training = [d % 7 != 2 for d, _ in rows]
    hashes = [np.append(np.array([xxhash.xxh3_64_intdigest(w) for w in t.encode().split()], np.uint64), suffix_tree.END) for _, t in rows]
    known, counts = np.unique(np.concatenate([h for h, y in zip(hashes, training) if y]), return_counts=True)
    grams = {2: {}, 3: {}}
    for h, y in zip(hashes, training):
        at = suffix_tree.numbers(h, known).tolist() if y else []
        for k in grams:
            for i in range(len(at) - k + 1):
                code = sum(w << (20 * (k - 1 - j)) for j, w in enumerate(at[i : i + k]))
                grams[k][code] = grams[k].get(code, 0) + 1
    full = {k: sorted((c, n) for c, n in g.items() if n >= 2) for k, g in grams.items()}
    arrays = [np.array(x, np.int64) for k in (2, 3) for x in zip(*full[k])]
    tree = suffix_tree.grow(known, counts, int(counts.sum()), len(known), tuple(arrays))
    assert len(tree.states[0]) > 5 and len(tree.states[1]) > 5
    want = {d: float(tree.scores(h, np.array([0, len(h)]))[1].sum()) for (d, _), h in zip(rows, hashes)}
    monkeypatch.setattr(suffix_tree, "BLOCK", 900)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x.doc_id: x.score for x in suffix_tree.score(frame, F.col("doc_id") % 7 != 2).collect()}
    assert got.keys() == want.keys() and max(abs(got[d] - want[d]) for d in want) < 1e-8


def test_tree_gives_probabilities():
    words = np.sort(np.array([3, 5, 9], np.uint64))
    counts = np.array([40, 40, 20])
    stored = (np.array([(0 << 20) | 1]), np.array([38]), np.zeros(0, np.int64), np.zeros(0, np.int64))
    tree = suffix_tree.grow(words, counts, 100, 3, stored)
    assert tree.states[0].tolist() == [0]
    p = [10 ** tree.scores(np.array([3, w], np.uint64), np.array([0, 2]))[1][1] for w in (3, 5, 9)]
    unseen = 10 ** (tree.rest[0][0]) * (1 / 104)
    assert abs(sum(p) + unseen - 1) < 1e-6


def test_quality(spark, docs):
    rows = {r.doc_id: r for r in quality.quality(docs.where("doc_id is not null")).collect()}
    assert rows[5].n_words == 0 and rows[5].base_failed and rows[1].kept and rows[8].n_words == 30_000 and rows[8].n_repeat_words == 0
    repeated = spark.createDataFrame([(1, "a b c d e f a b c d e"), (2, "x x x x x x"), (3, "same line\nsame line\nother")], "doc_id long, text string")
    assert [(r.n_repeat_words, r.n_dup_lines) for r in quality.quality(repeated).orderBy("doc_id").collect()] == [(10, 0), (6, 0), (0, 1)]
    junk = " ".join(f"word{k}%%%" for k in range(30)) + "\n" + "fine line of words"
    assert not quality.quality(spark.createDataFrame([(1, junk)], "doc_id long, text string")).first().kept
    assert quality.clean_lines(spark.createDataFrame([(junk,)], "text string")).first().text == "fine line of words"


def test_decontamination(spark, docs):
    item = " ".join(BASE[5:17])
    items = spark.createDataFrame([(1, item), (2, "one two"), (3, None), (None, "absent words"), (1, "again other")], "item_id long, text string")
    got = [(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in decontaminate.decontaminate(docs, items).collect()]
    assert (1, 60, 12, ["1"]) in got and (6, 2, 2, ["2"]) in got and (5, 0, 0, []) in got and (9, 3, 2, ["1"]) in got and (None, 60, 12, ["1"]) in got
    assert all(n == 0 for _, _, n, _ in ((r.doc_id, 0, r.n_hit, 0) for r in decontaminate.decontaminate(docs, items.where("false")).collect()))
    path = str(spark.conf.get("spark.checkpoint.dir")) + "/near"
    decontaminate.build_index(spark.createDataFrame([(1, "alpha x beta gamma"), (2, "alpha " + "y " * 30 + "beta gamma")], "doc_id long, text string"), path)
    near = decontaminate.search(spark.read.schema(decontaminate.SEGMENT).parquet(path), spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string"), slack=2)
    assert {r.doc_id: (r.n_hit, r.n_near) for r in near.collect()} == {1: (0, 1), 2: (0, 0)}
    assert decontaminate.keep_clean(docs, items).columns == docs.columns


def test_packing(spark, docs):
    rows = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end=1, window=256, with_ids=True).collect()
    by = {}
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 256
    assert sum(r.length for r in rows if r.doc_id == 8) == next(r.doc_tokens for r in rows if r.doc_id == 8)
    assert [r.length for r in rows if r.doc_id == 5] == [1]
    x = packing.nnls(np.array([[1.0, 0], [0, 2], [1, 1]]), np.array([3.0, 4, 5]))
    assert np.allclose(x, [3, 2], atol=1e-4)


def test_workers_let_go_of_tokenizers(spark, docs):
    def alive(batches):
        import gc
        import os

        import pyarrow as pa

        for _ in batches:
            yield pa.RecordBatch.from_pydict({"pid": [os.getpid()], "n": [sum(isinstance(x, bpe.Encoder) for x in gc.get_objects())]})

    encoders = lambda: {r.pid: r.n for r in spark.range(64, numPartitions=64).mapInArrow(alive, "pid long, n long").collect()}
    packing.pack(docs.repartition(64), public_tokenizers.path("byte_bpe_50k.json"), end=1).count()
    assert sum(encoders().values()) > 0  # for the next task of this operator
    many = spark.range(64, numPartitions=64).selectExpr("id as doc_id", "'some text' as text")
    assert toxicity.score(many, toxicity.Model()).where("score = 0").count() == 64
    assert sum(encoders().values()) == 0


def test_pipeline_batches_have_a_bound(spark):
    pytest.importorskip("corpus_pipeline")
    import corpus_pipeline

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.nbytes]})

    wide, key = spark.range(0, 6000, 1, 1).selectExpr("id as doc_id", "repeat('x', 2200) as text"), "spark.sql.execution.arrow.maxBytesPerBatch"
    for name, stage in corpus_pipeline.STAGES:
        before = spark.conf.get(key)
        try:
            stage(spark, wide.limit(1), "/root/testdata/sf0.001")
            assert max(r.n for r in wide.mapInArrow(sizes, "n long").collect()) <= corpus_pipeline.BATCH_BYTES, name
        finally:
            spark.conf.set(key, before)


def test_encoder_with_few_kept():
    path = public_tokenizers.path("byte_bpe_50k.json")
    few, texts = bpe.Encoder(path, most=20, most_parts=10), [" ".join(f"w{k}, x{k * j}" for k in range(30)).encode() for j in range(9)]
    for t in texts + texts:
        assert few.encode([t])[0].tolist() == bpe.Encoder(path).tokenizer.encode(t.decode(), add_special_tokens=False).ids


def test_html(spark):
    model = html.trained()
    right = total = 0
    for page, blocks in html.labelled_pages(40, seed=77):
        found = html.leaf_blocks(page)
        known = {}
        for text, y in blocks:
            known.setdefault(text, []).append(y)
        truth = [known[b[0]].pop(0) for b in found]
        right += sum(a == b for a, b in zip(truth, model.decode(found)))
        total += len(found)
    assert right / total > 0.97
    page = "<html><head><title>t</title></head><body><nav><ul><li><a href=/>Home</a></ul></nav><article><h1>A &amp; B</h1><p>First  long\n sentence of text here.<p><b>Second &eacute; sentence ends.<br></article><footer>&copy; x</footer>"
    rows = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<p"), (None, "u", page)], "page_id long, url string, html string")
    got = [r.text for r in html.extract(rows).collect()]
    assert got[0] == got[4] == "A & B\n\nFirst long sentence of text here.\n\nSecond é sentence ends." and got[1:4] == ["", "", ""]


def test_html_keeps_what_is_shown():
    """Only what is hidden by an attribute of that name or its own style goes; formulas, deep nesting and a head without end lose nothing."""
    text = lambda page: [b[0] for b in html.leaf_blocks(page)]
    assert text('<p>a</p><div style="overflow:hidden"><p>b</p></div><div data-x="hidden gem" class="overflow-hidden">c</div>') == ["a", "b", "c"]
    assert text('<div hidden>a</div><div style="color:red; display : none">b</div><p aria-hidden=true>c</p><p hidden="">d</p><p>e</p>') == ["e"]
    assert text("<p>one <math><mi>x</mi></math> two <noscript>three</noscript>") == ["one x two three"]
    assert text("<html><head><title>t</title><body><p>a") == ["a"] and text("<head><meta x><p>a") == ["a"]
    assert text("<b>" * 2000 + "<div hidden>" + "<i>" * 900 + "x</div>" + "<p>deep") == ["deep"]


def test_toxicity_with_few_labels(spark):
    frame = spark.createDataFrame([(k, "plain words here" if k > 1 else "you idiot") for k in range(30)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k <= 1)) for k in range(30)], "doc_id long, toxic int")
    model = toxicity.fit(frame, labels)
    assert model.curve is not None and 0 < model.score("anything") < 0.3
    long = "z" * 90
    phrase = toxicity.Model({" idiot ": 5.0}, frozenset({f"{long} idiot"}))
    assert [h[2:] for h in phrase.hits(toxicity.fold(f"a {long}  idiot b"))] == [(f"{long} idiot", "idiot b")] and phrase.features(f"{long} idiot") == (0.0, 0.0)


def test_line_dedup_clashing_names(spark):
    """Columns of any name come through; equal rows, nulls and empties too."""
    names = ["_removed", "_uid", "removed", "kept_in", "n_lines", "document", "near_word", "near_bits", "_place", "hash", "key"]
    rows = [(k, t, *([k] * len(names))) for k, t in ((1, "a line of text\nother one"), (2, "A  line of text\n"), (2, "A  line of text\n"), (3, None), (None, ""))]
    frame = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", *[f"{c} long" for c in names]]))
    got = line_dedup.dedup_documents(frame)
    assert got.columns == frame.columns
    assert sorted(((r.doc_id or 0), r.text or "", r["key"] or 0) for r in got.collect()) == [(0, "", 0), (1, "a line of text\nother one", 1), (2, "", 2), (2, "", 2), (3, "", 3)]
    kept = decontaminate.keep_clean(frame.withColumnRenamed("key", "_key"), spark.createDataFrame([(1, "no such words")], "item_id long, text string"))
    assert sorted((r["_key"] or 0) for r in kept.collect()) == [0, 1, 2, 2, 3]


def test_line_dedup(spark, docs):
    line = "this is a line of some eleven words that comes again"
    rows = [(1, f"first unique line of five words\n{line}"), (2, f"{line.upper()}.\nsecond unique line with other words"), (3, "short\nshort"), (4, None), (5, ""), (None, f"tail text of five words\n{line}!")]
    frame = spark.createDataFrame([(d, t, len(t or "")) for d, t in rows], "doc_id long, text string, n_chars int")
    got = {r.doc_id: r for r in line_dedup.dedup_documents(frame).collect()}
    assert got[1].text == "first unique line of five words" and got[2].text == "second unique line with other words" and got[None].text.endswith("!")
    assert got[3].text == "short" and got[4].text is None and got[5].text == "" and got[1].n_chars == len(got[1].text)
    assert line_dedup.dedup_documents(empty(docs)).count() == 0 and line_dedup.dedup_documents(docs).count() == len(texts())


@pytest.mark.parametrize("n", [10, 20, 30, 50])
def test_line_bands_find_short_lines(n):
    """Brute force over pairs of lines of n shingles at J from 0.80 to 0.85: nearly all share a band of the query's own banding."""
    import inspect

    parameters = inspect.signature(line_dedup.dedup).parameters
    bands, rows = parameters["bands"].default, parameters["rows"].default
    r = np.random.default_rng(n)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    lines = []
    for _ in range(1000):
        x = "".join(r.choice(letters, n + 7))
        for d in range(1, n):
            y = x[d:] + "".join(r.choice(letters, int(r.integers(0, 2))))
            a, b = line_dedup.line_sets([x.encode(), y.encode()])
            both = len(np.intersect1d(a, b))
            if 0.80 <= both / (len(a) + len(b) - both) <= 0.85:
                lines += [x.encode(), y.encode()]
                break
    sigs = line_dedup.band_hashes(lines, bands, rows)
    found = (sigs[::2] == sigs[1::2]).any(axis=1)
    assert len(found) > 300 and found.mean() > 0.99


def test_short_lines_take_part(spark, tmp_path):
    """op10 and the pipeline's stage: of exact copies of short lines, and of lines in a script without spaces, one stays; blank lines stay."""
    import corpus_pipeline
    from verdikt.llm import queries

    rows = [(1, "Read more\n\n日本語の長い行は空白なしで一つの語です"), (2, "read  more\nother\n\n"), (3, "日本語の長い行は空白なしで一つの語です\nRead more\nlast")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    want = {1: rows[0][1], 2: "other\n\n", 3: "last"}
    assert {r.doc_id: r.text for r in queries.op10_line_dedup(spark, str(tmp_path)).collect()} == want
    assert {r.doc_id: r.text for r in corpus_pipeline.dedup_lines(spark, frame, "").collect()} == want


def test_pipeline_keeps_columns(spark):
    pytest.importorskip("corpus_pipeline")
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    frame = spark.read.parquet(f"{d}/documents.parquet").limit(40)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, d)
        assert out.columns == frame.columns, name
    assert hashlib and corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("most_rows", [3, 1024])
def test_links_in_blocks(spark, most_rows):
    """One bucket of sets of which none is linked yet, in one block and in many, with and without bounds."""
    r = np.random.default_rng(8)
    centre = r.integers(0, 10_000, 60)
    sets = {}
    for k in range(40):
        x = centre.copy()
        x[r.choice(60, int(r.integers(2, 14)), replace=False)] = r.integers(20_000, 30_000)
        sets[k] = np.unique(x).astype("<u8")
    rows = [(1, k, len(x), ngram_join.histogram(x), x.tobytes()) for k, x in sets.items()]
    frame = spark.createDataFrame(rows, "sig long, key long, size long, histogram binary, text binary")
    roots = spark.createDataFrame([], "node long, root long")
    read = lambda blobs: [np.frombuffer(b, np.uint64) for b in blobs]
    whole = ngram_join.dealt(frame, roots, frame.select("key", "size", "text"), most_rows).drop("size")
    bounded = ngram_join.contested(ngram_join.dealt(frame, roots, frame.select("key", "size", "histogram"), most_rows), 80).join(frame.select("key", "text"), "key").select(whole.columns)
    want = {(a, b) for a in sets for b in sets if a < b and ngram_join.similar(sets[a], sets[b], 80)}

    def parts(links):
        of = {k: k for k in sets}
        for a, b in links:
            x, y = of[a], of[b]
            of = {k: min(x, y) if v in (x, y) else v for k, v in of.items()}
        return of

    for given in (whole, bounded):
        got = {(min(x), max(x)) for x in ngram_join.linked_in_blocks(given, read, 80).collect()}
        assert want and got <= want and parts(got) == parts(want)


def some_lines(r, n: int) -> list[bytes]:
    """Lines of which many are near each other: short ones, long ones, some not ASCII, some that repeat themselves."""
    letters = np.array(list("abcdefgh éß日𝄞"))
    starts = ["".join(r.choice(letters, int(k))) for k in r.integers(1, 400, 12)] + ["ab cd " * 60, "x" * 300, "日本 " * 90]
    out = []
    for _ in range(n):
        x = starts[int(r.integers(0, len(starts)))]
        cut = int(r.integers(0, len(x) // 4 + 1))
        out.append((x[cut:] + "".join(r.choice(letters, int(r.integers(0, 9))))).strip().encode() or b"-")
    return out


def test_rough_bounds_lose_no_pair():
    """Every similar pair of lines passes the bit vectors, and nearly all pairs of unlike lines without many repeated shingles do not."""
    lines = some_lines(np.random.default_rng(3), 250)
    sets = line_dedup.line_sets(lines)
    a, b = (np.ravel(x) for x in np.triu_indices(len(lines), 1))
    jaccard = np.array([len(np.intersect1d(sets[x], sets[y])) / len(np.union1d(sets[x], sets[y])) for x, y in zip(a.tolist(), b.tolist())])
    plain = np.array([len(s) > 30 and len(s) > 0.9 * (len(x.decode()) - 7) for x, s in zip(lines, sets)])
    for percent in (60, 80, 95):
        may = line_dedup.rough(lines, percent)(a, b)
        assert (jaccard >= percent / 100).sum() > 100 and may[jaccard >= percent / 100].all()
        n = [len(x) for x in lines]
        near = np.array([0.8 * n[x] <= n[y] <= 1.25 * n[x] for x, y in zip(a.tolist(), b.tolist())])
        assert may[(jaccard < 0.3) & plain[a] & plain[b] & near].mean() < 0.05
    assert not len(line_dedup.rough(lines, 80)(a[:0], b[:0]))


@pytest.mark.parametrize("most", [3, 1 << 18])
def test_rows_left_open_in_blocks(most):
    """Of several pairs of blocks, some with one block only, just the rows of a similar pair across blocks and components, in few or many pairs at once."""
    r = np.random.default_rng(4)
    lines = some_lines(r, 120)
    sets = line_dedup.line_sets(lines)
    groups = []
    for k in range(60):
        one, members = k % 3 == 0, r.choice(len(lines), 10, replace=False).tolist()
        groups.append(((k, 0, 0 if one else 1), [(0 if one else int(r.integers(0, 2)), x, int(r.integers(0, 3)), lines[x]) for x in members]))
    exact = lambda texts: lambda a, b: np.array([ngram_join.similar(*line_dedup.line_sets([texts[x], texts[y]]), 80) for x, y in zip(a.tolist(), b.tolist())], bool)
    want = {}
    for current, held in groups:
        for x in held:
            if any(ngram_join.similar(sets[x[1]], sets[y[1]], 80) and x[2] != y[2] and (current[1] == current[2] or x[0] != y[0]) for y in held):
                want.setdefault(current, set()).add(x)
    got = ngram_join.left_open(groups, exact, most)
    assert 10 < len(want) < 60 and {current: set(held) for current, held in got} == want and all(len(held) == len(set(held)) for _, held in got)


def test_blocks_compare_few_sets(spark):
    """Unlike lines of a bucket are not split into sets for exact counts (before, all were), and the similar ones are still linked."""
    r = np.random.default_rng(6)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz "))
    lines = ["".join(r.choice(letters, 200)).replace(" ", "x").encode() for _ in range(200)]
    lines.append(lines[0][:-3] + b"new")
    rows = [(int(k) % 5, 0, 0, 0, k, k, x) for k, x in enumerate(lines)]
    frame = spark.createDataFrame(rows, "sig long, i int, j int, own int, key long, root long, text binary")
    read = spark.sparkContext.accumulator(0)

    def sets(texts):
        read.add(len(texts))
        return line_dedup.line_sets(texts)

    import functools

    got = ngram_join.linked_in_blocks(frame, sets, 80, functools.partial(line_dedup.rough, percent=80)).collect()
    assert {(r.a, r.b) for r in got} in ({(0, 200)}, {(200, 0)}) and read.value == 2


def test_verified_over_many_rows(spark):
    """A pivot's rows that come in several parts, among unlike ones: the same links with rough bounds as without, and as by hand."""
    import functools

    pivot = "the first line of some length that all the others are held against"
    rows = [(k, f"{pivot if k % 3 else 'an altogether different beginning of a line that is of like size'} {k % 7}".encode()) for k in range(20_000)]
    texts = spark.createDataFrame(rows, "key long, text binary").repartition(3)
    pairs = spark.range(2, 20_000).selectExpr("1L as a", "id as b").union(spark.range(4, 40).selectExpr("3L as a", "id as b"))
    want = {(1, k) for k in range(2, 20_000) if k % 3} | {(3, k) for k in range(4, 40) if k % 3 == 0}
    for bound in (None, functools.partial(line_dedup.rough, percent=80)):
        got = ngram_join.verified(pairs, texts, line_dedup.line_sets, 80, salts=1, rough=bound).collect()
        assert len(got) == len(want) and {(r.a, r.b) for r in got} == want


def test_components_and_merged(spark):
    """Random edges, a chain and a hub in two lots: the same roots as by union-find, and none without edges."""
    from verdikt.llm.graph import components, merged

    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (180, 2))] + [(k, k + 1) for k in range(1000, 1040)] + [(2000, k) for k in range(1990, 2060)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    expected = {x: find(x) for x in root if find(x) != x}
    frame = lambda rows: spark.createDataFrame(rows, "a bigint, b bigint")
    for cut in (0, 1, 150, len(edges)):
        got = merged(components(frame(edges[:cut])), frame(edges[cut:])).collect()
        assert len(got) == len(expected) and {r.node: r.root for r in got} == expected
