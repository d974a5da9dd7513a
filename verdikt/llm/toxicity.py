"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton in folded text.

Folding: lower case, diacritics off, look-alike letters of other scripts and full-width forms to Latin, digits and signs
that stand for letters to those letters, anything else to a space.  A pattern is a whole word or a
word's beginning.  Exception phrases (a hit with its left or right neighbour) take a hit back.

``fit`` learns weights from labelled rows, of which at most ``most_labels`` are taken, by the smallest hash of
their doc_id (a bounded sample): log odds of documents with the pattern; then
exception phrases; then a logistic curve over the weighted hits and hits normalised by length.  ``score`` reads every whole text.

Defined cases: null or empty text: no hits, so the curve's value for none.  Without labels of both kinds
the lexicon is empty and each score is 0.  Repeated rows are scored alike.  Labels for one doc_id that
disagree count as toxic.  Other columns are ignored.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, written

# Letters that look like Latin ones.
CYRILLIC_GREEK = "аa вb еe кk мm нh оo рp сc тt уy хx ѕs іi јj ԁd ԛq ԝw ɡg αa βb εe ικ ιi κk νv οo ρp τt υu χx ɑa ıi ʟl ɴn ʀr"
#: Digits and signs that stand for letters.
DIGITS = "0o 1i 3e 4a 5s 7t 8b 9g"
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "l", "€": "e", "£": "l"}
SIGN = re.compile(r"(?<=[^\W_])[@$!|€£](?=[^\W_])|(?<![^\s])[@$€£](?=[^\W\d_])")


@functools.cache
def folds() -> dict[int, str]:
    """For every character of the basic plane and the mathematical letters: letters (often one) or a space."""
    out = {}
    for c in [*range(0x3000), *range(0xFF00, 0x10000), *range(0x1D400, 0x1D800)]:
        plain = unicodedata.normalize("NFKD", chr(c)).lower()
        kept = "".join(x for x in plain if not unicodedata.combining(x))
        out[c] = "".join(x if x.isalpha() else " " for x in kept) or ("" if unicodedata.combining(chr(c)) or unicodedata.category(chr(c)) == "Cf" else " ")
    pairs = [x for x in CYRILLIC_GREEK.split() if len(x) == 2 and x[1].isascii()] + DIGITS.split()
    table = {ord(a): b for a, b in pairs}
    for c, x in out.items():
        if c in table:
            out[c] = table[c]
        else:
            out[c] = "".join(table.get(ord(y), y) for y in x)
    return out


@functools.cache
def ascii_folds() -> bytes:
    t = folds()
    return bytes(ord(t[c]) if c < 128 and len(t[c]) == 1 else 32 for c in range(256))


def fold(text: str) -> str:
    """Words of letters, with single or more spaces around each."""
    if any(s in text for s in SIGNS):
        text = SIGN.sub(lambda m: SIGNS[m[0]], text)
    if text.isascii():
        return f" {text.encode().translate(ascii_folds()).decode()} "
    return f" {text.translate(folds())} "


@dataclass
class Model:
    patterns: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset[str] = frozenset()
    curve: tuple[float, float, float] | None = None

    @functools.cached_property
    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for p, w in self.patterns.items():
            a.add_word(p, (p, w))
        if self.patterns:
            a.make_automaton()
        return a

    def __getstate__(self):
        return {"patterns": self.patterns, "exceptions": self.exceptions, "curve": self.curve}

    def hits(self, folded: str) -> list[tuple[str, float, str, str]]:
        """(pattern, weight, phrase with the left word, phrase with the right word), the heaviest pattern of each word."""
        best: dict[int, tuple[str, float]] = {}
        for end, (p, w) in self.automaton.iter(folded) if self.patterns else ():
            start = end - len(p) + 1
            if w > best.get(start, ("", -1.0))[1]:
                best[start] = (p, w)
        out = []
        for start, (p, w) in best.items():
            stop = folded.find(" ", start + 1)
            word, a, b = folded[start + 1 : stop], start, stop
            while a > 0 and folded[a - 1] == " ":
                a -= 1
            while b < len(folded) and folded[b] == " ":
                b += 1
            left, right = folded[folded.rfind(" ", 0, a) + 1 : a], folded[b : max(b, folded.find(" ", b))]
            out.append((p, w, f"{left} {word}".strip(), f"{word} {right}".strip()))
        return out

    def features(self, text: str) -> tuple[float, float]:
        folded = fold(text)
        total = sum(w for _, w, a, b in self.hits(folded) if a not in self.exceptions and b not in self.exceptions)
        return math.log1p(total), total / math.sqrt(len(folded) / 8 + 10)

    def score(self, text: str) -> float:
        if self.curve is None:
            return 0.0
        a, b = self.features(text)
        z = self.curve[0] + self.curve[1] * a + self.curve[2] * b
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def candidates(text: str, shortest: int = 4, longest: int = 8) -> set[str]:
    """Patterns that a text has: whole words (a space on either side) and beginnings of words (one on the left)."""
    words = {w for w in fold(text).split() if len(w) >= 3}
    out = {f" {w} " for w in words}
    for w in words:
        out.update(f" {w[:k]}" for k in range(shortest, min(longest, len(w) - 1) + 1))
    return out


def choose(counts: dict[str, tuple[int, int]], n_toxic: int, n_clean: int, least_weight: float, most: int) -> dict[str, float]:
    """Weights of the lexicon.  A beginning stands for its extensions only where none of them has most of
    its documents; else the longest form is kept."""
    weight = lambda a, b: math.log((a + 0.5) / (n_toxic + 1)) - math.log((b + 0.5) / (n_clean + 1))
    good = {p: (a, weight(a, b)) for p, (a, b) in counts.items() if a >= max(4, 0.01 * n_toxic) and weight(a, b) >= least_weight}
    top: dict[str, int] = {}
    for p, (a, _) in counts.items():
        body = p[:-1] if p.endswith(" ") else p
        for k in range(5, len(body) + (p != body)):
            top[body[:k]] = max(top.get(body[:k], 0), a)
    general = {p: x for p, x in good.items() if p.endswith(" ") or top.get(p, 0) < 0.75 * x[0]}
    kept: dict[str, float] = {}
    for p, (a, w) in sorted(general.items(), key=lambda x: (len(x[0].rstrip()), x[0])):
        if not any(p[:k] in kept and kept[p[:k]] >= w - 1 for k in range(5, len(p))):
            kept[p] = w
    return dict(sorted(kept.items(), key=lambda x: (-x[1], x[0]))[:most])


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(x.shape[1])
        w = w + np.linalg.solve(h, x.T @ (y - p) - 1e-3 * w)
    return w


def fit(documents: DataFrame, labels: DataFrame, most_labels: int = 20_000, most_patterns: int = 5_000, least_weight: float = 3.0) -> Model:
    """documents: doc_id, text; labels: doc_id, toxic (rows that may be learned from)."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labels)  # bounded by most_labels: may be broadcast
    rows = documents.select("doc_id", "text").join(F.broadcast(known), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "toxic")

    def count(batches):
        import pyarrow as pa

        found, docs = Counter(), Counter()
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                docs[toxic > 0] += 1
                found.update((p, toxic > 0) for p in candidates(text))
        terms = list(found) + [("", k) for k in docs]
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in terms], pa.string()), pa.array([k for _, k in terms]), pa.array([found.get(t) or docs[t[1]] for t in terms], pa.int64())], ["pattern", "toxic", "n"])

    sums = rows.mapInArrow(lean(count), "pattern string, toxic boolean, n bigint").groupBy("pattern").agg(F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(~F.col("toxic"), F.col("n")).otherwise(0)).alias("b"))
    sums = written(sums, "patterns")
    n_toxic, n_clean = next(((r.a, r.b) for r in sums.where("pattern = ''").collect()), (0, 0))
    if not n_toxic or not n_clean:
        return Model()
    # As many as ``choose`` looks at, which needs a share of the toxic documents: bounded by what ``1 / share`` documents have.
    counts = {r.pattern: (r.a, r.b) for r in sums.where((F.col("a") >= 0.75 * max(4, 0.01 * n_toxic)) & (F.col("pattern") != "")).collect()}
    model = Model(choose(counts, n_toxic, n_clean, least_weight, most_patterns))

    def phrases(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                hits = model.hits(fold(text))
                out.append((toxic, math.log1p(sum(h[1] for h in hits)), sum(h[1] for h in hits) / math.sqrt(len(fold(text)) / 8 + 10), [x for h in hits for x in h[2:]]))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.float64()), pa.array([x[2] for x in out], pa.float64()), pa.array([x[3] for x in out], pa.list_(pa.string()))], ["toxic", "a", "b", "phrases"])

    seen = rows.mapInArrow(lean(phrases), "toxic int, a double, b double, phrases array<string>").collect()
    clean = Counter(x for r in seen if r.toxic <= 0 for x in r.phrases)
    toxic = Counter(x for r in seen if r.toxic > 0 for x in r.phrases)
    model.exceptions = frozenset(x for x, n in clean.items() if n >= 5 and n > 4 * toxic[x] * n_clean / n_toxic)
    x = np.array([(1.0, r.a, r.b) for r in seen])
    model.curve = tuple(logistic(x, np.array([float(r.toxic > 0) for r in seen])).tolist())
    return model


def score(documents: DataFrame, model: Model) -> DataFrame:
    """``doc_id`` and ``score`` of every row."""

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            out = [model.score(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["doc_id", "score"])

    return documents.select("doc_id", "text").mapInArrow(lean(rows), f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, score double")


def reject(documents: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The documents scored below the threshold, with all their columns."""
    names = documents.columns

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            keep = [model.score(t or "") < threshold for t in batch.column(names.index("text")).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return documents.mapInArrow(lean(rows), documents.schema)
