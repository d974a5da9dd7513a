"""Ids of whole texts by the tokenizers library, with a cache of words.

A byte-pair tokenizer first splits a text into pre-tokens and encodes each by itself, so a piece cut
at a place where every such split has a border has the same ids alone as inside its text.  Texts are cut
at white space; ids of pieces seen before come from a cache, the others go through the library in one
batch.  Only borders that hold for the tokenizer's own pattern are used:

``words``: the tokenizer drops white space, so any ASCII white space is a border.
``spaces``: a space between two characters that are not white space begins a piece, and so does what follows a line end.
A text where white space meets a space, or that has other white space than spaces and line ends, is cut by a
pattern that looks at both neighbours.

A piece not seen before is cut once more into ASCII punctuation, letters, punctuation, where the letters
are all of Unicode's class L and no apostrophe is near (contractions are pre-tokens of their own).

Strings of special tokens inside a text are ordinary text.
"""

from __future__ import annotations

import gc
import os
import re
from array import array
from collections.abc import Sequence

import numpy as np

from .common import kept

#: Marks a text's first piece; no byte of UTF-8.
FIRST = b"\xff"
BORDER = re.compile(r"(?<=\S) (?=\S)")
# White space in UTF-8 other than spaces and line ends.
ODD_BYTES = re.compile(rb"[\x09\x0b-\x0d\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
ODD_ASCII = re.compile(rb"[\x09\x0b-\x0d\x1c-\x1f]")
#: ASCII punctuation but the apostrophe, which begins contractions.
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c != 39)
#: A piece and its end: perhaps the mark of a text's first piece, punctuation, ASCII letters, punctuation; or anything else.
SHAPED = re.compile(rb"(?:(\xff?)([%b]*)([A-Za-z]+)([%b]*)|([^\xfe]*))\xfe" % ((re.escape(MARKS),) * 2))


class Pieces(dict):
    """Numbers of pieces in the order in which they are first asked for; ``new`` has those not learned yet."""

    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, x: bytes) -> int:
        self[x] = k = len(self)
        self.new.append(x)
        return k


def alphabet() -> dict[int, int]:
    """Bytes as byte-level tokenizers write them: printable ones as they are, the others from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: b for b in printable} | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in printable)}


ALPHABET = alphabet()
SPACE_LETTER = chr(ALPHABET[32])


def mode_of(tokenizer) -> str:
    """How texts of this tokenizer may be cut: ``words``, ``spaces``, or ``""`` (not at all)."""
    import json

    made = json.loads(tokenizer.to_str())
    kinds = str(made["pre_tokenizer"])
    if "'behavior': 'Removed'" in kinds and "[^\\\\s\\\\p{L}\\\\p{N}]+" in kinds:
        return "words"
    pre = made["pre_tokenizer"] or {}
    return "spaces" if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and made["normalizer"] is None else ""


class Encoder:
    """``encode(texts)`` gives all ids in a row and the number of ids of each text."""

    def __init__(self, path: str, most: int = 300_000, most_parts: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.mode, self.most, self.most_parts = mode_of(self.tokenizer), most, most_parts
        self.parts: dict[bytes, bytes] = {}  # pre-tokens, with their ids as unsigned 32 bits (or 16, where they fit)
        self.kind = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.clear()

    def clear(self) -> None:
        self.known = Pieces()  # pieces between white space, by place in begin and length
        self.begin, self.length, self.pool = array("q"), array("q"), array(self.kind)
        self.hits = np.zeros(0, np.int64)  # how often each piece was asked for

    def cut(self, text: bytes) -> list[bytes]:
        if self.mode == "words":
            return text.split()
        if not text:
            return []
        if self.mode == "spaces":
            if b"  " in text or b" \n" in text or b"\n " in text or ODD_ASCII.search(text) or (not text.isascii() and ODD_BYTES.search(text)):
                cut = [x.encode() for x in BORDER.split(text.decode())]
            elif b"\n\n\n" in text or text.endswith(b"\n\n"):
                cut = text.split(b" ")
            else:  # a line end with at most one more beside it is a pre-token, and what follows it begins without a space
                cut = text.replace(b"\n", b" \xff\n \xff").split(b" ")
            cut[0] = FIRST + cut[0]  # all others stand for themselves after a space
            return cut
        return [text]

    def ids_of(self, part: bytes) -> bytes | None:
        """Ids of a pre-token by the model alone, if the steps before it only lower and map the part: letters
        below U+0180 (already composed) after at most a space.  None: the library's whole way is needed."""
        text = part.decode()
        letters = text[1:] if text[:1] == " " else text
        if not letters.isalpha() or max(letters) >= "\u0180" or "\u0130" in letters:
            return None
        plain = (text.lower().encode() if self.mode == "words" else part).decode("latin-1").translate(ALPHABET)
        return array(self.kind, [t.id for t in self.tokenizer.model.tokenize(plain)]).tobytes()

    def split(self, x: bytes) -> tuple[bytes, ...]:
        """Punctuation, letters and punctuation of a piece, or the piece.  A space belongs to what follows it."""
        space = self.mode == "spaces" and x[:1] == b" "
        right = (x[1:] if space else x).lstrip(MARKS)
        core = right.rstrip(MARKS)
        if not core or len(core) == len(x) or not core.decode().isalpha():
            return (x,)
        lead, trail = x[: len(x) - len(right)], right[len(core) :]
        if lead == b" ":
            lead, core = b"", b" " + core
        return tuple(p for p in (lead, core, trail) if p)

    def plans(self, new: list[bytes]):
        """The pre-tokens of each piece.  Most pieces are ASCII letters between punctuation, which one search over all of them finds."""
        if not self.mode:
            yield from ((x,) for x in new)
            return
        spaces = self.mode == "spaces"
        for first, lead, core, trail, other in SHAPED.findall(b"\xfe".join(new) + b"\xfe"):
            if not core:
                yield self.split(other if not spaces else other[1:] if other[:1] == FIRST else b" " + other)
            elif not spaces or first:
                yield tuple(p for p in (lead, core, trail) if p) if lead or trail else (core,)
            elif lead:
                yield (b" " + lead, core, trail) if trail else (b" " + lead, core)
            else:
                yield (b" " + core, trail) if trail else (b" " + core,)

    def learn(self) -> None:
        """Take in the pieces in ``known.new``, in order."""
        parts, hard, tokenize = self.parts, {}, self.tokenizer.model.tokenize
        plans = list(self.plans(self.known.new))
        lower, kind = self.mode == "words", self.kind
        for plan in plans:
            for p in plan:
                if p not in parts and p not in hard:
                    letters = p[1:] if p[:1] == b" " else p
                    if self.mode and letters.isascii() and letters.isalpha():
                        plain = p.lower().decode() if lower else p.decode().replace(" ", SPACE_LETTER)
                        parts[p] = array(kind, [t.id for t in tokenize(plain)]).tobytes()
                    elif self.mode and (ids := self.ids_of(p)) is not None:
                        parts[p] = ids
                    else:
                        hard[p] = None
        asked = list(hard)
        for k in range(0, len(asked), 20_000):
            some = asked[k : k + 20_000]
            for p, e in zip(some, self.tokenizer.encode_batch([p.decode() for p in some], add_special_tokens=False)):
                parts[p] = array(self.kind, e.ids).tobytes()
        found = [parts[plan[0]] if len(plan) == 1 else b"".join([parts[p] for p in plan]) for plan in plans]
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // self.pool.itemsize
        self.begin.frombytes((len(self.pool) + np.cumsum(lengths) - lengths).astype(np.int64).tobytes())
        self.length.frombytes(lengths.tobytes())
        self.pool.frombytes(b"".join(found))
        self.known.new = []

    def forget(self) -> None:
        """Of too many pieces, keep those asked for most often, half of ``most`` at most and twice at least each."""
        least = max(2, int(np.partition(self.hits, -self.most // 2)[-self.most // 2]))
        kept = np.flatnonzero(self.hits >= least)[: self.most // 2]
        names, begin, length, pool = list(self.known), np.frombuffer(self.begin, np.int64)[kept], np.frombuffer(self.length, np.int64)[kept], np.frombuffer(self.pool, self.kind)
        hits, ends = self.hits[kept] // 2, np.cumsum(length)
        ids = pool[np.repeat(begin - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)]
        del pool
        self.clear()
        self.known.update(zip([names[k] for k in kept.tolist()], range(len(kept))))
        self.hits = hits
        self.begin.frombytes((ends - length).tobytes())
        self.length.frombytes(length.tobytes())
        self.pool.frombytes(ids.tobytes())

    def encode(self, texts: Sequence[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Of UTF-8 texts (None: empty): ids (uint32), and how many of them each text has."""
        if len(self.known) > self.most:
            self.forget()
        if len(self.parts) > self.most_parts:
            self.parts.clear()
        gc.disable()  # many small objects, no cycles
        get, found = self.known.__getitem__, []
        for x in texts:
            cut = self.cut(x or b"")
            found.append(np.fromiter(map(get, cut), np.int64, len(cut)))
        self.learn()
        gc.enable()
        sizes = np.array([len(x) for x in found], np.int64)
        at = np.concatenate(found) if found else np.zeros(0, np.int64)
        if not len(at):
            return np.zeros(0, np.uint32), np.zeros(len(found), np.int64)
        hits = np.bincount(at, minlength=len(self.known))
        hits[: len(self.hits)] += self.hits
        self.hits = hits
        begin, length, pool = np.frombuffer(self.begin, np.int64)[at], np.frombuffer(self.length, np.int64)[at], np.array(self.pool, np.uint32)
        ends = np.cumsum(length)
        ids = pool[np.repeat(begin - (ends - length), length) + np.arange(ends[-1])]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])]
        return ids, np.diff(bounds)


def encoder(path: str) -> Encoder:
    """One for each path and Python worker, which may grow to some hundred MB."""
    return kept(("encoder", path), lambda: Encoder(path))


def documents_of(batches, path: str, end: int, most_bytes: int = 8_000_000):
    """(doc_ids, ids, bounds) for blocks of rows of Arrow batches with ``doc_id`` and ``text`` (binary).
    ``end`` is appended to each document; bounds has the begin of each and the end of the last."""
    coder = encoder(path)
    for batch in batches:
        keys, texts = batch.column(0).to_pylist(), batch.column(1)
        first = 0
        while first < len(keys):
            last, size, some = first, 0, []
            while last < len(keys) and size < most_bytes:
                some.append(texts[last].as_py())
                size += len(some[-1] or b"") + 64
                last += 1
            ids, n = coder.encode(some)
            ends = np.cumsum(n)
            full = np.insert(ids, ends, np.uint32(end))
            yield keys[first:last], full, np.concatenate([[0], ends + np.arange(1, len(n) + 1)])
            first = last
