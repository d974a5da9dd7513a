"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is read once by a tag scanner that keeps the stack of open elements.  A leaf block is the text
between two block-level borders.  Features of a block come from its ancestors' tags, words of their
class, id and role, and its text; the chain has two labels (article or not).  ``train`` fits weights on
labelled pages by gradient ascent on the conditional likelihood; ``decode`` is Viterbi.

The labelled pages are made by ``labelled_pages``: layouts drawn from a seeded generator over element and
class names in common use, with invented words.  They are the training set, and no page of any table is.

Scripts, styles, comments, templates, forms' fields, heads and hidden elements hold no text at all.  Character references are
decoded, white space inside a block becomes one space, blocks are trimmed and joined by two line ends.

Defined cases: null or empty html: an empty text.  Broken markup: an end tag without its start is ignored, open
elements end with the page, a tag cut off at the end of the page is dropped.  A page without blocks of the article has
an empty text.  Repeated rows are pages of their own.  Other columns are ignored.
"""

from __future__ import annotations

import functools
import html as entities
import random
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.DOTALL)
NAMES = re.compile(r"\b(class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
NOT_SHOWN = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.IGNORECASE)
WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")

# Elements of the HTML standard by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea template iframe select option button title xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"body", "html", "head", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "p": BLOCK - {"p"}}


def hidden(attributes: str) -> bool:
    """Whether an element with these attributes is not shown: ``hidden``, ``aria-hidden="true"`` or a style of ``display: none``."""
    low = attributes.lower()
    if "hidden" not in low and "none" not in low:
        return False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").strip()
        if name == "hidden" and value.lower() != "false" or name == "aria-hidden" and value.lower() == "true" or name == "style" and NOT_SHOWN.search(value):
            return True
    return False


def leaf_blocks(page: str) -> list[tuple[str, tuple[str, ...], tuple[str, ...], float]]:
    """(text, ancestors' tags, words of their names, share of its characters inside links) of each leaf block."""
    out: list = []
    stack: list[tuple[str, tuple[str, ...], bool, bool]] = []  # tag, words of its names, whether it is hidden, whether in a link (or something around it is)
    piece: list[str] = []
    linked = 0

    def end() -> None:
        nonlocal linked
        text = " ".join(entities.unescape("".join(piece)).split())
        if text:
            out.append((text, tuple(x[0] for x in stack), tuple(w for x in stack for w in x[1]), min(1.0, linked / max(1, sum(map(len, piece))))))
        piece.clear()
        linked = 0

    def close(names: set[str], stop: set[str]) -> bool:
        """Close the nearest open element of ``names``, unless one of ``stop`` is nearer."""
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in names:
                if any(x[0] in BLOCK for x in stack[k:]):
                    end()
                del stack[k:]
                return True
            if stack[k][0] in stop:
                return False
        return False

    def take(text: str) -> None:
        nonlocal linked
        if text and not (stack and stack[-1][2]):
            piece.append(text)
            if stack and stack[-1][3]:
                linked += len(text)

    at = 0
    while m := TAG.search(page, at):
        take(page[at : m.start()])
        at = m.end()
        if m[0].startswith("<![CDATA["):
            continue
        slash, name, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if slash:
            if name in BLOCK or name == "a" or any(x[0] == name for x in stack):
                close({name}, set() if name in BLOCK else {"td", "th", "table"})
            continue
        if name in RAW:
            if not rest.endswith("/"):
                stop = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
                at = stop.end() if stop else len(page) if name in ("script", "style", "textarea", "title", "template", "iframe") else at
            continue
        if name in VOID:
            if name == "hr":
                end()
            elif name == "br" or name == "wbr":
                take(" " if name == "br" else "")
            continue
        if name in BLOCK:
            if name not in ("html", "head") and any(x[0] == "head" for x in stack[:2]):
                close({"head"}, set())  # its end may be left out
            if name in CLOSES_P:
                close({"p"}, SCOPES["p"])
            if name in SIBLINGS:
                close(SIBLINGS[name], SCOPES[name])
            end()
        words = tuple(w.lower() for x in NAMES.finditer(rest) for w in WORD.findall(x[2] or x[3] or x[4] or "")) if rest else ()
        above = stack[-1] if stack else ("", (), False, False)
        stack.append((name, words, above[2] or name == "head" or bool(rest and hidden(rest)), above[3] or name == "a"))
    take(page[at:])
    end()
    return out


SIZE = 1 << 13


def feature(name: str) -> int:
    return zlib.crc32(name.encode()) % SIZE



@functools.lru_cache(1 << 16)
def tags_features(tags: tuple[str, ...], words: tuple[str, ...]) -> tuple[int, ...]:
    names = {f"in:{t}" for t in tags} | {f"name:{w}" for w in words}
    names |= {f"leaf:{tags[-1]}"} if tags else set()
    blocks = [t for t in tags if t in BLOCK]
    names |= {f"under:{b}>{c}" for b, c in zip(blocks[-3:], blocks[-2:])} | {f"no:{t}" for t in ("article", "main", "nav", "footer", "aside", "header") if t not in tags}
    return tuple(sorted({feature(n) for n in names}))


def features(block: tuple) -> tuple[int, ...]:
    text, tags, words, links = block
    n = text.count(" ") + 1
    names = [f"words:{min(6, n.bit_length())}", f"links:{round(links * 3)}"]
    names.append("ends:" + ("stop" if text[-1] in ".!?…\"”。" else "none"))
    if "©" in text or "copyright" in text[:200].lower():
        names.append("copyright")
    if text[:1].isupper() and n >= 8:
        names.append("sentence")
    return tags_features(tags, words) + tuple(feature(x) for x in names) + (feature("bias"),)


def emissions(pages: list[list[tuple[int, ...]]], w: np.ndarray) -> list[np.ndarray]:
    return [np.array([w[list(f)].sum(axis=0) for f in page]).reshape(-1, 2) for page in pages]


class Model:
    """Weights of features (by label) and of label pairs, and of a first label."""

    def __init__(self, weights: np.ndarray, pairs: np.ndarray, first: np.ndarray):
        self.weights, self.pairs, self.first = weights, pairs, first

    def decode(self, blocks: list) -> list[int]:
        """The most likely labels of a page's blocks (1: article)."""
        if not blocks:
            return []
        e = [self.weights[list(features(b))].sum(axis=0).tolist() for b in blocks]
        (aa, ab), (ba, bb) = self.pairs.tolist()
        x, y = self.first[0] + e[0][0], self.first[1] + e[0][1]
        back = []
        for c, d in e[1:]:
            to_a, to_b = (0, x + aa) if x + aa >= y + ba else (1, y + ba), (0, x + ab) if x + ab >= y + bb else (1, y + bb)
            back.append((to_a[0], to_b[0]))
            x, y = to_a[1] + c, to_b[1] + d
        out = [0 if x >= y else 1]
        for step in reversed(back):
            out.append(step[out[-1]])
        return out[::-1]

    def text(self, page: str | None) -> str:
        blocks = leaf_blocks(page or "")
        return "\n\n".join(b[0] for b, y in zip(blocks, self.decode(blocks)) if y)


def train(pages: list[tuple[list, list[int]]], rounds: int = 60, rate: float = 0.3, prior: float = 1e-3) -> Model:
    """Fit on (leaf blocks, labels) of pages: forward-backward over all pages at once, Adagrad steps."""
    pages = [(b, y) for b, y in pages if b]
    longest, n = max(len(b) for b, _ in pages), len(pages)
    rows, cols, page_of, place = [], [], [], []
    labels = np.full((n, longest), -1)
    count = 0
    for i, (blocks, y) in enumerate(pages):
        labels[i, : len(y)] = y
        for t, b in enumerate(blocks):
            f = features(b)
            rows += [count] * len(f)
            cols += f
            page_of.append(i)
            place.append(t)
            count += 1
    rows, cols, page_of, place = map(np.array, (rows, cols, page_of, place))
    mask = labels >= 0
    gold = np.zeros((count, 2))
    gold[np.arange(count), labels[page_of, place]] = 1
    both = mask[:, 1:]
    gold_pairs = np.array([[((labels[:, :-1] == a) & (labels[:, 1:] == b)).sum() for b in (0, 1)] for a in (0, 1)], float)
    gold_first = np.array([(labels[:, 0] == a).sum() for a in (0, 1)], float)
    w, pairs, first = np.zeros((SIZE, 2)), np.zeros((2, 2)), np.zeros(2)
    sums = [np.full_like(x, 1e-6) for x in (w, pairs, first)]
    logsum = lambda x, axis: np.logaddexp.reduce(x, axis=axis)
    for _ in range(rounds):
        flat = np.stack([np.bincount(rows, w[cols, k], count) for k in (0, 1)], axis=1)
        e = np.zeros((n, longest, 2))
        e[page_of, place] = flat
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = first + e[:, 0]
        for t in range(1, longest):
            step = logsum(alpha[:, t - 1, :, None] + pairs, 1) + e[:, t]
            alpha[:, t] = np.where(mask[:, t, None], step, alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            step = logsum(pairs + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(mask[:, t + 1, None], step, 0)
        z = logsum(alpha[:, 0] + beta[:, 0], 1)
        one = np.exp(alpha + beta - z[:, None, None])
        two = np.exp(alpha[:, :-1, :, None] + pairs + (e + beta)[:, 1:, None, :] - z[:, None, None, None])
        two = (two * both[:, :, None, None]).sum(axis=(0, 1))
        rest = gold - one[page_of, place]
        steps = [np.stack([np.bincount(cols, rest[rows, k], SIZE) for k in (0, 1)], axis=1) / n - prior * w, (gold_pairs - two) / n - prior * pairs, (gold_first - one[:, 0].sum(axis=0)) / n - prior * first]
        for x, g, s in zip((w, pairs, first), steps, sums):
            s += g * g
            x += rate * g / np.sqrt(s)
    return Model(w, pairs, first)


#: Class and id names in common use, by what they hold.
GOOD_NAMES = "content article post entry main body text story article-body entry-content post-content page-content main-content story-body"
BAD_NAMES = {
    "nav": "nav menu navigation navbar breadcrumb breadcrumbs topbar site-nav main-menu pagination pager tabs toc",
    "header": "header site-header masthead banner top branding logo page-header hero-bar",
    "footer": "footer site-footer bottom copyright footer-links colophon legal credits",
    "aside": "sidebar side aside related recommended widget popular trending more-stories rail tags",
    "notice": "notice cookie cookies consent gdpr alert banner modal popup overlay cookie-banner message newsletter subscribe paywall",
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion ad-slot banner-ad partner",
    "form": "search form login signup subscribe-form search-form newsletter-form contact-form",
    "comments": "comments comment comment-list discussion replies responses disqus reader-comments respond reply",
    "share": "share social social-share sharing follow share-buttons meta-links",
}


def labelled_pages(n: int = 500, seed: int = 11) -> list[tuple[str, list[tuple[str, int]]]]:
    """(html, [(block text, 1 if of the article)]) of invented pages."""
    r = random.Random(seed)
    syllables = [a + b for a in "b c d f g h k l m n p r s t v w th sh st br".split() for b in "a e i o u ai en or an".split()]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 3)))
    phrase = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))

    def sentences(k: int) -> str:
        out = []
        for _ in range(k):
            s = phrase(3, 16)
            if r.random() < 0.12:
                s = s.replace(" ", r.choice(["*** ", "&&& ", "%%% ", " | ", ", ", "!! "]))
            s = s.upper() if r.random() < 0.03 else s[:1].upper() + s[1:]
            out.append(s + r.choice([".", ".", ".", "!", "?", ""]))
        return " ".join(out)

    def page() -> tuple[str, list[tuple[str, int]]]:
        blocks: list[tuple[str, int]] = []

        def leaf(tag: str, text: str, y: int, attributes: str = "") -> str:
            blocks.append((" ".join(text.split()), y))
            return f"<{tag}{attributes}>{entities.escape(text, quote=False)}" + (f"</{tag}>" if r.random() < 0.97 or tag not in ("p", "li") else "")

        named = lambda kind: r.choice(BAD_NAMES[kind].split())

        def attributes(name: str) -> str:
            return f' {r.choice(["class", "class", "id"])}="{name}"'

        def links(k: int) -> str:
            out = []
            for _ in range(k):
                text = phrase(1, 3)
                blocks.append((text, 0))
                out.append(f'<li><a href="/{word()}">{text}</a></li>')
            return "<ul>" + "".join(out) + "</ul>"

        def box(kind: str, inner) -> str:
            plain = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind)
            tag = plain if plain and r.random() < 0.65 else r.choice(["div", "div", "section"])
            name = attributes(named(kind)) if tag in ("div", "section") or r.random() < 0.4 else ""
            return f"<{tag}{name}>{inner()}</{tag}>"

        small = lambda: leaf(r.choice(["p", "div", "span", "p"]) if r.random() < 0.9 else "h3", sentences(r.randint(1, 3)) if r.random() < 0.8 else phrase(1, 5), 0)
        wrapped = lambda k: (lambda: "".join(f"<div>{small()}</div>" for _ in range(r.randint(1, k))))

        def bare(kind: str) -> str:
            text = ("© " if kind == "footer" and r.random() < 0.7 else "") + (sentences(r.randint(1, 2)) if r.random() < 0.8 else phrase(1, 6))
            blocks.append((" ".join(text.split()), 0))
            return entities.escape(text, quote=False)

        def any_box(kind: str) -> str:
            if kind in ("nav", "share"):
                return box(kind, lambda: links(r.randint(2, 7)))
            if kind == "form":
                return box(kind, lambda: leaf("label", phrase(1, 3), 0) + "<input name=q><button>go</button>")
            if kind == "comments":
                return box(kind, lambda: leaf("h3", phrase(1, 3), 0) + "".join(f"<div{attributes('comment')}>" + leaf("p", sentences(r.randint(1, 4)), 0) + "</div>" for _ in range(r.randint(1, 5))))
            if kind == "aside":
                return box(kind, lambda: (leaf("h3", phrase(1, 3), 0) if r.random() < 0.7 else "") + (links(r.randint(2, 6)) if r.random() < 0.5 else wrapped(3)()))
            if kind == "header":
                return box(kind, lambda: leaf(r.choice(["div", "p", "h2", "a"]), phrase(1, 4), 0) + (links(3) if r.random() < 0.4 else ""))
            return box(kind, (lambda: bare(kind)) if r.random() < 0.6 else wrapped(2))

        def body() -> str:
            out = [leaf("h1", sentences(1), 1)] if r.random() < 0.85 else []
            for _ in range(r.randint(1, 12)):
                x = r.random()
                if x < 0.08:
                    out.append(leaf(r.choice(["h2", "h3"]), phrase(2, 6), 1))
                elif x < 0.14:
                    out.append("<ul>" + "".join(leaf("li", sentences(1), 1) for _ in range(r.randint(2, 5))) + "</ul>")
                elif x < 0.18:
                    out.append("<blockquote>" + leaf("p", sentences(r.randint(1, 2)), 1) + "</blockquote>")
                elif x < 0.21:
                    out.append("<figure><img src=x>" + leaf("figcaption", sentences(1), 1) + "</figure>")
                elif x < 0.24:
                    out.append(leaf("pre", phrase(3, 9), 1))
                elif x < 0.27:
                    out.append("<table><tr>" + leaf("td", phrase(1, 3), 1) + leaf("td", phrase(1, 3), 1) + "</tr></table>")
                elif x < 0.33:
                    out.append(any_box(r.choice(["ad", "ad", "share", "aside", "notice", "form"])))
                elif x < 0.4:
                    text = sentences(r.randint(1, 2))
                    blocks.append((" ".join(text.split()), 1))
                    out.append(f"<p><b>{entities.escape(text, quote=False)}<br>")
                else:
                    out.append(leaf("p", sentences(r.randint(1, 7)) if r.random() < 0.9 else phrase(1, 2) + ".", 1))
            return "".join(out)

        before = "".join(any_box(k) for k in r.sample(["nav", "header", "notice", "ad", "form"], r.randint(1, 4)))
        side = any_box("aside") if r.random() < 0.35 else ""
        x = r.random()
        name = attributes(r.choice(GOOD_NAMES.split()))
        if x < 0.45:
            core = f"<article{name if r.random() < 0.3 else ''}>{body()}</article>"
        elif x < 0.6:
            core = f"<main{name if r.random() < 0.3 else ''}>{body()}</main>"
        elif x < 0.9:
            core = f"<{(t := r.choice(['div', 'div', 'section']))}{name}>{body()}</{t}>"
        else:
            core = f"<div>{body()}</div>"
        if r.random() < 0.25:
            core = f"<main>{core}</main>" if r.random() < 0.5 else f'<div class="{r.choice(["wrapper", "container", "page", "row", "layout"])}">{core}</div>'
        after = "".join(any_box(k) for k in r.sample(["aside", "comments", "share", "ad", "notice", "form"], r.randint(0, 3))) + (any_box("footer") if r.random() < 0.9 else "")
        return f"<!DOCTYPE html><html><head><title>{phrase(1, 5)}</title><style>p{{}}</style></head><body>{before}{side}{core}{after}</body></html>", blocks

    return [page() for _ in range(n)]


@functools.cache
def trained() -> Model:
    """The model of the invented pages; blocks get the labels of the texts they were made from."""
    pages = []
    for page, blocks in labelled_pages():
        found = leaf_blocks(page)
        known: dict[str, list[int]] = {}
        for text, y in blocks:
            known.setdefault(text, []).append(y)
        labels = [known[b[0]].pop(0) if known.get(b[0]) else None for b in found]
        if None not in labels:
            pages.append((found, labels))
    return train(pages)


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """``page_id, url, text`` of every page."""
    model = model or trained()

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            text = pa.array([model.text(x) for x in batch.column(2).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), text], ["page_id", "url", "text"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return pages.select("page_id", "url", F.col("html").cast("string").alias("html")).mapInArrow(rows, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
