"""Main text of web pages: a recurrent labeller over the blocks of a page.

A page is cut into leaf blocks, each with its tag path. A block becomes two hashed vectors, of its
path (tags, classes, ids) and of its words, and a few lengths. A bidirectional LSTM in numpy reads
all blocks of a page in order and labels each as main text or not, so that every decision sees the
whole page.

The network is trained when it is fitted, on at most ``TRAIN_PAGES`` of the given pages that mark
their article by a tag, one for each of the smallest hashes of an id, and on ``MADE_PAGES`` pages laid
out at random in other templates, with words of the former. Its weights are about 0.3 MB.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from .common import query, table

TRAIN_PAGES = 250
MADE_PAGES = 700
PATH, WORDS, NUMBERS = 128, 48, 8
WIDTH = PATH + WORDS + NUMBERS
HIDDEN = 24
EPOCHS = 8
BATCH = 32

# Element names of the HTML standard.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html iframe label legend li main menu nav noscript ol "
    "optgroup option p pre search section select summary table tbody td textarea tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

RAW = frozenset("script style template title".split())  # what they hold is no text of the page
DEEPEST = 256  # elements nested deeper count as children of the innermost one, as browsers limit it too

_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.IGNORECASE) for tag in RAW}
_NAME_END = re.compile(r"[\s/>]")
_SPECIAL = re.compile(r"[>\"']")
_NAMED = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
_PIECE = re.compile(r"[a-z]+")


@dataclass
class Block:
    """Text of a leaf, its path from the root and how much of it is link text."""

    text: str
    path: tuple[str, ...]
    linked: int


def _tokens(html: str) -> Iterator[tuple[int, int, str | None, bool, str]]:
    """``start, end, tag, closes, rest`` of what is not text: comments, raw elements (no tag), tags.

    Every character is looked at a fixed number of times, also where tags, quotes or comments are not
    closed: where a tag ends is known for all places at once, from the last one backwards.
    """
    at, size = 0, len(html)
    specials = ends = name_ends = None
    while (start := html.find("<", at)) >= 0:
        at = start + 1
        following = html[at:at + 1]
        if following in ("!", "?"):
            if html.startswith("<!--", start):
                end = html.find("-->", start + 2)
                end = size if end < 0 else end + 3
            elif html[start:start + 9].upper() == "<![CDATA[":
                end = html.find("]]>", start)
                end = size if end < 0 else end + 3
            else:
                end = html.find(">", start) + 1
                if not end:
                    at = html.find("<!--", at)  # where no tag ends any more, only a comment can follow
                    if at < 0:
                        return
                    continue
            yield start, end, None, False, ""
            at = end
            continue
        closes = following == "/"
        first = start + 2 if closes else start + 1
        if not html[first:first + 1].isascii() or not html[first:first + 1].isalpha():
            continue
        if ends is None:
            specials = [m.start() for m in _SPECIAL.finditer(html, start)]
            ends, later = [0] * (len(specials) + 1), {}
            ends[-1] = -1
            for i in range(len(specials) - 1, -1, -1):
                mark = html[specials[i]]
                if mark == ">":
                    ends[i] = specials[i] + 1
                else:
                    ends[i] = ends[later[mark] + 1] if mark in later else -1
                    later[mark] = i
            name_ends = [m.start() for m in _NAME_END.finditer(html, start)]
        n = bisect_left(name_ends, first)
        if n == len(name_ends):
            continue
        stop = name_ends[n]
        end = ends[bisect_left(specials, stop)]
        if end < 0:
            continue
        tag = html[first:stop].lower()
        if tag in RAW and not closes:
            match = _RAW_END[tag].search(html, end)
            at = match.end() if match else size
            yield start, at, None, False, ""
            continue
        yield start, end, tag, closes, html[stop:end - 1]
        at = end


def blocks_of(html: str | None) -> list[Block]:
    """Leaf blocks of a page in order; none for null or empty."""
    html = html or ""
    out: list[Block] = []
    labels: list[str] = []  # the open elements
    tags: list[str] = []
    open_blocks: list[int] = []  # places of the block elements among them
    count: Counter[str] = Counter()
    parts: list[str] = []
    linked = at = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(text, tuple(labels), linked))
        parts.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw:
            text = entities.unescape(raw)
            parts.append(text)
            if count["a"]:
                linked += len(text)

    def close(place: int) -> None:
        for tag in tags[place:]:
            count[tag] -= 1
        del tags[place:], labels[place:]
        while open_blocks and open_blocks[-1] >= place:
            open_blocks.pop()

    for start, end, tag, closes, rest in _tokens(html):
        say(html[at:start])
        at = end
        if tag is None:
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCK:
            flush()
        if closes:
            if count[tag]:
                close(len(tags) - 1 - tags[::-1].index(tag) if tags[-1] != tag else len(tags) - 1)
        elif tag not in VOID:
            if tag in CLOSES:
                for place in reversed(open_blocks):
                    if tags[place] in CLOSES[tag]:
                        close(place)
                        break
                    if tags[place] != "p":
                        break
            if not rest.endswith("/") and len(tags) < DEEPEST:
                names = " ".join(a or b or c for a, b, c in _NAMED.findall(rest)) if "=" in rest else ""
                if tag in BLOCK:
                    open_blocks.append(len(tags))
                tags.append(tag)
                labels.append(f"{tag} {names}" if names else tag)
                count[tag] += 1
    say(html[at:])
    flush()
    return out


def _slot(piece: str, size: int) -> int:
    return zlib.crc32(piece.encode("utf-8", "replace")) % size


_slots: dict[str, np.ndarray] = {}


def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    """Hashed tags and name pieces of a path; the inner ones also by their own slots."""
    key = ">".join(path)
    found = _slots.get(key)
    if found is None:
        found = np.zeros(PATH, np.float32)
        for step, label in enumerate(reversed(path)):
            tag, _, names = label.partition(" ")
            for piece in [f"<{tag}"] + _PIECE.findall(names.lower()):
                found[_slot(piece, PATH)] = 1.0
                if step == 0:
                    found[_slot(f"leaf {piece}", PATH)] = 1.0
        if len(_slots) < 50_000:
            _slots[key] = found
    return found


def vectors(blocks: list[Block]) -> np.ndarray:
    """One row per block: path, words, numbers."""
    out = np.zeros((len(blocks), WIDTH), np.float32)
    for i, b in enumerate(blocks):
        words = b.text.split()
        out[i, :PATH] = _path_vector(b.path)
        for word, n in Counter(words).items():
            out[i, PATH + _slot(word, WORDS)] += n
        out[i, PATH:PATH + WORDS] /= max(1.0, float(np.linalg.norm(out[i, PATH:PATH + WORDS])))
        n = max(len(b.text), 1)
        out[i, PATH + WORDS:] = (
            np.log1p(n) / 8, np.log1p(len(words)) / 6, b.linked / n, sum(map(b.text.count, ".,;:!?")) / n * 10,
            b.text[-1] in ".!?\"'", i / max(len(blocks) - 1, 1), 1.0 if i == 0 else 0.0, min(len(b.path), 12) / 12)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class Direction:
    """One direction of the LSTM. ``mask`` keeps the state where a shorter page has no block."""

    def __init__(self, rng: np.random.Generator, backward: bool):
        self.backward = backward
        self.p = {
            "x": rng.normal(0, 1 / np.sqrt(WIDTH), (WIDTH, 4 * HIDDEN)).astype(np.float32),
            "h": rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN)).astype(np.float32),
            "b": np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]).astype(np.float32),
        }

    def steps(self, n: int) -> range:
        return range(n - 1, -1, -1) if self.backward else range(n)

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        n, size = x.shape[:2]
        fed = x @ self.p["x"] + self.p["b"]
        h, c = np.zeros((size, HIDDEN), np.float32), np.zeros((size, HIDDEN), np.float32)
        out = np.zeros((n, size, HIDDEN), np.float32)
        for t in self.steps(n):
            z = fed[t] + h @ self.p["h"]
            i, f, o = (_sigmoid(z[:, k * HIDDEN:(k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN:])
            m = mask[t][:, None]
            new_c = m * (f * c + i * g) + (1 - m) * c
            squashed = np.tanh(new_c)
            new_h = m * (o * squashed) + (1 - m) * h
            if keep is not None:
                keep.append((t, h, c, i, f, o, g, squashed, m))
            h, c = new_h, new_c
            out[t] = h
        return out

    def backward_pass(self, x: np.ndarray, kept: list, d_out: np.ndarray) -> dict[str, np.ndarray]:
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        dh, dc = np.zeros_like(kept[0][1]), np.zeros_like(kept[0][2])
        for t, h, c, i, f, o, g, squashed, m in reversed(kept):
            dh = dh + d_out[t]
            do, dcell = m * dh * squashed, dc + m * dh * o * (1 - squashed**2)
            dz = np.hstack([m * dcell * g * i * (1 - i), m * dcell * c * f * (1 - f), do * o * (1 - o), m * dcell * i * (1 - g**2)])
            grads["x"] += x[t].T @ dz
            grads["h"] += h.T @ dz
            grads["b"] += dz.sum(axis=0)
            dh = dz @ self.p["h"].T + (1 - m) * dh
            dc = m * dcell * f + (1 - m) * dc
        return grads


class Labeller:
    """Bidirectional LSTM with one output per block."""

    def __init__(self, seed: int = 4):
        rng = np.random.default_rng(seed)
        self.parts = [Direction(rng, False), Direction(rng, True)]
        self.out = {"w": rng.normal(0, 0.1, (2 * HIDDEN, 1)).astype(np.float32), "b": np.zeros(1, np.float32)}

    @staticmethod
    def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        n = max(map(len, pages))
        x, mask = np.zeros((n, len(pages), WIDTH), np.float32), np.zeros((n, len(pages)), np.float32)
        for k, page in enumerate(pages):
            x[:len(page), k], mask[:len(page), k] = page, 1
        return x, mask

    def logits(self, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        stores = [[], []]
        h = np.concatenate([p.forward(x, mask, s if keep is not None else None) for p, s in zip(self.parts, stores, strict=True)], axis=2)
        if keep is not None:
            keep += stores
        return (h @ self.out["w"] + self.out["b"])[..., 0], h

    def main(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """For each page, which of its blocks are main text. Pages of similar length run together."""
        result: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k, p in enumerate(pages) if len(p)), key=lambda k: len(pages[k]))
        at = 0
        while at < len(order):
            # a batch holds at most some ten thousand padded blocks, and one page at least
            size = 1
            while at + size < len(order) and (size + 1) * len(pages[order[at + size]]) <= 8192:
                size += 1
            chosen = order[at:at + size]
            x, mask = self.padded([pages[k] for k in chosen])
            score = self.logits(x, mask)[0]
            for column, k in enumerate(chosen):
                result[k] = score[:len(pages[k]), column] > 0
            at += size
        return result

    def train(self, pages: list[np.ndarray], labels: list[np.ndarray], seed: int = 4) -> None:
        """Adam on the cross entropy of all blocks."""
        rng, step = np.random.default_rng(seed), 0
        groups = [d.p for d in self.parts] + [self.out]
        first = [{k: np.zeros_like(v) for k, v in g.items()} for g in groups]
        second = [{k: np.zeros_like(v) for k, v in g.items()} for g in groups]
        for epoch in range(EPOCHS):
            # pages of similar length share a batch; batches come in random order
            order = sorted(range(len(pages)), key=lambda k: (len(pages[k]), rng.random()))
            batches = [order[i:i + BATCH] for i in range(0, len(order), BATCH)]
            rng.shuffle(batches)
            for chosen in batches:
                x, mask = self.padded([pages[k] for k in chosen])
                # path slots go missing at random, so that names alone do not decide
                x = x * np.concatenate([rng.random((1, x.shape[1], PATH)) > 0.15, np.ones((1, x.shape[1], WIDTH - PATH), bool)], axis=2)
                # and so do the words of some blocks
                x[..., PATH:PATH + WORDS] *= rng.random((*mask.shape, 1)) > 0.4
                want = np.zeros_like(mask)
                for column, k in enumerate(chosen):
                    want[:len(pages[k]), column] = labels[k]
                stores: list = []
                score, h = self.logits(x, mask, stores)
                d = ((_sigmoid(score) - want) * mask / mask.sum())[..., None]
                d_h = d @ self.out["w"].T
                grads = [part.backward_pass(x, s, d_h[..., k * HIDDEN:(k + 1) * HIDDEN]) for k, (part, s) in enumerate(zip(self.parts, stores, strict=True))]
                grads.append({"w": np.einsum("tbh,tbo->ho", h, d), "b": d.sum(axis=(0, 1))})
                step += 1
                rate = 0.01 * (0.3 if epoch >= EPOCHS - 2 else 1.0) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for g, a, b, grad in zip(groups, first, second, grads, strict=True):
                    for k in g:
                        clipped = np.clip(grad[k], -1, 1)
                        a[k] += 0.1 * (clipped - a[k])
                        b[k] += 0.001 * (clipped**2 - b[k])
                        g[k] -= (rate * a[k] / (np.sqrt(b[k]) + 1e-8)).astype(np.float32)


# Names that page templates use for their parts.
MAIN = ("article", "main", "div class=content", "div id=main-content", "div class=post-body", "section class=entry-content", "div class=article-text", "div class=story", "td class=body", "div role=main", "div")
AROUND = {
    "menu": ("nav", "div class=menu", "ul class=navigation", "div id=navbar", "div class=breadcrumbs", "div role=navigation"),
    "header": ("header", "div class=header", "div id=masthead", "div class=top-bar", "div class=site-title"),
    "footer": ("footer", "div class=footer", "div id=site-footer", "div class=copyright", "section class=colophon"),
    "sidebar": ("aside", "div class=sidebar", "div id=right-rail", "section class=related", "div class=widget", "aside class=recommended"),
    "notice": ("div class=cookie-notice", "div class=banner", "div class=notice", "section class=consent", "div id=gdpr", "div class=alert", "div role=dialog", "div class=newsletter"),
    "advert": ("div class=ad", "div class=advert", "aside class=sponsored", "div id=ads-top", "div class=promo", "ins class=adsbygoogle"),
    "form": ("form", "form class=search", "div class=subscribe-form", "fieldset", "form id=login"),
    "comments": ("section class=comments", "div id=comments", "div class=comment-list", "ol class=commentlist", "div class=responses", "div class=reader-comments", "div class=disqus-thread"),
}
_ORDER = ("header", "menu", "notice", "advert")
_AFTER = ("sidebar", "form", "comments", "advert", "notice", "footer")


def made_page(rng: np.random.Generator, vocabulary: list[str]) -> tuple[str, list[int]]:
    """A page in a random template and the label of each of its blocks, in order."""
    labels: list[int] = []

    def text(low: int, high: int) -> str:
        words = [vocabulary[i] for i in rng.integers(0, len(vocabulary), rng.integers(low, high + 1))]
        return entities.escape(" ".join(words))

    def opened(kind: str) -> tuple[str, str]:
        tag, _, attribute = kind.partition(" ")
        name, _, value = attribute.partition("=")
        return (f'<{tag} {name}="{value}">' if name else f"<{tag}>"), f"</{tag}>"

    def around(part: str) -> str:
        kinds = AROUND[part]
        start, end = opened(kinds[rng.integers(len(kinds))])
        body = ""
        if part == "menu":
            for _ in range(rng.integers(2, 9)):
                body += f'<li><a href="/{rng.integers(999)}">{text(1, 3)}</a></li>'
                labels.append(0)
            body = f"<ul>{body}</ul>"
        elif part == "form":
            body = f'<label>{text(1, 3)}</label><input name="q"><button>{text(1, 2)}</button>'
            labels.extend([0, 0])
        elif part == "comments":
            body = f"<h3>{text(1, 3)}</h3>"
            labels.append(0)
            for _ in range(rng.integers(1, 6)):
                body += f'<div class="comment"><p>{text(2, 60)}</p></div>' if rng.random() < 0.7 else f"<li><b>{text(1, 2)}</b> <p>{text(2, 60)}</p></li>"
                labels.extend([0] if body.endswith("</div>") else [0, 0])
        else:
            for _ in range(rng.integers(1, 4)):
                wrap = ("p", "div", "li", "span")[rng.integers(4)]
                inner = text(1, 25)
                body += f"<{wrap}>{f'<a href=x>{inner}</a>' if rng.random() < 0.3 else inner}</{wrap}>" if wrap != "span" else f"<p>{inner}</p>"
                labels.append(0)
        return start + body + end

    page = ""
    for part in _ORDER:
        if rng.random() < 0.6:
            page += around(part)
    start, end = opened(MAIN[rng.integers(len(MAIN))])
    page += start
    if rng.random() < 0.8:
        page += f"<h1>{text(2, 12)}</h1>"
        labels.append(1)
    for _ in range(rng.integers(1, 12)):
        kind = rng.random()
        if kind < 0.06:
            page += around(("advert", "sidebar", "notice", "form")[rng.integers(4)])
            continue
        body = text(1, 6) if rng.random() < 0.15 else text(8, 150)
        if rng.random() < 0.04:  # a word over and over is the article's own fault
            body = " ".join([text(1, 1)] * int(rng.integers(5, 60)))
        tag = ("p", "p", "p", "p", "h2", "blockquote", "li", "pre", "div")[rng.integers(9)]
        page += f"<{tag}>{body}</{tag}>" if kind < 0.9 or tag != "p" else f"<p><b>{body}<br>"
        labels.append(1)
    inside = rng.random() < 0.3
    if inside and rng.random() < 0.6:
        page += around("comments")
    page += end
    for part in _AFTER:
        if rng.random() < 0.6:
            page += around(part)
    return f"<!DOCTYPE html><html><body>{page}</body></html>", labels


def _marked(blocks: list[Block]) -> list[int] | None:
    """Labels of a page that marks its article by a tag; None if it does not."""
    tags = [[label.partition(" ")[0] for label in b.path] for b in blocks]
    if not any("article" in t or "main" in t for t in tags):
        return None
    outside = {"nav", "footer", "header", "aside", "form"}
    return [int(("article" in t or "main" in t) and not outside & set(t) and "comment" not in " ".join(b.path).lower()) for b, t in zip(blocks, tags, strict=True)]


def fit(pages: DataFrame) -> Labeller:
    """Train a labeller; see the module's text for what it reads."""
    hashed = pages.where("html is not null").select(F.xxhash64("page_id").alias("h"), "html")
    # hashes first, so that only the pages wanted reach the driver, however many tasks there are
    wanted = [r["h"] for r in hashed.select("h").distinct().orderBy("h").limit(TRAIN_PAGES).collect()]
    sample = hashed.where(F.col("h").isin(wanted)).groupBy("h").agg(F.min("html").alias("html")).orderBy("h").collect()
    cut = [blocks_of(r["html"]) for r in sample]
    marked = [(b, m) for b in cut if b and (m := _marked(b)) is not None]
    vocabulary = sorted({w for b in cut for x in b for w in x.text.split()[:50]})[:20_000] or ["the", "of", "and"]
    xs, ys = [vectors(b) for b, _ in marked], [np.array(m, np.float32) for _, m in marked]
    rng = np.random.default_rng(44)
    for _ in range(MADE_PAGES):
        page, labels = made_page(rng, vocabulary)
        blocks = blocks_of(page)
        if len(blocks) == len(labels):
            xs.append(vectors(blocks))
            ys.append(np.array(labels, np.float32))
    model = Labeller()
    model.train(xs, ys)
    return model


def main_text(html: Column, model: Labeller) -> Column:
    """Main text of whole pages: blocks labelled as such, in order, joined by a blank line."""

    @pandas_udf(StringType())
    def extract(pages: pd.Series) -> pd.Series:
        cut = [blocks_of(p) for p in pages]
        chosen = model.main([vectors(b) for b in cut])
        return pd.Series(["\n\n".join(x.text for x, yes in zip(b, c, strict=True) if yes) for b, c in zip(cut, chosen, strict=True)], dtype="object")

    return extract(F.coalesce(html, F.lit("")))


def extracted(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` per page; ``text`` is empty if a page has no main text.

    A null html counts as empty; repeated rows each get a row; null ids and urls are kept. Other
    columns are ignored. An empty table gives an empty result.
    """
    model = fit(pages)
    return pages.select("page_id", "url", main_text(F.col("html"), model).alias("text")).withColumn("n_chars", F.length("text").cast("long"))


@query("op4_html_main_text")
def op4(spark, folder):
    return extracted(table(spark, folder, "pages"))
