"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is read with an explicit stack into leaf blocks: runs of text between block-level tags, with character references
decoded and white space made single. Each block has features from the tags, classes and ids of its ancestors and from its text. A
two-label chain, trained by gradient steps on the likelihood of labelled pages, is decoded by Viterbi; the blocks of the
main text are joined in page order. The labelled pages are made here from templates whose parts are known (article, menus, headers, footers,
sidebars, notices, adverts, forms, reader comments) and filled with random words; ``PAGES`` of them teach, others test.

Defined cases: null and empty pages give the empty text; broken markup (unclosed or stray tags, any depth) is read as far as it
goes; scripts, styles and embedded objects have no text, and where such an element closes itself or is never closed it has no content either, but for
scripts and styles, which then go to the end of the page; a ``<`` that starts no tag is text; pages are judged one by one; empty tables give empty results. Only the named columns
are read.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections.abc import Iterator, Set
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PAGES, EPOCHS, SEED = 400, 6, 7
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset(("script", "style", "noscript", "template", "textarea", "svg", "iframe", "object"))
# Opening one of these ends an open element of the same set, up to the nearest container.
_SIBLINGS = [frozenset(("p",)), frozenset(("li",)), frozenset(("dt", "dd")), frozenset(("td", "th")), frozenset(("tr",)), frozenset(("option",))]
_CONTAINERS = frozenset("html body article aside section div main nav header footer table ul ol dl form fieldset td th blockquote figure details select".split())
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*(?:>|\Z)", re.S)
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_TOKEN = re.compile(r"[a-z]{2,}")


class Block:
    """Text of a leaf block, its innermost element, the features of all elements around it, and how much of it are links."""

    __slots__ = ("text", "parent", "around", "linked")

    def __init__(self, text: str, parent: str | None, around: frozenset[str], linked: int):
        self.text, self.parent, self.around, self.linked = text, parent, around, linked


class _Open:
    """The open elements of a page, with the places of each tag, so that finding one costs the same at any depth.

    Elements share the set of features of the elements around them unless they add to it; with ``known`` only features in it count, so a
    set is copied at most as often as there are such features.
    """

    def __init__(self, known):
        self.known = known
        self.tags: list[str] = []
        self.around: list[frozenset[str]] = [frozenset()]
        self.places: dict[str, list[int]] = {}

    def last(self, tags) -> int:
        """Place of the innermost open element with one of the tags, or -1."""
        return max((places[-1] for t in tags if (places := self.places.get(t))), default=-1)

    def push(self, tag: str, names: set[str]) -> None:
        self.places.setdefault(tag, []).append(len(self.tags))
        self.tags.append(tag)
        mine = {f"ancestor:{tag}", *(f"name:{n}" for n in names)}
        if self.known is not None:
            mine &= self.known
        around = self.around[-1]
        self.around.append(around if mine <= around else around | mine)

    def close(self, depth: int) -> None:
        """End the element at a place and all inside it."""
        for tag in self.tags[depth:]:
            self.places[tag].pop()
        del self.tags[depth:], self.around[depth + 1:]


def leaf_blocks(page: str, known: Set[str] | None = None) -> list[Block]:
    opened = _Open(known)
    blocks: list[Block] = []
    said: list[str] = []
    # Raw elements that are not closed any more.
    endless: set[str] = set()
    linked = at = 0

    def flush():
        nonlocal linked
        text = " ".join(html.unescape("".join(said)).split())
        if text:
            blocks.append(Block(text, opened.tags[-1] if opened.tags else None, opened.around[-1], linked))
        said.clear()
        linked = 0

    def say(text: str):
        nonlocal linked
        said.append(text)
        linked += len(text) if opened.places.get("a") else 0

    while True:
        m = _TAG.search(page, at)
        if m is None:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at:m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag in BLOCK_TAGS:
                flush()
            depth = opened.last((tag,))
            if depth >= 0:
                opened.close(depth)
            continue
        if tag == "br":
            said.append(" ")
        if tag in BLOCK_TAGS:
            flush()
            for group in _SIBLINGS:
                if tag in group or "p" in group:
                    depth = opened.last(group)
                    if depth >= 0 and depth >= opened.last(_CONTAINERS):
                        opened.close(depth)
        if tag in RAW_TAGS:
            end = None if tag in endless or m[3].endswith("/") else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if end:
                at = end.end()
            elif not m[3].endswith("/"):
                endless.add(tag)
                at = len(page) if tag in ("script", "style") else at
        elif tag not in VOID_TAGS and not m[3].endswith("/"):
            opened.push(tag, {t for n in _NAMES.findall(m[3]) for t in _TOKEN.findall("".join(n).lower())} if m[3] else set())
    flush()
    return blocks


def features(blocks: list[Block]) -> list[list[str]]:
    out, n = [], len(blocks)
    for i, b in enumerate(blocks):
        text = b.text
        words = text.count(" ") + 1
        mine = {"bias", f"words:{min(8, int(math.log2(words)))}", f"linked:{min(4, int(4.99 * b.linked / max(1, len(text))))}", f"ends:{text[-1] if text[-1] in '.!?:,;' else 'x'}"}
        mine |= b.around
        if b.parent:
            mine.add("parent:" + b.parent)
        if i == 0:
            mine.add("first")
        if i == n - 1:
            mine.add("last")
        if "©" in text:
            mine.add("copyright")
        out.append(sorted(mine))
    return out


def chances(emit: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chance of each label at each place, and expected number of each pair of neighbouring labels, by forward-backward."""
    n = len(emit)
    forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
    forward[0] = emit[0]
    for i in range(1, n):
        forward[i] = emit[i] + np.logaddexp(forward[i - 1, 0] + t[0], forward[i - 1, 1] + t[1])
    for i in range(n - 2, -1, -1):
        backward[i] = np.logaddexp(t[:, 0] + emit[i + 1, 0] + backward[i + 1, 0], t[:, 1] + emit[i + 1, 1] + backward[i + 1, 1])
    total = np.logaddexp(*forward[-1])
    pairs = np.exp(forward[:-1, :, None] + t + (emit[1:] + backward[1:])[:, None, :] - total).sum(axis=0)
    return np.exp(forward + backward - total), pairs


class Chain:
    """Two-label chain: weights[feature] for both labels, and transitions[from][to]; label 1 is main text."""

    def __init__(self, weights: dict[str, tuple[float, float]], transitions: list[list[float]]):
        self.weights, self.transitions = weights, transitions

    def decode(self, rows: list[list[str]]) -> list[int]:
        """Viterbi."""
        get, (stay0, to1), (to0, stay1) = self.weights.get, *self.transitions
        back: list[tuple[int, int]] = []
        a = b = 0.0
        for i, row in enumerate(rows):
            e0 = e1 = 0.0
            for f in row:
                w = get(f)
                if w:
                    e0 += w[0]
                    e1 += w[1]
            if i:
                x0, y0, x1, y1 = a + stay0, b + to0, a + to1, b + stay1
                back.append((int(y0 > x0), int(y1 > x1)))
                a, b = max(x0, y0) + e0, max(x1, y1) + e1
            else:
                a, b = e0, e1
        if not rows:
            return []
        label = int(b > a)
        path = [label]
        for step in reversed(back):
            label = step[label]
            path.append(label)
        return path[::-1]


def train_chain(pages: list[tuple[list[list[str]], list[int]]], epochs: int = EPOCHS, rate: float = 0.3, ridge: float = 1e-4) -> Chain:
    """Likelihood by forward-backward, one adaptive gradient step per page."""
    index = {f: i for i, f in enumerate(sorted({f for rows, _ in pages for row in rows for f in row}))}
    w, t = np.zeros((len(index), 2)), np.zeros((2, 2))
    gw, gt = np.full_like(w, 1e-6), np.full_like(t, 1e-6)
    coded = [([np.array([index[f] for f in row]) for row in rows], np.array(labels)) for rows, labels in pages if rows]
    order = random.Random(SEED)
    for _ in range(epochs):
        order.shuffle(coded)
        for rows, labels in coded:
            emit = np.array([w[r].sum(axis=0) for r in rows])
            expected, counts = chances(emit, t)
            error = np.eye(2)[labels] - expected
            pairs = np.zeros((2, 2))
            np.add.at(pairs, (labels[:-1], labels[1:]), 1)
            pairs -= counts
            gt += pairs ** 2
            t += rate * pairs / np.sqrt(gt)
            flat = np.concatenate(rows)
            step = np.repeat(error, [len(r) for r in rows], axis=0)
            grad = np.zeros((0, 2))
            touched, where = np.unique(flat, return_inverse=True)
            grad = np.zeros((len(touched), 2))
            np.add.at(grad, where, step)
            grad -= ridge * w[touched]
            gw[touched] += grad ** 2
            w[touched] += rate * grad / np.sqrt(gw[touched])
    return Chain({f: (float(w[i, 0]), float(w[i, 1])) for f, i in index.items()}, t.tolist())


# Containers and names that pages use for their parts.
MAIN_PARTS = ("article", "article", "article", "main", "div class=content", "div id=main-content", "div class='post body'", "section class=story", "div class='entry text'", "div")
OTHER_PARTS = ("nav", "header", "footer", "aside", "div class=ad", "div class='advert banner'", "div class='cookie notice'", "div class=sidebar", "div class='menu navigation'",
               "form", "section class=comments", "div id=comments", "div class='comment reply'", "div class='related links'", "div class='share social'", "div class='newsletter signup'",
               "div class=breadcrumbs", "div class='sponsored promo'", "div class=popup", "div role=alert", "ul class=menu", "div class=footer", "div class=header", "dialog")


def labelled_pages(count: int, seed: int = SEED) -> list[tuple[str, list[str]]]:
    """(page, blocks of the main text in order) made from templates."""
    rng, pages = random.Random(seed), []

    def words(low, high):
        return [("".join(rng.choice("aeioustnrlbdmpk") for _ in range(rng.randint(1, 9)))) for _ in range(rng.randint(low, high))]

    def sentence(low=1, high=40):
        return (" ".join(words(low, high)).capitalize() + rng.choice(("", ".", ".", ".", "!", "?"))) or "x"

    def other(part, copyright=False):
        tag = part.split()[0]
        kind = rng.random()
        if tag == "form":
            inner = f"<label>{sentence(1, 4)}</label><input name=q><button>{sentence(1, 2)}</button>"
        elif kind < 0.4 or tag == "nav":
            inner = "<ul>" + "".join(f"<li><a href='/{i}'>{' '.join(words(1, 3))}</a>" + rng.choice(("</li>", "</li>", "")) for i in range(rng.randint(1, 8))) + "</ul>"
        elif kind < 0.7:
            inner = ("&copy; " if copyright or tag == "footer" and rng.random() < 0.7 else "") + sentence(1, 14)
        else:
            inner = "".join(f"<{t}>{sentence(1, 30)}</{t}>" for t in rng.choices(("p", "p", "div", "h3", "span"), k=rng.randint(1, 4)))
        return f"<{part}>{inner}</{tag}>"

    for _ in range(count):
        main: list[str] = []

        def body(tag="p", low=1, high=60, main=main):
            text = sentence(low, high)
            main.append(text)
            said = text
            if " " in text and rng.random() < 0.3:
                first, _, rest = text.partition(" ")
                said = rng.choice((f"<b>{first}</b> {rest}", f"<a href='/x'>{first}</a> {rest}", f"<em>{first}</em>\n {rest}"))
            return f"<{tag}>{said}" + (f"</{tag}>" if tag != "p" or rng.random() < 0.9 else "")

        head = f"<head><title>{sentence(2, 9)}</title><style>p{{}}</style><script>x='</p>'</script></head>"
        part = rng.choice(MAIN_PARTS)
        inner = []
        if rng.random() < 0.8:
            inner.append(body("h1", 1, 12))
        for _ in range(rng.choice((0, 1, 2, 4, 8, 16))):
            pick = rng.random()
            if pick < 0.75:
                inner.append(body())
            elif pick < 0.85:
                inner.append("<p><b>" + (lambda t: main.append(t) or t)(sentence(1, 12)) + "<br>")
            elif pick < 0.9:
                inner.append("<ul>" + body("li", 1, 20) + body("li", 1, 20) + "</ul>")
            elif pick < 0.94:
                inner.append(body(rng.choice(("h2", "h3", "blockquote", "pre")), 1, 15))
            else:
                inner.append(other(rng.choice(OTHER_PARTS[3:])))
        before = [other(p) for p in rng.sample(OTHER_PARTS, rng.randint(0, 4))]
        after = [other(p) for p in rng.sample(OTHER_PARTS, rng.randint(0, 4))] + ([other("footer", True)] if rng.random() < 0.7 else [])
        whole = f"<!DOCTYPE html><html>{head}<body>" + "".join(before) + f"<{part}>" + "".join(inner) + f"</{part.split()[0]}>" + "".join(after)
        pages.append((whole + ("</body></html>" if rng.random() < 0.9 else ""), main))
    return pages


def as_training(page: str, main: list[str]) -> tuple[list[list[str]], list[int]]:
    """Features and labels of a labelled page: the main blocks are a subsequence of the leaf blocks."""
    blocks, labels, k = leaf_blocks(page), [], 0
    for b in blocks:
        hit = k < len(main) and b.text == " ".join(main[k].split())
        labels.append(int(hit))
        k += hit
    return features(blocks), labels


@lru_cache(maxsize=1)
def default_chain() -> Chain:
    return train_chain([as_training(*p) for p in labelled_pages(PAGES)])


def main_text(page: str | None, chain: Chain) -> str:
    blocks = leaf_blocks(page or "", chain.weights.keys())
    return "\n".join(b.text for b, label in zip(blocks, chain.decode(features(blocks)), strict=True) if label)


def extract_main(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", chain: Chain | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per page: id, text, and the columns named in ``keep``."""
    chain = chain or default_chain()
    shared = pages.sparkSession.sparkContext.broadcast((chain.weights, chain.transitions))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Chain(*shared.value)
        for batch in batches:
            texts = pa.array([main_text(p.as_py(), mine) for p in batch.column("html")], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("id"), texts, *[batch.column(f"keep{i}") for i in range(len(keep))]], ["id", "text", *[f"keep{i}" for i in range(len(keep))]])

    picked = pages.select(pages[id_col].alias("id"), pages[html_col].cast("string").alias("html"), *[pages[k].alias(f"keep{i}") for i, k in enumerate(keep)])
    kinds = {f.name: f.dataType.simpleString() for f in picked.schema}
    found = picked.mapInArrow(run, ", ".join(["id " + kinds["id"], "text string", *[f"keep{i} {kinds[f'keep{i}']}" for i in range(len(keep))]]))
    return found.select("id", "text", *[found[f"keep{i}"].alias(k) for i, k in enumerate(keep)])
