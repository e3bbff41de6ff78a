"""Recurrent block labeller in numpy: a bidirectional LSTM over the leaf blocks of a page.

A block is read as the sum of vectors of its tag path's marks, its own element's vector, the mean of its hashed
words' vectors, and a few shapes; the two directions together see the whole page at every block. Its size is fixed,
whatever the input. It is trained here, on pages drawn from a seeded grammar of layouts whose blocks are known to
be article or not; nothing is learnt from the table.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from .blocks import Page, parse

MARKS, WORDS, PATH, WORD, SHAPES, HIDDEN = 2048, 2048, 24, 8, 5, 24
WIDTH = 2 * PATH + WORD + SHAPES

#: Names of elements, classes and ids around articles, and around everything else.
_MAIN = "article main content post entry story text body news blog page single".split()
_OTHER = {
    "nav": "nav menu navigation navbar breadcrumb toc",
    "header": "header masthead banner top topbar logo",
    "footer": "footer bottom copyright legal colophon",
    "aside": "aside sidebar widget related recommended trending popular more",
    "div": "ad ads advert advertisement sponsor sponsored promo banner",
    "section": "comments comment reply discussion respond disqus reader",
    "form": "form search login newsletter subscribe signup contact",
    "dialog": "cookie consent notice gdpr modal popup overlay alert banner",
    "ul": "share social tags pagination pager follow",
}
#: Words seen in such blocks.
_PHRASES = "home about contact login subscribe newsletter cookie cookies accept privacy terms copyright rights reserved share tweet comments reply advertisement sponsored related search menu follow".split()
_WRAPS = "div section span container wrapper inner row col grid box layout".split()


def _bucket(words: list[str], size: int) -> list[int]:
    return [zlib.crc32(w.encode("utf-8", "surrogatepass")) % size for w in words]


class Sheet:
    """Number arrays of a page's blocks."""

    def __init__(self, page: Page):
        flat = [m for marks in page.marks for m in marks]
        self.parent = np.array(page.parent)
        self.sizes = np.array([len(m) for m in page.marks])
        self.marks = np.array(_bucket(flat, MARKS), np.int64)
        self.node = np.array(page.node, np.int64)
        self.leaf = np.array(_bucket(["leaf " + t for t in page.leaf], MARKS), np.int64)[self.node]
        split = [t.lower().split() for t in page.text]
        self.counts = np.array([len(s) for s in split], np.int64)
        self.words = np.array([b for s in split for b in _bucket(s, WORDS)], np.int64)
        n = len(split)
        ends = np.array([t[-1] in ".!?…\"”" for t in page.text], np.float32)
        self.shapes = np.stack([np.log1p(self.counts) / 5, np.array(page.linked), ends, np.arange(n) / max(n, 1), np.ones(n)], 1).astype(np.float32) if n else np.zeros((0, SHAPES), np.float32)

    def path_vectors(self, table: np.ndarray) -> np.ndarray:
        """Of each node: the sum of its path's mark vectors over the square root of their number."""
        sums = np.zeros((len(self.parent), PATH), np.float32)
        owner = np.repeat(np.arange(len(self.parent)), self.sizes)
        np.add.at(sums, owner, table[self.marks])
        depth = self.sizes.astype(np.float32)
        for i in range(1, len(self.parent)):
            sums[i] += sums[self.parent[i]]
            depth[i] += depth[self.parent[i]]
        return sums / np.sqrt(np.maximum(depth, 1))[:, None]

    def path_pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(block, mark, weight) of all paths; for training, whose pages are small."""
        first = np.concatenate(([0], np.cumsum(self.sizes)))
        block, mark, weight = [], [], []
        for b, node in enumerate(self.node.tolist()):
            found = []
            while node:
                found += self.marks[first[node] : first[node + 1]].tolist()
                node = int(self.parent[node])
            block += [b] * len(found)
            mark += found
            weight += [len(found) ** -0.5] * len(found)
        return np.array(block, np.int64), np.array(mark, np.int64), np.array(weight, np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _turned(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each row's first `size` steps in opposite order; an involution. x is (steps, rows, ...)."""
    steps = np.arange(x.shape[0])[:, None]
    at = np.where(steps < sizes[None, :], sizes[None, :] - 1 - steps, steps)
    return x[at, np.arange(x.shape[1])[None, :]]


def _run(x: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states (steps, rows, HIDDEN) of one direction. Padding comes after a row's end and changes nothing before it."""
    pre = x @ w + b
    h = np.zeros((x.shape[1], HIDDEN), np.float32)
    c = np.zeros_like(h)
    out = np.empty((*x.shape[:2], HIDDEN), np.float32)
    for t in range(len(x)):
        z = pre[t] + h @ u
        gates, new = _sigmoid(z[:, : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        old, before = c, h
        c = f * old + i * new
        tc = np.tanh(c)
        h = o * tc
        out[t] = h
        if keep is not None:
            keep.append((i, f, o, new, old, tc, before))
    return out


def _back(x, w, u, kept, dout):
    """Gradients of one direction: of w, u, b and x."""
    dz = np.empty((*x.shape[:2], 4 * HIDDEN), np.float32)
    du = np.zeros_like(u)
    dh = np.zeros((x.shape[1], HIDDEN), np.float32)
    dc = np.zeros_like(dh)
    for t in reversed(range(len(x))):
        i, f, o, new, old, tc, before = kept[t]
        dh = dh + dout[t]
        dc = dc + dh * o * (1 - tc * tc)
        dz[t] = np.concatenate((dc * new * i * (1 - i), dc * old * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - new * new)), 1)
        du += before.T @ dz[t]
        dh, dc = dz[t] @ u.T, dc * f
    flat = dz.reshape(-1, 4 * HIDDEN)
    return x.reshape(-1, x.shape[2]).T @ flat, du, flat.sum(0), dz @ w.T


class Labeller:
    """Weights by name, and labels of pages."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p = {"marks": draw(MARKS, PATH, scale=0.3), "leaf": draw(MARKS, PATH, scale=0.3), "words": draw(WORDS, WORD, scale=0.1), "out": draw(2 * HIDDEN, scale=0.2), "bias": np.zeros(1, np.float32)}
        for d in "lr":
            self.p |= {f"w{d}": draw(WIDTH, 4 * HIDDEN, scale=WIDTH**-0.5), f"u{d}": draw(HIDDEN, 4 * HIDDEN, scale=HIDDEN**-0.5), f"b{d}": np.zeros(4 * HIDDEN, np.float32)}

    def _inputs(self, sheet: Sheet) -> np.ndarray:
        mean = np.zeros((len(sheet.node), WORD), np.float32)
        starts = np.concatenate(([0], np.cumsum(sheet.counts)))
        for b in range(len(sheet.node)):
            seen = np.bincount(sheet.words[starts[b] : starts[b + 1]], minlength=1) if sheet.counts[b] > WORDS else None
            part = self.p["words"][sheet.words[starts[b] : starts[b + 1]]] if seen is None else None
            mean[b] = part.mean(0) if seen is None else seen @ self.p["words"][: len(seen)] / sheet.counts[b]
        return np.concatenate((sheet.path_vectors(self.p["marks"])[sheet.node], self.p["leaf"][sheet.leaf], mean, sheet.shapes), 1)

    def _batch(self, sheets: list[Sheet]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(s.node) for s in sheets])
        x = np.zeros((sizes.max(), len(sheets), WIDTH), np.float32)
        for r, s in enumerate(sheets):
            x[: sizes[r], r] = self._inputs(s)
        return x, sizes

    def _logits(self, x, sizes, keep=None):
        kept = ([], []) if keep is not None else (None, None)
        left = _run(x, self.p["wl"], self.p["ul"], self.p["bl"], kept[0])
        turned = _turned(x, sizes)
        right = _turned(_run(turned, self.p["wr"], self.p["ur"], self.p["br"], kept[1]), sizes)
        both = np.concatenate((left, right), 2)
        if keep is not None:
            keep += [*kept, turned, both]
        return both @ self.p["out"] + self.p["bias"]

    def label(self, pages: list[Page], most_cells: int = 1 << 15) -> Iterator[tuple[int, np.ndarray]]:
        """(place, one flag a block: article or not) of each page; pages of like length go together."""
        order = sorted((i for i, p in enumerate(pages) if p.node), key=lambda i: len(pages[i].node))
        while order:
            rows = [order.pop()]
            steps = len(pages[rows[0]].node)
            while order and (len(rows) + 1) * steps <= most_cells:
                rows.append(order.pop())
            x, sizes = self._batch([Sheet(pages[i]) for i in rows])
            told = self._logits(x, sizes) > 0
            for r, i in enumerate(rows):
                yield i, told[: sizes[r], r]

    def step(self, sheets: list[Sheet], truth: list[np.ndarray]) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy of a batch, and its gradients."""
        x, sizes = self._batch(sheets)
        y, real = np.zeros(x.shape[:2], np.float32), np.zeros(x.shape[:2], np.float32)
        for r, t in enumerate(truth):
            y[: sizes[r], r], real[: sizes[r], r] = t, 1
        keep: list = []
        z = self._logits(x, sizes, keep)
        kept_l, kept_r, turned, both = keep
        loss = float((real * (np.logaddexp(0, z) - y * z)).sum() / real.sum())
        dz = real * (_sigmoid(z) - y) / real.sum()
        g = {"out": np.einsum("tr,trh->h", dz, both), "bias": dz.sum().reshape(1)}
        dboth = dz[..., None] * self.p["out"]
        g["wl"], g["ul"], g["bl"], dx = _back(x, self.p["wl"], self.p["ul"], kept_l, dboth[..., :HIDDEN])
        g["wr"], g["ur"], g["br"], dt = _back(turned, self.p["wr"], self.p["ur"], kept_r, _turned(dboth[..., HIDDEN:], sizes))
        dx = dx + _turned(dt, sizes)
        for name in ("marks", "leaf", "words"):
            g[name] = np.zeros_like(self.p[name])
        for r, s in enumerate(sheets):
            d = dx[: sizes[r], r]
            block, mark, weight = s.path_pairs()
            np.add.at(g["marks"], mark, d[block, :PATH] * weight[:, None])
            np.add.at(g["leaf"], s.leaf, d[:, PATH : 2 * PATH])
            per = d[:, 2 * PATH : 2 * PATH + WORD] / np.maximum(s.counts, 1)[:, None]
            np.add.at(g["words"], s.words, np.repeat(per, s.counts, axis=0))
        return loss, g


def draw_page(rng: random.Random) -> tuple[str, list[bool]]:
    """A page of the grammar, and whether each of its blocks is of the article."""
    pick, lexicon = rng.choice, _lexicon(rng.random() < 0.05)
    upto = lambda lo, hi: rng.randrange(lo, hi)
    word = lambda: pick(lexicon)
    prose = lambda n: " ".join(rng.choices(lexicon, k=max(1, n))).capitalize() + pick([".", ".", ".", "", "!"])
    labels: list[bool] = []

    def say(tag: str, text: str, main: bool, link: bool = False) -> str:
        labels.append(main)
        shown = f'<a href="/{len(labels)}">{text}</a>' if link else text
        if rng.random() < 0.1:
            shown = f"<b>{shown}" + pick(["</b>", "<br>"])
        return f"<{tag}>{shown}" + (f"</{tag}>" if rng.random() < 0.9 or tag not in ("p", "li") else "")

    def frame(tag: str, names: list[str], body: str) -> str:
        if rng.random() < 0.6 or tag in ("div", "section", "ul"):
            return f"<{tag} {pick(['class', 'class', 'id'])}=\"{'-'.join(rng.choices(names, k=upto(1, 3)))}\">{body}</{tag}>"
        return f"<{tag}>{body}</{tag}>"

    def other(kind: str) -> str:
        body = ""
        if rng.random() < (0.85 if kind in ("nav", "ul", "footer") else 0.2):
            items = "".join(say("li", pick([word(), word(), pick(_PHRASES), prose(3)]), False, True) for _ in range(upto(1, 10)))
            body = items if kind == "ul" else f"<ul>{items}</ul>"
        if kind not in ("nav", "ul") or not body:
            for _ in range(upto(1, 9 if kind == "section" else 5)):
                text = prose(upto(1, 40)) if rng.random() < 0.7 else " ".join(rng.choices(_PHRASES, k=upto(1, 6)))
                inner = say(pick(["p", "p", "div", "h3", "h4"]), text, False)
                body += f'<article class="comment">{inner}</article>' if kind == "section" and rng.random() < 0.3 else inner
        return frame(kind if rng.random() < 0.7 and kind != "dialog" else "div", _OTHER[kind].split(), body)

    def article() -> str:
        body = say("h1", prose(upto(1, 10)), True) if rng.random() < 0.85 else ""
        if rng.random() < 0.15 and body:
            body = f"<header>{body}</header>"
        for _ in range(upto(1, 6) if rng.random() < 0.4 else upto(4, 40)):
            roll, size = rng.random(), upto(1, 12) if rng.random() < 0.3 else upto(10, 100)
            if roll < 0.8:
                body += say("p", prose(size), True)
            elif roll < 0.86:
                body += say(pick(["h2", "h3"]), prose(4), True)
            elif roll < 0.91:
                body += "<ul>" + "".join(say("li", prose(8), True) for _ in range(upto(1, 5))) + "</ul>"
            elif roll < 0.94:
                body += "<blockquote>" + say("p", prose(20), True) + "</blockquote>"
            elif roll < 0.96:
                body += "<table><tr>" + "".join(say("td", word(), True) for _ in range(3)) + "</tr></table>"
            elif roll < 0.98:
                body += say("p", prose(12), True, True)
            else:
                body += frame("div", _OTHER["div"].split(), say("p", prose(10), False))
        return frame(pick(["article", "article", "article", "main", "div", "section"]), _MAIN, body)

    before = [k for k in ("dialog", "header", "nav", "div", "form", "aside") if rng.random() < 0.45]
    after = [k for k in ("ul", "section", "aside", "div", "form", "footer", "dialog") if rng.random() < 0.45]
    page = "".join(map(other, before)) + article() + "".join(map(other, after))
    for _ in range(upto(0, 3)):
        page = f'<div class="{pick(_WRAPS)}">{page}</div>'
    return f"<html><head><title>{prose(4)}</title></head><body>{page}</body></html>", labels


@lru_cache(maxsize=2)
def _lexicon(cyrillic: bool) -> list[str]:
    """Words that mean nothing, so that the labeller learns from layout and from the phrases above."""
    rng = random.Random(11)
    parts = ("ка но ре та ли" if cyrillic else "th er in an on re st en ti or ou ha le que ai ch un der").split()
    return ["".join(rng.choices(parts, k=rng.randrange(1, 5))) + rng.choice(["", "", "", "", "", ",", "***", "&amp;&amp;"]) for _ in range(4000)]


def examples(n: int, seed: int) -> list[tuple[Page, np.ndarray]]:
    rng, out = random.Random(seed), []
    for _ in range(n):
        source, truth = draw_page(rng)
        page = parse(source)
        if len(page.node) == len(truth):
            out.append((page, np.array(truth)))
    return out


@lru_cache(maxsize=4)
def trained(pages: int = 900, rounds: int = 5, batch: int = 16, rate: float = 0.006, seed: int = 5) -> Labeller:
    """A labeller fitted by Adam on `pages` drawn pages; the same weights for the same parameters."""
    model, rng = Labeller(seed), np.random.default_rng(seed)
    data = [(Sheet(p), t) for p, t in examples(pages, seed)]
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}
    n = 0
    steps = rounds * -(-len(data) // batch)
    for _ in range(rounds):
        order = rng.permutation(len(data))
        for lo in range(0, len(data), batch):
            some = [data[i] for i in order[lo : lo + batch]]
            _, grad = model.step([s for s, _ in some], [t for _, t in some])
            norm = float(np.sqrt(sum(float((g * g).sum()) for g in grad.values())))
            n += 1
            for k, g in grad.items():
                g = g * min(1.0, 1.0 / max(norm, 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                model.p[k] = model.p[k] - np.float32(rate * (1 - n / (steps + 1))) * (first[k] / (1 - 0.9**n)) / (np.sqrt(second[k] / (1 - 0.99**n)) + 1e-8)
                model.p[k] = model.p[k].astype(np.float32)
    return model
