"""Main text of HTML pages by a recurrent block labeller.

A page is a sequence of leaf blocks. Each block's vector holds its tag path (hashed names and what
they stand for), its hashed words and a few numbers; a bidirectional LSTM in numpy reads the whole
sequence in both directions, and a logistic layer over both states and the vector says for each
block if it belongs to the article. The text is the chosen blocks in page order.

Training: ``TRAIN_PAGES`` pages, chosen by hash, lend their blocks' texts. They are laid out anew in many
page skeletons (wrappers, menus, side columns, notices, adverts, forms, comments, in varying markup),
so that every block's label is known by construction; page copies with the pages' own markup, where
an ``article`` or ``main`` element says what is what, are added. Long pages are trained on in pieces of
``TRAIN_BLOCKS`` blocks. The bounds are parameters; labelling reads whole pages.

White space is what Unicode calls so, no-break spaces included. Inline elements, images and scripts inside a line
don't end a block; a button's or list's text is a block of its own and the line around it goes on.

Cases: null and empty pages have an empty text; very long pages are read whole; unclosed, cut and misnested
markup is read as far as it goes; character references are decoded once; a score of exactly one half is
the article's; repeated rows give equal results and are learned from once; without any page the labeller
is trained on placeholder words; an empty table gives an empty result; other columns, whatever their
names, play no part.
"""

from __future__ import annotations

import html
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiscope.llm.html_blocks import WIDTH, Features, Leaf, leaves

#: Bound of the training pages, laid-out pages, epochs, hidden size, blocks of a training sequence.
TRAIN_PAGES, LAYOUTS, EPOCHS, HIDDEN, TRAIN_BLOCKS = 120, 600, 6, 16, 60
#: Blocks that are labelled together, about.
BATCH_BLOCKS = 8192


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BiLstm:
    """Two LSTMs and a logistic layer; forward pass, gradients and Adam."""

    def __init__(self, params: dict[str, np.ndarray] | None = None, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        if params is None:
            params = {"o": rng.normal(0, 0.1, 2 * HIDDEN + WIDTH), "ob": np.zeros(1)}
            for d in "fb":
                params["w" + d] = rng.normal(0, 1 / np.sqrt(WIDTH + HIDDEN), (WIDTH + HIDDEN, 4 * HIDDEN))
                params["b" + d] = np.concatenate([np.ones(HIDDEN), np.zeros(3 * HIDDEN)])
        self.p = params

    def states(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """(time, batch, HIDDEN) states of direction ``d`` and, if asked to, what the backward pass needs."""
        steps, n, _ = x.shape
        h, c = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
        out, tape = np.zeros((steps, n, HIDDEN)), []
        inputs = x @ self.p["w" + d][:WIDTH] + self.p["b" + d]
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = inputs[t] + h @ self.p["w" + d][WIDTH:]
            gates = sigmoid(z[:, : 3 * HIDDEN])
            f, i, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new_c = f * c + i * g
            new_h = o * np.tanh(new_c)
            if keep:
                tape.append((t, h, c, f, i, o, g, new_c))
            h, c = m * new_h + (1 - m) * h, m * new_c + (1 - m) * c
            out[t] = h
        return out, tape

    def scores(self, x: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        hf, tf = self.states(x, mask, "f", keep)
        hb, tb = self.states(x, mask, "b", keep)
        every = np.concatenate([hf, hb, x], axis=2)
        return sigmoid(every @ self.p["o"] + self.p["ob"]), (every, tf, tb)

    def gradients(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> dict[str, np.ndarray]:
        s, (every, tf, tb) = self.scores(x, mask, True)
        e = (s - y) * mask / mask.sum()
        grad = {"o": np.tensordot(e, every, axes=([0, 1], [0, 1])), "ob": np.array([e.sum()])}
        for d, tape, part in (("f", tf, slice(0, HIDDEN)), ("b", tb, slice(HIDDEN, 2 * HIDDEN))):
            from_out = e[:, :, None] * self.p["o"][part]
            w = self.p["w" + d]
            gw, gb = np.zeros_like(w), np.zeros_like(self.p["b" + d])
            dh, dc = np.zeros(x.shape[1:2] + (HIDDEN,)), np.zeros(x.shape[1:2] + (HIDDEN,))
            for t, h, c, f, i, o, g, new_c in reversed(tape):
                m = mask[t][:, None]
                dh = dh + from_out[t]
                dnh, dnc = m * dh, m * dc
                th = np.tanh(new_c)
                dnc = dnc + dnh * o * (1 - th**2)
                z = np.concatenate([dnc * c * f * (1 - f), dnc * g * i * (1 - i), dnh * th * o * (1 - o), dnc * i * (1 - g**2)], axis=1)
                gw[:WIDTH] += x[t].T @ z
                gw[WIDTH:] += h.T @ z
                gb += z.sum(axis=0)
                dh, dc = (1 - m) * dh + z @ w[WIDTH:].T, (1 - m) * dc + dnc * f
            grad["w" + d], grad["b" + d] = gw, gb
        return grad

    def train(self, sequences: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, batch: int = 24, rate: float = 0.01, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        step = 0
        for _ in range(epochs):
            order = sorted(range(len(sequences)), key=lambda i: (len(sequences[i][0]) // 8, rng.random()))
            groups = [order[i : i + batch] for i in range(0, len(order), batch)]
            for at in rng.permutation(len(groups)):
                x, mask = padded([sequences[i][0] for i in groups[at]])
                y = np.zeros(mask.shape)
                for k, i in enumerate(groups[at]):
                    y[: len(sequences[i][1]), k] = sequences[i][1]
                step += 1
                for k, g in self.gradients(x, y, mask).items():
                    g = np.clip(g, -1, 1)
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Scores of every block, page by page; pages of like length are read together."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            n = max(1, min(len(order) - at, BATCH_BLOCKS // len(pages[order[at]])))
            while n > 1 and n * len(pages[order[at + n - 1]]) > 2 * BATCH_BLOCKS:
                n //= 2
            own = order[at : at + n]
            s, _ = self.scores(*padded([pages[i] for i in own]))
            for k, i in enumerate(own):
                out[i] = s[: len(pages[i]), k]
            at += n
        return out


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(time, batch, WIDTH) and its mask."""
    steps = max(map(len, rows))
    x, mask = np.zeros((steps, len(rows), WIDTH)), np.zeros((steps, len(rows)))
    for k, r in enumerate(rows):
        x[: len(r), k], mask[: len(r), k] = r, 1
    return x, mask


#: Wrappers of the parts of a training page (fixed values): opening tags, closing tags follow from them.
ARTICLE = ("<article>", "<main>", "<main><article>", '<div class="content">', '<div id="main"><div class="post">', '<div class="entry-content">', '<section class="story">', '<div class="article-body">', "<div>")
OTHERS = {
    "menu": ("<nav><ul>", '<div class="menu"><ul>', '<ul class="nav">', '<div class="breadcrumbs">', '<div role="navigation"><ul>'),
    "header": ("<header>", '<div class="header">', '<div id="masthead">'),
    "footer": ("<footer>", '<div class="footer">', '<div id="footer">'),
    "side": ("<aside>", '<div class="sidebar">', '<div id="side">', '<section class="related">', '<div class="widget">'),
    "notice": ('<div class="notice">', '<div class="cookie-banner">', '<div class="alert">', '<div role="dialog">'),
    "advert": ('<div class="ad">', '<div class="ads">', '<div class="sponsored">', '<ins class="adsbygoogle">', '<div id="promo">'),
    "form": ("<form>", '<form class="search">', '<div class="newsletter"><form>', '<div class="subscribe">'),
    "comment": ('<div class="comments">', '<section id="comments">', '<ol class="comment-list">', '<div id="disqus">', '<div class="reply">'),
}
BEFORE, AFTER, INSIDE = ("menu", "header", "advert", "notice", "side", "form"), ("comment", "side", "advert", "form", "footer", "menu"), ("advert", "side", "form", "notice", "header", "menu", "comment")


def ending(opening: str) -> str:
    return "".join(f"</{t.split()[0].rstrip('>')}>" for t in reversed(opening.split("<")[1:]))


def laid_out(rng: np.random.Generator, texts: list[str]) -> tuple[str, set[str]]:
    """A page with known labels: its markup, and marks of the blocks that are the article."""
    main: set[str] = set()
    serial = iter(range(10_000))

    def block(keep: bool, short: bool) -> str:
        words = texts[rng.integers(len(texts))].split()
        n = int(rng.integers(1, 7)) if short else int(rng.integers(3, 90))
        start = int(rng.integers(max(1, len(words) - n)))
        mark = f"zq{next(serial)}zq"
        if keep:
            main.add(mark)
        return mark + " " + html.escape(" ".join(words[start : start + n]))

    def part(kind: str) -> str:
        opening = OTHERS[kind][rng.integers(len(OTHERS[kind]))]
        n = int(rng.integers(1, 8 if kind in ("menu", "side", "comment") else 3))
        listed = "<ul>" in opening or "<ol" in opening
        body = ""
        for _ in range(n):
            inner = block(False, kind in ("menu", "form", "header") or rng.random() < 0.4)
            if kind == "menu" or (kind in ("side", "footer") and rng.random() < 0.5):
                inner = f'<a href="/x">{inner}</a>'
            body += f"<li>{inner}</li>" if listed else f"<label>{inner}</label><input name=q><button>{block(False, True)}</button>" if kind == "form" else f"<p>{inner}</p>" if rng.random() < 0.6 or n > 1 else inner
        return opening + body + ending(opening)

    page = "".join(part(k) for k in BEFORE if rng.random() < 0.5)
    opening = ARTICLE[rng.integers(len(ARTICLE))]
    page += opening + (f"<h1>{block(True, True)}</h1>" if rng.random() < 0.8 else "")
    for _ in range(int(rng.integers(1, 14))):
        kind = rng.random()
        if kind < 0.72:
            page += f"<p>{'<b>' if rng.random() < 0.2 else ''}{block(True, rng.random() < 0.2)}{'<br>' if rng.random() < 0.2 else '</p>'}"
        elif kind < 0.8:
            page += f"<h2>{block(True, True)}</h2>"
        elif kind < 0.87:
            page += "<ul>" + "".join(f"<li>{block(True, rng.random() < 0.5)}</li>" for _ in range(3)) + "</ul>"
        elif kind < 0.92:
            page += f"<blockquote>{block(True, False)}</blockquote>"
        else:
            page += part(INSIDE[rng.integers(len(INSIDE))])
    page += ending(opening) if rng.random() < 0.9 else ""
    page += "".join(part(k) for k in AFTER if rng.random() < 0.6) if rng.random() < 0.9 else ""
    return page[: int(len(page) * rng.uniform(0.6, 1))] if rng.random() < 0.08 else page, main


def own_labels(page: list[Leaf]) -> np.ndarray | None:
    """Labels that a page's own markup gives: inside ``article`` or ``main`` and in no other named part."""
    rest = {"nav", "aside", "footer", "form", "header", "ad", "ads", "comments", "comment", "sidebar", "notice"}
    y = np.array([float(any(n[0] in ("article", "main") for n in leaf.path) and not any(rest & set(n) for n in leaf.path)) for leaf in page])
    return y if y.any() else None


def fit(pages: DataFrame, column: str = "html", key: str = "page_id", most: int = TRAIN_PAGES, seed: int = 17, layouts: int = LAYOUTS, epochs: int = EPOCHS) -> dict[str, np.ndarray]:
    """Parameters of the labeller, from at most ``most`` different pages."""
    keyed = pages.where(F.col(column).isNotNull()).select(F.xxhash64(F.lit(seed), F.col(key), F.col(column)).alias("h"), F.col(column).alias("html"))
    last = [r["h"] for r in keyed.select("h").distinct().orderBy("h").limit(most).collect()]
    chosen = keyed.where(F.col("h") <= max(last, default=0)).groupBy("h").agg(F.first("html").alias("html")).orderBy("h").limit(most)
    known = [leaves(r["html"]) for r in chosen.collect()] if last else []
    texts = [leaf.text for page in known for leaf in page] or ["some words of a page", "other words stand here"]
    rng, features = np.random.default_rng(seed), Features()
    sequences = []

    def learn(page: list[Leaf], y: np.ndarray) -> None:
        x = features.rows(page)
        sequences.extend((x[at : at + TRAIN_BLOCKS], y[at : at + TRAIN_BLOCKS]) for at in range(0, len(page), TRAIN_BLOCKS))

    for page in known:
        if page and (y := own_labels(page)) is not None:
            learn(page, y)
    for _ in range(layouts):
        markup, main = laid_out(rng, texts)
        page = leaves(markup)
        y = np.array([float(leaf.text.split()[0] in main) for leaf in page])
        for leaf in page:
            leaf.parts = [leaf.text.partition(" ")[2] or leaf.text]
        learn(page, y)
    net = BiLstm()
    net.train(sequences, epochs)
    return net.p


def main_text(column: Column, params: dict[str, np.ndarray]) -> Column:
    """Main text of every page."""

    @F.pandas_udf("string")
    def own(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        net, features = BiLstm(params), Features()
        for pages in batches:
            out: list[str] = []
            for at in range(0, len(pages), 500):
                blocks = [leaves(p if isinstance(p, str) else None) for p in pages.iloc[at : at + 500]]
                for page, s in zip(blocks, net.label([features.rows(b) for b in blocks]), strict=True):
                    out.append("\n".join(leaf.text for leaf, x in zip(page, s, strict=True) if x >= 0.5))
            yield pd.Series(out, dtype="object")

    return own(column)
