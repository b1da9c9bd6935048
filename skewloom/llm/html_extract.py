"""Main text of web pages by a bidirectional LSTM over the page's blocks.

A page is a sequence of leaf blocks. Each block is a vector of its hashed tag path (element names, class
and id words), its hashed words and a few scalars; one LSTM reads the sequence forwards and one backwards,
and a logistic unit on both states says whether the block is main text. So the label of a block depends
on all blocks of its page. The model is trained here, in NumPy, on ``PRACTICE_PAGES`` practice pages that
are made together with their labels. Training is seeded; ``python -m skewloom.llm.html_extract`` repeats it and writes
the weights to ``labeller.npz`` beside this module, from where they are read.

Text is decoded, white space inside a block becomes one space, blocks are joined in page order by a line
feed. A null or empty page gives an empty text. Repeated rows each get their answer; an empty table gives
an empty result. Pages are read whole, however long.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import page_maker
from .html_blocks import DIM, blocks, features

#: Bound on the labelled pages that the model is fitted on.
PRACTICE_PAGES = 3000
HIDDEN = 16
EPOCHS = 10
BATCH = 32
#: Padded blocks that are labelled at a time.
BATCH_BLOCKS = 16_384


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _run(pre: np.ndarray, mask: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, list]:
    """States over time of one direction; ``pre`` is time x batch x 4H, ``mask`` time x batch x 1."""
    steps, n, width = pre.shape
    h = c = np.zeros((n, width // 4), np.float32)
    hs, kept = np.zeros((steps, n, width // 4), np.float32), []
    for t in range(steps):
        z = pre[t] + h @ u
        i, f, o, g = *np.split(_sigmoid(z[:, : 3 * width // 4]), 3, 1), np.tanh(z[:, 3 * width // 4 :])
        c2 = f * c + i * g
        tc = np.tanh(c2)
        h2 = o * tc
        m = mask[t]
        kept.append((h, c, i, f, o, g, tc))
        h, c = m * h2 + (1 - m) * h, m * c2 + (1 - m) * c
        hs[t] = h
    return hs, kept


def _back(dhs: np.ndarray, kept: list, mask: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of ``pre`` and of ``u``."""
    steps, n, width = dhs.shape
    dpre, du = np.zeros((steps, n, 4 * width), np.float32), np.zeros_like(u)
    dh = dc = np.zeros((n, width), np.float32)
    for t in reversed(range(steps)):
        h, c, i, f, o, g, tc = kept[t]
        m = mask[t]
        dh = dh + dhs[t]
        d2, skip_h, skip_c = dh * m, dh * (1 - m), dc * (1 - m)
        dcell = dc * m + d2 * o * (1 - tc**2)
        dz = np.concatenate([dcell * g * i * (1 - i), dcell * c * f * (1 - f), d2 * tc * o * (1 - o), dcell * i * (1 - g**2)], 1)
        dpre[t] = dz
        du += h.T @ dz
        dh, dc = dz @ u.T + skip_h, dcell * f + skip_c
    return dpre, du


def _padded(xs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, xs))
    x, mask = np.zeros((steps, len(xs), DIM), np.float32), np.zeros((steps, len(xs), 1), np.float32)
    for k, a in enumerate(xs):
        x[: len(a), k], mask[: len(a), k] = a, 1
    return x, mask


class Labeller:
    """Weights of both directions and of the output."""

    def __init__(self, hidden: int = HIDDEN, seed: int = 7):
        r = np.random.default_rng(seed)
        mat = lambda a, b: (r.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        bias = np.zeros(4 * hidden, np.float32)
        bias[hidden : 2 * hidden] = 1  # remember at first
        self.p = {"wf": mat(DIM, 4 * hidden), "uf": mat(hidden, 4 * hidden), "bf": bias.copy(), "wb": mat(DIM, 4 * hidden), "ub": mat(hidden, 4 * hidden), "bb": bias.copy(), "v": mat(2 * hidden + DIM, 1), "a": np.zeros(1, np.float32)}

    def logits(self, x: np.ndarray, mask: np.ndarray):
        p = self.p
        f, kept_f = _run(x @ p["wf"] + p["bf"], mask, p["uf"])
        b, kept_b = _run((x @ p["wb"] + p["bb"])[::-1], mask[::-1], p["ub"])
        both = np.concatenate([f, b[::-1], x], 2)
        return (both @ p["v"])[..., 0] + p["a"], (both, kept_f, kept_b)

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        z, (both, kept_f, kept_b) = self.logits(x, mask)
        hidden = self.p["uf"].shape[0]
        dz = ((_sigmoid(z) - y) * mask[..., 0] / mask.sum())[..., None]
        g = {"v": np.einsum("tnd,tno->do", both, dz), "a": dz.sum((0, 1))}
        dboth = dz @ self.p["v"].T
        for way, dh, kept, flip in (("f", dboth[..., :hidden], kept_f, 1), ("b", dboth[..., hidden : 2 * hidden], kept_b, -1)):
            dpre, g["u" + way] = _back(dh[::flip], kept, mask[::flip], self.p["u" + way])
            dpre = dpre[::flip]
            g["w" + way], g["b" + way] = np.einsum("tnd,tnh->dh", x, dpre), dpre.sum((0, 1))
        return g

    def fit(self, xs: list[np.ndarray], ys: list[np.ndarray], epochs: int = EPOCHS, rate: float = 0.01, seed: int = 3) -> Labeller:
        r = np.random.default_rng(seed)
        m, v, step = {k: np.zeros_like(a) for k, a in self.p.items()}, {k: np.zeros_like(a) for k, a in self.p.items()}, 0
        size = np.array([len(x) for x in xs])
        for epoch in range(epochs):
            order = np.argsort(size + r.uniform(0, 8, len(xs)))
            starts = np.arange(0, len(xs), BATCH)
            r.shuffle(starts)
            lr = rate * (1 - epoch / epochs) ** 0.5
            for s in starts:
                pick = order[s : s + BATCH]
                x, mask = _padded([xs[k] for k in pick])
                y = np.zeros(mask.shape[:2], np.float32)
                for c, k in enumerate(pick):
                    y[: len(ys[k]), c] = ys[k]
                step += 1
                for k, g in self.gradients(x, mask, y).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = (self.p[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def label(self, xs: list[np.ndarray]) -> list[np.ndarray]:
        """Which blocks of each page are main text."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(xs)
        order = sorted((k for k in range(len(xs)) if len(xs[k])), key=lambda k: len(xs[k]))
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and (end - at + 1) * len(xs[order[end]]) <= BATCH_BLOCKS:
                end += 1
            x, mask = _padded([xs[k] for k in order[at:end]])
            z, _ = self.logits(x, mask)
            for c, k in enumerate(order[at:end]):
                out[k] = z[: len(xs[k]), c] > 0
            at = end
        return out


def practice(n: int, seed: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    xs, ys = [], []
    for page, labels in page_maker.pages(n, seed):
        found = blocks(page)
        if len(found) == len(labels) and found:
            xs.append(features(found))
            ys.append(np.array(labels, np.float32))
    return xs, ys


WEIGHTS = Path(__file__).with_name("labeller.npz")


@lru_cache(2)
def trained(pages: int = PRACTICE_PAGES) -> Labeller:
    """The stored model, or one that is fitted on another number of practice pages."""
    if pages != PRACTICE_PAGES:
        return Labeller().fit(*practice(pages, 11))
    made = Labeller()
    with np.load(WEIGHTS) as stored:
        made.p = {k: stored[k] for k in made.p}
    return made


def texts_of(model: Labeller, pages: list[str | None]) -> list[str]:
    """Main text of each page."""
    found = [blocks(p) if p else [] for p in pages]
    picked = model.label([features(f) for f in found])
    return ["\n".join(b.text for b, keep in zip(f, k, strict=True) if keep) for f, k in zip(found, picked, strict=True)]


def _extract(model: Labeller):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 512):
                some = b.slice(k, 512)
                made = texts_of(model, some.column("html").to_pylist())
                yield pa.RecordBatch.from_arrays([some["page_id"], some["url"], pa.array(made, pa.string()), pa.array([len(t) for t in made], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", practice_pages: int = PRACTICE_PAGES) -> DataFrame:
    """One row per page: ``page_id url text n_chars``."""
    picked = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return picked.mapInArrow(_extract(trained(practice_pages)), "page_id long, url string, text string, n_chars long")


if __name__ == "__main__":
    np.savez_compressed(WEIGHTS, **Labeller().fit(*practice(PRACTICE_PAGES, 11)).p)
