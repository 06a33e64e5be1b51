"""Quality classifier: a byte-level convolutional network in numpy (operator 10).

Filters of ``span`` bytes slide over overlapping chunks that cover the whole document. As a filter
reads one-hot bytes, it is one table a place: the response at a position is a sum of looked-up rows
(the tables of two neighbouring places are joined for inference, which halves the lookups). Responses
are max-pooled over a chunk; filters of fixed weights, on a second channel that marks bytes repeating
the text up to ``LAGS`` bytes before, are pooled likewise and see loops. Rectified chunk vectors are
averaged over the document and give one probability. Training is backpropagation through the maxima,
on a bounded sample of labelled rows (``per_class`` of each label).

Edge cases: null or empty texts have no chunk and the probability of the bias; a text shorter than a
filter is padded with zero bytes; with one label only (or none) the model gives that label's share;
texts of any length are cut into chunks, all of which count; repeated rows score alike; there are no
ties (the threshold itself counts as label 1); an empty table gives an empty one; other columns pass
through, and those named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from tracelet.llm.common import labelled_sample, map_text

#: Bytes of a chunk, and by how many the next one starts later.
CHUNK, STRIDE = 256, 192
#: Chunks looked at together.
WIDTH = 256
SPAN, FILTERS, LAGS = 4, 16, 24
#: Lengths of the fixed filters on the repeat channel.
RUNS = (8, 16, 32)
PER_CLASS, MAX_CHARS = 800, 12_000
THRESHOLD = 0.7


def chunks(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes[chunk, CHUNK], text of each chunk); the last chunk of a text is padded with zeros."""
    size = np.array([len(t) for t in texts], np.int64)
    n = np.where(size > 0, 1 + np.maximum(0, -(-(size - CHUNK) // STRIDE)), 0)
    flat = np.frombuffer(b"".join(texts) + bytes(CHUNK), np.uint8)
    begin = np.cumsum(size) - size
    of = np.repeat(np.arange(len(texts)), n)
    start = (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)) * STRIDE
    place = np.arange(CHUNK)
    x = flat[np.minimum((begin[of] + start)[:, None] + place, len(flat) - 1)]
    x[place >= (size[of] - start)[:, None]] = 0
    return x, of


def repeats(x: np.ndarray) -> np.ndarray:
    """Responses of the fixed filters: whether a chunk has a run of n bytes, each equal to the one a fixed lag before."""
    found = np.zeros((len(x), len(RUNS)), np.float32)
    live = x != 0
    for lag in range(2, LAGS + 1):
        same = (x[:, lag:] == x[:, :-lag]) & live[:, lag:]
        width = 1
        for k, run in enumerate(RUNS):
            while width < run:
                same = same[:, :-width] & same[:, width:]
                width *= 2
            hit = same.any(1)
            if not hit.any():
                break
            found[:, k] = np.maximum(found[:, k], hit)
    return found


class ByteConvolution:
    def __init__(self, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.tables = rng.normal(0, 0.3, (SPAN, 256, FILTERS)).astype(np.float32)
        self.shift = np.zeros(FILTERS, np.float32)
        self.weight = rng.normal(0, 0.3, FILTERS + len(RUNS)).astype(np.float32)
        self.bias = np.float32(0)
        self.pairs: list[np.ndarray] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"pairs": None}  # made again where it is used

    def pooled(self, x: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Largest response of every filter in every chunk (and the place of it)."""
        if self.pairs is None:
            self.pairs = [(self.tables[j][:, None] + self.tables[j + 1][None]).reshape(-1, FILTERS) for j in range(0, SPAN, 2)]
        n = CHUNK - SPAN + 1
        top, at = np.empty((len(x), FILTERS), np.float32), np.empty((len(x), FILTERS), np.int64) if where else None
        step = 32
        total, more = np.empty((step * n, FILTERS), np.float32), np.empty((step * n, FILTERS), np.float32)
        for i in range(0, len(x), step):
            part = x[i : i + step].astype(np.int32)
            both = (part[:, :-1] << 8) + part[:, 1:]
            m = len(part) * n
            np.take(self.pairs[0], both[:, :n].reshape(-1), axis=0, out=total[:m], mode="clip")
            for j in range(1, SPAN // 2):
                np.take(self.pairs[j], both[:, 2 * j : 2 * j + n].reshape(-1), axis=0, out=more[:m], mode="clip")
                np.add(total[:m], more[:m], out=total[:m])
            seen = total[:m].reshape(len(part), n, FILTERS)
            seen.max(1, out=top[i : i + step])
            if where:
                at[i : i + step] = seen.argmax(1)
        return top + self.shift, at

    def features(self, texts: Sequence[bytes]) -> np.ndarray:
        x, of = chunks(texts)
        total = np.zeros((len(texts), FILTERS + len(RUNS)))
        for i in range(0, len(x), WIDTH):
            part = x[i : i + WIDTH]
            np.add.at(total, of[i : i + WIDTH], np.hstack([np.maximum(self.pooled(part)[0], 0), repeats(part)]))
        return total / np.maximum(1, np.bincount(of, minlength=len(texts)))[:, None]

    def probability(self, texts: Sequence[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ self.weight + self.bias, -30, 30)))

    def train(self, texts: Sequence[bytes], labels: np.ndarray, epochs: int = 6, least: int = 300, batch: int = 32, rate: float = 0.02, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        epochs = max(epochs, -(-least * batch // len(texts)))  # few rows are read more often
        params = {"tables": self.tables, "shift": self.shift, "weight": self.weight}
        seen = {k: np.full_like(v, 1e-3) for k, v in params.items()} | {"bias": 1e-3}
        cut = [chunks([t])[0] for t in texts]
        loops = [repeats(x) for x in cut]
        steps, step = epochs * -(-len(texts) // batch), 0
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for i in range(0, len(order), batch):
                mine = order[i : i + batch]
                x = np.concatenate([cut[k] for k in mine])
                of = np.repeat(np.arange(len(mine)), [len(cut[k]) for k in mine])
                n = np.maximum(1, np.bincount(of, minlength=len(mine)))
                self.pairs = None
                top, at = self.pooled(x, True)
                chunk = np.hstack([np.maximum(top, 0), np.concatenate([loops[k] for k in mine])])
                f = np.zeros((len(mine), chunk.shape[1]), np.float32)
                np.add.at(f, of, chunk)
                f /= n[:, None]
                p = 1 / (1 + np.exp(-np.clip(f @ self.weight + self.bias, -30, 30)))
                d = ((p - labels[mine]) / len(mine)).astype(np.float32)
                g = {"weight": f.T @ d + 1e-4 * self.weight}
                back = (d / n)[of][:, None] * self.weight[None, :FILTERS] * (top > 0)
                g["shift"] = back.sum(0)
                g["tables"] = np.zeros_like(self.tables)
                rows, cols = np.nonzero(back)
                for j in range(SPAN):
                    np.add.at(g["tables"][j], (x[rows, at[rows, cols] + j], cols), back[rows, cols])
                lr = rate * (1 - step / steps)
                step += 1
                for k, v in params.items():
                    seen[k] += 0.05 * (g[k] ** 2 - seen[k])
                    v -= lr * g[k] / (np.sqrt(seen[k]) + 1e-4)
                b = float(d.sum())
                seen["bias"] += 0.05 * (b * b - seen["bias"])
                self.bias -= np.float32(lr * b / (np.sqrt(seen["bias"]) + 1e-4))
        self.pairs = None


def learn(docs: DataFrame, labels: DataFrame, usable: Column, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> ByteConvolution:
    rows = labelled_sample(docs, labels, id_col, text_col, label_col, usable & labels[label_col].isin(0, 1), per_class, max_chars)
    model = ByteConvolution()
    y = np.array([int(label) for _, label in rows], np.float32)
    if 0 < y.sum() < len(y):
        model.train([t.encode() for t, _ in rows], y)
    else:
        model.weight[:] = 0
        model.bias = np.float32(0 if not len(y) else 4 if y[0] else -4)
    return model


OUT = [("score", T.DoubleType(), pa.float64()), ("predicted", T.IntegerType(), pa.int32())]


def score(docs: DataFrame, model: ByteConvolution, text_col: str = "text", threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """Append score (probability of label 1) and predicted (1 from ``threshold`` on)."""

    def run(texts):
        p = model.probability([t or b"" for t in texts])
        return pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32), pa.int32())

    return map_text(docs, text_col, OUT, run, keep)
