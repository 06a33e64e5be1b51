"""Language identification by a bidirectional gated recurrent network over bytes (operator 3).

One light gated unit (an update gate, no reset gate; both squashed piecewise linearly, so numpy needs
no transcendental function in the loop) reads each chunk of bytes forwards and one backwards. Their
states together label every byte with a distribution over the languages. A document's probability of
a language is the mean over all its letter bytes (ASCII letters and all non-ASCII bytes), whatever
chunk they lie in. Training is backpropagation through time in numpy on chunks of a bounded sample
of rows with a known language (``per_class`` rows of each, ranked by a hash of the identifier; beyond
64 languages they share SAMPLE_ROWS evenly). Over MAX_LANGUAGES languages are an error.

Edge cases: null, empty or letterless texts get ``und`` with score 0; texts of any length are cut
into chunks, all of which count; with no labelled row every text is ``und``; with one language all
lettered texts get it; ties between languages go to the first in sorted order; repeated rows are
judged alike, and count once in the sample; an empty table gives an empty one; other columns pass
through, and those named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from tracelet.llm.common import labelled_sample, map_text

UNKNOWN = "und"
#: Bytes of a chunk; chunks read in step.
LENGTH, WIDTH = 128, 2048
#: Labelled rows of each language to learn from, and the longest of them in characters.
PER_CLASS, MAX_CHARS = 400, 50_000
#: Languages at most, and labelled rows of all together.
MAX_LANGUAGES, SAMPLE_ROWS = 2500, 64 * PER_CLASS

LETTER = np.array([0x41 <= c <= 0x5A or 0x61 <= c <= 0x7A or c >= 0x80 for c in range(256)])


class ByteTagger:
    """Weights of both directions, and of the layer that labels a position."""

    def __init__(self, labels: Sequence[str], hidden: int = 8, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.labels, self.hidden = list(labels), hidden
        draw = lambda *shape, s: rng.normal(0, s, shape).astype(np.float32)
        self.w: dict[str, np.ndarray] = {"bo": np.zeros(len(self.labels), np.float32)}
        for d in "fb":
            self.w |= {f"xz{d}": draw(256, hidden, s=0.3), f"xn{d}": draw(256, hidden, s=0.5), f"uz{d}": draw(hidden, hidden, s=0.2), f"un{d}": draw(hidden, hidden, s=0.4), f"o{d}": draw(hidden, len(self.labels), s=0.4)}

    def states(self, x: np.ndarray, d: str, out: np.ndarray, tape: list | None = None, inside: np.ndarray | None = None) -> np.ndarray:
        """States of one direction for bytes x[time, chunk]; out[time, chunk, hidden] is in reading order. The state stays zero where ``inside`` is false."""
        w, n = self.w, x.shape[1]
        h = np.zeros((n, self.hidden), np.float32)
        z, c, t = (np.empty_like(h) for _ in range(3))
        for i in range(len(x)):
            row = x[i]
            np.take(w["xz" + d], row, axis=0, out=z, mode="clip")
            np.matmul(h, w["uz" + d], out=t)
            np.add(z, t, out=z)
            np.add(z, 0.5, out=z)
            np.clip(z, 0, 1, out=z)
            np.take(w["xn" + d], row, axis=0, out=c, mode="clip")
            np.matmul(h, w["un" + d], out=t)
            np.add(c, t, out=c)
            np.clip(c, -1, 1, out=c)
            if tape is not None:
                tape.append((h, z.copy(), c.copy()))
            np.subtract(h, c, out=t)
            np.multiply(t, z, out=t)
            h = np.add(t, c, out=out[i])
            if inside is not None:
                h *= inside[i][:, None]
        return out

    def logits(self, x: np.ndarray, inside: np.ndarray | None = None) -> np.ndarray:
        """Of every position. With padding behind the chunks (``inside`` false there), reading backwards starts at their own ends."""
        n, m = x.shape
        f, b = np.empty((n, m, self.hidden), np.float32), np.empty((n, m, self.hidden), np.float32)
        self.states(x, "f", f)
        self.states(x[::-1], "b", b, None, None if inside is None else inside[::-1])
        out = (f.reshape(-1, self.hidden) @ self.w["of"]).reshape(n, m, -1)
        out += (b.reshape(-1, self.hidden) @ self.w["ob"]).reshape(n, m, -1)[::-1]
        out += self.w["bo"]
        return out

    @staticmethod
    def softmax(y: np.ndarray) -> np.ndarray:
        y = np.exp(y - y.max(-1, keepdims=True))
        return y / y.sum(-1, keepdims=True)

    def probabilities(self, x: np.ndarray, inside: np.ndarray | None = None) -> np.ndarray:
        """p[time, chunk, language] of every position."""
        return self.softmax(self.logits(x, inside))

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients for bytes x[time, chunk] of chunks with labels y[chunk]."""
        w, n, h = self.w, x.shape[0], self.hidden
        tapes: dict[str, list] = {"f": [], "b": []}
        f, b = np.empty((n, x.shape[1], h), np.float32), np.empty((n, x.shape[1], h), np.float32)
        self.states(x, "f", f, tapes["f"])
        self.states(x[::-1], "b", b, tapes["b"])
        p = self.softmax(f @ w["of"] + b[::-1] @ w["ob"] + w["bo"])
        mask = LETTER[x].astype(np.float32)
        scale = mask / max(1.0, mask.sum())
        loss = float(-(np.log(np.take_along_axis(p, y[None, :, None], 2)[..., 0] + 1e-9) * scale).sum())
        p[:, np.arange(len(y)), y] -= 1
        p *= scale[..., None]
        g = {"bo": p.sum((0, 1))}
        for d, s, gp in (("f", f, p), ("b", b, p[::-1])):
            g["o" + d] = s.reshape(-1, h).T @ gp.reshape(-1, p.shape[-1])
            own = gp @ w["o" + d].T
            seen = x if d == "f" else x[::-1]
            gz, gc, uz, un = np.zeros((256, h), np.float32), np.zeros((256, h), np.float32), np.zeros((h, h), np.float32), np.zeros((h, h), np.float32)
            dh = np.zeros_like(own[0])
            for i in range(n - 1, -1, -1):
                before, z, c = tapes[d][i]
                dh = dh + own[i]
                dz = dh * (before - c) * ((z > 0) & (z < 1))
                dc = dh * (1 - z) * ((c > -1) & (c < 1))
                np.add.at(gz, seen[i], dz)
                np.add.at(gc, seen[i], dc)
                uz += before.T @ dz
                un += before.T @ dc
                dh = dh * z + dz @ w["uz" + d].T + dc @ w["un" + d].T
            g |= {"xz" + d: gz, "xn" + d: gc, "uz" + d: uz, "un" + d: un}
        return loss, g

    def train(self, texts: Sequence[bytes], labels: Sequence[str], steps: int = 220, batch: int = 128, length: int = 48, rate: float = 0.02, seed: int = 11) -> None:
        """Adam on chunks drawn evenly over the languages."""
        rng = np.random.default_rng(seed)
        pools = [[t for t, y in zip(texts, labels, strict=True) if y == name] for name in self.labels]
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(v) for k, v in self.w.items()}
        for step in range(1, steps + 1):
            y = rng.integers(0, len(self.labels), batch)
            x = np.zeros((batch, length), np.uint8)
            for row, k in enumerate(y):
                text = pools[k][rng.integers(len(pools[k]))]
                at = int(rng.integers(0, max(1, len(text) - length + 1)))
                part = np.frombuffer(text[at : at + length], np.uint8)
                x[row, : len(part)] = part
            _, g = self.gradients(np.ascontiguousarray(x.T), y)
            norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
            lr = rate * min(1.0, 3 * (1 - (step - 1) / steps))
            for k, a in g.items():
                a = a * min(1.0, 1.0 / (norm + 1e-9))
                m[k] += 0.1 * (a - m[k])
                v[k] += 0.01 * (a * a - v[k])
                self.w[k] -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)

    def positions(self, text: bytes) -> list[str]:
        """The label of every byte."""
        out: list[str] = []
        for start in range(0, len(text), LENGTH):
            x = np.frombuffer(text[start : start + LENGTH], np.uint8)[:, None]
            out += [self.labels[k] for k in self.logits(x)[:, 0].argmax(-1)]
        return out

    def pooled(self, texts: Sequence[bytes]) -> np.ndarray:
        """Mean distribution over the letter bytes of each text; zeros where it has none."""
        k = len(self.labels)
        total, letters = np.zeros((len(texts), k)), np.zeros(len(texts))
        flat = np.frombuffer(b"".join(texts) + bytes(LENGTH), np.uint8)
        size = np.array([len(t) for t in texts], np.int64)
        begin = np.cumsum(size) - size
        n = -(-size // LENGTH)
        of = np.repeat(np.arange(len(texts)), n)
        part = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        start = begin[of] + part * LENGTH
        left = np.minimum(size[of] - part * LENGTH, LENGTH)
        order = np.argsort(left, kind="stable")  # short chunks together
        width = max(1, WIDTH * 64 // max(64, k))  # many languages: fewer chunks at once
        for i in range(0, len(order), width):
            mine = order[i : i + width]
            steps = np.arange(int(left[mine].max()))[:, None]
            inside = steps < left[mine][None, :]
            x = np.where(inside, flat[start[mine][None, :] + steps], 0)
            mask = LETTER[x] & inside
            p = self.probabilities(x, None if inside.all() else inside)
            np.add.at(total, of[mine], np.einsum("tbk,tb->bk", p, mask.astype(np.float32)))
            np.add.at(letters, of[mine], mask.sum(0))
        return total / np.maximum(letters, 1)[:, None]


def has_letter(text: bytes) -> bool:
    """Whether any character is a letter; only texts without ASCII letters are decoded."""
    raw = np.frombuffer(text, np.uint8)
    if LETTER[raw[:256]].any() and (raw[:256] < 0x80)[LETTER[raw[:256]]].any():
        return True
    found = LETTER[raw]
    if (raw[found] < 0x80).any():
        return True
    return bool(found.any()) and any(map(str.isalpha, text.decode("utf-8", "replace")))


def learn(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_class: int = PER_CLASS, max_chars: int = MAX_CHARS, hidden: int = 8) -> ByteTagger | None:
    rows = labelled_sample(docs, docs, id_col, text_col, lang_col, usable, per_class, max_chars, MAX_LANGUAGES, SAMPLE_ROWS)
    rows = [(t.encode(), y) for t, y in rows if t and has_letter(t.encode())]
    if not rows:
        return None
    model = ByteTagger(sorted({y for _, y in rows}), hidden)
    if len(model.labels) > 1:
        model.train([t for t, _ in rows], [y for _, y in rows])
    return model


OUT = [("lang_pred", T.StringType(), pa.string()), ("score", T.DoubleType(), pa.float64())]


def identify(docs: DataFrame, model: ByteTagger | None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append lang_pred and score (the pooled probability of that language)."""

    def run(texts):
        whole = [t or b"" for t in texts]
        lettered = [model is not None and has_letter(t) for t in whole]
        p = model.pooled([t if ok else b"" for t, ok in zip(whole, lettered, strict=True)]) if model else None
        names, scores = [], []
        for i, ok in enumerate(lettered):
            best = int(p[i].argmax()) if ok else -1
            names.append(model.labels[best] if ok else UNKNOWN)
            scores.append(min(1.0, float(p[i, best])) if ok else 0.0)
        return names, scores

    return map_text(docs, text_col, OUT, run, keep)


def lettered(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append whether the text has a letter; no model is needed."""
    return map_text(docs, text_col, [("lettered", T.BooleanType(), pa.bool_())], lambda texts: ([t is not None and has_letter(t) for t in texts],), keep)


def tagged(model: ByteTagger, text: str) -> list[tuple[int, int, str]]:
    """Runs of equally labelled bytes of one text as (start, end, language)."""
    out: list[tuple[int, int, str]] = []
    for i, name in enumerate(model.positions(text.encode())):
        if out and out[-1][2] == name:
            out[-1] = (out[-1][0], i + 1, name)
        else:
            out.append((i, i + 1, name))
    return out

