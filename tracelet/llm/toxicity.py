"""Toxicity by a weighted finite-state pattern grammar (operator 8).

A lexical transducer rewrites words to symbols (insult, threat, modal, target, negation, report, quote,
other, clause end) with the weight of the word. Four more read the symbols in step: the target
transducer adds weight where an insult and an addressed person stand in one clause, the threat
transducer where a modal, a threat and a target follow each other, the negation transducer damps
what stands within three words of a negation, and the reported-speech transducer what stands behind
a verb of saying or inside quotation marks. One more notes words of other languages in a clause; behind
them the words of SHARED, which those languages have too, are other words. Their composition is one
automaton whose states are made when first reached. A clause's score is the weight of its path; a
document's features are those of its matched clauses, and logistic regression turns them into a
probability.

Learned from a bounded sample of labelled rows (``per_class`` of each label): the weights of insults
(words that mark the label, beside the given ones, by smoothed log odds), insulting stems with any
ending, further targets (words that stand beside insults far more often than elsewhere) and threats
(words between a modal and a target in toxic documents), the weights of the arcs of the four
transducers (ARCS are where they begin, and where they stay if the sample never reaches them), and the
regression.

Edge cases: null, empty and unmatched texts get the probability of a document without any match;
repeated rows score alike; texts of any length are read whole; there are no ties (the threshold itself
counts as toxic); an empty table gives an empty one; without both labels the given weights and
regression are used; other columns pass through, and those named like an output are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from tracelet.llm.common import labelled_sample, map_text

# Word lists of the grammar.
INSULTS = "bastard bitch clown coward cretin creep degenerate despicable dimwit disgusting dumb dumbass filth filthy fool freak garbage halfwit idiot idiotic idiots imbecile jerk lame liar loser losers lowlife maggot moron morons moronic nasty parasite pathetic pig repulsive rat scum shit shithead sickening stupid subhuman swine trash ugly useless vermin vile worm worthless".split()
THREATS = "beat break burn choke crush cut destroy die gut hang hit hunt hurt kick kill murder punch shoot slap smash stab strangle".split()
MODALS = "ll gonna will shall should must deserve deserves want wants".split()
TARGETS = "you your yours yourself youre u they them their those these he she him her people everyone".split()
NEGATIONS = "no not never nobody isn aren wasn weren don doesn didn won wouldn can't cannot hardly without neither nor".split()
#: Words of the lists above that German or Spanish have too, and words that tell a clause of theirs from an English one.
SHARED = "die he her u".split()
FOREIGN_WORDS = "und nicht ist ein eine einen einer ich wir sie sich auch auf für zu que una por pero muy".split()
REPORTS = "said says say saying called calls call claimed claims told tells wrote writes quoted quotes reported reports according".split()

(OTHER, INSULT, THREAT, MODAL, TARGET, NEGATION, REPORT, QUOTE, END, FOREIGN) = range(10)
PER_CLASS, MAX_CHARS = 600, 100_000
THRESHOLD = 0.5
#: Stems are prefixes of so many bytes, with so many different words behind them.
STEM, STEM_MOST, FORMS = 4, 8, 4
#: Words, ends of clauses and quotation marks; one word has an apostrophe, as its head alone says the opposite.
TOKEN = re.compile(rb"[Cc][Aa][Nn] {0,2}'[Tt](?![0-9A-Za-z])|[0-9A-Za-z\x80-\xff]+|[.!?;\n]|\"")
#: Weights of the arcs before anything is learned: factors behind a negation and in reported speech, additions for an insult with a target and for a threat.
ARCS = {"negated": 0.5, "reported": 0.7, "targeted": 0.5, "threatened": 1.5}
#: What is tried for each.
TRIED = {"negated": (0.02, 0.1, 0.25, 0.5, 0.75, 1.0), "reported": (0.02, 0.1, 0.25, 0.5, 0.7, 1.0), "targeted": (0.0, 0.25, 0.5, 1.0, 2.0), "threatened": (0.0, 0.5, 1.0, 1.5, 3.0)}
#: Word bytes stay, A-Z becomes a-z, all else separates.
TABLE = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def negation(state: int, symbol: int) -> tuple[int, bool]:
    """Counts down three words from a negation; whether what is met is damped."""
    if symbol == NEGATION:
        return 3, False
    if symbol == END:
        return 0, False
    return max(0, state - 1), state > 0


def reported(state: int, symbol: int) -> tuple[int, bool]:
    """1 behind a verb of saying, 2 inside quotation marks; whether what is met is damped."""
    if symbol == END:
        return (2 if state == 2 else 0), False
    if symbol == QUOTE:
        return (0 if state == 2 else 2), False
    if symbol == REPORT:
        return max(state, 1), False
    return state, state > 0


def targeted(state: int, symbol: int) -> tuple[int, bool]:
    """Bits: a target was seen, an insult was seen; whether this is the second of both."""
    if symbol == END:
        return 0, False
    bit = {TARGET: 1, INSULT: 2}.get(symbol, 0)
    return state | bit, bool(bit and state and not state & bit)


def threatening(state: int, symbol: int) -> tuple[int, bool]:
    """0 nothing, 1 modal, 2 modal and threat; whether a target follows these."""
    if symbol == END:
        return 0, False
    if symbol == MODAL:
        return 1, False
    if symbol == THREAT:
        return (2 if state else 0), False
    if symbol == TARGET and state == 2:
        return 0, True
    return state, False


def straight(text: bytes) -> bytes:
    """Typographic apostrophes as plain ones, of the same length."""
    return text.replace(b"\xe2\x80\x99", b"  '") if b"\xe2\x80\x99" in text else text


def regression(x: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, float]:
    """(weights, loss) of logistic regression by Newton's method, slightly damped; both labels weigh the same."""
    n1, n0 = labels.sum(), (1 - labels).sum()
    w = np.where(labels > 0, 0.5 / max(1, n1), 0.5 / max(1, n0))
    beta, eye = np.zeros(x.shape[1]), np.eye(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (w * p * (1 - p))[:, None]).T @ x + 1e-3 * eye
        step = np.linalg.solve(h, x.T @ (w * (p - labels)) + 1e-3 * beta)
        beta -= step
        if np.abs(step).max() < 1e-9:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(x @ beta, -30, 30))), 1e-9, 1 - 1e-9)
    return beta, float(-(w * (labels * np.log(p) + (1 - labels) * np.log(1 - p))).sum() + 5e-4 * (beta**2).sum())


def foreign(state: int, symbol: int) -> int:
    """1 behind a word of another language in a clause."""
    return 0 if symbol == END else int(state or symbol == FOREIGN)


class Path(NamedTuple):
    """What an arc of the composed automaton says: the next state, and which of the transducers' arcs it takes."""

    state: tuple[int, int, int, int, int]
    negated: bool
    reported: bool
    targeted: bool
    threatened: bool


class Grammar:
    def __init__(self, weights: dict[bytes, float] | None = None, stems: dict[bytes, float] | None = None, targets: Sequence[bytes] = (), threats: Sequence[bytes] = (), arcs: dict[str, float] | None = None) -> None:
        self.symbols: dict[bytes, tuple[int, float]] = {b".": (END, 0.0), b"!": (END, 0.0), b"?": (END, 0.0), b";": (END, 0.0), b"\n": (END, 0.0), b'"': (QUOTE, 0.0)}
        for words, symbol in ((TARGETS, TARGET), (MODALS, MODAL), (NEGATIONS, NEGATION), (REPORTS, REPORT), (THREATS, THREAT), (FOREIGN_WORDS, FOREIGN)):
            self.symbols |= {w.encode(): (symbol, 0.0) for w in words}
        self.symbols |= {w: (TARGET, 0.0) for w in targets} | {w: (THREAT, 0.0) for w in threats}
        self.weight = {**ARCS, **(arcs or {})}
        self.symbols |= {w: (INSULT, x) for w, x in ({w.encode(): 1.0 for w in INSULTS} | (weights or {})).items()}
        self.shared = {w.encode() for w in SHARED if self.symbols[w.encode()][0] != INSULT}
        self.stems = stems or {}
        self.heads = {s[:STEM] for s in self.stems}
        self.marks = {w for w, (s, _) in self.symbols.items() if s in (INSULT, THREAT)}
        self.arcs: dict[tuple, Path] = {}
        self.beta = np.array([-3.0, 4.0, 0.5, 0.5])

    def __getstate__(self) -> dict:
        return self.__dict__ | {"arcs": {}}

    def arc(self, state: tuple[int, int, int, int, int], symbol: int) -> Path:
        """The arc of the composed transducers."""
        made = self.arcs.get((state, symbol))
        if made is None:
            (n, damped), (r, far), (t, pair), (h, threat) = (f(s, symbol) for f, s in zip((negation, reported, targeted, threatening), state, strict=False))
            made = self.arcs[state, symbol] = Path((n, r, t, h, foreign(state[4], symbol)), damped, far, pair, threat)
        return made

    def scored(self, steps: Sequence[tuple[float, Path]]) -> float:
        """Weight of a path: each word's own weight and what its arc adds, damped by what its arc damps."""
        w, total = self.weight, 0.0
        for own, arc in steps:
            more = own + (w["targeted"] if arc.targeted else 0.0) + (w["threatened"] if arc.threatened else 0.0)
            total += more * (w["negated"] if arc.negated else 1.0) * (w["reported"] if arc.reported else 1.0)
        return total

    def symbol(self, word: bytes) -> tuple[int, float]:
        """The lexical transducer: whole words first, then the longest learned stem."""
        found = self.symbols.get(word)
        if found is None and word[:STEM] in self.heads:
            stem = next((word[:n] for n in range(min(len(word), STEM_MOST), STEM - 1, -1) if word[:n] in self.stems), None)
            found = (INSULT, self.stems[stem]) if stem else None
        return found or (OTHER, 0.0)

    def paths(self, text: bytes) -> list[tuple[list[tuple[float, Path]], int, int]]:
        """(steps that weigh anything, start, end) of clauses that matched; offsets in bytes."""
        out, state, steps, start, last = [], (0, 0, 0, 0, 0), [], 0, 0
        for m in TOKEN.finditer(straight(text)):
            word = m[0].lower().replace(b" ", b"")
            symbol, weight = self.symbol(word)
            if state[4] and word in self.shared:
                symbol = OTHER
            arc = self.arc(state, symbol)
            state = arc.state
            if weight or arc.targeted or arc.threatened:
                steps.append((weight, arc))
            last = m.end()
            if symbol == END:
                if steps:
                    out.append((steps, start, last))
                steps, start = [], last
        if steps:
            out.append((steps, start, last))
        return out

    def clauses(self, text: bytes) -> list[tuple[float, int, int]]:
        """(score, start, end) of clauses that matched; offsets in bytes."""
        return [(score, start, end) for steps, start, end in self.paths(text) if (score := self.scored(steps))]

    def may_match(self, text: bytes) -> bool:
        """Whether the text has any insult or threat; without one no clause matches."""
        words = straight(text).translate(TABLE).split()
        return not self.marks.isdisjoint(words) or bool(self.heads) and not self.heads.isdisjoint([w[:STEM] for w in words])

    def summed(self, paths: Sequence[tuple]) -> tuple[float, float, float]:
        """Of the matched clauses: the largest score, log of the summed score, log of their number."""
        scores = [s for steps, *_ in paths if (s := self.scored(steps))]
        if not scores:
            return 0.0, 0.0, 0.0
        return max(scores), math.log1p(sum(scores)), math.log1p(len(scores))

    def features(self, text: bytes) -> tuple[float, float, float]:
        return self.summed(self.paths(text)) if self.may_match(text) else (0.0, 0.0, 0.0)

    def probability(self, texts: Sequence[bytes]) -> np.ndarray:
        x = np.array([(1.0, *self.features(t)) for t in texts]).reshape(-1, 4)
        return 1 / (1 + np.exp(-np.clip(x @ self.beta, -30, 30)))

    @classmethod
    def learned(cls, texts: Sequence[bytes], labels: np.ndarray, least: float = 0.02) -> Grammar:
        """Insults by log odds: a word must stand behind as many different words in positive documents as ``least`` of their number, and be 20 times likelier there. Counting different neighbours keeps copies of one document from making its words insults."""
        sides: tuple[set, set] = (set(), set())
        for t, y in zip(texts, labels, strict=True):
            found = t.translate(TABLE).split()
            sides[int(y)].update(zip(found, found[1:], strict=False))
        neg, pos = (Counter(w for _, w in side) for side in sides)
        few = max(5, least * float(labels.sum()))
        heads = Counter(w[:n] for _, w in sides[1] for n in range(STEM, min(len(w), STEM_MOST) + 1))
        kept = {s for s, c in heads.items() if c >= few}
        against = Counter(w[:n] for _, w in sides[0] for n in range(STEM, min(len(w), STEM_MOST) + 1) if w[:n] in kept)
        forms = Counter(s for w in pos for n in range(STEM, min(len(w), STEM_MOST) + 1) if (s := w[:n]) in kept)
        n1, n0 = int(labels.sum()), int(len(labels) - labels.sum())
        weights = {}
        odds = lambda w: math.log((pos[w] + 0.5) / (n1 + 1)) - math.log((neg[w] + 0.5) / (n0 + 1))
        for w, c in pos.items():
            if c >= few and odds(w) >= math.log(20):
                weights[w] = min(2.0, odds(w) / 3)
        given = {w.encode() for w in INSULTS}
        weights |= {w: min(1.0, max(0.1, odds(w) / 3)) for w in given if pos[w] + neg[w] >= 5 and w not in weights}
        stems: dict[bytes, float] = {}
        for s in sorted(kept, key=len):  # the shortest that tells; longer ones say no more
            o = math.log((heads[s] + 0.5) / (n1 + 1)) - math.log((against[s] + 0.5) / (n0 + 1))
            if o >= math.log(100) and forms[s] >= FORMS and not any(s[:n] in stems for n in range(STEM, len(s))):
                stems[s] = min(2.0, o / 3)
        made = cls(weights, stems, *cls(weights, stems).companions(texts, labels, few))
        made.fit(texts, labels)
        return made

    def companions(self, texts: Sequence[bytes], labels: np.ndarray, few: float) -> tuple[list[bytes], list[bytes]]:
        """(targets, threats) that the sample shows, beside the given ones.

        A target stands next to an insult in ``few`` toxic documents, and ten times as often there as its
        share of all words would have it. A threat stands between a modal and a target in ``few`` toxic
        documents, and in twenty times as many of them as of the others, by smoothed odds.
        """
        beside, between, every, places = Counter(), (Counter(), Counter()), Counter(), 0
        for t, y in zip(texts, labels, strict=True):
            words = straight(t).translate(TABLE).split()
            kinds = [self.symbol(w)[0] for w in words]
            every.update(words)
            if y and INSULT in kinds:
                near = [w for w, a, b, k in zip(words, [OTHER, *kinds], [*kinds[1:], OTHER], kinds, strict=False) if k == OTHER and INSULT in (a, b)]
                beside.update(set(near))
                places += len(set(near))
            if MODAL in kinds:
                between[int(y)].update({w for w, a, b, k in zip(words[1:], kinds, kinds[2:], kinds[1:], strict=False) if k == OTHER and a == MODAL and b == TARGET})
        total, n1, n0 = max(1, sum(every.values())), int(labels.sum()), int(len(labels) - labels.sum())
        targets = sorted(w for w, c in beside.items() if c >= few and c / places >= 10 * every[w] / total)
        odds = lambda w: math.log((between[1][w] + 0.5) / (n1 + 1)) - math.log((between[0][w] + 0.5) / (n0 + 1))
        return targets, sorted(w for w, c in between[1].items() if c >= few and w not in targets and odds(w) >= math.log(20))

    def fit(self, texts: Sequence[bytes], labels: np.ndarray) -> None:
        """The regression, and with it the weights of arcs: one after the other takes the value that lowers the loss, twice around. An arc that no clause takes keeps its weight."""
        paths = [self.paths(t) if self.may_match(t) else [] for t in texts]
        matched = [i for i, p in enumerate(paths) if p]
        x = np.zeros((len(texts), 4))
        x[:, 0] = 1

        def loss() -> float:
            for i in matched:
                x[i, 1:] = self.summed(paths[i])
            self.beta, found = regression(x, labels)
            return found

        taken = {n for i in matched for steps, *_ in paths[i] for _, arc in steps for n in ARCS if getattr(arc, n)}
        best = loss()
        for name in [n for _ in range(2) for n in ARCS if n in taken]:
            kept = self.weight[name]
            for value in TRIED[name]:
                self.weight[name] = value
                now = loss()
                if now < best - 1e-4:  # not for nothing
                    best, kept = now, value
            self.weight[name] = kept
        loss()


def learn(docs: DataFrame, labels: DataFrame, usable: Column, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> Grammar:
    rows = labelled_sample(docs, labels, id_col, text_col, label_col, usable & labels[label_col].isin(0, 1), per_class, max_chars)
    y = np.array([int(label) for _, label in rows], float)
    if not 0 < y.sum() < len(y):
        return Grammar()
    return Grammar.learned([t.encode() for t, _ in rows], y)


OUT = [("score", T.DoubleType(), pa.float64()), ("predicted", T.IntegerType(), pa.int32())]


def score(docs: DataFrame, grammar: Grammar, text_col: str = "text", threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """Append score and predicted (1 from ``threshold`` on)."""

    def run(texts):
        p = grammar.probability([t or b"" for t in texts])
        return pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32), pa.int32())

    return map_text(docs, text_col, OUT, run, keep)


CLAUSES = T.ArrayType(T.StructType([T.StructField("score", T.DoubleType()), T.StructField("text", T.StringType())]))


def matched_clauses(docs: DataFrame, grammar: Grammar, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append the matched clauses with their scores and texts, for reading."""
    kind = pa.list_(pa.struct([("score", pa.float64()), ("text", pa.string())]))
    return map_text(docs, text_col, [("clauses", CLAUSES, kind)], lambda texts: ([[{"score": s, "text": t[a:b].decode("utf-8", "replace").strip()} for s, a, b in grammar.clauses(t or b"")] for t in texts],), keep)
