"""SentencePiece BPE encoding by a table of last tokens (operator 4).

Merge-type BPE has the property that the encoding of every prefix of a text ends in one token that
its text alone determines, and two neighbouring tokens stand in an encoding exactly when encoding
their joined text gives those two back. So the last token of each prefix is found among the pieces
that an automaton matches there: the one that is compatible with the last token of the prefix before
it. The ids are then read off backwards. Time is linear in the text.

Blanks delimit: no piece has the blank mark behind another character, so a unit is a mark and what
follows it up to the next one. A newline stands in no piece either. Units repeat, so their ids are
remembered (the memory is bounded and then emptied). Runs of blanks merge after everything else,
with equal scores, where the last-token property does not hold; those merges run one by one, which
for a run of n marks is n steps, remembered by n.

Edge cases: null counts as empty; an empty text has the begin and end ids alone; characters outside
the vocabulary become byte pieces; the blank mark itself in a text is a blank, as in the library; of
equally good merges (ties) the leftmost goes first, as there; texts of any length are encoded whole;
repeated rows are encoded alike; an empty table gives an empty one; other columns pass through, and
those named like an output are replaced. A model that normalises texts or puts no blank before them,
or with pieces across blanks, is refused when it is loaded.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
from collections.abc import Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tracelet.llm.common import map_text, remembered

BLANK = "▁"
MODEL = "piece_bpe_32k.model"
#: Units whose ids a worker remembers at most.
REMEMBER = 500_000
#: Characters of a unit, or bytes of its ids, that are remembered at most.
LONGEST = 256
NEVER = float("inf")

_loaded: dict[str, Pieces] = remembered("pieces")


class Remembered(dict):
    """A bounded memo: emptied when full; long keys are not kept."""

    def __init__(self, fn, most: int = REMEMBER) -> None:
        super().__init__()
        self.fn, self.most = fn, most

    def __missing__(self, key):
        if not isinstance(key, (int, tuple)) and len(key) > LONGEST:
            return self.fn(key)
        if len(self) >= self.most:
            self.clear()
        made = self[key] = self.fn(key)
        return made


class Pieces:
    """Tables of one model file; nothing but the file is needed to encode and decode."""

    def __init__(self, model: str) -> None:
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=model)
        n = lib.get_piece_size()
        self.bos, self.eos = lib.bos_id(), lib.eos_id()
        self.byte = {int(lib.id_to_piece(i)[1:-1], 16): i for i in range(n) if lib.is_byte(i)}
        special = [lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i) for i in range(n)]
        self.ids = {lib.id_to_piece(i): i for i in range(n) if not special[i]}
        self.rank = {p: -lib.get_score(i) for p, i in self.ids.items()}
        self.text = {i: p.replace(BLANK, " ").encode() for p, i in self.ids.items()} | {i: bytes([b]) for b, i in self.byte.items()} | {i: b"" for i in range(n) if lib.is_control(i)}
        if any(BLANK in p.lstrip(BLANK) for p in self.ids) or any("\n" in p for p in self.ids) or any(p[:2] == BLANK * 2 and p.strip(BLANK) for p in self.ids):
            raise ValueError("this model has pieces across blanks or newlines")
        probe = " a  \ufb01\u2460e\u0301\n "
        if lib.decode(lib.encode(probe)) != probe or not lib.encode("a", out_type=str)[0].startswith(BLANK):
            raise ValueError("this model normalises texts, or puts no blank before them")
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            if len(p) > 1 and p.strip(BLANK):
                self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.spines = Remembered(self._spines, 1 << 20)
        self.fits = Remembered(self._fits, 1 << 20)
        self.unit = Remembered(self._unit)
        self.run = Remembered(self._run, 1 << 12)
        self.back = Remembered(self._back)
        self.pack = Remembered(self._pack)

    def merged(self, symbols: Sequence[str]) -> list[tuple[str, tuple | None]]:
        """Merge pair by pair, best rank first and leftmost of equals; (text, (left, right, rank) or None) of what is left."""
        left = [(s, None) for s in symbols]
        after, before, live = list(range(1, len(left) + 1)), list(range(-1, len(left) - 1)), [True] * len(left)
        heap: list = []

        def offer(i: int, j: int) -> None:
            if 0 <= i and j < len(left) and (r := self.rank.get(left[i][0] + left[j][0])) is not None:
                heapq.heappush(heap, (r, i, j, left[i][0], left[j][0]))

        for i in range(len(left) - 1):
            offer(i, i + 1)
        while heap:
            r, i, j, a, b = heapq.heappop(heap)
            if not (live[i] and j < len(left) and live[j] and after[i] == j and left[i][0] == a and left[j][0] == b):
                continue
            left[i], live[j] = (a + b, (left[i], left[j], r)), False
            after[i] = after[j]
            if after[i] < len(left):
                before[after[i]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [x for x, ok in zip(left, live, strict=True) if ok]

    def _spines(self, token: str) -> tuple | None:
        """What stands at a token's left and right end while it is built: [(text, rank at which it is taken up)]; None if encoding it gives more than one token."""
        made = self.merged(token)
        if len(made) > 1:
            return None
        ends = []
        for side in (0, 1):
            chain, node = [], made[0]
            taken = NEVER
            while True:
                chain.append((node[0], taken))
                if node[1] is None:
                    break
                taken, node = node[1][2], node[1][side]
            ends.append(chain[::-1])
        return ends[0], ends[1]

    def _fits(self, pair: tuple[str, str]) -> bool:
        """Whether the two are tokens and stay apart: at no time may the symbols that meet between them merge before either is taken up on its own side."""
        if self.spines[pair[1]] is None:
            return False
        right, left = self.spines[pair[0]][1], self.spines[pair[1]][0]
        i = j = 0
        while True:
            (a, a_taken), (b, b_taken) = right[i], left[j]
            r = self.rank.get(a + b)
            if r is not None and r < a_taken and r <= b_taken:
                return False
            if a_taken == b_taken == NEVER:
                return True
            if a_taken <= b_taken:
                i += 1
            else:
                j += 1

    def tokens(self, unit: str) -> list[str]:
        """Tokens of a unit (no blank mark but at its start): last tokens of all prefixes, then backwards.

        Matches come in order of their ends. Of the candidates at a place (the pieces that match there, and
        its one character) exactly one is compatible with the last token of the prefix before it, so where
        no piece is, the character is; these places stay empty in ``last``.
        """
        n = len(unit)
        last: list[str | None] = [None] * (n + 1)
        fits, spines = self.fits, self.spines
        for end, piece in self.automaton.iter(unit) if n > 1 else ():
            end += 1
            if last[end] is None:
                start = end - len(piece)
                if fits[last[start] or unit[start - 1], piece] if start else spines[piece] is not None:
                    last[end] = piece
        out = []
        while n:
            token = last[n] or unit[n - 1]
            out.append(token)
            n -= len(token)
        return out[::-1]

    def _pack(self, token: str) -> bytes:
        """Ids of a token: its own, or those of its bytes."""
        i = self.ids.get(token)
        return b"".join(x.to_bytes(4, "little") for x in ([i] if i is not None else [self.byte[b] for b in token.encode()]))

    def packed(self, tokens: Sequence[str]) -> bytes:
        return b"".join(map(self.pack.__getitem__, tokens))

    def _unit(self, field: str) -> bytes:
        """Ids of one field of a text split at blanks, where a field starting with a newline has no blank before it."""
        if field[:1] == "\n":
            return self.packed(["\n"]) + self.packed(self.tokens(field[1:]))
        return self.packed(self.tokens(BLANK + field))

    def _run(self, n: int) -> bytes:
        return self.packed([x for x, _ in self.merged(BLANK * n)])

    def _back(self, ids: bytes) -> bytes:
        return b"".join(map(self.text.__getitem__, struct.unpack(f"<{len(ids) // 4}I", ids)))

    def encode(self, text: str) -> list[bytes]:
        """Ids of a text as little-endian unsigned 32-bit integers, in pieces to be joined."""
        ends = [self.bos.to_bytes(4, "little"), self.eos.to_bytes(4, "little")]
        if not text:
            return ends
        if BLANK in text:
            text = text.replace(BLANK, " ")
        fields = text.replace("\n", " \n").split(" ")
        if "" not in fields:
            return [ends[0], *map(self.unit.__getitem__, fields), ends[1]]
        out, waiting, mark = [ends[0]], 0, self.ids[BLANK].to_bytes(4, "little")
        for field in fields:
            if field == "":
                waiting += 1
                continue
            ids = self.unit[field]
            if waiting:
                joins = field[0] != "\n" and ids[:4] == mark
                out.append(self.run[waiting + joins])
                ids = ids[4:] if joins else ids
                waiting = 0
            out.append(ids)
        if waiting:
            out.append(self.run[waiting])
        return [*out, ends[1]]

    def decode(self, parts: Sequence[bytes]) -> bytes:
        """Text of ids, in UTF-8: byte pieces join, control pieces vanish, and the blank before the text goes."""
        made = b"".join(map(self.back.__getitem__, parts))
        return made[1:] if made[:1] == b" " else made


def tables(model: str) -> Pieces:
    if model not in _loaded:
        _loaded[model] = Pieces(model)
    return _loaded[model]


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(docs: DataFrame, model: str | None = None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append piece_ids (array of int, with begin and end) and decoded (the text they decode to).

    ``model``: path of a model file on every executor; by default the public 32k one there.
    """

    def run(texts):
        table = tables(model or model_path())
        parts = [table.encode((t or b"").decode("utf-8", "replace")) for t in texts]
        ids = [b"".join(p) for p in parts]
        at = [0]
        for x in ids:
            at.append(at[-1] + len(x) // 4)
        flat = pa.Array.from_buffers(pa.int32(), at[-1], [None, pa.py_buffer(b"".join(ids))])
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), flat), pa.array([table.decode(p) for p in parts], pa.binary()).cast(pa.string())

    return map_text(docs, text_col, [("piece_ids", T.ArrayType(T.IntegerType()), pa.list_(pa.int32())), ("decoded", T.StringType(), pa.string())], run, keep, owner="pieces")


DIGESTS = [("n_tokens", T.LongType(), pa.int64()), ("ids_sha256", T.StringType(), pa.string()), ("decoded_sha256", T.StringType(), pa.string())]


def digests(docs: DataFrame, model: str | None = None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The same encoding and decoding, of which only counts and digests leave the executors."""

    def run(texts):
        table = tables(model or model_path())
        out: list[list] = [[], [], []]
        for t in texts:
            parts = table.encode((t or b"").decode("utf-8", "replace"))
            ids = b"".join(parts)
            out[0].append(len(ids) // 4)
            out[1].append(hashlib.sha256(ids).hexdigest())
            out[2].append(hashlib.sha256(table.decode(parts)).hexdigest())
        return out

    return map_text(docs, text_col, DIGESTS, run, keep, owner="pieces")
