"""Benchmark decontamination with a word-level Aho-Corasick automaton (operator 2).

Words are runs of ASCII digits, letters (A-Z lower-cased) and all non-ASCII characters. Every
``window`` consecutive words of an item, or all its words where it has fewer, form one pattern. The
patterns of all items make one automaton over word numbers; each document is scanned once, and a
match ending at word e covers words e-n+1 .. e, which map back to character offsets.

The automaton is shipped to the executors, so its size is checked: the items are dealt into as many
shards as keep each automaton under ``max_words`` pattern words, and the documents pass one
automaton after the other, carrying the matches found so far, staged in between.

Edge cases: null or empty texts have no words and no hits; items without words have no windows;
windows of an item with a null id mark words as hit, but that item is neither counted nor listed;
items that share a window (ties) are all reported, an id that is repeated once; item ids may be of any
type; an empty benchmark leaves all documents clean; repeated documents are judged alike, those of any
length whole; an empty table gives an empty one; other columns pass through whatever their names, and
those named like an output are replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelet.llm.common import discard, map_text, own_names, plain_names, quoted, reading, remembered, staged

WINDOW = 13
#: Pattern words in one automaton at most (about 100 MB in a worker).
MAX_WORDS = 1_500_000
#: Bytes that separate words become blanks, A-Z becomes a-z, all else stays.
TABLE = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
SEPARATORS = r"[\x00-/:-@\[-`{-\x7f]+"
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

_built: dict[str, tuple] = remembered("decontaminate")


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TABLE).split()


def windows(item: Sequence[bytes], window: int = WINDOW) -> set[tuple[bytes, ...]]:
    if not item:
        return set()
    return {tuple(item[i : i + window]) for i in range(max(1, len(item) - window + 1))}


def automaton(items: Sequence[tuple[str | None, bytes]], window: int) -> tuple:
    """(automaton over word numbers, word -> number). A pattern's value: (its length, ids of its items)."""
    numbers: dict[bytes, int] = {}
    owners: dict[tuple[int, ...], set] = {}
    for item_id, text in items:
        for w in windows(words(text), window):
            owners.setdefault(tuple(numbers.setdefault(x, len(numbers) + 1) for x in w), set()).add(item_id)
    built = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for key, ids in owners.items():
        built.add_word(key, (len(key), tuple(ids)))
    if owners:
        built.make_automaton()
    return (built if owners else None), numbers


def scan(found: list[bytes], built, numbers: dict[bytes, int]) -> tuple[list[tuple[int, int]], set]:
    """Word spans [start, end) of all occurrences, merged, and the ids of the items they belong to."""
    if built is None or len(found) == 0 or numbers.keys().isdisjoint(found):
        return [], set()
    get = numbers.get
    spans, ids = [], set()
    for end, (n, owners) in built.iter(tuple([get(w, 0) for w in found])):
        start = end + 1 - n
        ids.update(owners)
        while spans and spans[-1][1] >= start:  # ends never fall back, starts may
            start = min(start, spans.pop()[0])
        spans.append((start, end + 1))
    return spans, ids


def merge(a: list, b: list) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted([*map(tuple, a), *map(tuple, b)]):
        if out and out[-1][1] >= start:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def offsets(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word spans as character offsets of the original text."""
    if not spans:
        return []
    at = [m.span() for m in WORD.finditer(text)]
    raw = np.frombuffer(text, dtype=np.uint8)
    chars = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    return [(int(chars[at[s][0]]), int(chars[at[e - 1][1]])) for s, e in spans]


SPANS = T.ArrayType(T.ArrayType(T.LongType()))
#: Item ids travel as text and get their own type back at the end.
OUT = [
    ("n_words", T.LongType(), pa.int64()),
    ("hit_words", SPANS, pa.list_(pa.list_(pa.int64()))),
    ("hit_chars", SPANS, pa.list_(pa.list_(pa.int64()))),
    ("hit_items", T.ArrayType(T.StringType()), pa.list_(pa.string())),
]


class Shards:
    """Lists of items; each is read when its turn comes, so the driver holds one. Several are written apart from each other first, so each is read once."""

    def __init__(self, items: DataFrame, n: int) -> None:
        dealt = items.withColumn("part", F.pmod(F.xxhash64("i", "t"), F.lit(n)).cast("int"))
        self.items, self.n = (dealt if n == 1 else staged(dealt.repartition("part"), "benchmark", ["part"])), n

    def __len__(self) -> int:
        return self.n

    def __iter__(self) -> Iterator[list[tuple[str | None, bytes]]]:
        for k in range(self.n):
            yield sorted(((r["i"], (r["t"] or "").encode()) for r in self.items.where(F.col("part") == k).collect()), key=repr)


def shards(benchmark: DataFrame, id_col: str, text_col: str, window: int, max_words: int) -> Shards:
    """The items in shards of about ``max_words`` pattern words, which are counted first. Long items are cut into pieces that overlap by a window less one word, so they have the same windows."""
    items = benchmark.select(quoted(id_col).cast("string").alias("i"), quoted(text_col).cast("string").alias("t"))
    step = max(1, max_words // window // 8)  # windows of a piece; small against a shard, so shards come out even
    found = F.filter(F.split("t", SEPARATORS), lambda w: w != "")
    cut = F.transform(F.expr(f"sequence(0, greatest(0, size(w) - {window}), {step})"), lambda i: F.array_join(F.slice("w", i + 1, step + window - 1), " "))
    items = items.withColumn("w", found).select("i", F.explode(F.when(F.size("w") > step + window - 1, cut).otherwise(F.array("t"))).alias("t"))
    most = F.size(F.split(F.coalesce("t", F.lit("")), SEPARATORS))  # its words, or one or two more
    total = items.agg(F.coalesce(F.sum(most * window), F.lit(0)).alias("n")).first()["n"]
    n = max(1, -(-int(total) // max_words))
    return Shards(items, n)


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, max_words: int = MAX_WORDS, keep: list[str] | None = None) -> DataFrame:
    """Append n_words, hit_words (merged word spans), hit_chars (their character offsets), hit_items (in order, of the benchmark's own type)."""
    outputs = [n for n, _, _ in OUT]
    stay = [c for c in (docs.columns if keep is None else keep) if c.lower() not in outputs]
    spark = docs.sparkSession
    parts = shards(benchmark, item_id, item_text, window, max_words)
    done = plain_names(docs, stay, quoted(text_col).cast("string").alias("t"))
    own = done.columns[:-1]
    before = None
    for k, items in enumerate(parts):
        if before is not None:  # that pass is written before the next one is shipped
            made, done = done, staged(done, f"scan{k}")
            discard(made)
            before.destroy()
        before = shipped = spark.sparkContext.broadcast(items)
        name = hashlib.sha256(repr((items, window)).encode()).hexdigest()

        def run(texts, words_so_far=None, items_so_far=None, shipped=shipped, name=name):
            if name not in _built:
                _built.clear()
                _built[name] = automaton(shipped.value, window)
            built, numbers = _built[name]
            out: list[list] = [[], [], [], []]
            for row, text in enumerate(texts):
                found = words(text)
                spans, ids = scan(found, built, numbers)
                if words_so_far is not None:
                    spans, ids = merge(words_so_far[row], spans), ids.union(items_so_far[row])
                for x, v in zip(out, (len(found), spans, offsets(text or b"", spans), sorted(i for i in ids if i is not None)), strict=True):
                    x.append(v)
            return out

        last = k == len(parts) - 1
        source = done
        done = reading(map_text(source, "t", OUT, run, own if last else [*own, "t"], ("hit_words", "hit_items") if k else (), "decontaminate"), *([source] if k else []))
    kind = benchmark.schema[item_id].dataType
    ids = F.array_sort(F.transform("hit_items", lambda i: i.cast(kind)))
    return own_names(done, stay, "n_words", "hit_words", "hit_chars", ids.alias("hit_items"))


def judged(found: DataFrame) -> DataFrame:
    """Append n_hit, n_items, items_sha256 and contaminated, after the contract's rule: a twentieth of the words."""
    n_hit = F.aggregate("hit_words", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    ids = F.array_join(F.array_sort(F.transform("hit_items", lambda i: i.cast("string"))), ",")
    out = found.withColumns({"n_hit": n_hit, "n_items": F.size("hit_items").cast("long"), "items_sha256": F.sha2(ids, 256)})
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
