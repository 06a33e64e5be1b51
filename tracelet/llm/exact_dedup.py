"""Exact deduplication by Patricia tries (operator 9).

Texts are normalised (A-Z lower-cased, nothing else) and dealt by (length, content hash). A trie
takes each full byte string; its terminal node stores the smallest and the largest identifier, how
often the largest occurs, and the number of rows. Tries run twice. Where the rows are read, a task
keeps one trie, so that copies leave it as one row; when its labels exceed ``HELD`` bytes, whole
subtrees are spilled, the heaviest first, as finished rows: what comes later of the same texts makes
rows of its own, and the second trie adds them up. Behind the shuffle rows arrive sorted by (length,
hash); when that key moves on, the subtree under it is complete, and it is written out and released.
So neither holds more than ``HELD`` bytes, or the distinct texts of one key, beside a slice of rows.

Edge cases: a null text counts as empty; empty texts are copies of each other; identifiers may be of
any type that has an order; rows with a null identifier join their group, rank below every other
identifier and are kept only if the whole group has none; of repeated rows (same identifier, same
text: ties) the one with the smallest hash of all its columns is kept; texts of any length are
compared whole; an empty table gives an empty result; other columns pass through whatever their
names, and one that has the name of an output is replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tracelet.llm.common import SLICE_BYTES, as_bytes, lookup, map_arrow, map_text, one_of_each, own_names, plain_names, quoted, slices, staged, without

#: Bytes of labels that a task's trie holds before subtrees are spilled.
HELD = 8 << 20


class Terminal:
    __slots__ = ("least", "most", "rows", "ties")

    def __init__(self) -> None:
        self.least, self.most, self.ties, self.rows = None, None, 0, 0

    def add(self, least: object, most: object, ties: int, rows: int) -> None:
        if least is not None and (self.least is None or least < self.least):
            self.least = least
        if most == self.most:
            self.ties += ties
        elif self.most is None or (most is not None and most > self.most):
            self.most, self.ties = most, ties
        self.rows += rows


class Node:
    __slots__ = ("edges", "terminal")

    def __init__(self) -> None:
        self.edges: dict[int, tuple[bytes, Node]] = {}
        self.terminal: Terminal | None = None


def shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class Patricia:
    """A compressed radix trie over byte strings: one edge for every run without a branch."""

    def __init__(self) -> None:
        self.root = Node()
        self.held = 0

    def owner(self, text: bytes) -> Terminal:
        """The terminal node of ``text``, made where it is missing."""
        node, at = self.root, 0
        while at < len(text):
            edge = node.edges.get(text[at])
            if edge is None:
                leaf = Node()
                node.edges[text[at]] = (text[at:], leaf)
                self.held += len(text) - at
                node, at = leaf, len(text)
                break
            label, child = edge
            same = len(label) if text.startswith(label, at) else shared(label, text[at : at + len(label)])
            if same < len(label):
                fork = Node()
                fork.edges[label[same]] = (label[same:], child)
                node.edges[label[0]] = (label[:same], fork)
                child = fork
            node, at = child, at + same
        if node.terminal is None:
            node.terminal = Terminal()
        return node.terminal

    def items(self) -> Iterator[tuple[bytes, Terminal]]:
        """All strings with their terminals."""
        return walk(b"", self.root)

    def spill(self, most: int) -> Iterator[tuple[bytes, Terminal]]:
        """Cut off subtrees of the root, the heaviest first, until at most ``most`` bytes are held; their strings with their terminals."""
        weights = sorted(((weight(edge), first) for first, edge in self.root.edges.items()), reverse=True)
        for size, first in weights:
            if self.held <= most:
                return
            label, child = self.root.edges.pop(first)
            self.held -= size
            yield from walk(label, child)


def walk(head: bytes, node: Node) -> Iterator[tuple[bytes, Terminal]]:
    """Strings under a node that ``head`` leads to, without recursion."""
    stack = [(head, node)]
    while stack:
        head, node = stack.pop()
        if node.terminal is not None:
            yield head, node.terminal
        stack.extend((head + label, child) for label, child in node.edges.values())


def weight(edge: tuple[bytes, Node]) -> int:
    """Bytes of the labels of an edge and all under it."""
    total, stack = 0, [edge]
    while stack:
        label, node = stack.pop()
        total += len(label)
        stack.extend(node.edges.values())
    return total


def normal(text: bytes | None) -> bytes:
    """A-Z lower-cased; bytes.lower touches no other byte."""
    return (text or b"").lower()


def owner_fields(key: T.DataType) -> list[T.StructField]:
    return [T.StructField(n, k) for n, k in (("least", key), ("most", key), ("ties", T.LongType()), ("rows", T.LongType()))]


def batch_of(rows: list, schema: T.StructType) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, type=to_arrow_type(f.dataType)) for c, f in zip(columns, schema, strict=True)], names=schema.names)


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def local_owners(schema: T.StructType, held: int = HELD):
    """One trie a task, of which subtrees are spilled: the task's texts with their owners."""

    def rows_of(found: Iterator[tuple[bytes, Terminal]]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for t, o in found:
            rows.append((len(t), signed(xxhash.xxh64_intdigest(t)), t, o.least, o.most, o.ties, o.rows))
            size += len(t)
            if size >= SLICE_BYTES:
                yield batch_of(rows, schema)
                rows, size = [], 0
        if rows:
            yield batch_of(rows, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Patricia()
        for whole in batches:
            for part in slices(whole, 1):
                for key, text in zip(part.column(0).to_pylist(), map(normal, as_bytes(part.column(1))), strict=True):
                    trie.owner(text).add(key, key, 1, 1)
                    if trie.held > held:
                        yield from rows_of(trie.spill(held // 2))
        yield from rows_of(trie.items())

    return run


def merged_owners(schema: T.StructType):
    """Rows come sorted by (length, hash); the subtree of one key is written out when the key moves on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, trie, ready = None, Patricia(), []
        told = lambda: [(hashlib.sha256(t).hexdigest(), o.least, o.most, o.ties, o.rows) for t, o in trie.items()]
        for batch in batches:
            for part in slices(batch, 2):
                for n, h, text, least, most, ties, rows in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if (n, h) != at:
                        ready += told()
                        at, trie = (n, h), Patricia()
                    trie.owner(text).add(least, most, ties, rows)
                if len(ready) >= 10_000:
                    yield batch_of(ready, schema)
                    ready = []
        ready += told()
        if ready:
            yield batch_of(ready, schema)

    return run


def owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held: int = HELD) -> DataFrame:
    """One row for each distinct normalised text: sha256, smallest and largest identifier, ties, rows."""
    rows = docs.select(quoted(id_col).alias("id"), quoted(text_col).cast("string").alias("t"))
    fields = owner_fields(rows.schema["id"].dataType)
    texts = T.StructType([T.StructField("n", T.LongType()), T.StructField("h", T.LongType()), T.StructField("t", T.BinaryType()), *fields])
    local = map_arrow(rows, local_owners(texts, held), texts)
    classes = T.StructType([T.StructField("sha", T.StringType()), *fields])
    return map_arrow(local.repartition("n", "h").sortWithinPartitions("n", "h"), merged_owners(classes), classes)


def digests(docs: DataFrame, text_col: str, out: str, keep: list[str] | None = None) -> DataFrame:
    return map_text(docs, text_col, [(out, T.StringType(), pa.string())], lambda texts: ([hashlib.sha256(normal(t)).hexdigest() for t in texts],), keep)


def classes_of(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """Classes of over one row, staged; and the number of rows of ``docs``."""
    every = staged(owners(docs, id_col, text_col), "owners")
    total = every.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).first()["n"]
    return every.where("rows > 1"), total


def one_of_ties(df: DataFrame, sure: str, by: list[str]) -> DataFrame:
    """Settle rows where ``sure`` is null: true for one row of each ``by``; only those rows are shuffled."""
    tied = one_of_each(df.where(F.col(sure).isNull()).drop(sure), by, sure)
    return df.where(F.col(sure).isNotNull()).unionByName(tied)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append keep_id, group_size, kept and text_sha256 to the rows (all columns, or those of ``keep``)."""
    found, total = classes_of(docs, id_col, text_col)
    outputs = ("keep_id", "group_size", "kept", "text_sha256")
    allowed = set(without(docs, outputs))
    stay = [c for c in (docs.columns if keep is None else keep) if c in allowed]
    named = plain_names(docs, stay, quoted(id_col).alias("id"), quoted(text_col).cast("string").alias("t"))
    rows = digests(named, "t", "sha", [c for c in named.columns if c != "t"])
    joined = lookup(rows, found, "sha", "rows", total)
    alone = F.col("rows").isNull()
    owner = F.when(alone, F.col("id")).otherwise(F.col("most"))
    # null: this row and others like it are equally entitled, so one of them is to be picked
    kept = F.when(alone, True).when(~F.col("id").eqNullSafe(owner), False).when(F.col("ties") == 1, True)
    told = joined.select(*rows.columns, owner.alias("owner"), F.coalesce("rows", F.lit(1)).alias("size"), kept.alias("kept"))
    settled = one_of_ties(told, "kept", ["sha"])
    return own_names(settled, stay, *[F.col(a).alias(b) for a, b in zip(("owner", "size", "kept", "sha"), outputs, strict=True)])
