"""SimHash near-duplicates through BK-trees (operator 5).

Fingerprints that differ in at most ``radius`` bits agree exactly in at least ``agree`` of the
``blocks`` parts the 64 bits are cut into (radius 4, six parts: at least two), so each fingerprint
goes to one shard for every choice of parts and the values it has there, and any two within the
radius meet in a shard. A shard's distinct fingerprints form a BK-tree: a node's children are keyed
by their Hamming distance to it, and a search follows only the edges within the radius of the
query's distance. Trees travel with the shuffle to the task that holds the shard's queries; sent to
all executors through the driver they would be the fingerprints of all documents, which have no
size bound.

A shard gives a spanning forest of its links, not all pairs: tree edges within the radius are links
already, and the search leaves out subtrees that lie wholly in the query's own component. The
fingerprints of a shard of over ``most`` of them are handed back and dealt anew by the bits that the
shard does not fix, cut into parts likewise; so no tree grows with the largest shard, nothing is paired
with everything, and no link is lost. Links of all shards become components by alternating large-star
and small-star steps over staged tables.

Edge cases: texts without words (null, empty, blank) have fingerprint zero, which links like any
other; fewer words than a shingle give one shingle of all of them; equal fingerprints are one node
however many documents have them (repeated rows as well); identifiers may be of any type that has an
order; rows with a null identifier belong to their component but cannot name it unless all do; texts
of any length are read whole; ties between representatives are settled as ``representatives`` says;
an empty table gives an empty result; other columns have no influence whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import combinations, count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelet.llm.common import discard, lookup, map_arrow, map_text, one_of_each, own_names, plain_names, quoted, reading, staged

SHINGLE = 4
SEED = 42
RADIUS = 4
BLOCKS = 6
#: Fingerprints in one tree at most.
MOST = 20_000
#: (query, node) pairs searched at once.
FRONT = 1 << 20


def bit_counts(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many hashes of each group set each of the 64 bits, highest bit first."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, 64)
    return np.add.reduceat(bits, starts, axis=0, dtype=np.int64)


def fingerprints(texts: list[bytes | None], shingle: int = SHINGLE, most: int = 1 << 18) -> np.ndarray:
    """Unsigned 64-bit SimHash of each text; ``most`` hashes are expanded to bits at once."""
    digest, seed = xxhash.xxh64_intdigest, SEED
    counts = np.zeros((len(texts), 64), np.int64)
    sizes = np.zeros(len(texts), np.int64)
    held: list[int] = []
    at: list[tuple[int, int]] = []

    def flush() -> None:
        if held:
            rows = np.array([r for r, _ in at])
            np.add.at(counts, rows, bit_counts(np.array(held, np.uint64), np.array([s for _, s in at])))
            held.clear()
            at.clear()

    for row, text in enumerate(texts):
        words = (text or b"").lower().split()
        if not words:
            continue
        n = max(1, len(words) - shingle + 1)
        sizes[row] = n
        if n == 1:
            made = [digest(b" ".join(words), seed)]
        else:
            line = b" ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words]) - 1
            starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
            made = [digest(line[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]
        for start in range(0, n, most):
            part = made[start : start + most]
            if len(held) + len(part) > most:
                flush()
            at.append((row, len(held)))
            held += part
    flush()
    bits = (2 * counts > sizes[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1).view(">u8").reshape(-1).astype(np.uint64)


class BKTree:
    """A BK-tree over distinct fingerprints; built and searched level by level, for all at once."""

    def __init__(self, points: np.ndarray) -> None:
        self.points = points
        n = len(points)
        self.parent = np.full(n, -1, np.int64)
        self.edge = np.zeros(n, np.int64)
        self.levels: list[np.ndarray] = [np.zeros(min(n, 1), np.int64)]
        # all points wait at a node; of those that wait for the same (node, distance) the first becomes
        # that child, and the others wait there
        waiting, node = np.arange(1, n), np.zeros(max(0, n - 1), np.int64)
        while len(waiting):
            d = np.bitwise_count(points[waiting] ^ points[node]).astype(np.int64)
            _, first, group = np.unique(node * 65 + d, return_index=True, return_inverse=True)
            child = waiting[first]
            self.parent[child], self.edge[child] = node[first], d[first]
            self.levels.append(child)
            stay = np.ones(len(waiting), bool)
            stay[first] = False
            node, waiting = child[group][stay], waiting[stay]
        order = np.argsort(self.parent[1:], kind="stable") + 1
        self.children = order
        self.first = np.searchsorted(self.parent[order], np.arange(n + 1)) if n else np.zeros(1, np.int64)

    def uniform(self, label: np.ndarray) -> np.ndarray:
        """The label that all of a node's subtree has, or -1."""
        low, high = label.copy(), label.copy()
        for level in self.levels[:0:-1]:
            np.minimum.at(low, self.parent[level], low[level])
            np.maximum.at(high, self.parent[level], high[level])
        return np.where(low == high, low, -1)

    def search(self, queries: np.ndarray, radius: int, skip: tuple[np.ndarray, np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, node) pairs within the radius. skip: a label of each query and ``uniform`` labels; subtrees of the query's own label are left out."""
        if not len(self.points):
            return
        todo = [(part, np.zeros(len(part), np.int64)) for part in np.array_split(np.arange(len(queries)), -(-len(queries) // (FRONT >> 4))) if len(part)]
        while todo:
            q, node = todo.pop()
            if len(q) > FRONT:
                todo += [(q[FRONT:], node[FRONT:])]
                q, node = q[:FRONT], node[:FRONT]
            if skip is not None:
                open_ = skip[0][q] != skip[1][node]
                q, node = q[open_], node[open_]
            if not len(q):
                continue
            d = np.bitwise_count(queries[q] ^ self.points[node]).astype(np.int64)
            near = d <= radius
            if near.any():
                yield q[near], node[near]
            n = self.first[node + 1] - self.first[node]
            total = int(n.sum())
            if not total:
                continue
            of = np.repeat(np.arange(len(q)), n)
            child = self.children[np.arange(total) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[node], n)]
            go = np.abs(self.edge[child] - d[of]) <= radius
            todo.append((q[of[go]], child[go]))


def rooted(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Smallest index connected to each of n points by the links (a, b), starting from ``label``."""
    label = np.arange(n) if label is None else label.copy()
    while True:
        la, lb = label[a], label[b]
        low = np.minimum(la, lb)
        if np.array_equal(la, lb):
            return label
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up


def forest(points: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links (indices) that connect exactly what links within the radius connect."""
    tree = BKTree(points)
    child = np.nonzero((tree.parent >= 0) & (tree.edge <= radius))[0]
    label = rooted(len(points), child, tree.parent[child])
    pairs = [(child, tree.parent[child])]
    for q, node in tree.search(points, radius, (label, tree.uniform(label))):
        other = label[q] != label[node]
        pairs.append((q[other], node[other]))
    a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
    # one link to each component's smallest point says the same
    final = rooted(len(points), a, b, label)
    away = np.nonzero(final != np.arange(len(points)))[0]
    return away, final[away]


def masks(fixed: int, radius: int, blocks: int) -> list[int]:
    """The choices of parts that must agree, as bit masks, where the bits of ``fixed`` agree already: the other bits are cut into ``blocks`` parts."""
    free = [1 << b for b in range(63, -1, -1) if not fixed >> b & 1]
    ends = [len(free) * i // blocks for i in range(blocks + 1)]
    parts = [sum(free[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
    return sorted({fixed | sum(chosen) for chosen in combinations(parts, blocks - radius)})


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def shard_keys(points: DataFrame, fp: str, choices: Sequence[int]) -> DataFrame:
    """Fingerprints once for each choice of parts, with the key of the shard: the choice (k) and the values there (v)."""
    keys = [F.struct(F.lit(signed(m)).alias("k"), F.col(fp).bitwiseAND(F.lit(signed(m))).alias("v")) for m in choices]
    return points.select(F.col(fp).alias("p"), F.inline(F.array(*keys))).select("k", "v", "p")


FOUND = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType()), T.StructField("k", T.LongType())])


def shard_links(radius: int, blocks: int, most: int):
    """Rows (k, v, fingerprint) sorted by all three -> links (u, v, null). A row that two choices have led to counts once.

    The fingerprints of shards over ``most`` come back as (fingerprint, null, k), unless there are not
    enough bits left to cut them further; these have at most 2 ** blocks fingerprints.
    """
    none = lambda n: pa.nulls(n, pa.int64())
    cuttable = lambda k: 64 - int(k & ((1 << 64) - 1)).bit_count() > blocks

    def handed_back(k: np.ndarray, p: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), none(len(p)), pa.array(k, pa.int64())], names=FOUND.names)

    def solve(points: np.ndarray, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        us, vs = [], []
        for start, end in bounds:
            mine = points[start:end]
            if end - start == 2:
                if np.bitwise_count(mine[0] ^ mine[1]) <= radius:
                    us.append(mine[1:])
                    vs.append(mine[:1])
                continue
            a, b = forest(mine, radius)
            if len(a):
                us.append(mine[a])
                vs.append(mine[b])
        if us:
            u, v = np.concatenate(us).view(np.int64), np.concatenate(vs).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), none(len(u))], names=FOUND.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.empty(0, np.int64)] * 3
        over = None  # the shard whose rows are being handed back
        for batch in batches:
            k, v, p = (np.concatenate([r, c.to_numpy(zero_copy_only=False).astype(np.int64)]) for r, c in zip(rest, batch.columns, strict=True))
            if over is not None:
                same = (k == over[0]) & (v == over[1])
                if same.any():
                    yield handed_back(k[same], p[same])
                    k, v, p = k[~same], v[~same], p[~same]
                if len(k):
                    over = None
            if not len(k):
                rest = [k, v, p]
                continue
            new = np.concatenate(([True], (np.diff(k) != 0) | (np.diff(v) != 0) | (np.diff(p) != 0)))
            k, v, p = k[new], v[new], p[new]
            cut = np.nonzero((np.diff(k) != 0) | (np.diff(v) != 0))[0] + 1
            start = np.concatenate(([0], cut))
            tail = start[-1]
            ends = start[1:]
            start = start[:-1]
            rest = [k[tail:], v[tail:], p[tail:]]
            large = [e - s > most and cuttable(int(k[s])) for s, e in zip(start.tolist(), ends.tolist(), strict=True)]
            for s, e in zip(start[large], ends[large], strict=True):
                yield handed_back(k[s:e], p[s:e])
            start, ends = start[~np.array(large, bool)], ends[~np.array(large, bool)]
            if len(rest[0]) > most and cuttable(int(rest[0][0])):
                over = (int(rest[0][0]), int(rest[1][0]))
                yield handed_back(rest[0], rest[2])
                rest = [x[:0] for x in rest]
            pairs = ends - start > 1
            yield from solve(p.view(np.uint64), np.stack([start[pairs], ends[pairs]], 1))
        if len(rest[0]) > 1:
            yield from solve(rest[2].view(np.uint64), np.array([[0, len(rest[0])]]))

    return run


def links(points: DataFrame, fp: str = "fp", radius: int = RADIUS, blocks: int = BLOCKS, most: int = MOST) -> DataFrame:
    """Links (u, v) between distinct fingerprints (signed) that connect exactly what links within the radius connect.

    Shards over ``most`` are dealt anew by their other bits, again and again: there too any two within
    the radius agree in some parts. Each time about a third of those bits becomes the same, so with 64
    bits it takes four turns at most until no shard can have 20,000 fingerprints.
    """
    if blocks <= radius:
        raise ValueError("there must be more parts than differing bits")
    found_so_far, tables, keyed = [], [], shard_keys(points, fp, masks(0, radius, blocks))
    for turn in count():
        found = staged(map_arrow(keyed.repartition("k", "v").sortWithinPartitions("k", "v", "p"), shard_links(radius, blocks, most), FOUND), f"shards{turn}")
        tables.append(found)
        found_so_far.append(found.where("k IS NULL").select("u", "v"))
        large = found.where("k IS NOT NULL").select("k", F.col("u").alias("p"))
        choices = [r["k"] for r in large.select("k").distinct().collect()]  # some of the masks of this turn, whose number is fixed
        if not choices:
            return reading(reduce(DataFrame.unionByName, found_so_far), *tables)
        spark = points.sparkSession
        deeper = spark.createDataFrame([(k, [signed(m) for m in masks(k & ((1 << 64) - 1), radius, blocks)]) for k in sorted(choices)], "k long, masks array<long>")
        again = large.join(F.broadcast(deeper), "k").select("p", F.explode("masks").alias("k"))
        keyed = again.select("k", F.col("p").bitwiseAND(F.col("k")).alias("v"), "p")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the links (u, v): the smallest node connected to it.

    Each round turns every node's links towards its smallest neighbour, first for the larger
    neighbours (large star), then for the smaller ones (small star). Smallest neighbours come from
    partial aggregation; the hub of a large star looks its own up by broadcast (``lookup``), so no
    task gathers its links. Every round that changes anything lowers a link, so rounds end by
    themselves; their number grows with the logarithm of the longest path.
    """
    now = staged(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    for turn in count():
        n = now.count()
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("links"))
        large = staged(lookup(both.where("v > u"), least, "u", "links", 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), f"large{turn}")
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("links"))
        met = lookup(large, low, "u", "links", n)
        small = met.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        before, now = now, staged(small, f"small{turn}")
        discard(before, large)
        # settled when every node has one link, and none leads to a node that has a link itself
        degrees = now.groupBy("u").agg(F.count(F.lit(1)).alias("links"))
        if degrees.where("links > 1").isEmpty() and now.select(F.col("v").alias("u")).distinct().join(degrees, "u", "left_semi").isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def fingerprinted(docs: DataFrame, text_col: str = "text", out: str = "fp", shingle: int = SHINGLE, keep: list[str] | None = None) -> DataFrame:
    """Append the fingerprint as a signed long."""
    return map_text(docs, text_col, [(out, T.LongType(), pa.int64())], lambda texts: (pa.array(fingerprints(texts, shingle).view(np.int64), pa.int64()),), keep)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, radius: int = RADIUS, shingle: int = SHINGLE, blocks: int = BLOCKS, most: int = MOST) -> DataFrame:
    """The columns of ``keep``, then fp, root (smallest fingerprint of the component) and component_id (its smallest identifier) of each row."""
    outputs = ("fp", "root", "component_id")
    stay = [c for c in ([id_col] if keep is None else keep) if c.lower() not in outputs]
    rows = plain_names(docs, stay, quoted(id_col).alias("id"), quoted(text_col).cast("string").alias("t"))
    marked = staged(fingerprinted(rows, "t", "fp", shingle, [c for c in rows.columns if c != "t"]), "fingerprints")
    distinct = staged(marked.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("rows")), "distinct")
    total = distinct.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).first()["n"]
    near = links(distinct.select("fp"), "fp", radius, blocks, most)
    roots = components(near)
    discard(near)  # components has written what it needs of them
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    found = lookup(marked, named.join(least, "root").select("fp", "rows", "root", "component_id"), "fp", "rows", total)
    return own_names(found, stay, *outputs)


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` that stay when one of each component does: the one with the smallest identifier.

    Of different texts with that identifier the one with the smaller hash stays, of rows that have the
    text in common too the one with the smallest hash of all columns; only such rows need a rank. The
    texts are shuffled once, to meet the chosen identifiers.
    """
    key, text_hash = quoted(id_col), F.xxhash64(quoted(text_col).cast("string"))
    plain = plain_names(docs, docs.columns, key.alias("id"), text_hash.alias("th"))
    marked = near_duplicates(docs.select(key.alias("id"), text_hash.alias("th"), quoted(text_col).cast("string").alias("t")), "id", "t", ["id", "th"], **settings)
    entitled = marked.where(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("root", "id", "th").agg(F.count(F.lit(1)).alias("n"))
    chosen = entitled.groupBy("root").agg(F.min(F.struct("th", "id", "n")).alias("c")).select(F.col("c.id").alias("cid"), F.col("c.th").alias("cth"), F.col("c.n").alias("n"))
    met = plain.join(chosen, F.col("id").eqNullSafe(F.col("cid")) & (F.col("th") == F.col("cth")))
    one = one_of_each(met.where("n > 1"), ["id", "th"], "one").where("one").drop("one")
    return own_names(met.where("n = 1").unionByName(one), docs.columns)


def hexed(fp: str):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
