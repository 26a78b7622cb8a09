"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked at a small Hamming distance with BK-trees.

A BK-tree keeps a fingerprint at each node and its children by their integer Hamming distance to it; a search within
radius r around a fingerprint at distance d from a node follows only the edges from d - r to d + r.

One tree over a corpus would be walked almost whole for random fingerprints, so the fingerprints are sharded first: the
bits are cut into `BLOCKS` blocks, and two fingerprints within the radius agree on BLOCKS - radius blocks at least. Each
choice of that many blocks is a table, and the bits of the chosen blocks name a shard in it: linked fingerprints meet in
one shard at least, so nothing is lost. A shard's tree holds its distinct fingerprints. A shard of more than `SHARD`
fingerprints is cut into parts of at most about that many, each part's tree is sent (replicated) to one task for each
part whose fingerprints it is searched with, and so a crowded shard is spread over tasks and none holds it whole.

Within a task links become a forest by union-find, so a crowd of n near copies gives n - 1 links and not n^2 / 2.
Components of the links are found by contracting the graph on tables, stored in the shared folder.

Nulls: a null text has no words, thus the fingerprint zero, linked like any other. Null ids are kept, and a component of
null ids only has a null id. Repeated rows share a fingerprint and a component.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import small_batches, stored, whole_text

RADIUS = 4
SHINGLE = 4
SEED = 42
SHARD = 2048
#: Fingerprints up to which so many blocks give shards of a few: with b blocks a shard's name has 64 (b - r) / b bits.
BLOCKS = ((2_000_000, 6), (200_000_000, 7), (1 << 62, 8))


def shingles(text: str, n: int = SHINGLE) -> list[bytes]:
    w = text.encode("utf-8", "replace").lower().split()
    if not w:
        return []
    return [b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [b" ".join(w)]


def fingerprints_of(texts: list[str], n: int = SHINGLE) -> np.ndarray:
    """Fingerprints as unsigned numbers; bit i is 1 if more than half the hashes have it."""
    from xxhash import xxh64_intdigest

    out = np.zeros(len(texts), np.uint64)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for i, t in enumerate(texts):
        h = np.array([xxh64_intdigest(s, SEED) for s in shingles(t, n)], np.uint64)
        if not len(h):
            continue
        ones = np.zeros(64, np.int64)
        for a in range(0, len(h), 65536):
            ones += np.unpackbits(h[a : a + 65536].astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
        out[i] = weights[2 * ones > len(h)].sum(dtype=np.uint64)
    return out


def with_fingerprint(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """doc_id and fingerprint (the 64 bits as a signed long)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = fingerprints_of(b.column(1).to_pylist(), n)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f.view(np.int64))], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(run, "doc_id long, fingerprint long")


class BKTree:
    """Distinct numbers; children are keyed by their Hamming distance to the parent."""

    def __init__(self, items=()):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []
        for x in items:
            self.add(x)

    def add(self, x: int) -> None:
        if not self.values:
            self.values.append(x)
            self.children.append({})
            return
        node = 0
        while d := (self.values[node] ^ x).bit_count():
            after = self.children[node].get(d)
            if after is None:
                self.children[node][d] = len(self.values)
                self.values.append(x)
                self.children.append({})
                return
            node = after

    def near(self, x: int, radius: int) -> Iterator[int]:
        """Positions of the values within the radius."""
        todo = [0] if self.values else []
        while todo:
            node = todo.pop()
            d = (self.values[node] ^ x).bit_count()
            if d <= radius:
                yield node
            for edge, child in self.children[node].items():
                if d - radius <= edge <= d + radius:
                    todo.append(child)


def root(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def forest(tree: list[int], queries: list[int] | None, radius: int) -> Iterator[tuple[int, int]]:
    """Links (larger, smaller) that join what the radius joins: within `tree`, or from `queries` to it."""
    values = list(dict.fromkeys(tree))
    bk = BKTree(values)
    values = bk.values
    extra = list(dict.fromkeys(queries)) if queries is not None else []
    parent = list(range(len(values) + len(extra)))
    for i, x in enumerate(values if queries is None else extra):
        me = i if queries is None else len(values) + i
        for j in bk.near(x, radius):
            a, b = root(parent, me), root(parent, j)
            if a != b:
                parent[a] = b
                yield (x, values[j])


def block_masks(blocks: int, radius: int) -> list[int]:
    edges = [64 * i // blocks for i in range(blocks + 1)]
    bits = [((1 << (b - a)) - 1) << a for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return [sum(c) for c in combinations(bits, blocks - radius)]


LINKS = "a long, b long"


def link_stage(radius: int, join=forest):
    """Rows sorted by shard: a part's tree and the fingerprints it is searched with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(key, tree, queries):
            # A task for one part twice looks for links in it, one for two parts looks across.
            return join(tree, queries if key[2] != key[3] else None, radius) if key and tree else ()

        key, tree, queries, out = None, [], [], []
        for b in batches:
            for table, shard, i, j, role, f in zip(*(b.column(c).to_pylist() for c in range(6)), strict=True):
                if (at := (table, shard, i, j)) != key:
                    out += found(key, tree, queries)
                    key, tree, queries = at, [], []
                (queries if role else tree).append(f & (1 << 64) - 1)
            if out:
                links = np.array(out, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["a", "b"])
                out = []
        out += found(key, tree, queries)
        if out:
            links = np.array(out, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["a", "b"])

    return run


def links(prints: DataFrame, radius: int = RADIUS, shard: int = SHARD, blocks: int | None = None) -> DataFrame:
    """(a, b) pairs of distinct fingerprints within the radius that connect all such pairs; prints: distinct `fingerprint`."""
    if blocks is None:
        n = prints.count()
        blocks = next(b for most, b in BLOCKS if n <= most)
    tables = F.posexplode(F.array(*[F.col("fingerprint").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)) for m in block_masks(blocks, radius)]))
    return shard_links(prints.select("fingerprint", tables.alias("table", "shard")), radius, shard)


def shard_links(keyed: DataFrame, radius: int, shard: int = SHARD, join=forest) -> DataFrame:
    """(a, b) pairs within the radius of fingerprints that share a shard: keyed has distinct (table, shard, fingerprint)."""
    sizes = keyed.groupBy("table", "shard").agg(F.count("*").alias("n")).where("n > 1").withColumn("parts", F.ceil(F.col("n") / F.lit(float(shard))).cast("int"))
    crowded = keyed.join(sizes, ["table", "shard"]).withColumn("part", F.expr("cast(pmod(xxhash64(fingerprint), parts) as int)"))
    # A part is searched with itself and with each part after it: it is the tree for all of these.
    task = F.explode(F.expr(
        "concat(transform(sequence(part, parts - 1), j -> struct(part as i, j as j, 0 as role)),"
        " transform(if(part > 0, sequence(0, part - 1), cast(array() as array<int>)), i -> struct(i as i, part as j, 1 as role)))"
    ))
    rows = crowded.select("table", "shard", task.alias("t"), "fingerprint").select("table", "shard", "t.i", "t.j", "t.role", "fingerprint")
    small_batches(keyed.sparkSession)
    return rows.repartition("table", "shard", "i", "j").sortWithinPartitions("table", "shard", "i", "j", "role", "fingerprint").mapInArrow(link_stage(radius, join), LINKS).distinct()


def components(edges: DataFrame, jumps: int = 2) -> DataFrame:
    """(node, component) for all ends of edges (a, b): the smallest node that can be reached.

    Each round maps every node to the one next to it (or itself) that comes first in a hashed order, jumps along these
    maps, and goes on with the edges between what nodes were mapped to: their number falls by a factor each round, also
    on long paths. The rounds' maps are composed last.
    """
    ends = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    left = stored(edges.where("a <> b").select(*ends("a", "b")).distinct(), "links")
    maps: list[DataFrame] = []
    while not (maps and left.isEmpty()):
        order = lambda c: F.struct(F.xxhash64(c, F.lit(len(maps))).alias("h"), F.col(c).alias("x"))  # noqa: B023, E731
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min(order("b")).alias("first"))
        mapped = stored(first.select(F.col("a").alias("node"), F.least(order("a"), F.col("first"))["x"].alias("label")), "map")
        for _ in range(jumps):
            onward = mapped.select(F.col("node").alias("via"), F.col("label").alias("jump"))
            mapped = mapped.join(onward, F.col("label") == F.col("via")).select("node", F.col("jump").alias("label"))
        mapped = stored(mapped, "map")
        maps.append(mapped)
        x, y = mapped.select(F.col("node").alias("a"), F.col("label").alias("x")), mapped.select(F.col("node").alias("b"), F.col("label").alias("y"))
        left = stored(left.join(x, "a").join(y, "b").where("x <> y").select(*ends("x", "y")).distinct(), "links")
    found = maps.pop()
    while maps:  # a node that the later rounds don't have has arrived
        later = found.select(F.col("node").alias("via"), F.col("label").alias("last"))
        found = maps.pop().join(later, F.col("label") == F.col("via"), "left").select("node", F.coalesce("last", "label").alias("label"))
    found = stored(found, "map")
    least = found.groupBy("label").agg(F.min("node").alias("component"))
    return found.join(least, "label").select("node", "component")


def extended(joined: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) of the components joined (node, component) and further links (a, b) between their nodes or new ones.
    Only components that the links join are gone through again."""
    x, y = joined.toDF("a", "x"), joined.toDF("b", "y")
    between = stored(links.join(x, "a", "left").join(y, "b", "left").select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")).distinct(), "links")
    ends = links.select(F.col("a").alias("node")).union(links.select("b")).distinct().join(joined, "node", "left_anti")
    both = joined.select("node", "component").union(ends.select("node", F.col("node").alias("component")))
    return both.join(components(between).toDF("component", "wider"), "component", "left").select("node", F.coalesce("wider", "component").alias("component"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id (the smallest doc_id reachable) of docs (doc_id, text)."""
    marked = stored(with_fingerprint(docs, shingle), "fingerprints")
    prints = marked.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id"))
    joined = components(links(prints.select("fingerprint"), radius))
    grouped = prints.join(joined, prints["fingerprint"] == joined["node"], "left").select("fingerprint", "first_id", F.coalesce("component", "fingerprint").alias("component"))
    least = grouped.groupBy("component").agg(F.min("first_id").alias("component_id"))
    ids = grouped.join(least, "component").select("fingerprint", "component_id")
    out = marked.join(ids, "fingerprint")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
