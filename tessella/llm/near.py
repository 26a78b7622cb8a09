"""Near duplicates of a Jaccard similarity of word shingles, by SimHash fingerprints in BK-trees and confirmed on whole sets.

At similarity 0.8 64-bit fingerprints are about 10 bits apart, beyond what bit blocks can shard by. So the shards here are
the smallest shingle hashes of the texts under `FUNCTIONS` independent functions, which texts of similarity s share with
probability s each: 0.2 % of the pairs of similarity 0.8 share none, and these alone can be lost.

First each fingerprint is searched for in its shards' BK-trees with `RADIUS`, and paired with the nearest few of each
group; confirmed pairs join components. That finds crowds of copies with few comparisons, but not each link: the nearest
may be texts of one template that are not alike enough. So the shards in which several components are left are gone
through once more by `minhash.crowd_links`: all pairs of different components whose sketches agree often enough are
compared by whole sets, in tasks of bounded size, and links that join components leave them. So each pair of a shard is
confirmed or refuted, or its ends are in one component by other links.

Nulls: a null text has no words; texts without words are copies of each other. Null ids are kept, and a group of null ids
only has a null id. Texts of equal shingle sets are one node, and equal rows get equal groups. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import minhash
from tessella.llm.common import small_batches, stored, whole_text
from tessella.llm.simhash import BKTree, components, extended, root, shard_links

SHINGLE = 5
SIMILAR = 80  # of a hundred
RADIUS = 16
FUNCTIONS = 4
NEAREST = 6  # neighbours in each group that are paired in the first search, so that one that fails leaves others
CLOSE = 6  # a neighbour of a group as close as this is taken without looking for a closer one


def nearest_forest(tree: list[int], queries: list[int] | None, radius: int) -> Iterator[tuple[int, int]]:
    """Links like those of `forest`, each to the nearest few of a group, as these are likeliest to be confirmed."""
    values = list(dict.fromkeys(tree))
    extra = list(dict.fromkeys(queries)) if queries is not None else values
    bk = BKTree(values if queries is not None else ())
    parent = list(range(len(values) + (len(extra) if queries is not None else 0)))
    groups = len(values) if queries is not None else 0
    for i, x in enumerate(extra):
        best: dict[int, list[tuple[int, int]]] = {}
        close: set[int] = set()
        for j in bk.near(x, radius):
            d, r = (bk.values[j] ^ x).bit_count(), root(parent, j)
            found = best.setdefault(r, [])
            found.append((d, j))
            if len(found) > 4 * NEAREST:
                found[:] = sorted(found)[:NEAREST]
            if d <= CLOSE:
                close.add(r)
                if len(close) == groups:
                    break
        me = i if queries is None else len(values) + i
        groups += 1
        for r, found in best.items():
            parent[r] = root(parent, me)
            groups -= 1
            for _, j in sorted(found)[:NEAREST]:
                yield (x, bk.values[j])
        if queries is None:
            bk.add(x)


MARKED = "doc_id long, text_id long, fingerprint long, node long, tokens array<long>"


def fingerprint_of(shingles: np.ndarray) -> int:
    """64 bits of distinct shingle hashes as a signed number; a bit is 1 if more than half of them have it."""
    ones = np.zeros(64, np.int64)
    for a in range(0, len(shingles), 65536):
        ones += np.unpackbits(shingles[a : a + 65536].astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(shingles), bitorder="little").view("<i8")[0])


def with_marks(docs: DataFrame, n: int = SHINGLE, functions: int = FUNCTIONS) -> DataFrame:
    """doc_id, text_id, fingerprint, a hash of the shingle set (`node`) and its smallest hashes of docs (doc_id, text)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for b in batches:
            sets = [minhash.shingle_set(t, n) for t in b.column(2).to_pylist()]
            prints = pa.array([fingerprint_of(s) for s in sets], pa.int64())
            nodes = pa.array([xxh64_intdigest(s.tobytes()) - (1 << 63) for s in sets], pa.int64())
            tokens = pa.array([minhash.signature(s, functions).view(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), prints, nodes, tokens], ["doc_id", "text_id", "fingerprint", "node", "tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole_text()).alias("text_id"), whole_text().alias("text")).mapInArrow(run, MARKED)


def tree_pairs(lists: DataFrame, nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): nodes whose fingerprints the trees of their shards find near, and each with the first of its fingerprint."""
    keyed = lists.join(nodes.select("node", "fingerprint"), "node").select(F.lit(0).alias("table"), F.col("token").alias("shard"), "fingerprint").distinct()
    found = stored(shard_links(keyed, radius, join=nearest_forest), "near-links").toDF("a_print", "b_print")
    heads = nodes.groupBy("fingerprint").agg(F.min("node").alias("head"))
    one, two = heads.toDF("a_print", "a"), heads.toDF("b_print", "b")
    across = found.join(one, "a_print").join(two, "b_print").select("a", "b")
    within = nodes.join(heads, "fingerprint").where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    return across.union(within).where("a <> b").distinct()


def linked(nodes: DataFrame, docs: DataFrame, similar: int = SIMILAR, n: int = SHINGLE, radius: int = RADIUS, part: int = minhash.PART) -> DataFrame:
    """(node, component) of the nodes (node, text_id, fingerprint, tokens) that have a link, from confirmed pairs."""
    posts = stored(nodes.select(F.explode("tokens").alias("token"), "node"), "near-posts")
    lists = stored(posts.join(posts.groupBy("token").agg(F.count("*").alias("n")).where("n > 1"), "token").select("token", "node"), "near-lists")
    pairs = stored(tree_pairs(lists, nodes, radius), "near-pairs")
    asked = nodes.join(lists.select("node").union(pairs.select("a")).union(pairs.select("b")).distinct(), "node", "left_semi")
    sets = stored(minhash.shingle_sets(docs, asked.select("node", "text_id"), n), "shingle-sets")
    links = stored(minhash.confirmed(pairs, sets, similar), "links")
    joined = stored(components(links), "components")
    known = sets.join(joined, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "sketch", "shingles")
    more = stored(minhash.crowd_links(lists, known, similar, part=part), "links")
    return joined if more.isEmpty() else stored(extended(joined, more), "components")


def near_groups(docs: DataFrame, similar: int = SIMILAR, n: int = SHINGLE, radius: int = RADIUS, part: int = minhash.PART) -> DataFrame:
    """doc_id, group_id (the smallest doc_id reachable by pairs of that similarity) of docs (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    marked = stored(with_marks(docs, n), "near-marks")
    nodes = marked.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.min("text_id").alias("text_id"), F.first("fingerprint").alias("fingerprint"), F.first("tokens").alias("tokens"))
    nodes = stored(nodes, "near-nodes")
    joined = linked(nodes, docs, similar, n, radius, part)
    grouped = nodes.join(joined, "node", "left").select("node", "first_id", F.coalesce("component", "node").alias("component"))
    least = grouped.groupBy("component").agg(F.min("first_id").alias("group_id"))
    return marked.select("doc_id", "node").join(grouped.join(least, "component").select("node", "group_id"), "node").select("doc_id", "group_id")


def without_near_duplicates(docs: DataFrame, similar: int = SIMILAR, n: int = SHINGLE) -> DataFrame:
    """docs, all columns, with the document of the smallest doc_id of each group of near copies; rows of that id all stay,
    and rows of a null id stay if a group has no other. Texts without words are copies of each other."""
    kept = near_groups(docs, similar, n).where("doc_id <=> group_id").select(F.col("doc_id").alias("_near_kept")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_near_kept")), "left_semi")
