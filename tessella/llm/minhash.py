"""MinHash near-duplicates by an inverted join on signature coordinates, confirmed on whole shingle sets.

A text's set is that of its distinct four-word shingles, and texts of equal sets are one node. A node's signature has the
smallest hash of its set under `COORDINATES` independent functions; texts of similarity s agree in each with probability
s. A node is posted under each (coordinate, value) pair, and pairs that collide `MATCHES` times at least are kept: at
similarity 0.8 the chance that a pair has fewer is 4e-5.

Prefixes: values that no other node has are left out, and a node with fewer than `MATCHES` others can't be in a pair. The
pairs of the rest stand in order of how many nodes have them, and of m only the m - MATCHES + 1 rarest are joined, as two
nodes that share `MATCHES` share one of these. Skips: the other lists are never merged; the collisions of a pair that met
are counted on both signatures.

Posting lists can be as long as a crowd of copies, so pairs in them are not all made. First each node is paired with the
first node of its lists, and confirmed links join components. Then only lists with several components are left: the
largest component's nodes and the others' are cut into parts by the bytes of their sets, each two of which are one task.
There collisions are counted on a longer signature, of which a byte of each value is kept (`SKETCH` bytes, of which
`SKETCH_MATCHES` must be equal; at similarity 0.8 the chance of fewer is 2e-5). What has enough is compared by whole sets,
those with most collisions first, until the node is in the other's component; and only links that join components leave
the task. So every pair with enough collisions is confirmed or refuted, or its ends are in one component by other links.

Nulls: a null text, or one without words, has no shingles and is linked with nothing. Null ids are kept; a component of
null ids only has a null id. Equal rows are one node and each gets its row. An empty table gives no rows. Of docs only
doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.llm.common import small_batches, stored, whole_text
from tessella.llm.simhash import components

SHINGLE = 4
SIMILAR = 80  # of a hundred
COORDINATES = 32
MATCHES = 16
SKETCH = 128
SKETCH_MATCHES = 83
#: Bytes of the sets in a part of a list.
PART = 8 << 20
#: Pairs of one node that are joined to it in one task.
FAN = 4096
#: Comparisons of coordinates, and hashes, that a task makes at a time.
CELLS = 1 << 20

WIDE = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> WIDE(30))) * WIDE(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> WIDE(27))) * WIDE(0x94D049BB133111EB)
    return x ^ (x >> WIDE(31))


def shingle_set(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """Hashes of the distinct n-word shingles, in order; of the whole sequence if it has fewer words, none without words."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    h = np.fromiter(map(xxh64_intdigest, words), WIDE, len(words))
    if not len(h):
        return h
    k = min(n, len(h))
    places = mixed(np.arange(1, n + 1, dtype=WIDE)) | WIDE(1)
    sums = np.zeros(len(h) - k + 1, WIDE)
    for i in range(k):
        sums += mixed(h[i : len(h) - k + 1 + i] * places[i])
    return np.unique(mixed(sums + WIDE(k)))


def signature(shingles: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """The smallest hash under each function, its lowest bits replaced by the function's number."""
    seeds = mixed(np.arange(1, coordinates + 1, dtype=WIDE) * WIDE(0x9E3779B97F4A7C15))[:, None]
    out = np.full(coordinates, ~WIDE(0))
    step = CELLS // coordinates
    for at in range(0, len(shingles), step):
        out = np.minimum(out, mixed(shingles[None, at : at + step] ^ seeds).min(1))
    low = WIDE((1 << (coordinates - 1).bit_length()) - 1)
    return out & ~low | np.arange(coordinates, dtype=WIDE)


def with_signature(docs: DataFrame, n: int = SHINGLE, coordinates: int = COORDINATES) -> DataFrame:
    """doc_id, text_id, n_shingles, node (a hash of the set, null without one) and tokens (the signature) of docs."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for b in batches:
            sets = [shingle_set(t, n) for t in b.column(2).to_pylist()]
            nodes = [xxh64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None for s in sets]
            tokens = [signature(s, coordinates).view(np.int64) if len(s) else None for s in sets]
            columns = [pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.int64()), pa.array(tokens, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], ["doc_id", "text_id", "n_shingles", "node", "tokens"])

    one = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole_text()).alias("text_id"), whole_text().alias("text"))
    return one.mapInArrow(run, "doc_id long, text_id long, n_shingles long, node long, tokens array<long>")


def sketch(shingles: np.ndarray, size: int = SKETCH) -> bytes:
    """A byte of the smallest hash under each of `size` functions, other than those of the signature."""
    return ((signature(mixed(shingles + WIDE(1)), size) >> WIDE(40)) & WIDE(255)).astype(np.uint8).tobytes()


def shingle_sets(docs: DataFrame, asked: DataFrame, n: int = SHINGLE) -> DataFrame:
    """(node, shingles, sketch) of asked (node, text_id), from the texts of docs."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t, n) for t in b.column(1).to_pylist()]
            columns = [pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array([sketch(s) for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["text_id", "shingles", "sketch"])

    texts = docs.select(F.xxhash64(whole_text()).alias("text_id"), whole_text().alias("text")).join(asked, "text_id", "left_semi")
    sets = texts.dropDuplicates(["text_id"]).mapInArrow(run, "text_id long, shingles array<long>, sketch binary")
    return sets.join(asked.select("text_id", "node"), "text_id").select("node", "shingles", "sketch")


def prefixes(nodes: DataFrame, matches: int = MATCHES) -> DataFrame:
    """(token, node): the rarest tokens that each of nodes (node, tokens) shares, as many as a pair must have one of."""
    posts = nodes.select("node", F.explode("tokens").alias("token"))
    sizes = posts.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    w = Window.partitionBy("node")
    ranked = posts.join(sizes, "token").withColumn("place", F.row_number().over(w.orderBy("n", "token"))).withColumn("m", F.count(F.lit(1)).over(w))
    return ranked.where(F.col("place") <= F.col("m") - matches + 1).select("token", "node")


def beside(pairs: DataFrame, end: str, known: DataFrame, column: str) -> DataFrame:
    """pairs with `column` of known (node, column) for the node in `end`, named by `end`. A node of many pairs is dealt to
    tasks by the other end's hash, `FAN` pairs or so each."""
    other = "b" if end == "a" else "a"
    fans = pairs.groupBy(F.col(end).alias("node")).agg(F.ceil(F.count("*") / F.lit(float(FAN))).cast("int").alias("fan"))
    dealt = pairs.join(fans.where("fan > 1").withColumnRenamed("node", end), end, "left").withColumn("salt", F.pmod(F.xxhash64(other), F.coalesce("fan", F.lit(1))).cast("int")).drop("fan")
    spread = known.join(fans, "node").select(F.col("node").alias(end), F.col(column).alias(f"{column}_{end}"), F.explode(F.sequence(F.lit(0), F.col("fan") - 1)).alias("salt"))
    return dealt.join(spread, [end, "salt"]).drop("salt")


def confirmed(pairs: DataFrame, sets: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """The pairs (a, b) whose whole sets have the similarity."""
    both = beside(beside(pairs, "a", sets, "shingles"), "b", sets, "shingles")
    both = both.select("a", "b", F.size("shingles_a").alias("x"), F.size("shingles_b").alias("y"), F.size(F.array_intersect("shingles_a", "shingles_b")).alias("shared"))
    return both.where(100 * F.col("shared") >= similar * (F.col("x") + F.col("y") - F.col("shared"))).select("a", "b")


def first_pairs(lists: DataFrame, nodes: DataFrame, matches: int = MATCHES) -> DataFrame:
    """(a, b): each node with the first node of each of its lists, if they collide often enough."""
    leaders = lists.groupBy("token").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1").select("token", "a")
    pairs = lists.join(leaders, "token").where("node <> a").select("a", F.col("node").alias("b")).distinct()
    both = beside(beside(stored(pairs, "first-pairs"), "a", nodes, "tokens"), "b", nodes, "tokens")
    return both.where(F.size(F.array_intersect("tokens_a", "tokens_b")) >= matches).select("a", "b")


def joining(tree: list, queries: list, matches: int = SKETCH_MATCHES, similar: int = SIMILAR) -> Iterator[tuple[int, int]]:
    """Links of a query and a node of the tree that join all components that links between the two join. Rows are (node,
    component, sketch, set in order)."""
    parent: dict[int, int] = {}

    def root(c: int) -> int:
        while (above := parent.get(c, c)) != c:
            parent[c] = parent.get(above, above)
            c = above
        return c

    comps = np.array([r[1] for r in tree], np.int64)
    sizes = np.array([len(r[3]) for r in tree])
    bytes_of = lambda rows: np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(len(rows), -1)
    t = bytes_of(tree)
    step = max(1, 4 * CELLS // max(1, t.size))
    for at in range(0, len(queries), step):
        part = queries[at : at + step]
        same = np.count_nonzero(bytes_of(part)[:, None, :] == t[None, :, :], axis=2)
        for (node, comp, _, own), hits in zip(part, same, strict=True):
            left = np.nonzero((hits >= matches) & (comps != comp))[0]
            left = left[np.argsort(-hits[left], kind="stable")]
            most = 8
            while len(left):
                left = left[[root(c) != root(comp) for c in comps[left].tolist()]]
                now, left = left[:most], left[most:]
                if not len(now):
                    break
                whole = np.concatenate([tree[k][3] for k in now])
                found = own[np.minimum(np.searchsorted(own, whole), len(own) - 1)] == whole
                shared = np.add.reduceat(found, np.concatenate([[0], np.cumsum(sizes[now])[:-1]]), dtype=np.int64)
                for k in now[100 * shared >= similar * (sizes[now] + len(own) - shared)].tolist():
                    if (x := root(int(comps[k]))) != (y := root(comp)):
                        parent[x] = y
                        yield node, tree[k][0]
                most *= 4


def crowd_links(lists: DataFrame, known: DataFrame, similar: int = SIMILAR, matches: int = SKETCH_MATCHES, part: int = PART) -> DataFrame:
    """(a, b) of lists (token, node) and known (node, component, sketch, shingles): links that join the components that
    links of nodes in one list join. A list of one component gives nothing."""
    weight = (F.lit(256.0) + 8 * F.size("shingles")).alias("weight")
    rows = lists.join(known.select("node", "component", weight), "node")
    by = rows.groupBy("token", "component").agg(F.sum("weight").alias("n"))
    live = by.groupBy("token").agg(F.sum("n").alias("n"), F.count("*").alias("parts"), F.max(F.struct("n", "component")).alias("top")).where("parts > 1")
    cuts = lambda n: F.ceil(n / F.lit(float(part))).cast("int")
    live = live.select("token", F.col("top.component").alias("top"), cuts(F.col("top.n")).alias("wide"), cuts(F.col("n") - F.col("top.n")).alias("rest"))
    # The largest component's parts (from 0) meet each part of the others (from -1 down); these also meet each other.
    placed = rows.join(live, "token").withColumn("part", F.expr("if(component = top, cast(pmod(xxhash64(node), wide) as int), -1 - cast(pmod(xxhash64(node), rest) as int))"))
    task = F.explode(F.expr(
        "if(part >= 0, transform(sequence(1, rest), j -> struct(part as i, -j as j, 0 as role)),"
        " concat(transform(sequence(0, wide - 1), i -> struct(i as i, part as j, 1 as role)),"
        " transform(sequence(1, -part), i -> struct(-i as i, part as j, 1 as role)),"
        " if(-part < rest, transform(sequence(1 - part, rest), j -> struct(part as i, -j as j, 0 as role)), cast(array() as array<struct<i:int,j:int,role:int>>))))"
    ))
    dealt = placed.select("token", task.alias("t"), "node").join(known, "node").select("token", "t.i", "t.j", "t.role", "node", "component", "sketch", "shingles")
    small_batches(lists.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(key, tree, queries):
            one = key is not None and key[1] == key[2]
            if queries and (tree or one) and (found := list(joining(queries if one else tree, queries, matches, similar))):
                ends = np.array(found, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])

        key, tree, queries = None, [], []
        for b in batches:
            offsets, values = b.column(7).offsets.to_numpy(), b.column(7).values.to_numpy().view(WIDE)
            for k, (token, i, j, role, *row) in enumerate(zip(*(b.column(c).to_pylist() for c in range(7)), strict=True)):
                if (at := (token, i, j)) != key:
                    yield from links(key, tree, queries)
                    key, tree, queries = at, [], []
                (queries if role else tree).append((*row, values[offsets[k] : offsets[k + 1]].copy()))
        yield from links(key, tree, queries)

    return dealt.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j").mapInArrow(run, "a long, b long").distinct()


def linked(nodes: DataFrame, docs: DataFrame, similar: int = SIMILAR, n: int = SHINGLE, part: int = PART) -> DataFrame:
    """(node, component) of the nodes (node, text_id, tokens) that have a link, from confirmed pairs."""
    posted = stored(prefixes(nodes), "posted")
    lists = stored(posted.join(posted.groupBy("token").agg(F.count("*").alias("n")).where("n > 1"), "token").select("token", "node"), "prefixes")
    asked = stored(nodes.join(lists.select("node").distinct(), "node", "left_semi").select("node", "text_id", "tokens"), "asked")
    sets = stored(shingle_sets(docs, asked, n), "shingle-sets")
    links = stored(confirmed(first_pairs(lists, asked), sets, similar), "links")
    joined = stored(components(links), "components")
    known = sets.join(joined, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "sketch", "shingles")
    more = stored(crowd_links(lists, known, similar, part=part), "links")
    return joined if more.isEmpty() else stored(components(links.union(more)), "components")


def near_duplicates(docs: DataFrame, similar: int = SIMILAR, n: int = SHINGLE, part: int = PART) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable, itself included) and kept (whether that is its own) of
    docs (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    marked = stored(with_signature(docs, n), "signatures")
    nodes = marked.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.min("text_id").alias("text_id"), F.first("tokens").alias("tokens"))
    nodes = stored(nodes, "nodes")
    joined = linked(nodes, docs, similar, n, part)
    grouped = nodes.join(joined, "node", "left").select("node", "first_id", F.coalesce("component", "node").alias("component"))
    least = grouped.groupBy("component").agg(F.min("first_id").alias("component_id"))
    ids = grouped.join(least, "component").select("node", "component_id")
    rows = marked.select("doc_id", "n_shingles", "node").join(ids, "node", "left")
    own = rows.select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    return own.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
