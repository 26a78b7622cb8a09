"""Alignment of two tokenizers: where their tokens end together in a text, and which ids that links how often.

A pipeline on Arrow arrays inside tasks. A batch's ids are list arrays; flattened, with each token's text as parent index,
the lengths of the tokens' bytes are summed up within each text, so that (text, end) is a key. An Acero hash join of both
sides' keys gives the links: pairs of tokens that end together, which also cut both sequences into groups. Links are
counted with `Table.group_by` in each task, and Spark adds these partial counts up per id pair.

A text's sums over corpus-wide counts come from a second pass: the `HOT` most frequent pairs go to the tasks as one small
table (its bound), all others, each of which is rarer than those, are joined by id pair. No result depends on `HOT`.

The byte-level file (A) gets a space before the text, which the piece file (B) adds by itself. Strings of special tokens
in a text are plain text.

Nulls: a null or empty text, and one that the tokens' joined bytes don't give back (as where it holds U+2581 itself), has
no tokens: zeros and ''. Null ids are kept, repeated rows are separate rows that each add to the counts. An empty table
gives no rows. Of docs only doc_id and text are read. A task holds the tokens of about `CHUNK` characters, or of one text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import small_batches, stored
from tessella.llm.packing import PartEncoder

HOT = 200_000
CHUNK = 1 << 20
#: Rows of partial counts that a task holds before it hands them on.
PARTIAL = 1 << 21


class Tokenizers:
    """Both vocabularies: ids of texts, the bytes of each id and their numbers."""

    def __init__(self, byte_path: str, piece_path: str):
        import sentencepiece

        self.bytewise = PartEncoder(byte_path)
        a = [b""] * len(self.bytewise.sizes)
        for token, i in self.bytewise.ranks.items():
            a[i] = token
        # Strings of added tokens are ordinary text here.
        self.bytewise.added = re.compile(r"(?!)")
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        n = self.pieces.get_piece_size()
        byte = lambda i: bytes([int(self.pieces.id_to_piece(i)[3:5], 16)])
        b = [byte(i) if self.pieces.is_byte(i) else self.pieces.id_to_piece(i).replace("▁", " ").encode() for i in range(n)]
        self.a_bytes, self.b_bytes = pa.array(a, pa.large_binary()), pa.array(b, pa.large_binary())
        self.a_sizes, self.b_sizes = (pc.cast(pc.binary_length(x), pa.int64()) for x in (self.a_bytes, self.b_bytes))
        self.n_a, self.n_b = len(a), n
        # Each id as it stands in the rendered groups: within a group, then at the end of its side.
        marks = [f"{i}," for i in range(self.n_a)] + [f"{i}|" for i in range(self.n_a)] + [f"{i}," for i in range(n)] + [f"{i};" for i in range(n)]
        self.marks = pa.array(marks, pa.large_string())

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        # A letter before the space is one token of its own, and the encoder then sees a text of words between spaces.
        a = [np.frombuffer(x, "<u4")[1:] for x in self.bytewise.encode(["a " + t for t in texts])]
        return a, [np.array(x, np.uint32) for x in self.pieces.encode(texts, num_threads=1)]


KNOWN: dict[tuple[str, str], Tokenizers] = {}  # of this Python worker, for the tasks that it runs


def tokenizers_of(byte_path: str, piece_path: str) -> Tokenizers:
    if (byte_path, piece_path) not in KNOWN:
        KNOWN[byte_path, piece_path] = Tokenizers(byte_path, piece_path)
    return KNOWN[byte_path, piece_path]


def lists(ids: list[np.ndarray]) -> pa.LargeListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
    return pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*ids, np.zeros(0, np.uint32)]).astype(np.int32)))


def end_keys(ids: pa.LargeListArray, sizes: pa.Int64Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Flat ids, their texts, and the byte at which each token ends within its text."""
    flat, parents = pc.list_flatten(ids), pc.list_parent_indices(ids).to_numpy()
    ends = pc.cumulative_sum(sizes.take(flat)).to_numpy()
    offsets = ids.offsets.to_numpy()
    before = np.concatenate([[0], ends])[offsets[:-1]]
    return flat, parents, ends - before[parents]


def joined(ids: list[np.ndarray], table: pa.LargeBinaryArray) -> list[memoryview]:
    """The bytes that each text's tokens stand for."""
    if not sum(map(len, ids)):
        return [memoryview(b"")] * len(ids)
    made = table.take(pa.array(np.concatenate(ids).astype(np.int64)))
    ends = np.frombuffer(made.buffers()[1], np.int64)[: len(made) + 1]
    at = ends[np.concatenate([[0], np.cumsum([len(x) for x in ids])])]
    data = memoryview(made.buffers()[2]).cast("B")  # bytes, not signed numbers
    return [data[x:y] for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def links_of(a: pa.LargeListArray, b: pa.LargeListArray, tok: Tokenizers) -> tuple[np.ndarray, np.ndarray, tuple, tuple]:
    """Places in the flat ids of both sides that end together, in order."""
    left, right = end_keys(a, tok.a_sizes), end_keys(b, tok.b_sizes)
    key = lambda side: pa.array(side[1].astype(np.int64) << 40 | side[2])
    one = pa.table({"key": key(left), "i": pa.array(np.arange(len(left[0])))})
    two = pa.table({"key": key(right), "j": pa.array(np.arange(len(right[0])))})
    met = one.join(two, keys="key", join_type="inner", use_threads=False).combine_chunks()
    i, j = met["i"].to_numpy(), met["j"].to_numpy()
    order = np.argsort(i)
    return i[order], j[order], left, right


def cut(n: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each of n tokens ends a group, as 0 or 1, and the number of its group, where `at` are the ends."""
    ends = np.zeros(n, np.int64)
    ends[at] = 1
    return ends, np.cumsum(ends) - ends


def rendered(i: np.ndarray, j: np.ndarray, left: tuple, right: tuple, counts: np.ndarray, tok: Tokenizers) -> list[str]:
    """SHA-256 of each text's groups as a1,a2|b1;a3|b2,b3, '' without tokens; counts: tokens of both sides per text."""
    end_a, group_a = cut(len(left[0]), i)
    end_b, group_b = cut(len(right[0]), j)
    codes = np.zeros(len(left[0]) + len(right[0]), np.int64)
    codes[np.arange(len(end_a)) + np.concatenate([[0], j + 1])[group_a]] = left[0].to_numpy() + end_a * tok.n_a
    codes[np.arange(len(end_b)) + (i + 1)[group_b]] = right[0].to_numpy() + 2 * tok.n_a + end_b * tok.n_b
    made = tok.marks.take(pa.array(codes))
    ends = np.frombuffer(made.buffers()[1], np.int64)[: len(made) + 1]
    at = ends[np.concatenate([[0], np.cumsum(counts)])].tolist()
    data = memoryview(made.buffers()[2] or b"")
    return [hashlib.sha256(data[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(at[:-1], at[1:], strict=True)]


def chunks(texts: list[str | None], most: int = CHUNK) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for k, t in enumerate(texts):
        if size and size + len(t or "") > most:
            yield start, k
            start, size = k, 0
        size += len(t or "")
    if start < len(texts):
        yield start, len(texts)


def aligned(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """row (a number of its own), doc_id, n_a, n_b, n_groups, n_links, groups_sha256 and pairs (a * |B| + b of each link, in
    order) of docs (doc_id, text)."""
    small_batches(docs.sparkSession, 500)
    tok = Tokenizers(byte_path, piece_path)
    n_b, kind = tok.n_b, "int" if tok.n_a * tok.n_b < 1 << 31 else "long"
    numbers = pa.int32() if kind == "int" else pa.int64()
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizers_of(byte_path, piece_path)
        none = np.zeros(0, np.uint32)
        for batch in batches:
            whole = batch.column(1).to_pylist()
            for x, y in chunks(whole):
                texts = [t or "" for t in whole[x:y]]
                a, b = tok.encode(texts)
                for k, (t, p, q) in enumerate(zip(texts, joined(a, tok.a_bytes), joined(b, tok.b_bytes), strict=True)):
                    if not t or p != (want := b" " + t.encode()) or q != want:
                        a[k] = b[k] = none
                n_a, n_b_of = np.array([len(v) for v in a]), np.array([len(v) for v in b])
                i, j, left, right = links_of(lists(a), lists(b), tok)
                sums = rendered(i, j, left, right, n_a + n_b_of, tok)
                pairs = left[0].to_numpy()[i].astype(np.int64) * n_b + right[0].to_numpy()[j]
                found = np.bincount(left[1][i], minlength=len(texts))
                offsets = pa.array(np.concatenate([[0], np.cumsum(found)]).astype(np.int32))
                columns = [pa.array(v.astype(np.int64)) for v in (n_a, n_b_of, found, found)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(x, y - x), *columns, pa.array(sums, pa.string()), pa.ListArray.from_arrays(offsets, pa.array(pairs).cast(numbers))], names)

    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<{kind}>")
    return made.select(F.monotonically_increasing_id().alias("row"), *names)


def counted(lists_of: DataFrame, partial: int = PARTIAL) -> DataFrame:
    """(pair, n) of a column `pairs` of lists: partial counts by tasks, added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def merged(parts):
            one = pa.concat_tables(parts).group_by("pair", use_threads=False).aggregate([("n", "sum")])
            return pa.table({"pair": one["pair"], "n": one["n_sum"]})

        held: list[pa.Table] = []
        for b in batches:
            flat = pc.list_flatten(b.column(0)).cast(pa.int64())
            counts = pa.table({"pair": flat}).group_by("pair", use_threads=False).aggregate([([], "count_all")])
            held.append(pa.table({"pair": counts["pair"], "n": counts["count_all"]}))
            if sum(map(len, held)) > partial:
                held = [merged(held)]
                if 2 * len(held[0]) > partial:
                    yield from held[0].to_batches()
                    held = []
        if held:
            yield from merged(held).to_batches()

    return lists_of.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def pair_counts(alignment: DataFrame, n_b: int) -> DataFrame:
    """(pair, n, best): how many links hold an id pair linked, and whether its B id has no pair of more. What is joined to
    the pairs is one number for each B id, so no more rows than B's vocabulary has."""
    counts = stored(counted(alignment), "pair-counts").withColumn("b", F.col("pair") % n_b)
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def alignment_sums(docs: DataFrame, byte_path: str, piece_path: str, hot: int = HOT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is the best of its B id), count_sum (their pairs' counts
    added up) and groups_sha256 of docs (doc_id, text)."""
    spark = docs.sparkSession
    made = stored(aligned(docs, byte_path, piece_path), "aligned")
    n_b = tokenizers_of(byte_path, piece_path).n_b
    counts = stored(pair_counts(made, n_b), "best-pairs")
    first = counts.orderBy(F.desc("n"), "pair").limit(hot).toArrow().combine_chunks()
    table = spark.sparkContext.broadcast({c: first[c].to_numpy() for c in ("pair", "n", "best")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_pairs, hot_n, hot_best = (pa.array(table.value[c]) for c in ("pair", "n", "best"))
        hot_best = hot_best.cast(pa.int64())
        for b in batches:
            pairs = b.column(b.schema.get_field_index("pairs"))
            flat, parents = pc.list_flatten(pairs).cast(pa.int64()), pc.list_parent_indices(pairs)
            at = pc.index_in(flat, value_set=hot_pairs)
            sums = pa.table({"parent": parents, "n": hot_n.take(at), "best": hot_best.take(at)}).group_by("parent", use_threads=False).aggregate([("n", "sum"), ("best", "sum")])
            out = {c: np.zeros(len(b), np.int64) for c in ("best", "n")}
            for c in out:
                out[c][sums["parent"].to_numpy()] = pc.fill_null(sums[f"{c}_sum"], 0).to_numpy()
            missing = pc.is_null(at)
            rest = np.bincount(parents.filter(missing).to_numpy(), minlength=len(b))
            cold = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(rest)]).astype(np.int32)), flat.filter(missing))
            kept = [b.column(c) for c in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(out["best"]), pa.array(out["n"]), cold], [*b.schema.names[:-1], "n_best", "count_sum", "cold"])

    small_batches(spark, 500)
    names = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, cold array<long>"
    known = stored(made.mapInArrow(run, names), "hot-sums")
    asked = known.select("row", F.explode("cold").alias("pair")).groupBy("row", "pair").agg(F.count("*").alias("times"))
    more = asked.join(counts, "pair").groupBy("row").agg(F.sum(F.col("times") * F.col("n")).alias("more_n"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"))
    both = known.drop("cold").join(more, "row", "left")
    added = lambda c, m: (F.col(c) + F.coalesce(m, F.lit(0))).alias(c)
    return both.select("doc_id", "n_a", "n_b", "n_groups", "n_links", added("n_best", "more_best"), added("count_sum", "more_n"), "groups_sha256")
