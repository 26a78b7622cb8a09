"""Mixture-controlled packing: deficit round-robin over one queue per source fills fixed-size sequences.

Documents are dealt by a hash of their id, source and text into buckets of about equal size; a bucket is read as a stream
and packed on its own, so no group of one source or id ever meets in one task. A task has a run of successive buckets:
one while there are at most `TASKS` of them. Each source has a target share of the tokens (its share of the
corpus unless given). A window of `window` tokens adds share * window to the deficit of every source; the source with
the largest deficit is served next, in pieces cut at document ends, at the window's end or where its deficit is used up
(pieces are not cut below `min_piece` tokens for that). What is left of a deficit goes on to the next window, and a
bucket starts with the deficits that the buckets before it have left, which running sums of bytes give beforehand.

The last tokens of a bucket go into sequences of powers of two, so nothing is padded.

Nulls: a null text is the empty text (one piece with the end id only); a null source is the source ''; a null id is
kept. Repeated rows are separate documents. An empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.llm.common import small_batches, whole_text

WINDOW = 2048
END_ID = 1
BUCKET_BYTES = 24 << 20
TASKS = 20_000
MIN_PIECE = 256
#: Tokens that wait in a bucket's queues before windows are filled, so that every source has some to offer.
BACKLOG = 512 * 1024
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string, ids binary"

#: Unicode's White_Space property, as the byte-level pattern's \s has it.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Parts that the byte-level pattern never joins: it takes at most one leading space into a word.
PARTS = re.compile(rf"[{SPACE}]+(?![^{SPACE}])| ?[^{SPACE}]+|[{SPACE}]+")
CACHE_PARTS = 300_000
#: Fixed value: the pattern of the byte-level tokenizers.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class PartEncoder:
    """Ids of whole texts as little-endian 32-bit bytes; the ids of parts that come again are remembered.

    The byte-level pattern splits a text at its white space (a word takes the one space before it), so the ids of a text
    are those of its parts. New parts are encoded many in one string, and told apart by the bytes that tokens stand for.
    Texts that hold one of the file's added tokens, which are cut out before anything else, go to `tokenizers` as they are.
    The file is a byte-level BPE of the `tokenizers` library, whose ids are the ranks of its merges; they are encoded by
    the ranks, which for words that come once takes an eighth of that library's time, and gives the same ids.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        vocabulary = self.whole.get_vocab(with_added_tokens=False)
        added = [re.escape(t.content) for t in self.whole.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added) or r"(?!)")
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the file
        as_byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        ranks = {bytes(as_byte[c] for c in token): i for token, i in vocabulary.items() if all(c in as_byte for c in token)}
        self.ranks = ranks
        self.ids_of = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.known: dict[str, bytes] = {}  # words after a space, without it
        self.lines: dict[str, bytes] = {}  # words after a line end, without it
        self.others: dict[str, bytes] = {}  # any other parts, as they are
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.sizes[i] = len(token)

    def learn(self, known: dict[str, bytes], new: list[str], before: str) -> None:
        """Ids of new parts, each encoded with `before` in front of it."""
        groups = [new[i : i + 500] for i in range(0, len(new), 500)] if before else [[x] for x in new]
        for parts in groups:
            ids = np.array(self.ids_of(before + before.join(parts)), "<u4")
            ends = np.cumsum([len(before) + len(x.encode()) for x in parts])
            made = np.cumsum(self.sizes[ids])
            at = np.searchsorted(made, ends)
            data = ids.tobytes()
            if len(made) and at[-1] < len(made) and (made[at] == ends).all():
                start = 0
                for x, end in zip(parts, (4 * (at + 1)).tolist(), strict=True):
                    known[x] = data[start:end]
                    start = end
            else:  # nothing to tell them apart by
                for x in parts:
                    known[x] = np.array(self.ids_of(before + x), "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        for known in (self.known, self.lines, self.others):
            if len(known) > CACHE_PARTS:
                known.clear()
        split, words, starts, others = [], set(), set(), set()
        for t in texts:
            if self.added.search(t):
                split.append(np.array(self.whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes())
                continue
            lines = t.split("\n")
            # Single spaces and line ends between words, nothing else: then words need no pattern.
            parts = [x.split(" ") for x in lines]
            if [w for x in parts for w in x] == t.split():
                split.append(parts)
                for x in parts:
                    words.update(x)
                starts.update([x[0] for x in parts[1:]])
                others.add(parts[0][0])
            else:
                found = PARTS.findall(t)
                split.append(found)
                others.update(found)
        self.learn(self.known, list(words.difference(self.known)), " ")
        self.learn(self.lines, list(starts.difference(self.lines)), "\n")
        self.learn(self.others, list(others.difference(self.others)), "")
        after, line, other = self.known.__getitem__, self.lines.__getitem__, self.others.__getitem__
        out = []
        for parts in split:
            if isinstance(parts, bytes):
                out.append(parts)
            elif parts and isinstance(parts[0], list):
                ids = [other(parts[0][0]), *map(after, parts[0][1:])]
                for x in parts[1:]:
                    ids.append(line(x[0]))
                    ids += map(after, x[1:])
                out.append(b"".join(ids))
            else:
                out.append(b"".join(map(other, parts)))
        return out


ENCODERS: dict[str, PartEncoder] = {}  # of this Python worker, for the tasks that it runs


def encoder_of(path: str) -> PartEncoder:
    if path not in ENCODERS:
        ENCODERS[path] = PartEncoder(path)
    return ENCODERS[path]


class Queue:
    """Documents of one source that wait: (doc_id, ids, next token, tokens)."""

    __slots__ = ("share", "deficit", "docs", "source")

    def __init__(self, source: str, share: float, deficit: float):
        self.source, self.share, self.deficit, self.docs = source, share, deficit, deque()


class Bucket:
    """The queues of one bucket and the sequence being filled."""

    def __init__(self, number: int, window: int, min_piece: int):
        self.window, self.min_piece, self.waiting = window, min_piece, 0
        self.queues: dict[str, Queue] = {}
        self.sequence = number << 32
        self.carry: dict[str, tuple[float, float]] = {}
        self.bytes = self.tokens = 0
        self.started = False

    def add(self, doc_id: int | None, source: str, n_bytes: int, ids: bytes) -> None:
        n = len(ids) // 4
        self.bytes, self.tokens, self.waiting = self.bytes + n_bytes, self.tokens + n, self.waiting + n
        if source not in self.queues:
            share, carry = self.carry.get(source, (0.0, 0.0))
            self.queues[source] = Queue(source, share, carry)
        self.queues[source].docs.append([doc_id, ids, 0, n])

    def fill(self, size: int, out: list) -> None:
        """One sequence of `size` tokens, of which at least so many wait."""
        queues = self.queues.values()
        if not self.started:  # bytes of the carried deficits become tokens at the rate seen so far
            self.started, rate = True, self.tokens / max(1, self.bytes)
            for q in queues:
                q.deficit *= rate
        for q in queues:
            q.deficit += q.share * size
        at = 0
        while at < size:
            best = None
            for q in queues:
                if q.docs and (best is None or q.deficit > best.deficit):
                    best = q
            doc = best.docs[0]
            n = min(size - at, doc[3] - doc[2], max(int(best.deficit), self.min_piece))
            piece = doc[1][4 * doc[2] : 4 * (doc[2] + n)]
            out.append((doc[0], doc[2], n, zlib.crc32(piece), doc[3], self.sequence, at, best.source, piece))
            best.deficit -= n
            doc[2] += n
            at += n
            if doc[2] == doc[3]:
                best.docs.popleft()
        self.waiting -= size
        self.sequence += 1

    def drain(self, least: int, out: list) -> None:
        while self.waiting >= max(least, self.window):
            self.fill(self.window, out)

    def finish(self, out: list) -> None:
        self.drain(0, out)
        while self.waiting:
            self.fill(1 << (self.waiting.bit_length() - 1), out)


def packer(path: str, window: int, min_piece: int, end_id: int, with_ids: bool):
    names = [c.split()[0] for c in PIECES.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.string(), pa.binary()]

    def batch(rows: list) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
        if not with_ids:
            columns[8] = [None] * len(rows)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end, bucket, number = encoder_of(path), end_id.to_bytes(4, "little"), None, None
        for b in batches:
            out: list = []
            col = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            texts = col["text"].to_pylist()
            ids = encoder.encode([t or "" for t in texts])
            rows = zip(*(col[n].to_pylist() for n in ("bucket", "kind", "doc_id", "source", "share", "carry", "n_bytes")), ids, strict=True)
            for at, kind, doc_id, source, share, carry, n_bytes, x in rows:
                if at != number:
                    if bucket:
                        bucket.finish(out)
                    bucket, number = Bucket(at, window, min_piece), at
                if kind == 0:
                    bucket.carry[source] = (share, carry)
                else:
                    bucket.add(doc_id, source, n_bytes, x + end)
                    bucket.drain(BACKLOG, out)
                if len(out) > 20_000:
                    yield batch(out)
                    out = []
            if out:
                yield batch(out)
        if bucket:
            bucket.finish(out := [])
            yield batch(out)

    return pack


def pack(
    docs: DataFrame, tokenizer: str, targets: dict[str, float] | None = None, window: int = WINDOW, end_id: int = END_ID,
    min_piece: int = MIN_PIECE, bucket_bytes: int = BUCKET_BYTES, with_ids: bool = True,
) -> DataFrame:
    """Pieces of `docs` (doc_id, text, source) in sequences; `ids` holds a piece's ids as little-endian 32-bit numbers.

    tokenizer: path of a tokenizers file, as every executor sees it. targets: share of tokens by source (those not named
    get none of the windows' quotas and fill what the others leave); None: the shares that the corpus has.
    """
    small_batches(docs.sparkSession, 500)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source"), F.lit("")).alias("source"), whole_text().alias("text"))
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("long") + 1)
    total = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    n = max(1, -(-total // bucket_bytes))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "source", "text", F.lit("bucket")), F.lit(n)).cast("long"))
    sizes = rows.groupBy("bucket", "source").agg(F.sum("n_bytes").alias("bytes"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    share = F.sum("bytes").over(Window.partitionBy("source")) / F.lit(float(max(1, total)))
    if targets is not None:
        whole = sum(targets.values()) or 1.0
        given = F.create_map(*[F.lit(x) for k, v in targets.items() for x in (k, v / whole)]) if targets else None
        share = F.coalesce(given[F.col("source")], F.lit(0.0)) if targets else F.lit(0.0)
    heads = sizes.select(
        "bucket", "source", share.alias("share"),
        F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("before"),
    ).select(
        F.lit(None).cast("long").alias("doc_id"), "source", F.lit("").alias("text"), F.lit(0).cast("long").alias("n_bytes"), "bucket", F.lit(0).alias("kind"), "share",
        (F.col("share") * F.lit(float(total)) * F.col("bucket") / F.lit(float(n)) - F.col("before")).alias("carry"),
    )
    both = rows.select("*", F.lit(1).alias("kind"), F.lit(0.0).alias("share"), F.lit(0.0).alias("carry")).unionByName(heads)
    tasks = min(n, TASKS)
    dealt = both.repartitionById(tasks, F.floor(F.col("bucket") * tasks / F.lit(float(n))).cast("int")).sortWithinPartitions("bucket", "kind", F.xxhash64("doc_id", F.lit("order")), "doc_id", "source")
    return dealt.mapInArrow(packer(tokenizer, window, min_piece, end_id, with_ids), PIECES)
