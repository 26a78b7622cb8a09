"""Near-duplicate passages by compact windows.

A text is the sequence of its word shingles. For one hash function all subsequences whose smallest hash is at position c
and which lie within [l, r] share that smallest hash: a compact window (l, c, r). The windows of a text are the nodes of
the Cartesian tree of its hashes; only those at least as wide as the shortest passage are kept, 2 n / width on average,
so a few windows stand for all n^2 subsequences. Among equal smallest hashes a middle one is taken, which keeps the tree
of a text that repeats itself shallow.

Two passages with Jaccard similarity s share the smallest hash of a function with probability s. So:

1. windows of all texts under `FUNCTIONS` functions meet by (function, smallest hash); those that meet no other text go;
2. a common phrase brings texts together that share nothing else, so windows go on to meet by a second key: the smallest
   hash of `SIDE` shingles that end `REACH` shingles after c, and of as many before it. A passage of 50 words that holds c
   reaches that far on one side at least. Of the windows that agree, those that agree on the other side as well are linked
   to the first of them, and these to the first of all, so a group of n gives under n links;
3. the links of two texts are chained by position (an interval join over sorted positions), and each chain is a candidate:
   two shingles of the texts agree at about the same distance;
4. the words around a candidate's chain are fetched from both texts, and the passages verified on 64-bit hashes of the
   words: the longest stretches with a Jaccard similarity of `SIMILAR`, found by a score that a shared shingle raises and
   any other lowers.

The end of a passage is less than one window's width from the nearest link, as what remains of it would be a window
itself; so fetching that much on both sides finds whole passages.

Equal texts are one text throughout, known by a 64-bit hash; where two texts have one hash, which 128-bit digests tell, one
of them gets another. Windows group equal rows before anything is linked. A very common hash is dealt to several tasks:
hashes that are frequent among the windows of every `PROBE`-th text are salted, first linked within a salt, then from salt
to salt. The choice changes only where rows meet, not whether they do.

Nulls: a null text is the empty text and has no windows; texts of under `WORDS` words share nothing. Null ids are kept.
Repeated rows are copies. An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import small_batches, stored, whole_text
from tessella.llm.simhash import components

SHINGLE = 5
WORDS = 50
FUNCTIONS = 4
SIDE = 12
REACH = 22
SIMILAR = 0.8
PROBE = 128
HOT_SHARE = 1000  # a hash with more than 1 / HOT_SHARE of the probe's windows is salted, so there are at most HOT_SHARE
SALTS = 64
KNOWN_TEXTS = 500_000
TOGETHER = 500_000  # bytes of texts whose windows are made together
DRIFT = 32  # links whose shifts differ by at most so many words may be one chain
WINDOW_ROWS = 20_000  # rows of numbers in an Arrow batch
SEEDS = np.array([0x9E3779B97F4A7C15 * (i + 1) & (1 << 64) - 1 for i in range(8)], np.uint64)
FACTORS = np.array([0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * FACTORS[0]
    x = (x ^ (x >> np.uint64(29))) * FACTORS[1]
    return x ^ (x >> np.uint64(32))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1), modulo 2 ** 64."""
    return np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, base, np.uint64)])


BLOCK = 1 << 15  # bytes hashed at a time, so that what they need stays in the processor's cache
BASE = 0x2545F4914F6CDD1D
INVERSE = pow(BASE, -1, 1 << 64)
POWERS, INVERSES = powers(BASE, BLOCK), powers(INVERSE, BLOCK)
SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
BYTES = mixed(np.array([ord(chr(i).lower()) if i < 128 else i for i in range(256)], np.uint64) + FACTORS[1])


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words of a text in UTF-8, and where the words start.

    A word is a polynomial of its bytes' random numbers: differences of running sums, divided by the power of its start.
    """
    codes = np.frombuffer(data, np.uint8)
    edges = np.flatnonzero(np.diff(np.r_[True, SPACE[codes], True]))
    sums = np.zeros(len(edges), np.uint64)
    total, scale, step = 0, 1, pow(BASE, BLOCK, 1 << 64)
    for start in range(0, len(codes), BLOCK):
        part = BYTES[codes[start : start + BLOCK]]
        part *= POWERS[: len(part)]
        running = np.r_[np.uint64(0), np.cumsum(part)]
        lo, hi = np.searchsorted(edges, [start, start + len(part) + (start + len(part) == len(codes))])
        sums[lo:hi] = running[edges[lo:hi] - start] * np.uint64(scale) + np.uint64(total)
        total, scale = (total + int(running[-1]) * scale) % (1 << 64), scale * step % (1 << 64)
    starts, ends = edges[::2], edges[1::2]
    blocks = powers(pow(INVERSE, BLOCK, 1 << 64), len(codes) // BLOCK + 1)
    hashes = (sums[1::2] - sums[::2]) * INVERSES[starts % BLOCK] * blocks[starts // BLOCK]
    return mixed(hashes + (ends - starts).astype(np.uint64) * FACTORS[3]), starts


def shingle_hashes(words: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        out += words[i : len(words) - n + 1 + i] * FACTORS[i % 8] ^ (words[i : len(words) - n + 1 + i] >> np.uint64(i + 1))
    return mixed(out)


def tree_windows(hashes: np.ndarray, first: np.ndarray, past: np.ndarray, least: int) -> np.ndarray:
    """Rows (l, c, r), both ends included, of the nodes that are at least `least` wide of the Cartesian trees of several
    texts, whose hashes lie from `first` to before `past`. All trees grow together, a level at a time."""
    out = []
    while True:
        wide = past - first >= least
        first, past = first[wide], past[wide]
        if not len(first):
            return np.concatenate(out) if out else np.zeros((0, 3), np.int64)
        width = past - first
        begin = np.cumsum(width) - width
        part = hashes[np.repeat(first - begin, width) + np.arange(int(width.sum()))]
        same = np.flatnonzero(part == np.repeat(np.minimum.reduceat(part, begin), width))
        lo = np.searchsorted(same, begin)
        count = np.diff(np.r_[lo, len(same)])
        c = same[lo] - begin
        c = np.where(16 * np.minimum(c, width - 1 - c) <= width, same[lo + count // 2] - begin, c) + first
        out.append(np.column_stack([first, c, past - 1]))
        first, past = np.column_stack([first, c + 1]).ravel(), np.column_stack([c, past]).ravel()


def compact_windows(hashes: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(l, c, r) of the nodes of one text's tree that are at least `least` wide."""
    return [tuple(x) for x in tree_windows(hashes, np.array([0]), np.array([len(hashes)]), least).tolist()]


def smallest(hashes: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each `width` hashes in a row."""
    out, done = hashes, 1
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[:-step], out[step:])
        done += step
    return out


def side_keys(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each shingle a key of those before it and of those after it, 0 where the text does not reach so far."""
    before, after = np.zeros(len(shingles), np.int32), np.zeros(len(shingles), np.int32)
    if len(shingles) > REACH:
        near = (smallest(mixed(shingles ^ SEEDS[7]), SIDE) >> np.uint64(33)).astype(np.int32) | 1
        n = len(shingles) - REACH
        before[REACH:], after[:n] = near[:n], near[REACH - SIDE + 1 :][:n]
    return before, after


WINDOWS = "key long, text long, c int, l int, r int, before int, after int"
WINDOW_NAMES = [x.split()[0] for x in WINDOWS.split(", ")]


def window_rows(docs: DataFrame, words: int = WORDS, functions: int = FUNCTIONS) -> DataFrame:
    """The compact windows of docs (text_id, text); the lowest 3 bits of a key are the function."""
    small_batches(docs.sparkSession)
    least = words - SHINGLE + 1

    def rows(ids: list[int], texts: list[bytes]) -> pa.RecordBatch:
        hashes, starts = word_hashes(b" ".join(texts))
        sizes = np.array([len(t) + 1 for t in texts])
        first = np.searchsorted(starts, np.cumsum(sizes) - sizes)
        past = np.maximum(first, np.r_[first[1:], len(hashes)] - (SHINGLE - 1))
        shingles = shingle_hashes(hashes)
        before, after = side_keys(shingles)
        parts = []
        for k in range(functions):
            h = mixed(shingles ^ SEEDS[k])
            found = tree_windows(h, first, past, least)
            key = (h[found[:, 1]] & np.uint64(~7 & (1 << 64) - 1) | np.uint64(k)).view(np.int64)
            parts.append(np.column_stack([key, found]))
        key, left, c, right = np.concatenate(parts).T
        text = np.searchsorted(first, c, "right") - 1  # of texts without words the last, which is the one with this place
        begin, end = first[text], past[text]
        before, after = np.where(c - begin >= REACH, before[c], 0), np.where(end - c > REACH, after[c], 0)
        i32 = lambda v: pa.array(v.astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.array(ids, np.int64)[text]), i32(c - begin), i32(left - begin), i32(right - begin), i32(before), i32(after)], WINDOW_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, held = [], [], 0
            for text_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.append(text_id)
                texts.append(text.encode("utf-8", "replace"))
                held += len(texts[-1])
                if held > TOGETHER:
                    yield rows(ids, texts)
                    ids, texts, held = [], [], 0
            if ids:
                yield rows(ids, texts)

    return docs.select("text_id", whole_text().alias("text")).mapInArrow(run, WINDOWS)


def meeting(windows: DataFrame) -> DataFrame:
    """The windows (with salt) whose key another text has as well; of salted keys all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None  # rows of the open group, as long as they are of one text
        emitted = None  # the open group, once it has two texts
        for b in batches:
            if not b.num_rows:
                continue
            if waiting is not None:
                b = pa.Table.from_batches([waiting, b]).combine_chunks().to_batches()[0]
            key, salt, text = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 7, 1))
            new = np.r_[True, (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])]
            first = np.flatnonzero(new)
            last = np.r_[first[1:], len(key)] - 1
            several = (text[first] != text[last]) | (salt[first] > 0)
            several[0] |= emitted == (key[0], salt[0])
            keep = np.repeat(several, last - first + 1)
            emitted = (key[-1], salt[-1]) if several[-1] else None
            waiting = None if several[-1] else b.slice(int(first[-1]))
            if keep.any():
                yield b.filter(pa.array(keep))

    dealt = windows.repartition("key", "salt").sortWithinPartitions("key", "salt", "text", "c")
    return dealt.mapInArrow(run, WINDOWS + ", salt int")


LINKED = "text long, c int, rep long, rc int, key long, side int, sub int, other int, first boolean"


def linked(rows: DataFrame) -> DataFrame:
    """Links of rows (key, side, sub, salt, other, text, c) that share the first four: from each to the first with the same
    `other`, and from this to the first of all. Rows with `first` are these firsts, linked to nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = run_head = None  # the first row of the open group, and of the open run in it
        for b in batches:
            if not b.num_rows:
                continue
            x = np.column_stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(7)])
            skip = 0
            if head is not None:
                x, skip = np.concatenate([[head], [run_head], x]), 2
            new = np.r_[True, (x[1:, :4] != x[:-1, :4]).any(1)]
            fresh = new | np.r_[True, x[1:, 4] != x[:-1, 4]]
            if skip:
                fresh[1] = True  # the open run's first row, also where it is the group's
            at = np.arange(len(x))
            group, start = np.maximum.accumulate(np.where(new, at, 0)), np.maximum.accumulate(np.where(fresh, at, 0))
            head, run_head = x[group[-1]], x[start[-1]]
            i = at[skip:]
            j = np.where(fresh[i], group[i], start[i])
            firsts = i[fresh[i]]
            keep = x[i, 5] != x[j, 5]
            i, j = i[keep], j[keep]
            swap = x[i, 5] < x[j, 5]
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            m, n = np.concatenate([x[i], x[firsts]]), np.concatenate([x[j], x[firsts]])
            if len(m):
                i32 = lambda v: pa.array(v.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(m[:, 5]), i32(m[:, 6]), pa.array(n[:, 5]), i32(n[:, 6]), pa.array(m[:, 0]), i32(m[:, 1]), i32(m[:, 2]), i32(m[:, 4]), pa.array(np.arange(len(m)) >= len(i))],
                    ["text", "c", "rep", "rc", "key", "side", "sub", "other", "first"],
                )

    order = ["key", "side", "sub", "salt", "other", "text", "c"]
    dealt = rows.select(*order).repartition("key", "side", "sub", "salt").sortWithinPartitions(*order)
    return dealt.mapInArrow(run, LINKED)


CANDIDATES = "text long, lo int, hi int, rep long, rlo int, rhi int"


def candidates(links: DataFrame, words: int = WORDS) -> DataFrame:
    """Chains of the links (text, c, rep, rc) of two texts: of about one shift, less than two passages from link to link."""

    def chains(x: np.ndarray) -> pa.RecordBatch:
        text, rep, c, rc = x.T
        shift = c - rc
        rank = np.lexsort((shift, rep, text))
        pair = np.r_[True, (text[rank][1:] != text[rank][:-1]) | (rep[rank][1:] != rep[rank][:-1])]
        band = np.empty(len(x), np.int64)
        band[rank] = np.cumsum(pair | np.r_[True, np.diff(shift[rank]) > DRIFT])
        rank = np.lexsort((c, band))
        first = np.flatnonzero(np.r_[True, (np.diff(band[rank]) != 0) | (np.diff(c[rank]) > 2 * words)])
        lo, hi = np.minimum.reduceat(c[rank], first), np.maximum.reduceat(c[rank], first)
        rlo, rhi = np.minimum.reduceat(rc[rank], first), np.maximum.reduceat(rc[rank], first)
        i32 = lambda v: pa.array(v.astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(text[rank][first]), i32(lo), i32(hi), pa.array(rep[rank][first]), i32(rlo), i32(rhi)], ["text", "lo", "hi", "rep", "rlo", "rhi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for b in batches:
            if not b.num_rows:
                continue
            x = np.column_stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)])
            if (x[-1, :2] == x[0, :2]).all() and (not held or (held[0][0, :2] == x[0, :2]).all()):
                held.append(x)  # one pair goes on
                continue
            x = np.concatenate([*held, x])
            cut = int(np.flatnonzero((x[:, :2] != x[-1, :2]).any(1))[-1]) + 1
            held = [x[cut:]]
            yield chains(x[:cut])
        if held:
            yield chains(np.concatenate(held))

    order = ["text", "rep", "c", "rc"]
    return links.select(*order).repartition("text", "rep").sortWithinPartitions(*order).mapInArrow(run, CANDIDATES)


EXCERPTS = "text long, lo int, hi int, start int, words binary"


def excerpts(texts: DataFrame, places: DataFrame, words: int = WORDS) -> DataFrame:
    """Hashed words of texts (text_id, text) around places (text, lo, hi): `start` is the first one's position."""
    small_batches(texts.sparkSession)
    margin = words + SHINGLE

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # of copies within a task one is enough
        for b in batches:
            ids = b.column(0).to_pylist()
            keep = []
            for i, x in enumerate(ids):
                if x not in seen:
                    if len(seen) > KNOWN_TEXTS:
                        seen.clear()
                    seen.add(x)
                    keep.append(i)
            yield b.take(pa.array(keep, pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, hashes, text = None, None, ""
        for b in batches:
            out = []
            for text_id, kind, t, lo, hi in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if kind == 0:
                    if text_id != current:
                        current, text, hashes = text_id, t, None
                    continue
                if text_id != current:
                    continue
                if hashes is None:
                    hashes = word_hashes(text.encode("utf-8", "replace"))[0]
                start = max(0, lo - margin)
                out.append((text_id, lo, hi, start, hashes[start : hi + margin + SHINGLE].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()], strict=True)], ["text", "lo", "hi", "start", "words"])

    rows = texts.select("text_id", whole_text().alias("text")).mapInArrow(once, "text_id long, text string")
    rows = rows.select("text_id", F.lit(0).alias("kind"), "text", F.lit(0).alias("lo"), F.lit(0).alias("hi"))
    asked = places.select(F.col("text").alias("text_id"), F.lit(1).alias("kind"), F.lit("").alias("text"), "lo", "hi")
    both = rows.union(asked).repartition("text_id").sortWithinPartitions("text_id", "kind", "lo", "hi")
    return both.mapInArrow(run, EXCERPTS)


def increasing(values: np.ndarray) -> np.ndarray:
    """Positions of a longest strictly increasing subsequence."""
    if (np.diff(values) > 0).all():
        return np.arange(len(values))
    tails, ends, before = [], [], []
    for i, v in enumerate(values.tolist()):
        k = bisect_left(tails, v)
        before.append(ends[k - 1] if k else -1)
        tails[k:k + 1], ends[k:k + 1] = [v], [i]
    out, i = [], ends[-1]
    while i >= 0:
        out.append(i)
        i = before[i]
    return np.array(out[::-1])


def chains_of_hits(x: np.ndarray, y: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions in x and in y of equal shingles, both increasing: the longest chain, then that of the rest, and so on."""
    order = np.argsort(y, kind="stable")
    first, past = np.searchsorted(y[order], x), np.searchsorted(y[order], x, "right")
    at = np.flatnonzero(past > first)
    where = order[np.minimum(first[at], len(y) - 1)]
    single = (past - first)[at] == 1
    if not single.all():  # of several places the one that keeps the shift
        shift = int(np.median((where - at)[single])) if single.any() else 0
        for k, i in enumerate(at.tolist()):
            if not single[k]:
                places = order[first[i] : past[i]]
                p = int(np.searchsorted(places, i + shift))
                where[k] = min(places[max(p - 1, 0) : p + 1].tolist(), key=lambda v: abs(v - i - shift))  # noqa: B023
            shift = int(where[k]) - i
    while len(at) >= least:
        chain = increasing(where)
        if len(chain) < least:
            return
        yield at[chain], where[chain]
        rest = np.ones(len(at), bool)
        rest[chain] = False
        at, where = at[rest], where[rest]


def similar_stretches(at: np.ndarray, where: np.ndarray, mine: np.ndarray, others: np.ndarray, width: int, loss: float) -> list[tuple[int, int, int, int]]:
    """Stretches (start, end, other start, other end) in shingles of one chain, the longest with a score of 0 or more.

    A hit scores 1 and a shingle that only one of the texts has, as `mine` and `others` count them, costs `loss`, so that
    the score is 0 where the Jaccard similarity is as asked. A stretch begins and ends with hits; one that is narrower
    than `width` in both texts is filled up to it in both, and what fills it costs as much.
    """
    n = len(at)
    score = np.arange(n) - loss * (mine[at] + others[where])
    # The last hit that a stretch can reach from each hit: the best scores from there on fall, so it is found by halving.
    top = np.maximum.accumulate(score[::-1])[::-1]
    last = np.searchsorted(-top, 1 + 1e-6 - score, "right") - 1
    wide = np.maximum(at[last] - at, where[last] - where) + 1 >= width
    whole = np.flatnonzero(wide & (last > np.r_[-1, np.maximum.accumulate(np.where(wide, last, -1))[:-1]]))
    out = [(int(at[i]), int(at[last[i]]) + 1, int(where[i]), int(where[last[i]]) + 1) for i in whole]
    covered = np.zeros(n + 1, np.int64)
    np.add.at(covered, whole, 1)
    np.add.at(covered, last[whole] + 1, -1)
    free = np.flatnonzero(np.cumsum(covered[:n]) == 0)
    if len(free) and mine.size > width and others.size > width:
        to = np.minimum(free[:, None] + np.arange(width), n - 1)
        p, q = at[to] - at[free][:, None] + 1, where[to] - where[free][:, None] + 1
        good = (p < width) & (q < width) & (score[to] - score[free][:, None] + 1 - loss * (2 * width - p - q) >= -1e-6)
        reached = -1
        for i, row in zip(free[good.any(1)].tolist(), good[good.any(1)], strict=True):
            j = min(i + int(np.flatnonzero(row)[-1]), n - 1)
            if j > reached:
                reached = j
                s, s2 = int(at[i]), int(where[i])
                left = min(s, s2, width - (int(at[j]) - s + 1), width - (int(where[j]) - s2 + 1))
                s, s2 = min(s - left, mine.size - 1 - width), min(s2 - left, others.size - 1 - width)
                out.append((s, s + width, s2, s2 + width))
    return sorted(out)


def verified(a: np.ndarray, b: np.ndarray, words: int = WORDS, similar: float = SIMILAR) -> list[tuple[int, int, int, int]]:
    """Passages (start, end, other start, other end) in words of two excerpts that are near duplicates.

    Passages may overlap; those that lie within what others cover are left out.
    """
    x, y = shingle_hashes(a.astype(np.uint64)), shingle_hashes(b.astype(np.uint64))
    width = words - SHINGLE + 1
    if not len(x) or not len(y):
        return []
    here, there = np.isin(x, y), np.isin(y, x)
    mine, others = np.r_[0, np.cumsum(~here)], np.r_[0, np.cumsum(~there)]

    def alike(s: int, e: int, s2: int, e2: int) -> bool:
        p, q = set(x[s:e].tolist()), set(y[s2:e2].tolist())
        return len(p & q) >= similar * len(p | q)

    def grown(s: int, e: int, s2: int, e2: int) -> tuple[int, int, int, int]:
        """With the shared shingles beside it, as where a text repeats itself more often than the other."""
        left, right = np.flatnonzero(~here[:s]), np.flatnonzero(~here[e:])
        left2, right2 = np.flatnonzero(~there[:s2]), np.flatnonzero(~there[e2:])
        return (
            int(left[-1]) + 1 if len(left) else 0, e + int(right[0]) if len(right) else len(x),
            int(left2[-1]) + 1 if len(left2) else 0, e2 + int(right2[0]) if len(right2) else len(y),
        )

    found = []
    for at, where in chains_of_hits(x, y, similar * width):
        for stretch in similar_stretches(at, where, mine, others, width, similar / (1 - similar)):
            more = grown(*stretch)
            if more != stretch and alike(*more):
                found.append(more)
            elif alike(*stretch):
                found.append(stretch)
    out: list[tuple[int, int, int, int]] = []
    for stretch in sorted(set(found), key=lambda v: (v[0], -v[1])):
        if len(out) > 1 and stretch[0] <= out[-2][1] and stretch[2] <= out[-2][3] and out[-2][2] <= out[-1][2] and stretch[1] >= out[-1][1] and stretch[3] >= out[-1][3]:
            out[-1] = stretch  # the one before and this one cover the last
        elif not (out and stretch[1] <= out[-1][1] and out[-1][2] <= stretch[2] and stretch[3] <= out[-1][3]):
            out.append(stretch)
    return [(s, e + SHINGLE - 1, s2, e2 + SHINGLE - 1) for s, e, s2, e2 in out]


SPANS = "text long, start int, end int, rep long, rep_start int, rep_end int"


def spans(found: DataFrame, pieces: DataFrame, words: int = WORDS, similar: float = SIMILAR) -> DataFrame:
    """Verified passages of candidates: where they are in both texts, in words."""
    mine = pieces.select("text", "lo", "hi", F.col("start").alias("mine_at"), F.col("words").alias("mine"))
    other = pieces.select(F.col("text").alias("rep"), F.col("lo").alias("rlo"), F.col("hi").alias("rhi"), F.col("start").alias("other_at"), F.col("words").alias("other"))
    both = found.join(mine, ["text", "lo", "hi"]).join(other, ["rep", "rlo", "rhi"]).select("text", "rep", "mine_at", "mine", "other_at", "other")
    small_batches(found.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, rep, i, a, j, o in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                for s, e, s2, e2 in verified(np.frombuffer(a, np.uint64), np.frombuffer(o, np.uint64), words, similar):
                    out.append((text, i + s, i + e, rep, j + s2, j + e2))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64() if k in (0, 3) else pa.int32()) for k, x in enumerate(zip(*out, strict=True))], ["text", "start", "end", "rep", "rep_start", "rep_end"])

    return both.mapInArrow(run, SPANS)


def passages(docs: DataFrame, words: int = WORDS, functions: int = FUNCTIONS, similar: float = SIMILAR) -> DataFrame:
    """Verified near-duplicate passages (text, start, end, rep, ...) between different texts of docs (text_id, text).

    Of two texts the one with the larger id is `text`; `rep` is the other.
    """
    spark = docs.sparkSession
    rows = window_rows(docs, words, functions)
    probe = window_rows(docs.where(F.pmod(F.col("text_id"), F.lit(PROBE)) == 0), words, functions).groupBy("key").count()
    probe = stored(probe.where("count > 1"), "probe")
    total = probe.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    hot = [r[0] for r in probe.where(F.col("count") > max(16, total // HOT_SHARE)).select("key").collect()]
    salted = F.when(F.col("key").isin(hot), F.pmod(F.xxhash64("text"), F.lit(SALTS)).cast("int") + 1).otherwise(F.lit(0)) if hot else F.lit(0)
    small_batches(spark, WINDOW_ROWS)
    met = stored(meeting(rows.withColumn("salt", salted)), "meeting-windows")
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("before").alias("sub"), F.col("after").alias("other")), F.struct(F.lit(1).alias("side"), F.col("after").alias("sub"), F.col("before").alias("other"))))
    agreeing = met.select("key", "salt", "text", "c", sides.alias("x")).select("key", "salt", "text", "c", "x.*").where("sub <> 0")
    links = stored(linked(agreeing).where("not first" if not hot else F.expr("not first") | F.col("key").isin(hot)), "window-links")
    both = links.where("not first")
    if hot:  # what is first within a salt goes on to meet the other salts
        both = both.unionByName(linked(links.where("first").withColumn("salt", F.lit(0))).where("not first"))
    found = stored(candidates(both, words), "candidates")
    places = found.select("text", "lo", "hi").union(found.select("rep", "rlo", "rhi")).distinct()
    pieces = stored(excerpts(docs, places, words), "excerpts")
    return spans(found, pieces, words, similar)


def with_text_id(docs: DataFrame) -> DataFrame:
    """docs with text_id, a 64-bit hash of the text; of different texts with one hash all but one get another."""
    digest = F.md5(whole_text().cast("binary"))
    ids = docs.select(F.xxhash64(whole_text()).alias("text_id"), digest.alias("_digest"))
    shared = stored(ids.groupBy("text_id").agg(F.min("_digest").alias("_kept"), F.max("_digest").alias("_last")).where("_kept <> _last"), "shared-hashes")
    if shared.isEmpty():
        return docs.withColumn("text_id", F.xxhash64(whole_text()))
    both = docs.withColumns({"text_id": F.xxhash64(whole_text()), "_digest": digest}).join(shared.drop("_last"), "text_id", "left")
    return both.withColumn("text_id", F.when(F.col("_digest") != F.col("_kept"), F.xxhash64("_digest")).otherwise(F.col("text_id"))).select(*docs.columns, "text_id")


MERGED = "text long, n_words int, spans array<struct<start:int,end:int>>"


def merged_spans(found: DataFrame) -> DataFrame:
    """(text, n_words, spans): the joined spans of each text and the words they hold."""
    small_batches(found.sparkSession)
    lists = found.groupBy("text").agg(F.collect_set(F.struct("start", "end")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            out = []
            for found in b.column(1).to_pylist():
                joined: list[list[int]] = []
                for s, e in sorted((x["start"], x["end"]) for x in found):
                    if joined and s <= joined[-1][1]:
                        joined[-1][1] = max(e, joined[-1][1])
                    else:
                        joined.append([s, e])
                out.append(joined)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sum(e - s for s, e in x) for x in out], pa.int32()), pa.array([[{"start": s, "end": e} for s, e in x] for x in out], kind)], ["text", "n_words", "spans"])

    return lists.mapInArrow(run, MERGED)


def long_enough(words: int):
    return F.size(F.split(F.trim(whole_text()), r"\s+", words)) >= words


def sharing_documents(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Documents (doc_id, text) that share a passage of `words` words or more with another one, one row each.

    class_id: the smallest doc_id that shared passages connect it with; copies: documents with its very text;
    shared_words and spans: what of it others have too (for a copy without links all of it, as no span).
    """
    tagged = with_text_id(docs.select("doc_id", "text"))
    found = stored(passages(tagged.select("text_id", "text"), words), "passages")
    groups = components(found.select(F.col("text").alias("a"), F.col("rep").alias("b")).distinct())
    both = found.select("text", "start", "end", "rep").union(found.select("rep", "rep_start", "rep_end", "text"))
    marked = merged_spans(both).join(groups, F.col("text") == F.col("node")).drop("node")
    ids = tagged.where(long_enough(words)).select("doc_id", "text_id")
    copies = ids.groupBy("text_id").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"))
    joined = copies.join(marked, F.col("text_id") == F.col("text"), "left").where("copies > 1 or text is not null")
    joined = stored(joined.withColumn("group", F.coalesce("component", "text_id")).drop("text", "component"), "sharing")
    least = joined.groupBy("group").agg(F.min("first_id").alias("class_id"))
    return ids.join(joined.join(least, "group"), "text_id").select(
        "doc_id", "class_id", "copies",
        F.coalesce("n_words", F.lit(0)).alias("shared_words"), F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"),
    )


def without_repeats(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """docs, all columns, where each shared passage stays in one text only and of equal texts one document stays.

    Of the texts that share a passage the one with the smallest text hash keeps it; a text of which nothing is left goes.
    Texts without shared passages are not touched, nor rows that repeat the document that stays; n_chars follows the text where there is such a column.
    """
    names, at = docs.columns, docs.columns.index("text")
    tagged = with_text_id(docs.select(*[F.col(c).alias(f"_kept_{c}") for c in names], "doc_id", "text"))
    cut = merged_spans(passages(tagged.select("text_id", "text"), words))
    first = tagged.where(long_enough(words)).groupBy("text_id").agg(F.count("*").alias("copies"), F.min("doc_id").alias("kept_id"))
    marks = first.join(cut, F.col("text_id") == F.col("text"), "full").select(F.coalesce("text_id", F.col("text")).alias("mark"), "copies", "kept_id", "spans").where("copies > 1 or spans is not null")
    joined = tagged.join(marks, F.col("text_id") == F.col("mark"), "left")
    joined = joined.where("copies is null or copies = 1 or doc_id <=> kept_id")
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, keep = [], []
            for i, (text, found) in enumerate(zip(b.column(at).to_pylist(), b.column(len(names)).to_pylist(), strict=True)):
                left = without(text, [(x["start"], x["end"]) for x in found]) if found else text
                if not found or left.split():
                    keep.append(i)
                    texts.append(left)
            rows = b.take(pa.array(keep, pa.int32()))
            columns = [*rows.columns[:at], pa.array(texts, pa.string()), *rows.columns[at + 1 : len(names)]]
            if "n_chars" in names:
                n = names.index("n_chars")
                columns[n] = pa.array([len(t) if t is not None else v for t, v in zip(texts, columns[n].to_pylist(), strict=True)], columns[n].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return joined.select(*[F.col(f"_kept_{c}").alias(c) for c in names], F.col("spans").alias("_spans")).mapInArrow(run, docs.schema)


def without(text: str, found: list[tuple[int, int]]) -> str:
    """The text without the words of the spans; white space between the words that stay is kept as it was."""
    data = text.encode("utf-8", "replace")
    out, word, at = [], 0, 0
    ends = iter([*sorted(found), (1 << 60, 1 << 60)])
    start, end = next(ends)
    place, begin = 0, 0  # begin: where what is kept starts
    for w in data.split():
        a = data.index(w, place)
        place = a + len(w)
        if word == start:
            out.append(data[begin:a])
            at = 1
        word += 1
        if at and word == end:
            begin, at = place, 0
            start, end = next(ends)
    if not at:
        out.append(data[begin:])
    return b"".join(out).decode("utf-8", "replace")
