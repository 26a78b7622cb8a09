"""Prediction by partial matching over bytes, and a smoothed word unigram score as the base to compare with.

A pretrained model of order K has, for each context of up to K bytes, how often each byte followed. A byte is coded in
the longest context that the model has; a byte it has not seen there is escaped to the context shorter by one, where
the symbols of the longer one are excluded. Escapes follow method D: in a context with n occurrences of d symbols a
symbol of count c has (2 c - 1) / 2 n and the escape d / 2 n, both counted without excluded symbols. A context all of
whose symbols are excluded escapes at no cost. Counts are updated with exclusion: a shorter context counts in how many
longer ones a symbol came. Beyond the empty context all symbols not seen yet are alike. Texts begin
after K start marks and end with an end mark, bytes that UTF-8 never has, so a score is a proper probability.

Counts of (context, byte) come from all training texts by a Spark aggregation, and all of them count in the scores. The
probabilities of at most `MAX_NODES` of the most frequent pairs are broadcast as a cache. The distinct pairs of the texts
that the cache lacks are dealt by the last `SHARD_ORDER` bytes of their context and meet the stored counts there: all
contexts of that order or more that a pair needs end with these bytes, and the shorter ones' counts are broadcast, so a
trie of one shard gives what one of all pairs would. Likewise the `HOT_WORDS` most frequent words are broadcast for the
base score and all other words are joined by a shuffle, so no word and no pair is left out.

`adaptive_code_length` is the same model learnt from the text itself as it is read, byte by byte.

Nulls: a null text is the empty text, which has the end mark only. Null ids are kept. Repeated rows are scored one by
one. With no training rows each byte has probability 1/256 and each token 1 / (V + 1) = 1.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import small_batches, stored, whole_text

ORDER = 5
MAX_NODES = 1_500_000
SHARD_ORDER = 3
SHARD_ROWS = 200_000
SCORED_ROWS = 100  # texts scored at a time, as each byte takes several numbers
HOT_WORDS = 200_000
HOT_WORD_BYTES = 64
START, END = 0xFE, 0xFF
HELD_WORDS = 400_000
HELD_PAIRS = 6_000_000
LN10 = np.log(10.0)


def tokens(data: bytes) -> list[bytes]:
    return data.lower().split()


def padded(texts: list[bytes], order: int) -> np.ndarray:
    mark, end = bytes([START]) * order, bytes([END])
    return np.frombuffer(b"".join([x for t in texts for x in (mark, t, end)]), np.uint8)


def pair_keys(a: np.ndarray, order: int) -> np.ndarray:
    """For each byte of padded texts but the start marks: its context and itself as one number."""
    k = a[: len(a) - order].astype(np.uint64)
    for j in range(1, order + 1):
        k = (k << np.uint64(8)) | a[j : len(a) - order + j]
    return k[a[order:] != START] if order else k


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts[:0]


COUNTS = "word binary, pair long, n long"


def count_stage(order: int):
    """Rows of words (an empty word for the ends of texts) and of byte pairs, summed within a task."""

    def rows(words: list, pairs: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        size = 100_000
        for i in range(0, len(words), size):
            some = words[i : i + size]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in some], pa.binary()), pa.nulls(len(some), pa.int64()), pa.array([c for _, c in some], pa.int64())], ["word", "pair", "n"])
        for i in range(0, len(pairs), size):
            yield pa.RecordBatch.from_arrays([pa.nulls(len(pairs[i : i + size]), pa.binary()), pa.array(pairs[i : i + size].view(np.int64)), pa.array(n[i : i + size])], ["word", "pair", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        keys, ns = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for b in batches:
            texts = [t.encode("utf-8", "replace") for t in b.column(0).to_pylist()]
            words[b""] += len(texts)
            for t in texts:
                words.update(tokens(t))
            k, c = np.unique(pair_keys(padded(texts, order), order), return_counts=True)
            keys.append(k)
            ns.append(c)
            if sum(map(len, keys)) > HELD_PAIRS:
                k, c = summed(np.concatenate(keys), np.concatenate(ns))
                keys, ns = [k], [c]
                if len(k) > HELD_PAIRS // 2:
                    yield from rows([], k, c)
                    keys, ns = [k[:0]], [c[:0]]
            if len(words) > HELD_WORDS:
                yield from rows(list(words.items()), *summed(keys[0][:0], ns[0][:0]))
                words = Counter()
        yield from rows(list(words.items()), *summed(np.concatenate(keys), np.concatenate(ns)))

    return count


def corpus_counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(word, pair, n): how often each word and each (context, byte) pair occurs in docs (text)."""
    small_batches(docs.sparkSession)
    found = docs.select(whole_text().alias("text")).mapInArrow(count_stage(order), COUNTS)
    return found.groupBy("word", "pair").agg(F.sum("n").alias("n"))


def least_count(counts: DataFrame, most: int) -> int:
    """The smallest n such that at most `most` rows have that n or more."""
    # Large counts are few and share a level with others between two powers of two, so the histogram stays short.
    level = F.when(F.col("n") < 4096, F.col("n")).otherwise(F.pow(2.0, F.floor(F.log2("n"))).cast("long"))
    seen, least = 0, 1 << 62
    histogram = sorted(((r[0], r[1]) for r in counts.groupBy(level.alias("level")).count().collect()), reverse=True)
    for c, rows in histogram:
        seen += rows
        if seen > most:
            return least
        least = c
    return 1


class Slots:
    """Values by key: open addressing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(2 * len(keys) + 1).bit_length())
        self.shift, self.size = np.uint64(64 - bits), 1 << bits
        self.slot_key, self.slot_value = np.zeros(self.size, np.uint64), np.zeros(self.size, np.float32)
        todo = np.arange(len(keys))
        slot = self.home(keys)
        while len(todo):  # of several that want a free slot one gets it, the others go on
            free = self.slot_key[slot] == 0
            self.slot_key[slot[free]] = keys[todo[free]]
            won = self.slot_key[slot] == keys[todo]
            self.slot_value[slot[won]] = values[todo[won]]
            todo, slot = todo[~won], (slot[~won] + 1) & (self.size - 1)

    def home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The keys' values, 0 where there is none, and the places of those without."""
        slot = self.home(keys)
        there = self.slot_key[slot]
        out = np.where(there == keys, self.slot_value[slot], 0.0).astype(np.float64)
        todo = np.flatnonzero((there != keys) & (there != 0))
        missed = [np.flatnonzero(there == 0)]
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & (self.size - 1)
            there = self.slot_key[slot]
            hit, none = there == keys[todo], there == 0
            out[todo[hit]] = self.slot_value[slot[hit]]
            missed.append(todo[none])
            on = ~hit & ~none
            todo, slot = todo[on], slot[on]
        return out, np.concatenate(missed)


class Trie:
    """Log probabilities of the pretrained model, from sorted pairs of the highest order and their counts.

    With `upper`, the sorted keys and counts of the level below SHARD_ORDER, the pairs may be those of some shards only.
    """

    def __init__(self, pairs: np.ndarray, counts: np.ndarray, order: int, upper: tuple[np.ndarray, np.ndarray] | None = None):
        self.order, self.levels = order, []
        keys, n = pairs, counts.astype(np.int64)
        by_level = {}
        for k in range(order, -1, -1):
            mask = np.uint64((1 << (8 * (k + 1))) - 1)
            if upper is not None and k == min(SHARD_ORDER, order) - 1:
                keys, n = upper
            elif k < order:
                keys, n = summed(keys & mask, np.ones_like(n))
            by_level[k] = (keys, n)
        with np.errstate(divide="ignore", invalid="ignore"):
            for k in range(order, -1, -1):
                keys, n = by_level[k]
                contexts = keys >> np.uint64(8)
                first = np.flatnonzero(np.r_[True, contexts[1:] != contexts[:-1]]) if len(keys) else np.zeros(0, np.int64)
                of = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(keys)]))
                total = np.add.reduceat(n, first) if len(first) else n[:0]
                kinds = np.diff(np.r_[first, len(keys)])
                level = {"keys": keys, "log_n": np.log(2 * n - 1), "contexts": contexts[first], "own": np.log((2 * n - 1) / (2 * total)[of]) if len(keys) else np.zeros(0), "escape": np.log(kinds / (2 * total)), "kinds": kinds}
                if k:  # what is left of the shorter context without this one's symbols
                    lower, lower_n = by_level[k - 1]
                    mask = np.uint64((1 << (8 * k)) - 1)
                    at = np.searchsorted(lower, keys & mask)
                    taken = np.add.reduceat(lower_n[at], first) if len(first) else n[:0]
                    lower_contexts = lower >> np.uint64(8)
                    suffix = contexts[first] & np.uint64((1 << (8 * (k - 1))) - 1) if k > 1 else np.zeros(len(first), np.uint64)
                    lo, hi = np.searchsorted(lower_contexts, suffix, "left"), np.searchsorted(lower_contexts, suffix, "right")
                    sums = np.r_[0, np.cumsum(lower_n)]
                    left, left_kinds = sums[hi] - sums[lo] - taken, hi - lo - kinds
                    level |= {"log_z": np.log(2 * left), "escape_on": np.where(left_kinds > 0, np.log(left_kinds / (2 * left)), 0.0)}
                self.levels.append(level)
        top = self.levels[0]
        self.slots = Slots(top["keys"], top["own"])

    def log_probabilities(self, keys: np.ndarray) -> np.ndarray:
        """Natural logarithms, one for each pair of the highest order."""
        out, todo = self.slots.find(keys)
        before = self.find(self.levels[0]["contexts"], keys[todo] >> np.uint64(8))
        out[todo] += np.where(before >= 0, self.levels[0]["escape"][before] if len(self.levels[0]["escape"]) else 0.0, 0.0)
        for k in range(self.order - 1, -1, -1):
            if not len(todo):
                return out
            level, above = self.levels[self.order - k], self.levels[self.order - k - 1]
            key = keys[todo] & np.uint64((1 << (8 * (k + 1))) - 1)
            at = self.find(level["keys"], key)
            context = self.find(level["contexts"], key >> np.uint64(8))
            hit, excluded = at >= 0, before >= 0
            gain = np.zeros(len(todo))
            if len(level["keys"]):
                a, c = np.maximum(at, 0), np.maximum(context, 0)
                gain = np.where(hit, level["own"][a], np.where(context >= 0, level["escape"][c], 0.0))
                if len(above["keys"]):
                    b = np.maximum(before, 0)
                    gain = np.where(excluded, np.where(hit, level["log_n"][a] - above["log_z"][b], above["escape_on"][b]), gain)
            out[todo] += gain
            todo, before = todo[~hit], context[~hit]
        kinds = int(self.levels[-1]["kinds"].sum())
        out[todo] -= np.log(256 - kinds) if kinds < 256 else 0.0
        return out

    @staticmethod
    def find(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
        if not len(sorted_keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
        return np.where(sorted_keys[at] == keys, at, -1)

    def score(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of each text."""
        if not texts:
            return np.zeros(0)
        logs = self.log_probabilities(pair_keys(padded(texts, self.order), self.order))
        ends = np.cumsum([len(t) + 1 for t in texts])
        return np.add.reduceat(logs, np.r_[0, ends[:-1]]) / LN10


def adaptive_code_length(text: bytes, order: int = ORDER) -> float:
    """log10 probability of a text under a model that starts empty and learns each byte after coding it."""
    seen: dict[bytes, Counter] = {}
    history, total = bytes([START]) * order, 0.0
    for symbol in [*text, END]:
        excluded: set[int] = set()
        found = 0
        for k in range(order, -1, -1):
            left = {s: c for s, c in seen.get(history[len(history) - k :], {}).items() if s not in excluded}
            if not left:
                continue
            twice = 2 * sum(left.values())
            if symbol in left:
                total += np.log10((2 * left[symbol] - 1) / twice)
                found = k
                break
            total += np.log10(len(left) / twice)
            excluded |= set(left)
        else:
            total -= np.log10(max(1, 256 - len(excluded)))
        for k in range(found, order + 1):
            seen.setdefault(history[len(history) - k :], Counter())[symbol] += 1
        history = (history + bytes([symbol]))[1:] if order else b""
    return float(total)


def context_mask(k: int) -> int:
    return (1 << 8 * k) - 1


def resolved(pairs: DataFrame, asked: DataFrame, order: int) -> DataFrame:
    """(pair, log_p) of the distinct pairs asked (pair) for, by the model of all pairs (pair, n)."""
    spark, depth = pairs.sparkSession, min(SHARD_ORDER, order)
    upper = None
    if depth:
        short = pairs.select(F.col("pair").bitwiseAND(F.lit(context_mask(depth + 1))).alias("pair")).distinct()
        found = short.groupBy(F.col("pair").bitwiseAND(F.lit(context_mask(depth))).alias("pair")).agg(F.count("*").alias("n")).toArrow()
        keys = found.column("pair").to_numpy().astype(np.int64).view(np.uint64)
        rank = np.argsort(keys)
        upper = spark.sparkContext.broadcast((keys[rank], found.column("n").to_numpy()[rank].astype(np.int64)))
    small_batches(spark)

    def solved(pair: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        want = pair[n == 0]
        if len(want):
            rank = np.argsort(pair[n > 0])
            trie = Trie(pair[n > 0][rank], n[n > 0][rank], order, upper.value if upper else None)
            logs = trie.log_probabilities(want)
            for i in range(0, len(want), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(want[i : i + 100_000].view(np.int64)), pa.array(logs[i : i + 100_000])], ["pair", "log_p"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        rows = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)])
            rows += b.num_rows
            if rows > SHARD_ROWS and held[0][0][0] != held[-1][0][-1]:  # whole shards only
                shard, pair, n = (np.concatenate(x) for x in zip(*held, strict=True))
                cut = int(np.searchsorted(shard, shard[-1]))
                yield from solved(pair[:cut].view(np.uint64), n[:cut])
                held, rows = [[shard[cut:], pair[cut:], n[cut:]]], len(shard) - cut
        if held:
            _, pair, n = (np.concatenate(x) for x in zip(*held, strict=True))
            yield from solved(pair.view(np.uint64), n)

    shard = F.shiftrightunsigned("pair", 8).bitwiseAND(F.lit(context_mask(depth))).alias("shard")
    both = pairs.select(shard, "pair", "n").union(asked.select(shard, "pair", F.lit(0).cast("long")))
    return both.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, "pair long, log_p double")


def scores(docs: DataFrame, training: DataFrame, order: int = ORDER, max_nodes: int = MAX_NODES, hot_words: int = HOT_WORDS) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of docs (doc_id, text), learnt from training (text)."""
    spark = docs.sparkSession
    counts = stored(corpus_counts(training, order), "lm-counts")
    words, pairs = counts.where(F.col("word").isNotNull()).select("word", "n"), counts.where(F.col("pair").isNotNull()).select("pair", "n")
    n_train, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    space = float(n_train + distinct + 1)
    short = words.where(F.length("word") <= HOT_WORD_BYTES)
    hot = short.where((F.col("n") >= least_count(short, hot_words)) | (F.length("word") == 0)).toArrow()
    context = F.shiftrightunsigned("pair", 8).alias("context")
    totals = pairs.groupBy(context).agg(F.sum("n").alias("total"))
    kept = pairs.where(F.col("n") >= least_count(pairs, max_nodes)).select("pair", "n", context).join(totals, "context")
    kept = kept.select("pair", F.log((2 * F.col("n") - 1) / (2 * F.col("total"))).cast("float").alias("own")).toArrow()
    model = spark.sparkContext.broadcast((kept.column("pair").to_numpy().astype(np.int64).view(np.uint64), kept.column("own").to_numpy()))
    common = spark.sparkContext.broadcast(dict(zip(hot.column("word").to_pylist(), hot.column("n").to_pylist(), strict=True)))
    small_batches(spark)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Slots(*model.value)
        known = {w: np.log10((c + 1) / space) for w, c in common.value.items()}
        end = known.get(b"", np.log10(1 / space))
        get, part, row = known.get, TaskContext.get().partitionId() << 33, 0
        for b in (b.slice(i, SCORED_ROWS) for b in batches for i in range(0, b.num_rows, SCORED_ROWS)):
            texts = [t.encode("utf-8", "replace") for t in b.column(1).to_pylist()]
            ids, n_tokens, n_known, base, rare, many = [], [], [], [], [], []
            for t in texts:
                found = tokens(t)
                values = [get(w) for w in found]
                cold = Counter(w for w, v in zip(found, values, strict=True) if v is None)
                missing = sum(cold.values())
                ids.append(part + row)
                row += 1
                n_tokens.append(len(found) + 1)
                n_known.append(len(found) - missing + (b"" in known))
                base.append(sum(v for v in values if v is not None) + end)
                rare.append(list(cold))
                many.append(list(cold.values()))
            keys = pair_keys(padded(texts, order), order)
            ends = np.cumsum([len(t) + 1 for t in texts])
            logs, missed = cache.find(keys)
            at = np.searchsorted(ends, missed, "right")
            rank = np.lexsort((keys[missed], at))
            at, cold_keys = at[rank], keys[missed][rank]
            first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (cold_keys[1:] != cold_keys[:-1])]) if len(at) else np.zeros(0, np.int64)
            offsets = pa.array(np.searchsorted(at[first], np.arange(len(texts) + 1)).astype(np.int32))
            times = np.diff(np.r_[first, len(at)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), b.column(0), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(np.add.reduceat(logs, np.r_[0, ends[:-1]]), pa.float64()), pa.array(rare, pa.list_(pa.binary())), pa.array(many, pa.list_(pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(cold_keys[first].view(np.int64))), pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int64)))],
                ["row", "doc_id", "n_tokens", "n_known", "base", "log_p", "rare", "many", "pairs", "times"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    scored = stored(rows.mapInArrow(score, "row long, doc_id long, n_tokens long, n_known long, base double, log_p double, rare array<binary>, many array<long>, pairs array<long>, times array<long>"), "lm-scores")
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "many")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.many").alias("tf"))
    rare = rare.join(words.withColumnRenamed("n", "c"), "word", "left")
    value = F.col("tf") * F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(space))
    rare = rare.groupBy("row").agg(F.sum(value).alias("rare_base"), F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("rare_known"))
    cold = scored.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("tf"))
    logs = resolved(pairs, cold.select("pair").distinct(), order)
    cold = cold.join(logs, "pair").groupBy("row").agg(F.sum(F.col("tf") * F.col("log_p")).alias("cold_log_p"))
    both = scored.select("row", "doc_id", "n_tokens", "n_known", "base", "log_p").join(rare, "row", "left").join(cold, "row", "left")
    return both.select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"),
        ((F.col("log_p") + F.coalesce("cold_log_p", F.lit(0.0))) / F.lit(float(LN10))).alias("score"),
    )
