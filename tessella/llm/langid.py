"""Language identification, words first: a known word counts with its relative frequency in each language; an unseen
one with its longest character n-grams that are known, falling back to shorter ones.

Costs are -log10 of relative frequencies; a language that lacks a word (or n-gram) that another has pays `PENALTY`. The
language with the smallest mean cost over the words of a text wins; ties go to the smaller name. An unseen word costs the
mean over its known n-grams of the greatest length, up to `LONGEST`, that has any, each as often as it occurs in the word
(word ends are marked); with none at all it costs `PENALTY` everywhere. Words are runs of letters with their
combining marks.

Every word of the training texts and all n-grams of each are counted, none is left out. Words and n-grams are known by
64-bit hashes, which spares moving strings. The entries are stored; the most frequent ones, at most `CACHE_BYTES` of
them, are broadcast as a cache, which no result depends on: words that it lacks are looked up in the stored entries by a
join, and of those that are in none of the training texts the n-grams that the cache lacks likewise. So what a task holds
is bounded, and a text's languages come out as if every task had the whole model.

Nulls: a null text or one without a letter gives 'und' with score 0; rows with a null lang teach nothing. With no
training rows at all every text gives 'und'. Repeated rows are predicted one by one, also those of a null id. Very long
words are words like any other. Columns of any name are kept, but `lang_pred` and `score` are replaced where there are
such columns. An empty table gives no rows.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tessella.llm.common import small_batches, stored, whole_text

LONGEST = 5
PENALTY = 7.0
CACHE_BYTES = 24 << 20
HELD = 200_000
UNKNOWN = "und"
#: Combining marks, which belong to the letter before them (vowel signs of Indic scripts, tone marks).
MARKS = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) in ("Mn", "Mc"))
PAST_LATIN = re.compile("[\u0300-\U0010ffff]")  # from the first mark on
LETTERS = re.compile(r"[^\W\d_]+")
NEAR, FAR = ("".join(c for c in MARKS if (c > "\uffff") == far) for far in (False, True))  # a class of both is searched one by one
MARKED = re.compile(rf"[^\W\d_]+(?:(?:[{NEAR}]|[{FAR}])+[^\W\d_]*)*")
FACTORS = np.array([0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def words_of(text: str) -> list[str]:
    text = text.lower()
    pattern = MARKED if not text.isascii() and PAST_LATIN.search(text) else LETTERS
    found = pattern.findall(text)
    if "".join(found).isalpha() or not found:
        return found
    if odd := [c for c in set().union(*found) if not c.isalpha() and unicodedata.category(c) not in ("Mn", "Mc")]:
        found = pattern.findall(" ".join(found).translate(dict.fromkeys(map(ord, odd), " ")))  # numbers such as fractions are no letters
    return found


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * FACTORS[0]
    x = (x ^ (x >> np.uint64(29))) * FACTORS[1]
    return x ^ (x >> np.uint64(32))


def word_keys(words: list[str]) -> np.ndarray:
    """XXH64 of the words with seed 42."""
    from xxhash import xxh64_intdigest

    return np.array([xxh64_intdigest(w.encode("utf-8", "replace"), 42) for w in words], np.uint64)


def gram_keys(words: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, keys, numbers of their words) of all n-grams of the words with marked ends, for each size from 1."""
    points = np.frombuffer(" ".join(["", *words, ""]).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    lengths = np.array([len(w) for w in words], np.int64)
    starts = np.r_[0, np.cumsum(lengths + 1)]  # of the mark before each word
    for size in range(1, LONGEST + 1):
        each = np.maximum(lengths + 3 - size, 0)  # a word of n letters has n + 2 marked ones
        of = np.repeat(np.arange(len(words)), each)
        at = starts[of] + np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each)
        key = np.full(len(of), size, np.uint64)
        for i in range(size):
            key = mixed(key * FACTORS[2] + points[at + i])
        yield size, key, of


ENTRIES = "lang string, size int, key long, n long"


def entry_counts(docs: DataFrame) -> DataFrame:
    """(lang, size, key, n) over docs (text, lang): words (size 0) and their n-grams, counted in each task before anything moves."""
    small_batches(docs.sparkSession)

    def rows(lang: str, size: int, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(len(keys), np.int32))), pa.array(np.full(len(keys), size, np.int32)), pa.array(keys.view(np.int64)), pa.array(n)], ["lang", "size", "key", "n"])

    def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank = np.argsort(keys)
        keys, n = keys[rank], n[rank]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        return keys[first], np.add.reduceat(n, first) if len(first) else n

    def flushed(held: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, c in held.items():
            words, n = list(c), np.array(list(c.values()), np.int64)
            grams = {size: (np.zeros(0, np.uint64), np.zeros(0, np.int64)) for size in range(1, LONGEST + 1)}
            for i in range(0, len(words), 100_000):
                some, many = words[i : i + 100_000], n[i : i + 100_000]
                yield rows(lang, 0, word_keys(some), many)
                for size, keys, of in gram_keys(some):
                    new = summed(keys, many[of])
                    grams[size] = summed(np.concatenate([grams[size][0], new[0]]), np.concatenate([grams[size][1], new[1]]))
            for size, (keys, many) in grams.items():
                for i in range(0, len(keys), 100_000):
                    yield rows(lang, size, keys[i : i + 100_000], many[i : i + 100_000])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.setdefault(lang, Counter()).update(words_of(text))
            if sum(map(len, held.values())) > HELD:
                yield from flushed(held)
                held = {}
        yield from flushed(held)

    rows_in = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang")
    return rows_in.mapInArrow(count, ENTRIES).groupBy("lang", "size", "key").agg(F.sum("n").alias("n"))


class Cache:
    """Costs [entry, language] of some entries, by sorted keys."""

    def __init__(self, keys: np.ndarray, costs: np.ndarray):
        rank = np.argsort(keys)
        self.keys, self.costs = keys[rank], costs[rank]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Rows of the keys, -1 where there is none."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)


class Model:
    """Stored entries (size, key, costs), the languages in order, and the broadcast cache."""

    def __init__(self, langs: list[str], entries: DataFrame, words: Cache, grams: Cache):
        self.langs, self.entries, self.words, self.grams = langs, entries, words, grams


def train(docs: DataFrame, cache_bytes: int = CACHE_BYTES) -> Model:
    """From docs (text, lang)."""
    counts = stored(entry_counts(docs), "language-counts")
    totals = {(r[0], r[1]): float(r[2]) for r in counts.groupBy("lang", "size").agg(F.sum("n")).collect()}
    langs = sorted({lang for lang, _ in totals})
    spark = docs.sparkSession
    cost = lambda lang: F.coalesce(F.max(F.when(F.col("lang") == lang, F.least(F.lit(PENALTY), -F.log10(F.col("n") / F.col("total"))))), F.lit(PENALTY)).cast("float")
    sums = spark.createDataFrame([(*k, n) for k, n in totals.items()] or [("", 0, 1.0)], "lang string, size int, total double")
    wide = counts.join(F.broadcast(sums), ["lang", "size"]).groupBy("size", "key")
    entries = stored(wide.agg(F.sum("n").alias("n"), F.array(*[cost(x) for x in langs] or [F.lit(0.0).cast("float")]).alias("costs")), "language-entries")
    most = cache_bytes // (12 + 4 * max(1, len(langs)))
    caches = []
    for some in (entries.where("size = 0"), entries.where("size > 0")):
        kept = some.where(F.col("n") >= least_count(some, most // 2)).select("key", "costs").toArrow()
        costs = kept.column("costs").combine_chunks()
        table = costs.flatten().to_numpy().reshape(len(kept), -1) if len(kept) else np.zeros((0, max(1, len(langs))), np.float32)
        caches.append(Cache(kept.column("key").to_numpy().astype(np.int64).view(np.uint64), table.astype(np.float32)))
    return Model(langs, entries, *caches)


def least_count(counts: DataFrame, most: int) -> int:
    """The smallest n such that at most `most` rows have that n or more."""
    level = F.when(F.col("n") < 4096, F.col("n")).otherwise(F.pow(2.0, F.floor(F.log2("n"))).cast("long"))
    seen, least = 0, 1 << 62
    for c, rows in sorted(((r[0], r[1]) for r in counts.groupBy(level.alias("level")).count().collect()), reverse=True):
        seen += rows
        if seen > most:
            return least
        least = c
    return 1


def best(sums: np.ndarray, n_words: np.ndarray, langs: list[str]) -> tuple[list[str], np.ndarray]:
    """The language and the score of each text from the summed costs of its words."""
    mean = sums / np.maximum(n_words, 1)[:, None]
    at = mean.argmin(1)
    odds = 10.0 ** (-np.minimum(n_words, 20)[:, None] * (mean - mean[np.arange(len(at)), at][:, None]))
    return [langs[i] if n else UNKNOWN for i, n in zip(at.tolist(), n_words.tolist(), strict=True)], np.where(n_words > 0, 1 / odds.sum(1), 0.0)


def word_costs(words: DataFrame, model: Model) -> DataFrame:
    """(word_key, costs) of distinct words (word_key, word) that the cache lacks: from the stored entries, else from their
    n-grams."""
    spark, n = words.sparkSession, len(model.langs)
    known = model.entries.where("size = 0").select(F.col("key").alias("word_key"), "costs")
    looked = stored(words.join(known, "word_key", "left"), "language-words")
    unseen = looked.where("costs is null").select("word_key", "word")
    shared = spark.sparkContext.broadcast(model.grams)
    small_batches(spark)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each word the n-grams that decide: a row (size, key) for each that the cache lacks, and a row with the sum
        over those that it has of the greatest size, beside which larger ones that it lacks may exist."""
        cache = shared.value
        for b in batches:
            for i in range(0, b.num_rows, 2000):
                words = b.column(0).slice(i, 2000)
                found = {size: (keys, of, cache.find(keys)) for size, keys, of in gram_keys(b.column(1).slice(i, 2000).to_pylist())}
                top = np.zeros(len(words), np.int64)
                for size, (_, of, at) in found.items():
                    top[of[at >= 0]] = size
                for size, (keys, of, at) in found.items():
                    lacks = (at < 0) & (top[of] <= size)
                    if lacks.any():
                        k = pa.array(keys[lacks].view(np.int64))
                        yield pa.RecordBatch.from_arrays([words.take(pa.array(of[lacks])), pa.array(np.full(len(k), size, np.int32)), k, pa.array(np.ones(len(k), np.int32)), pa.nulls(len(k), pa.list_(pa.float32()))], ["word_key", "size", "key", "times", "costs"])
                    has = (at >= 0) & (top[of] == size)
                    if has.any():
                        some, back = np.unique(of[has], return_inverse=True)
                        sums = np.zeros((len(some), max(1, n)), np.float64)
                        np.add.at(sums, back, cache.costs[at[has]])
                        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * sums.shape[1], pa.int32()), pa.array(sums.astype(np.float32).ravel()))
                        yield pa.RecordBatch.from_arrays([words.take(pa.array(some)), pa.array(np.full(len(some), size, np.int32)), pa.nulls(len(some), pa.int64()), pa.array(np.bincount(back).astype(np.int32)), lists], ["word_key", "size", "key", "times", "costs"])

    asked = stored(unseen.mapInArrow(ask, "word_key long, size int, key long, times int, costs array<float>"), "language-grams")
    have = asked.where("key is null").select("word_key", "size", "times", "costs")
    lack = asked.where("key is not null").select("word_key", "size", "key", "times").join(model.entries.where("size > 0").select("size", "key", "costs"), ["size", "key"])
    by_size = have.union(lack.select("word_key", "size", "times", "costs")).groupBy("word_key", "size")
    sums = by_size.agg(F.sum("times").alias("times"), *[F.sum(F.col("costs")[i].cast("double")).alias(f"c{i}") for i in range(n)])
    chosen = sums.groupBy("word_key").agg(F.max_by(F.struct("times", *[f"c{i}" for i in range(n)]), "size").alias("x"))
    backed = chosen.select("word_key", F.array(*[(F.col(f"x.c{i}") / F.col("x.times")).cast("float") for i in range(n)]).alias("costs"))
    nothing = F.array_repeat(F.lit(PENALTY).cast("float"), n)
    rest = unseen.select("word_key").join(backed, "word_key", "left").select("word_key", F.coalesce("costs", nothing).alias("costs"))
    return looked.where("costs is not null").select("word_key", "costs").union(rest)


def with_language(docs: DataFrame, model: Model, keep_text: bool = True) -> DataFrame:
    """docs with columns lang_pred and score; without `keep_text` the texts themselves are not carried along."""
    spark, langs, n = docs.sparkSession, model.langs, len(model.langs)
    names = [c for c in docs.columns if c not in ("lang_pred", "score") and (keep_text or c != "text")]
    if not langs:
        return docs.select(*names, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = spark.sparkContext.broadcast(model.words)
    small_batches(spark)
    kept = [f"_kept_{c}" for c in names]
    rows = docs.select(*[F.col(c).alias(k) for c, k in zip(names, kept, strict=True)], F.monotonically_increasing_id().alias("_row"), whole_text().alias("_text"))
    partial = StructType([*rows.schema.fields[:-1], *[StructField(k, t) for k, t in (("_words", DoubleType()), ("_pred", StringType()), ("_score", DoubleType()))]])
    more = StructType.fromDDL("_sums array<double>, _cold array<string>, _keys array<long>, _times array<long>").fields

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, places = shared.value, {}
        for b in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            sums, numbers, cold, times, keys = np.zeros((b.num_rows, n)), np.zeros(b.num_rows), [], [], []
            for i, text in enumerate(b.column(b.num_columns - 1).to_pylist()):
                words = words_of(text)
                new = list(set(words).difference(places))
                if new:
                    if len(places) > HELD:
                        places, new = {}, list(set(words))
                    places.update(zip(new, cache.find(word_keys(new)).tolist(), strict=True))
                at = np.array([places[w] for w in words], np.int64)
                numbers[i] = len(words)
                sums[i] = cache.costs[at[at >= 0]].sum(0, dtype=np.float64) if len(words) else 0
                lacking = Counter(w for w, p in zip(words, at.tolist(), strict=True) if p < 0)
                cold.append(list(lacking))
                keys.append(word_keys(cold[-1]).view(np.int64).tolist())
                times.append(list(lacking.values()))
            pred, score = best(sums, numbers, langs)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * n, pa.int32()), pa.array(sums.ravel()))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(numbers), pa.array(pred, pa.string()), pa.array(score), lists, pa.array(cold, pa.list_(pa.string())), pa.array(keys, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int64()))],
                [*partial.fieldNames(), "_sums", "_cold", "_keys", "_times"],
            )

    found = stored(rows.mapInArrow(count, StructType([*partial.fields, *more])), "language-texts")
    open_rows = found.where(F.size("_cold") > 0)
    asked = open_rows.select("_row", F.explode(F.arrays_zip("_cold", "_keys", "_times")).alias("x")).select("_row", F.col("x._keys").alias("word_key"), F.col("x._cold").alias("word"), F.col("x._times").alias("times"))
    costs = word_costs(asked.select("word_key", "word").distinct(), model)
    added = asked.select("_row", "word_key", "times").join(costs, "word_key").groupBy("_row").agg(*[F.sum(F.col("times") * F.col("costs")[i]).alias(f"_c{i}") for i in range(n)])
    small_batches(spark)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = b.column(2).flatten().to_numpy().reshape(-1, n) if b.num_rows else np.zeros((0, n))
            pred, score = best(sums, b.column(1).to_numpy(), langs)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(score)], ["_row", "_new_pred", "_new_score"])

    total = F.array(*[F.col("_sums")[i] + F.col(f"_c{i}") for i in range(n)])
    decided = open_rows.select("_row", "_words", "_sums").join(added, "_row").select("_row", "_words", total.alias("_sums")).mapInArrow(decide, "_row long, _new_pred string, _new_score double")
    both = found.drop("_sums", "_cold", "_keys", "_times").join(decided, "_row", "left")
    return both.select(*[F.col(k).alias(c) for k, c in zip(kept, names, strict=True)], F.coalesce("_new_pred", "_pred").alias("lang_pred"), F.coalesce("_new_score", "_score").alias("score"))
