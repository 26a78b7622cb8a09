"""Spelling variants: words that differ by one letter, found over a reduced alphabet, and the frequent form each belongs to.

Letters are hashed to `SYMBOLS` symbols. The reduced form of a word that is one edit away is the word's own reduced form or
one edit away from it, so each word generates the whole one-edit neighbourhood of its reduced form over the few symbols
(about (2 L + 1) * SYMBOLS strings for L letters, instead of one for each letter of the alphabet), the neighbourhood is
joined to the reduced vocabulary, and what meets is verified on the original words. Strings over the symbols are
polynomial hashes modulo 2^64, which a deletion, replacement or insertion changes by a term that prefix and suffix sums
give; equal hashes of different strings only cost a verification. Each neighbour is made once: an insertion or deletion
within a run of one symbol is taken at the run's begin.

A word's form is its near word of the largest count (ties: the first in code-point order) if that is `RATIO` times its own
at least, and the root is where forms lead to. A form's count is ten times the word's, so a chain has no more steps than
the largest count has digits.

Tasks get a filter of the reduced vocabulary of a fixed size, so that of a neighbourhood only what some word may have is
shuffled: a hash, the word's number and its letters as bits. Words of a reduced form never come together as a group, and
what meets is passed on if its letters can be one edit apart; Spark splits a skewed join partition. A very long word's
neighbourhood is made in slices.

Nulls: a null text has no words; a null id counts as the empty text in the hash that decides on a deletion. Equal rows
count each. An empty table, or one without words, gives no rows. Of docs only doc_id and text are read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import small_batches, stored, whole_text

SYMBOLS = 12
#: Runs of so many letters, once A-Z are lower-cased.
LETTERS = "[a-z\u00c0-\u00ff]{%d,}"
SHORTEST = 7
FEWEST = 2
NOISE = 31
RATIO = 10
#: Words that a task counts before it hands the counts on.
HELD = 1 << 18
#: Bits of the filter of reduced words that tasks get, 8 MiB. More words than bits let more through, and change no result.
FILTER_BITS = 1 << 26
#: Neighbours that a task makes at a time.
CELLS = 1 << 18

WIDE = np.uint64
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
INVERSE = pow(BASE, -1, 1 << 64)


def words_of(docs: DataFrame, shortest: int = SHORTEST, noise: int = NOISE, held: int = HELD) -> DataFrame:
    """(word, n): counts by tasks of the runs of letters of docs (doc_id, text), only A-Z lower-cased, of `shortest` letters
    at least after one is deleted where the hash of the id and the run is divisible by `noise`."""
    small_batches(docs.sparkSession)
    runs = re.compile(LETTERS % shortest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def handed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        counts: dict[str, int] = {}
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                begun = zlib.crc32(f"{i}:".encode())
                # Bytes only know A-Z when they are lower-cased.
                for word, n in Counter(runs.findall(text.encode().lower().decode())).items():
                    h = zlib.crc32(word.encode(), begun)
                    if h % noise == 0:
                        word = word[: h % len(word)] + word[h % len(word) + 1 :]
                        if len(word) < shortest:
                            continue
                    counts[word] = counts.get(word, 0) + n
                if len(counts) > held:
                    yield handed()
                    counts = {}
        yield handed()

    one = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), whole_text().alias("text"))
    return one.mapInArrow(run, "word string, n long")


def vocabulary(docs: DataFrame, fewest: int = FEWEST) -> DataFrame:
    """(wid, word, n): the words of docs that come `fewest` times at least, numbered."""
    counts = words_of(docs).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= fewest)
    return stored(counts.select(F.monotonically_increasing_id().alias("wid"), "word", "n"), "vocabulary")


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> WIDE(30))) * WIDE(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> WIDE(27))) * WIDE(0x94D049BB133111EB)
    return x ^ (x >> WIDE(31))


def symbols_of(words: list[str], symbols: int) -> np.ndarray:
    """Symbols (from 1) of words of one length, one row each."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(WIDE)
    return (mixed(points) % WIDE(symbols) + WIDE(1)).reshape(len(words), -1)


def powers(n: int) -> np.ndarray:
    out = np.ones(n, WIDE)
    if n > 1:
        out[1:] = np.multiply.accumulate(np.full(n - 1, BASE, WIDE))
    return out


def reduced(words: list[str], symbols: int = SYMBOLS) -> np.ndarray:
    """Hashes of the reduced forms of words of one length."""
    s = symbols_of(words, symbols)
    return (s * powers(s.shape[1])).sum(1, dtype=WIDE)


def neighbourhoods(words: list[str], symbols: int = SYMBOLS, cells: int = CELLS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, hash) arrays: of each of these words of one length the reduced form and all that is one edit from it, once."""
    s = symbols_of(words, symbols)
    n, length = s.shape
    p = powers(length + 1)
    terms = s * p[:length]
    prefix = np.concatenate([np.zeros((n, 1), WIDE), np.cumsum(terms, 1, dtype=WIDE)], 1)
    whole = prefix[:, -1:]
    rows = np.arange(n)
    yield rows, whole[:, 0]
    # A symbol that its left neighbour equals: deleting either, or inserting it before either, gives the same string.
    again = np.concatenate([np.zeros((n, 1), bool), s[:, 1:] == s[:, :-1]], 1)
    step = max(1, cells // max(1, n * symbols))
    for at in range(0, length + 1, step):
        i = slice(at, min(at + step, length))
        if i.start < i.stop:
            row, place = np.nonzero(~again[:, i])
            gone = prefix[:, i] + (whole - prefix[:, i.start + 1 : i.stop + 1]) * WIDE(INVERSE)
            yield row, gone[row, place]
        k = slice(at, min(at + step, length + 1))
        before = np.zeros((n, k.stop - k.start), WIDE)
        before[:, (1 if k.start == 0 else 0) :] = s[:, max(k.start - 1, 0) : k.stop - 1]
        shifted = prefix[:, k] + (whole - prefix[:, k]) * WIDE(BASE)
        for symbol in range(1, symbols + 1):
            if i.start < i.stop:
                row, place = np.nonzero(s[:, i] != symbol)
                yield row, (whole + (WIDE(symbol) - s[:, i]) * p[i])[row, place]
            row, place = np.nonzero(before != symbol)
            yield row, (shifted + WIDE(symbol) * p[k])[row, place]


def by_length(wids: np.ndarray, words: list[str], cells: int = CELLS) -> Iterator[tuple[np.ndarray, list[str]]]:
    """The words in groups of one length, each of about `cells` letters at most or one word."""
    lengths = np.array([len(w) for w in words])
    for length in np.unique(lengths):
        at = np.nonzero(lengths == length)[0]
        many = max(1, cells // (int(length) * 4 * SYMBOLS))
        for i in range(0, len(at), many):
            part = at[i : i + many]
            yield wids[part], [words[k] for k in part]


def letters_in(words: list[str]) -> np.ndarray:
    """Which of 64 groups of letters each word has, as bits: words one edit apart differ in two bits at most."""
    ends = np.cumsum([len(w) for w in words])
    points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(WIDE)
    return np.bitwise_or.reduceat(WIDE(1) << (points % WIDE(64)), ends - [len(w) for w in words])


def word_codes(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """(code, letters, wid, word, n) of words: the hash of the reduced form of each, and its letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, codes = b.column(1).to_pylist(), np.zeros(len(b), np.int64)
            lengths = np.array([len(w) for w in texts])
            for length in np.unique(lengths):
                at = np.nonzero(lengths == length)[0]
                codes[at] = reduced([texts[k] for k in at], symbols).view(np.int64)
            if texts:
                yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(letters_in(texts).view(np.int64)), *b.columns], ["code", "letters", "wid", "word", "n"])

    return words.select("wid", "word", "n").mapInArrow(run, "code long, letters long, wid long, word string, n long")


def code_filter(codes: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """`bits` bits, as numbers of 64, of which those of the codes are 1; their number and so the size is fixed."""
    place = F.pmod("code", F.lit(bits))
    cells = codes.select(F.shiftright(place, 6).alias("cell"), F.expr(f"shiftleft(1L, cast(pmod(code, {bits}) % 64 as int))").alias("bit")).groupBy("cell").agg(F.bit_or("bit").alias("bits"))
    found, out = cells.toArrow(), np.zeros(bits // 64, np.int64)
    out[found["cell"].to_numpy()] = found["bits"].to_numpy()
    return out.view(WIDE)


def neighbour_codes(words: DataFrame, known: np.ndarray | None = None, symbols: int = SYMBOLS) -> DataFrame:
    """(code, letters, wid): the reduced neighbourhoods of words (wid, word), as far as the filter of codes knows them."""
    sent = None if known is None else words.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for wids, group in by_length(b.column(0).to_numpy(), b.column(1).to_pylist()):
                letters = letters_in(group).view(np.int64)
                for row, code in neighbourhoods(group, symbols):
                    if sent is not None:
                        place = code % WIDE(len(sent.value) * 64)
                        hit = (sent.value[place >> WIDE(6)] >> (place & WIDE(63)) & WIDE(1)).astype(bool)
                        row, code = row[hit], code[hit]
                    yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), pa.array(letters[row]), pa.array(wids[row])], ["code", "letters", "wid"])

    return words.select("wid", "word").mapInArrow(run, "code long, letters long, wid long")


def one_edit(a: Column, b: Column) -> Column:
    """Whether two strings differ by one inserted, deleted or replaced code point."""
    return F.levenshtein(a, b, 1) == 1


def near_words(words: DataFrame, symbols: int = SYMBOLS, bits: int = FILTER_BITS) -> DataFrame:
    """(wid, near, near_n): the words one edit from each of words (wid, word, n), and how often they come."""
    small_batches(words.sparkSession, 2000)
    coded = stored(word_codes(words, symbols), "word-codes")
    around = neighbour_codes(words, code_filter(coded, bits), symbols)
    known = coded.select("code", F.col("letters").alias("near_letters"), F.col("wid").alias("other"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    alike = (F.col("wid") != F.col("other")) & (F.bit_count(F.col("letters").bitwiseXOR(F.col("near_letters"))) <= 2)
    met = around.join(known, "code").where(alike).select("wid", "near", "near_n")
    return met.join(words.select("wid", "word"), "wid").where(one_edit(F.col("word"), F.col("near"))).select("wid", "near", "near_n")


def with_roots(forms: DataFrame, most: int) -> DataFrame:
    """(word, root) of forms (word, form), where a chain has no more steps than `most`, the largest count, allows: each round
    doubles the steps."""
    found, steps, longest = forms.select("word", F.col("form").alias("root")), 1, len(str(max(most, 1)))
    while steps < longest:
        onward = found.select(F.col("word").alias("via"), F.col("root").alias("last"))
        found = stored(found.join(onward, F.col("root") == F.col("via"), "left").select("word", F.coalesce("last", "root").alias("root")), "roots")
        steps *= 2
    return found


def variants(docs: DataFrame, symbols: int = SYMBOLS, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form, form_n, root of the words of docs (doc_id, text)."""
    words = vocabulary(docs.select("doc_id", "text"))
    near = near_words(words, symbols).groupBy("wid").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("first"))
    joined = words.join(near, "wid", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "first.near", (-F.col("first.less")).alias("near_n"))
    enough = F.col("near_n") >= ratio * F.col("n")
    found = stored(joined.select("word", "n", "n_near", F.when(enough, F.col("near")).alias("form"), F.when(enough, F.col("near_n")).alias("form_n")), "forms")
    most = found.agg(F.max("n").alias("most")).first()["most"] or 1
    roots = with_roots(found.where("form is not null").select("word", "form"), most)
    return found.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
