"""A distributed positional inverted index of the corpus, asked for the phrases of a benchmark. DataFrame functions only.

Words are runs of ASCII digits and letters and of all other letters beyond ASCII; A-Z count as a-z. An item's phrases are
its windows of `PHRASE` consecutive words, or all its words if it has fewer. Items of the same words are one entry.

1. The corpus is cut into words once: (row, doc_id, mark, words) is stored, and all that follows reads it.
2. The occurrences in the corpus of each benchmark word are counted; a phrase with a word that the corpus lacks cannot
   occur and goes.
3. Of each phrase the two rarest words are its test terms. Postings (term, row, position) are stored for these only.
4. Each posting's position less the term's offset in the entry is where the entry would begin. The lists of the two rarest
   terms meet by (row, entry, begin), which leaves the places where both stand at the right distance.
5. Places are verified against all words of the document, and hit words are counted once.

`proximity_matches` asks the same postings for test terms that stand nearer than a slack to their distance in the item.

Benchmark tables are small next to the corpus but not bounded, so nothing of theirs is broadcast by a hint: they are
stored, and Spark broadcasts what the stored size allows and else joins by sorting, where it splits skewed terms.

Nulls: a null text has no words (n_words 0, not contaminated). Null doc_ids are kept; a null item_id counts as ''.
Rows of the same doc_id are verified one by one against their own text. Empty tables give no rows or no hits. Columns of
the documents other than doc_id and text are passed through by `uncontaminated` whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import stored, whole_text

PHRASE = 10
#: ASCII but digits and letters; texts are in lower case when they are cut.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Capitals beyond A-Z, which stay as they are, and characters that the JVM does not know yet.
OTHER_CAPITALS = r"[\p{IsUppercase}\p{Lt}\p{Cn}&&[^A-Z]]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    """A-Z as a-z and nothing else changed; texts without other capitals go the fast way."""
    plain = (F.octet_length(text) == F.char_length(text)) | ~text.rlike(OTHER_CAPITALS)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: str = "text") -> Column:
    """The words of a text; none of a null text."""
    return F.array_remove(F.split(lowered(whole_text(text)), BETWEEN), "")


def mark(text: str = "text") -> Column:
    return F.xxhash64(whole_text(text))


def forward(docs: DataFrame) -> DataFrame:
    """(row, doc_id, mark, words), stored: each row of docs (doc_id, text) with its words; `mark` tells texts of one id apart."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), mark().alias("mark"), words().alias("words"))
    return stored(rows, "words")


def tokens(rows: DataFrame) -> DataFrame:
    """(row, pos, term): the full index, one row for each word."""
    return rows.select("row", F.posexplode("words").alias("pos", "term"))


def entries(items: DataFrame) -> DataFrame:
    """(item, entry, words) of items (item_id, text); an entry is known by a hash of its words."""
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words().alias("words"))
    return rows.where(F.size("words") > 0).select("item", F.xxhash64("words").alias("entry"), "words").distinct()


def entry_terms(found: DataFrame) -> DataFrame:
    """(entry, n, at, term): the words of the entries, with their number."""
    return found.select("entry", "words").distinct().select("entry", F.size("words").alias("n"), F.posexplode("words").alias("at", "term"))


def frequencies(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, occurrences) in the corpus of those terms (term) that occur."""
    return tokens(rows).join(terms.select("term").distinct(), "term").groupBy("term").agg(F.count("*").alias("occurrences"))


def phrases(terms: DataFrame, counts: DataFrame, length: int = PHRASE) -> DataFrame:
    """(entry, begin, words, rare, second): phrases all of whose words occur, with the places of the rarest words."""
    known = terms.join(counts, "term")
    places = known.select("entry", "n", "at", "term", "occurrences", F.explode(F.expr(f"sequence(greatest(0, at - {length - 1}), greatest(0, least(at, n - {length})))")).alias("begin"))
    ranked = F.sort_array(F.collect_list(F.struct("occurrences", "at")))
    found = places.groupBy("entry", "begin", "n").agg(ranked.alias("ranked"), F.sort_array(F.collect_list(F.struct("at", "term"))).alias("sorted"))
    whole = found.where(F.size("ranked") == F.least(F.lit(length), F.col("n")))
    return whole.select(
        "entry", "begin", F.expr("transform(sorted, x -> x.term)").alias("words"), F.expr("ranked[0].at").alias("rare"),
        F.expr("ranked[least(1, size(ranked) - 1)].at").alias("second"),
    )


def test_terms(terms: DataFrame, found: DataFrame) -> DataFrame:
    """(term, entry, at): the terms of entries that postings are stored for."""
    places = found.select("entry", F.explode(F.array("rare", "second")).alias("at")).distinct()
    return terms.join(places, ["entry", "at"]).select("term", "entry", "at")


def postings(rows: DataFrame, tests: DataFrame) -> DataFrame:
    """(term, row, pos) of the test terms."""
    return tokens(rows).join(tests.select("term").distinct(), "term").select("term", "row", "pos")


def phrase_places(lists: DataFrame, tests: DataFrame, found: DataFrame) -> DataFrame:
    """(row, entry, start, words): where the two rarest words of a phrase stand as they do in it."""
    shifted = lists.join(tests, "term").select("row", "entry", (F.col("pos") - F.col("at")).alias("shift"), "at")
    met = shifted.groupBy("row", "entry", "shift").agg(F.collect_set("at").alias("places"))
    one = met.select("row", "entry", "shift", "places", F.explode("places").alias("rare"))
    both = one.join(found, ["entry", "rare"]).where(F.array_contains("places", F.col("second")) & (F.col("shift") + F.col("begin") >= 0))
    return both.select("row", "entry", (F.col("shift") + F.col("begin")).alias("start"), "words")


def proximity_matches(lists: DataFrame, tests: DataFrame, found: DataFrame, slack: int) -> DataFrame:
    """(row, entry, begin, pos, second_pos): places where the phrase's two rarest words stand at most `slack` words nearer
    or farther than in it; phrases of one word match where it stands."""
    near = lists.join(tests, "term").select("row", "entry", "at", "pos")
    pairs = found.select("entry", "begin", "rare", "second")
    size = slack + 1
    first = near.join(pairs.withColumnRenamed("rare", "at"), ["entry", "at"]).withColumn("wanted", F.col("pos") + F.col("second") - F.col("at"))
    first = first.withColumn("block", F.explode(F.expr(f"sequence(floor((wanted - {slack}) / {size}), floor((wanted + {slack}) / {size}))")))
    second = near.select("row", "entry", F.col("at").alias("second"), F.col("pos").alias("second_pos"), F.floor(F.col("pos") / size).alias("block"))
    both = first.join(second, ["row", "entry", "second", "block"]).where(F.abs(F.col("second_pos") - F.col("wanted")) <= slack)
    return both.select("row", "entry", "begin", "pos", "second_pos").distinct()


def hits(rows: DataFrame, found: DataFrame, length: int = PHRASE) -> DataFrame:
    """(row, entry, start, n), stored: the places in the rows of `forward` where phrases of `entries` occur word by word."""
    terms = stored(entry_terms(found), "entry-terms")
    counts = stored(frequencies(rows, terms), "term-counts")
    asked = stored(phrases(terms, counts, length), "phrases")
    tests = stored(test_terms(terms, asked), "test-terms")
    places = phrase_places(stored(postings(rows, tests), "postings"), tests, asked)
    by_row = stored(places.groupBy("row").agg(F.collect_set(F.struct("entry", "start", F.col("words").alias("phrase"))).alias("places")), "places")
    # Texts move as strings, which take a third of what arrays take, and only those that have a place if these are few.
    asked_rows = stored(by_row.select("row"), "place-rows")
    texts = rows.join(asked_rows, "row", "left_semi").select("row", F.array_join("words", " ").alias("body"))
    exact = by_row.join(texts, "row").withColumn("words", F.split("body", " "))
    exact = exact.select("row", F.explode(F.expr("filter(places, x -> slice(words, x.start + 1, size(x.phrase)) = x.phrase)")).alias("x"))
    return stored(exact.select("row", "x.entry", "x.start", F.size("x.phrase").alias("n")), "hits")


def contamination(docs: DataFrame, items: DataFrame, length: int = PHRASE) -> DataFrame:
    """One row for each of docs (doc_id, text): its words, hit words and the items whose phrases occur in it."""
    rows, found = forward(docs), stored(entries(items), "entries")
    exact = hits(rows, found, length)
    covered = exact.select("row", F.explode(F.expr("sequence(start, start + n - 1)")).alias("at")).distinct().groupBy("row").agg(F.count("*").alias("n_hit"))
    named = exact.select("row", "entry").distinct().join(found.select("entry", "item"), "entry").groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    joined = rows.select("row", "doc_id", F.size("words").cast("long").alias("n_words")).join(covered.join(named, "row"), "row", "left")
    ids, n_hit = F.coalesce("items", F.array().cast("array<string>")), F.coalesce("n_hit", F.lit(0))
    return joined.select(
        "doc_id", "n_words", n_hit.cast("long").alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def uncontaminated(docs: DataFrame, items: DataFrame, length: int = PHRASE) -> DataFrame:
    """docs, all columns, without the rows that hold a phrase of an item."""
    rows = forward(docs.select("doc_id", "text"))
    hit = hits(rows, stored(entries(items), "entries"), length).select("row").distinct()
    gone = rows.select("row", "doc_id", "mark").join(hit, "row").select(F.col("doc_id").alias("_gone_id"), F.col("mark").alias("_gone_mark")).distinct()
    return docs.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col("_gone_id")) & (mark() == F.col("_gone_mark")), "left_anti")
