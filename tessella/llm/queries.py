"""One query per operator over its whole table, with the parameters for production."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import alignment, gif, index, langid, licences, minhash, packing, ppm, quality, roles, simhash, spelling, windows
from tessella.llm.common import id_remainder, table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.repaired(table(spark, sf_dir, "conversations"))


def op2_licence_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op3_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.digests(gif.gif_column(table(spark, sf_dir, "documents"), "text"))


def op4_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.sharing_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    learn = labels.where(id_remainder("doc_id", 5) != 0).select("doc_id", F.col("quality").alias("label"))
    model = quality.train(docs.select("doc_id", "text"), learn)
    scored = quality.with_score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (id_remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op7_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = ppm.scores(docs, docs.where(id_remainder("doc_id", 7) != 2))
    return found.select("doc_id", (id_remainder("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), tokenizer_path(), with_ids=False)
    return pieces.drop("ids")


def op10_word_backoff_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.where(id_remainder("doc_id", 4) != 2).select("text", "lang"))
    found = langid.with_language(docs.select("doc_id", "text"), model, keep_text=False)
    return found.select("doc_id", (id_remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op11_arrow_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_sums(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))


def op12_reduced_alphabet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_coordinate_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {
    f.__name__: f
    for f in (op1_role_repair, op2_licence_sentences, op3_gif_media, op4_compact_windows, op5_positional_index, op6_compression_quality, op7_simhash_bktree, op8_ppm_scores, op9_mixture_packing, op10_word_backoff_language,
              op11_arrow_alignment, op12_reduced_alphabet, op13_coordinate_join)
}

OP5_SQL = r"""
WITH item_words AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
phrases AS (
  SELECT DISTINCT item, w[b:b + least(10, len(w)) - 1] AS p
  FROM (SELECT item, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS b FROM item_words WHERE len(w) > 0)),
doc_words AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
lengths AS (SELECT DISTINCT len(p) AS n FROM phrases),
grams AS (
  SELECT r, s, n, w[s:s + n - 1] AS g
  FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM doc_words, lengths WHERE len(w) >= n)),
hits AS (SELECT r, s, n, item FROM grams JOIN phrases ON g = p),
covered AS (SELECT r, count(DISTINCT s + i - 1) AS n_hit FROM (SELECT r, s, unnest(generate_series(1, n)) AS i FROM hits) GROUP BY r),
found AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN covered USING (r) LEFT JOIN found USING (r)
"""

OP12_SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, s: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= 7 GROUP BY 1, 2),
coded AS (SELECT run, n, hex(concat(CAST(doc_id AS VARCHAR), ':', run)) AS h FROM runs),
hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
                                 lambda c, b: xor(c // 256, t[(xor(c, b) & 255) + 1])), 4294967295) AS crc
  FROM coded, crc_table),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT n, CASE WHEN crc % 31 = 0 THEN substr(run, 1, crc % length(run)) || substr(run, crc % length(run) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 7 GROUP BY 1 HAVING sum(n) >= 2),
cuts AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(generate_series(1, length(word))) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON c.rest = w.word
  UNION SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON c.rest = w.word),
best AS (SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS place FROM near),
forms AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * n THEN near END AS form, CASE WHEN near_n >= 10 * n THEN near_n END AS form_n
  FROM words LEFT JOIN (SELECT * FROM best WHERE place = 1) USING (word)),
chain AS (
  SELECT word, form AS last, 1 AS steps FROM forms WHERE form IS NOT NULL
  UNION ALL SELECT chain.word, forms.form, steps + 1 FROM chain JOIN forms ON forms.word = last WHERE forms.form IS NOT NULL),
roots AS (SELECT word, arg_max(last, steps) AS root FROM chain GROUP BY 1)
SELECT word, form, coalesce(root, word) AS root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM forms LEFT JOIN roots USING (word)
"""

OP13_SQL = r"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT r, array_to_string(w[b:b + least(4, len(w)) - 1], ' ') AS g
  FROM (SELECT r, w, unnest(generate_series(1, greatest(1, len(w) - 3))) AS b FROM words WHERE len(w) > 0)),
sizes AS (SELECT r, count(*) AS n FROM shingles GROUP BY r),
shared AS (SELECT a.r AS x, b.r AS y, count(*) AS i FROM shingles a JOIN shingles b ON a.g = b.g AND a.r <> b.r GROUP BY 1, 2),
links AS (SELECT x, y FROM shared JOIN sizes p ON p.r = x JOIN sizes q ON q.r = y WHERE 100 * i >= 80 * (p.n + q.n - i)),
reach AS (SELECT r, r AS other FROM words UNION SELECT reach.r, y FROM reach JOIN links ON other = x),
least_ids AS (SELECT reach.r, min(doc_id) AS component_id FROM reach JOIN words ON words.r = other GROUP BY 1)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept
FROM words JOIN least_ids USING (r) LEFT JOIN sizes USING (r)
"""

ORACLE_SQL: dict[str, str] = {"op5_positional_index": OP5_SQL, "op12_reduced_alphabet": OP12_SQL, "op13_coordinate_join": OP13_SQL}
