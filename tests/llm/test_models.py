import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from tessella.llm import langid, ppm, quality, queries
from tessella.llm.common import table

ODD = [(0, None), (1, ""), (2, "123 456"), (3, "the and of"), (3, "the and of"), (None, "of the"), (5, "lorem " * 5000), (6, "\x00\x01")]


def odd(spark):
    return spark.createDataFrame([(d, t, 1.0, "x") for d, t in ODD], "doc_id long, text string, score double, lang string").drop("score")


def held(doc_id, modulus, rest):
    return zlib.crc32(str(doc_id).encode()) % modulus == rest


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in queries.op6_compression_quality(spark, sf).collect()}
    labels = {r["doc_id"]: r["quality"] for r in table(spark, sf, "labels").collect()}
    assert len(got) == table(spark, sf, "documents").count()
    assert all(r["held_out"] == held(d, 5, 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for d, r in got.items())
    test = [d for d in labels if held(d, 5, 0)]
    assert np.mean([got[d]["predicted"] == labels[d] for d in test]) > 0.94
    assert all(got[d]["predicted"] for d in test if labels[d])


def test_quality_odd_texts_and_labels(spark):
    docs = odd(spark)
    for rows in ([], [(0, 1), (3, None)], [(3, 1), (5, 0)]):
        model = quality.train(docs, spark.createDataFrame(rows, "doc_id long, label int"))
        got = quality.with_score(docs, model).collect()
        assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    good, bad = [f"plain words number {i} follow each other here".encode() for i in range(400)], [f"!!{i}%% ## $$ @@ {i * 7}".encode() for i in range(400)]
    model = quality.fit({0: bad, 1: good})
    assert model.score(b"plain words number 7531 follow each other here") > 0.5 > model.score(b"!!3%% ## $$ @@ 21") and model.score(b"") == model.prior
    assert quality.with_score(docs.limit(0), model).count() == 0


def test_language_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in table(spark, sf, "documents").collect()}
    got = {r["doc_id"]: r for r in queries.op10_word_backoff_language(spark, sf).collect()}
    test = [d for d in lang if held(d, 4, 2)]
    assert sorted(d for d, r in got.items() if r["held_out"]) == sorted(test)
    assert np.mean([got[d]["lang_pred"] == lang[d] for d in test]) > 0.97 and all(0 <= r["score"] <= 1 for r in got.values())


def brute_language(training, texts):
    """By dictionaries of all words and n-grams, kept whole."""
    def words(t):
        found = ""
        for c in (t or "").lower():
            mark = unicodedata.category(c) in ("Mn", "Mc") and found[-1:].strip()
            found += c if c.isalpha() or mark else " "
        return found.split()

    grams = lambda w, k: [f" {w} "[i : i + k] for i in range(len(w) + 3 - k)]
    counts = {k: {} for k in range(6)}
    for text, lang in training:
        for w in words(text) if text is not None and lang is not None else []:
            for k in range(6):
                counts[k].setdefault(lang, Counter()).update([w] if k == 0 else grams(w, k))
    langs = sorted(counts[0])

    def costs(k, x):
        n = [counts[k].get(lang, {}).get(x, 0) for lang in langs]
        return [min(7.0, -np.log10(c / sum(counts[k][lang].values()))) if c else 7.0 for c, lang in zip(n, langs, strict=True)] if any(n) else None

    def cost(w):
        if (c := costs(0, w)) is not None:
            return c
        for k in range(5, 0, -1):
            if known := [c for g in grams(w, k) if (c := costs(k, g)) is not None]:
                return np.mean(known, axis=0)
        return [7.0] * len(langs)

    out = []
    for t in texts:
        w = words(t)
        if not w or not langs:
            out.append(("und", 0.0))
            continue
        mean = np.mean([cost(x) for x in w], axis=0)
        at = int(mean.argmin())
        out.append((langs[at], 1 / sum(10 ** (-min(len(w), 20) * (mean - mean[at])))))
    return out


@pytest.mark.parametrize("cache", [0, 600, 4000, langid.CACHE_BYTES])
def test_language_against_brute_force_whatever_the_cache(spark, cache):
    rows = [
        (1, "the cat and the dog \u00bd ran", "en"), (2, "le chat et le chien \u2167 courent", "fr"), (3, "der hund und die katze", "de"), (31, "\u0939\u093f\u0928\u094d\u0926\u0940 \u092d\u093e\u0937\u093e \u092e\u0947\u0902", "hi"), (32, "\u09ac\u09be\u0982\u09b2\u09be \u09ad\u09be\u09b7\u09be", "bn"), (33, "\u0e01\u0e34\u0e19\u0e02\u0e49\u0e32\u0e27", "th"), (4, None, "en"), (5, "nobody knows", None),
        (6, "the dog", "en"), (6, "the dog", "en"), (None, "chienne chatte", "fr"), (8, "katzen hunde " * 30 + "x" * 5000, "de"), (9, "", "fr"),
    ]
    texts = [*[r[1] for r in rows], "\u092d\u093e\u0937\u093e\u0913\u0902 \u00bd\u0940", "\u0301 cat\u0301s", "\u0301", "hundert chatons", "\u00bd \u2167 \u00b2 12", "qqq zzz", "\u65e5\u672c", "Katze-Hund_9\u00b2cat", "y" * 3000, "x" * 4999]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, cache)
    asked = spark.createDataFrame([(i, t, "a", 0.5, 3) for i, t in enumerate(texts)], "doc_id int, text string, word string, score double, costs int").withColumns({"key": F.lit(1), "_row": F.lit(2)})
    got = langid.with_language(asked, model)
    assert got.columns == ["doc_id", "text", "word", "costs", "key", "_row", "lang_pred", "score"]
    want = brute_language([(r[1], r[2]) for r in rows], texts)
    for r in got.collect():
        pred, score = want[r["doc_id"]]
        assert (r["lang_pred"], r["text"]) == (pred, texts[r["doc_id"]]) and abs(r["score"] - score) < 1e-4, (r, pred, score)


def test_words_keep_their_marks():
    assert langid.words_of("\u0939\u093f\u0928\u094d\u0926\u0940 \u092d\u093e\u0937\u093e, \u09ac\u09be\u0982\u09b2\u09be \u0e01\u0e34\u0e19\u0e02\u0e49\u0e32\u0e27") == ["\u0939\u093f\u0928\u094d\u0926\u0940", "\u092d\u093e\u0937\u093e", "\u09ac\u09be\u0982\u09b2\u09be", "\u0e01\u0e34\u0e19\u0e02\u0e49\u0e32\u0e27"]
    assert langid.words_of("\u0301a\u0301 1\u0301 b\u00bdc_d") == ["a\u0301", "b", "c", "d"]


def test_language_odd_tables(spark):
    docs = odd(spark)
    got = langid.with_language(docs.drop("lang"), langid.train(docs)).collect()
    assert len(got) == len(ODD) and {r["lang_pred"] for r in got} == {"x", "und"}
    none = langid.train(docs.limit(0))
    assert {r["lang_pred"] for r in langid.with_language(docs, none).collect()} == {"und"}


def brute_base(rows, held_rest=2):
    words = lambda t: (t or "").encode().lower().split()
    c = Counter()
    for d, t in rows:
        if not held(d if d is not None else "", 7, held_rest):
            c.update([*words(t), b""])
    n, v = sum(c.values()), len(c)
    return n, [(d, len(words(t)) + 1, sum(c[w] > 0 for w in [*words(t), b""]), sum(np.log10((c[w] + 1) / (n + v + 1)) for w in [*words(t), b""])) for d, t in rows]


@pytest.mark.parametrize("hot", [ppm.HOT_WORDS, 20, 0])
def test_base_score_against_brute_force(spark, sf_dir, hot):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = [(r[0], r[1]) for r in docs.collect()]
    from tessella.llm.common import id_remainder

    got = {r["doc_id"]: r for r in ppm.scores(docs, docs.where(id_remainder("doc_id", 7) != 2), hot_words=hot).collect()}
    n, want = brute_base(rows)
    for d, tokens, known, base in want:
        r = got[d]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (tokens, known, n) and abs(r["base_score"] - base) < 1e-6 * abs(base)


def test_lm_odd_texts(spark):
    docs = odd(spark).drop("lang")
    got = ppm.scores(docs, docs, hot_words=2).collect()
    assert len(got) == len(ODD) and all(np.isfinite(r["score"]) and np.isfinite(r["base_score"]) for r in got)
    empty = ppm.scores(docs, docs.limit(0)).collect()
    assert {r["train_tokens"] for r in empty} == {0} and {r["base_score"] for r in empty} == {0.0}
    assert ppm.scores(docs.limit(0), docs).count() == 0


def brute_ppm(counts, order, context, symbol):
    """log10 probability from counts of (context of `order` bytes, symbol)."""
    levels = {order: counts}
    for k in range(order - 1, -1, -1):
        below = Counter()
        for c, s in levels[k + 1]:
            below[c[1:], s] += 1
        levels[k] = below
    total, excluded = 0.0, set()
    for k in range(order, -1, -1):
        here = {s: n for (c, s), n in levels[k].items() if c == context[len(context) - k :]}
        left = {s: n for s, n in here.items() if s not in excluded}
        if not left:
            continue
        if symbol in left:
            return total + np.log10((2 * left[symbol] - 1) / (2 * sum(left.values())))
        total += np.log10(len(left) / (2 * sum(left.values())))
        excluded |= set(left)
    return total - np.log10(256 - len(excluded))


@pytest.mark.parametrize("nodes", [0, 40, ppm.MAX_NODES])
def test_scores_use_all_counts_whatever_the_cache(spark, monkeypatch, nodes):
    monkeypatch.setattr(ppm, "SHARD_ROWS", 50, raising=False)
    texts = ["abracadabra", "abrupt cadavre", "bar bara abba", "", "quite other words abracadabra", "\u00e9t\u00e9 zebra", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counts, order = Counter(), ppm.ORDER
    data = [bytes([ppm.START]) * order + (t or "").encode() + bytes([ppm.END]) for t in texts]
    for d in data[:4]:
        counts.update((d[i - order : i], d[i]) for i in range(order, len(d)))
    want = {k: sum(brute_ppm(counts, order, d[i - order : i], d[i]) for i in range(order, len(d))) for k, d in enumerate(data)}
    got = {r["doc_id"]: r["score"] for r in ppm.scores(docs, docs.where("doc_id < 4"), max_nodes=nodes).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 * abs(want[k]) for k in want)


def test_trie_against_brute_force():
    texts, order = [b"abracadabra", b"abrupt cadavre", b"bar"], 2
    keys, n = np.unique(ppm.pair_keys(ppm.padded(texts, order), order), return_counts=True)
    trie = ppm.Trie(keys, n, order)
    counts = Counter()
    for t in texts:
        t = bytes([ppm.START]) * order + t + bytes([ppm.END])
        for i in range(order, len(t)):
            counts[t[i - order : i], t[i]] += 1
    for t in (b"abra", b"zebra", b"", b"cad\x00"):
        p = bytes([ppm.START]) * order + t + bytes([ppm.END])
        want = sum(brute_ppm(counts, order, p[i - order : i], p[i]) for i in range(order, len(p)))
        assert abs(trie.score([t])[0] - want) < 1e-5
    for context in (b"ab", b"zz", b"zr"):
        pairs = np.array([context[0] << 16 | context[1] << 8 | s for s in range(256)], np.uint64)
        assert abs(np.exp(trie.log_probabilities(pairs)).sum() - 1) < 1e-5


def test_model_learns_and_adapts(spark):
    text = b"the same words come again and again, " * 30
    assert ppm.adaptive_code_length(text) > 3 * ppm.adaptive_code_length(text[: len(text) // 30]) - 40
    assert ppm.adaptive_code_length(b"") < 0
    got = queries.op8_ppm_scores(spark, "/root/testdata/sf0.01").where("held_out").selectExpr("sum(score) / sum(n_tokens)").first()[0]
    assert -6 < got < -2


def test_least_count_bounds_the_model(spark):
    frame = spark.createDataFrame([(i, 1 + i % 7) for i in range(700)], "k long, n long")
    for most in (0, 50, 100, 250, 700, 10_000):
        assert frame.where(f"n >= {ppm.least_count(frame, most)}").count() <= most
