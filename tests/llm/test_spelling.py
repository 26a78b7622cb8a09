import random
import re
import zlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import queries, spelling


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, all_pairs=True):
    counts = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += len(w) >= 7
    counts = {w: n for w, n in counts.items() if n >= 2}
    cut = {}
    for w in counts:  # words that share what is left without one letter
        for i in range(-1, len(w)):
            cut.setdefault(w[:i] + w[i + 1 :] if i >= 0 else w, set()).add(w)
    near = {w: set() for w in counts}
    for ws in [counts] if all_pairs else cut.values():
        for a in ws:
            near[a].update(b for b in ws if one_edit(a, b))
    forms = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-counts[x], x), default=None)
        forms[w] = best if best is not None and counts[best] >= 10 * counts[w] else None

    def root(w):
        return w if forms[w] is None else root(forms[w])

    return {(w, forms[w], root(w), n, len(near[w]), counts.get(forms[w])) for w, n in counts.items()}


def rows_of(df):
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "w", 1) for d, t in rows], "doc_id long, text string, word string, n int")


@given(st.text("abcdé", min_size=1, max_size=7), st.integers(1, 4))
@settings(max_examples=150, deadline=None)
def test_neighbourhood_is_whole_and_has_no_repeats(word, symbols):
    """Against all strings one edit away, over letters that stand for all symbols."""
    letters = {}
    for c in map(chr, range(97, 400)):
        letters.setdefault(int(spelling.symbols_of([c], symbols)[0, 0]), c)
    edits = {word} | {word[:i] + word[i + 1 :] for i in range(len(word))}
    for c in letters.values():
        edits |= {word[:i] + c + word[i + 1 :] for i in range(len(word))} | {word[:i] + c + word[i:] for i in range(len(word) + 1)}
    want = {0 if e == "" else int(spelling.reduced([e], symbols)[0]) for e in edits}
    got = [int(x) for cells in (1 << 18,) for _, code in spelling.neighbourhoods([word], symbols, cells) for x in code]
    small = [int(x) for _, code in spelling.neighbourhoods([word], symbols, 2) for x in code]
    assert len(got) == len(set(got)) and set(got) == want and sorted(small) == sorted(got)


def test_variants_against_all_pairs(spark):
    rng = random.Random(4)
    rows = []
    base = ["".join(rng.choices("abcdefgéà", k=rng.randint(7, 11))) for _ in range(30)]
    for d in range(60):
        words = []
        for _ in range(150):
            w = base[int(rng.random() ** 3 * 30)]
            if rng.random() < 0.05:
                i = rng.randrange(len(w))
                w = w[:i] + rng.choice(["", "x", "ab", "Z"]) + w[i + (rng.random() < 0.7) :]
            words.append(w)
        rows.append((d, " ".join(words)))
    rows.append((60, " ".join([base[0]] * 2000 + [base[0] + "x"] * 100 + [base[0] + "xy"] * 5)))
    assert len(want := brute(rows)) > 100 and any(r[1] and r[1] != r[2] for r in want)
    for symbols in (1, 3, spelling.SYMBOLS):
        assert rows_of(spelling.variants(frame(spark, rows), symbols)) == want
    words = spelling.vocabulary(frame(spark, rows))
    small, wide = (spelling.near_words(words, bits=bits).select("wid", "near").collect() for bits in (64, 1 << 20))
    assert sorted(small) == sorted(wide) and len(set(small)) == len(small)


def test_query_against_brute_force(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    found = queries.op12_reduced_alphabet(spark, sf_dir)
    got = rows_of(found)
    assert got == brute(docs, all_pairs=False) and found.count() == len(got)
    assert dict(found.dtypes) == {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"}


def test_odd_rows(spark):
    rows = [(None, "letters letters LETTERS"), (1, None), (2, ""), (3, "w" * 20000 + " " + "w" * 20000), (4, "w" * 19999 + " " + "w" * 19999), (5, "Éclairs éclairs ÉCLAIRS×÷"), (5, "Éclairs éclairs ÉCLAIRS×÷"), (6, "aaaaaaa aaaaaaa aaaaaaab aaaaaaab aaaaaab aaaaaab")]
    assert rows_of(spelling.variants(frame(spark, rows))) == brute(rows)
    assert spelling.variants(frame(spark, rows).limit(0)).count() == 0
    assert spelling.variants(frame(spark, rows[1:3])).count() == 0
    deep = [(0, " ".join(["lettera"] * 2000 + ["letterb"] * 200 + ["letterbb"] * 20 + ["letterbbb"] * 2))]
    assert rows_of(spelling.variants(frame(spark, deep))) == brute(deep)
