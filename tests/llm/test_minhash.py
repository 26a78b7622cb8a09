import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import minhash, queries


def brute_sets(docs):
    out = []
    for t in docs:
        w = re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower())
        out.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set())
    return out


def links_of(sets):
    return [(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets) if i < j and x and y and 100 * len(x & y) >= 80 * len(x | y)]


def joined_by(links, ids):
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[root(a)] = root(b)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [least.get(root(i)) for i in range(len(ids))]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1, "x", 0) for d, t in rows], "doc_id long, text string, node int, token string, component int").repartition(3)


def test_sets_and_signatures():
    texts = ["a b c d", "A b\tc  d\n", "a b c", "a b", "b a", "a a a a a a", " ", None, "d c b a"]
    got = [tuple(minhash.shingle_set(t)) for t in texts]
    sets = brute_sets(texts)
    assert [len(g) for g in got] == [len(s) for s in sets]
    assert all((got[i] == got[j]) == (sets[i] == sets[j]) for i in range(len(texts)) for j in range(len(texts)))
    big = np.arange(1, 200_000, dtype=np.uint64)
    cells, minhash.CELLS = minhash.CELLS, 64
    small = minhash.signature(big[:5000])
    minhash.CELLS = cells
    assert (small == minhash.signature(big[:5000])).all() and len(set(small.tolist())) == 32


def test_collisions_are_as_frequent_as_the_similarity():
    """Functions are independent: of 3,000 pairs of similarity 0.78 hardly any has fewer collisions than are asked for."""
    rng, few, counts = np.random.default_rng(5), 0, []
    for _ in range(3000):
        x = rng.integers(0, 1 << 63, 180).astype(np.uint64)
        same = int((minhash.signature(x[:160]) == minhash.signature(x[20:])).sum())
        counts.append(same)
        few += same < minhash.MATCHES
    assert few <= 3 and abs(np.mean(counts) / 32 - 140 / 180) < 0.01 and abs(np.var(counts) / (32 * 140 / 180 * 40 / 180) - 1) < 0.15


@pytest.mark.parametrize("part", [minhash.PART, 9000])
def test_families_crowds_and_templates_against_all_pairs(spark, part):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8)))
    texts = []
    for size, copies, change in [(40, 3, 0.02), (150, 4, 0.03), (400, 2, 0.03), (8, 3, 0.02), (120, 60, 0.025), (90, 50, 0.06), (3, 3, 0.3)]:
        for _ in range(1 if copies > 10 else 8):
            base = [word() for _ in range(size)]
            texts += [" ".join(w if rng.random() > change else word() for w in base) for _ in range(copies)]
    template = [word() for _ in range(120)]
    for _ in range(30):  # a common template, not alike enough; and two that are, of each
        own = [word() for _ in range(60)]
        texts += [" ".join(template + own), " ".join([*template, *own[:-5], word()])]
    rng.shuffle(texts)
    texts += texts[:20]
    sets = brute_sets(texts)
    links = links_of(sets)
    want = joined_by(links, list(range(len(texts))))
    got = {r["doc_id"]: r for r in minhash.near_duplicates(frame(spark, list(enumerate(texts))), part=part).collect()}
    assert len(links) > 300 and len(got) == len(texts)
    assert [got[i]["component_id"] for i in range(len(texts))] == want
    assert all(r["kept"] == (r["component_id"] == d) and r["n_shingles"] == len(sets[d]) for d, r in got.items())


def test_near_template_pairs_are_found_among_many(spark):
    """Pairs of similarity 0.85 among texts of a common template that are 0.62 alike."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrst", k=7))
    template = [word() for _ in range(330)]
    texts = [" ".join(template + [word() for _ in range(100)]) for _ in range(400)]
    for _ in range(40):
        own = [word() for _ in range(100)]
        texts += [" ".join(template + own), " ".join([*template, *own[:65], *[word() for _ in range(35)]])]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(frame(spark, list(enumerate(texts)))).collect()}
    assert all(got[i] == i for i in range(400))
    assert [got[400 + 2 * i + k] for i in range(40) for k in (0, 1)] == [400 + 2 * i for i in range(40) for _ in (0, 1)]


def test_query_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    sets = brute_sets([r["text"] for r in docs])
    want = joined_by(links_of(sets), [r["doc_id"] for r in docs])
    found = queries.op13_coordinate_join(spark, sf_dir)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in found.collect()}
    assert got == {r["doc_id"]: (len(s), c, c == r["doc_id"]) for r, s, c in zip(docs, sets, want, strict=True)}
    assert dict(found.dtypes) == {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"}


def test_odd_rows(spark):
    rows = [(0, None), (1, ""), (2, " \n"), (3, "One"), (4, "one"), (4, "one two three"), (4, "one two three"), (None, "one two three"), (None, "alone here"), (9, "word " * 9000), (8, "word " * 50), (7, "Ärger ist"), (6, "ärger ist")]
    got = minhash.near_duplicates(frame(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["kept"]) for r in got) == sorted(
        (str(d), len(s), str(c if s else d), (c if s else d) == d) for (d, _), s, c in zip(rows, brute_sets([t for _, t in rows]), joined_by(links_of(brute_sets([t for _, t in rows])), [d for d, _ in rows]), strict=True)
    )
    assert minhash.near_duplicates(frame(spark, rows).limit(0)).count() == 0
    assert minhash.near_duplicates(frame(spark, rows[:3])).agg(F.sum("n_shingles")).first()[0] == 0
