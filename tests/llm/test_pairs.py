import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.llm import index, near, queries, simhash, windows

ODD = [(0, None), (1, ""), (2, "one"), (3, "a b c d e"), (3, "a b c d e"), (None, "x y z"), (6, "word " * 4000), (7, "  \n ")]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1, 2, 3) for d, t in rows], "doc_id long, text string, text_id int, start int, node int").select("doc_id", "text")


def joined_by(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def brute_fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    s = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@given(st.lists(st.integers(0, 1023), min_size=1, max_size=60, unique=True), st.integers(0, 1023), st.integers(0, 4))
@settings(max_examples=100, deadline=None)
def test_bk_tree_against_all_pairs(values, x, radius):
    tree = simhash.BKTree(values)
    assert sorted(tree.values[i] for i in tree.near(x, radius)) == sorted(v for v in values if (v ^ x).bit_count() <= radius)


def test_simhash_against_brute_force(spark, sf_dir):
    docs = {r[0]: r[1] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = {r["doc_id"]: r for r in queries.op7_simhash_bktree(spark, sf_dir).collect()}
    prints = {d: brute_fingerprint(t) for d, t in docs.items()}
    assert {d: int(r["fingerprint"], 16) for d, r in got.items()} == prints
    ids = sorted(prints)
    want = joined_by([(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 4], ids)
    assert {d: r["component_id"] for d, r in got.items()} == want


@pytest.mark.parametrize(("shard", "blocks"), [(2048, None), (8, 6), (8, 5), (5, 8)])
def test_links_of_crowds_in_parts(spark, shard, blocks):
    rng = random.Random(3)
    values = set()
    for _ in range(6):
        base = rng.getrandbits(64)
        for _ in range(40):
            x = base
            for _ in range(rng.randint(0, 5)):
                x ^= 1 << rng.randrange(64)
            values.add(x)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    found = simhash.links(spark.createDataFrame([(v,) for v in signed], "fingerprint long"), shard=shard, blocks=blocks).collect()
    assert all(((r["a"] ^ r["b"]) & (1 << 64) - 1).bit_count() <= 4 for r in found)
    brute = [(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4]
    assert joined_by([(r["a"], r["b"]) for r in found], signed) == joined_by(brute, signed)
    assert len(found) < 40 * len(values)


def test_components_taken_further(spark):
    rng = random.Random(4)
    first = [(rng.randrange(200), rng.randrange(200)) for _ in range(90)]
    more = [(rng.randrange(240), rng.randrange(240)) for _ in range(40)] + [(3, 3), (500, 501)]
    frames = [spark.createDataFrame([e for e in part if e[0] != e[1]], "a long, b long") for part in (first, more)]
    got = simhash.extended(simhash.components(frames[0]), frames[1]).collect()
    edges = [e for e in first + more if e[0] != e[1]]
    nodes = {n for e in edges for n in e}
    assert len(got) == len(nodes) and {r["node"]: r["component"] for r in got} == joined_by(edges, nodes)


def test_components_of_long_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(300, 400)] + [(5, 5), (-3, 9), (9, -3)]
    got = {r["node"]: r["component"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {n for e in edges for n in e if n != 5}
    assert got == joined_by([e for e in edges if e[0] != e[1]], nodes)


def test_simhash_odd_rows(spark):
    got = simhash.near_duplicates(frame(spark, ODD)).collect()
    assert len(got) == len(ODD)
    by = defaultdict(set)
    for r in got:
        by[r["doc_id"]].add((r["fingerprint"], r["component_id"]))
    assert by[0] == by[1] == by[7] == {("0" * 16, 0)} and len(by[3]) == 1
    assert simhash.near_duplicates(frame(spark, ODD).limit(0)).count() == 0
    kept = near.without_near_duplicates(frame(spark, ODD)).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == [0, 2, 3, 3, 6]


def test_near_groups_against_all_pairs(spark):
    rng = random.Random(21)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8)))
    docs, k = {}, 0
    for i in range(80):  # families of copies with some words changed
        base = [word() for _ in range(rng.choice([3, 20, 60, 150, 400]))]
        for _ in range(rng.randint(1, 5)):
            docs[k] = " ".join(w if rng.random() > 0.02 else word() for w in base)
            k += 1
    sets = {d: set(simhash.shingles(t, 5)) for d, t in docs.items()}
    brute = [(a, b) for a in docs for b in docs if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = joined_by(brute, docs)
    got = {r["doc_id"]: r["group_id"] for r in near.near_groups(frame(spark, list(docs.items()))).collect()}
    found = sum(got[a] == got[b] for a, b in brute)
    assert len(brute) > 60 and found >= 0.97 * len(brute)
    assert all(want[d] == want[g] for d, g in got.items())  # nothing that all pairs don't join


@pytest.mark.parametrize("others", [400, 2000])
def test_near_pairs_among_texts_of_one_template(spark, others):
    """Pairs of similarity 0.85 or so among texts that share a template and are alike by 0.62, under the limit."""
    rng = random.Random(others)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=7))
    template = [word() for _ in range(330)]
    own = lambda: [word() for _ in range(100)]
    texts = [template + own() for _ in range(others)]
    pairs = []
    for _ in range(40):
        tail = own()
        pairs.append((len(texts), len(texts) + 1))
        texts += [template + tail, template + tail[:65] + own()[:35]]
    docs = [(k, " ".join(t)) for k, t in enumerate(texts)]
    sets = {d: set(simhash.shingles(docs[d][1], 5)) for d in [0, 1, *(x for p in pairs for x in p)]}
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert alike(0, 1) < 0.65 and all(0.8 <= alike(a, b) < 0.9 for a, b in pairs)
    got = {r["doc_id"]: r["group_id"] for r in near.near_groups(frame(spark, docs), part=1 << 20).collect()}
    assert sum(got[a] == got[b] == a for a, b in pairs) >= 39
    assert all(got[d] == d for d in range(others))


def test_functions_of_near_shards_are_independent():
    rng = np.random.default_rng(8)
    missed = 0
    for _ in range(4000):  # 100 shingles each, 80 of 90 shared to 0.8
        h = rng.integers(0, 1 << 63, 100).astype(np.uint64)
        one, two = near.minhash.signature(h[:90], near.FUNCTIONS), near.minhash.signature(h[10:], near.FUNCTIONS)
        missed += not (one == two).any()
    assert missed < 0.003 * 4000


def test_near_duplicates_keep_columns_of_any_name(spark):
    rows = frame(spark, ODD).withColumns({c: F.lit(7) for c in ("kept_id", "fingerprint", "node", "text_id", "group_id", "component", "a", "b")})
    left = near.without_near_duplicates(rows)
    assert left.columns == rows.columns and left.where("kept_id = 7 and node = 7").count() == 6
    assert near.without_near_duplicates(rows.limit(0)).count() == 0


@given(st.lists(st.integers(0, 5), min_size=1, max_size=40), st.integers(1, 6))
@settings(max_examples=100, deadline=None)
def test_compact_windows_cover_each_subsequence_once(values, least):
    h = np.array(values, np.uint64)
    found = windows.compact_windows(h, least)
    for i in range(len(values)):
        for j in range(i + least - 1, len(values)):
            inside = [w for w in found if w[0] <= i <= w[1] <= j <= w[2]]
            assert len(inside) == 1 and h[inside[0][1]] == min(h[i : j + 1])


@given(st.lists(st.text("aB \n\t\x1c\u00e9\u2003", max_size=9), max_size=6), st.integers(1, 4))
@settings(max_examples=200, deadline=None)
def test_word_hashes_know_words_wherever_they_are(texts, repeats):
    data = (" ".join(texts) * repeats).encode()
    words = data.lower().split()
    hashes, starts = windows.word_hashes(data)
    assert len(hashes) == len(words) and len(set(hashes.tolist())) == len(set(words))
    known = {w: int(windows.word_hashes(w)[0][0]) for w in set(words)}
    assert hashes.tolist() == [known[w] for w in words]
    assert all(data[i:].lower().startswith(w) for i, w in zip(starts.tolist(), words, strict=True))


def test_word_hashes_of_texts_over_several_blocks():
    rng = random.Random(4)
    words = ["".join(rng.choices("abcd", k=rng.randint(1, 9))) for _ in range(30_000)] + ["x" * 70_000, "y"]
    hashes, _ = windows.word_hashes(" ".join(words).encode())
    assert len(hashes) == len(words) > 3 and len(set(hashes.tolist())) == len(set(words))
    assert [int(windows.word_hashes(w.encode())[0][0]) for w in words[-3:]] == hashes[-3:].tolist()
    assert len(" ".join(words)) > 4 * windows.BLOCK


def test_windows_of_texts_made_together_are_those_of_each():
    rng = random.Random(8)
    h = np.array([rng.randrange(50) for _ in range(3000)], np.uint64)
    cuts = [0, 0, 1, 700, 700, 705, 2100, 2999, 3000, 3000]
    first, past = np.array(cuts[:-1]), np.array(cuts[1:])
    got = windows.tree_windows(h, first, past, 6)
    want = [(a + i, a + c, a + j) for a, b in zip(first, past, strict=True) for i, c, j in windows.compact_windows(h[a:b], 6)]
    assert sorted(map(tuple, got.tolist())) == sorted(want)


def test_repetitive_texts_give_shallow_trees():
    h = np.zeros(200_000, np.uint64)
    h[1::2] = 7
    assert len(windows.compact_windows(h, 46)) < 20_000


def corpus(seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8)))
    text = lambda n: [word() for _ in range(n)]
    passage, near, long = text(60), text(120), text(900)
    changed = near.copy()
    changed[50] = "other"
    docs = {1: text(100) + passage + text(80), 2: passage + text(50), 3: text(30) + passage, 4: text(200), 5: text(45)}
    docs |= {6: text(10) + near + text(10), 7: text(25) + changed + text(5), 8: long, 9: text(40) + long[100:] + text(20), 10: text(150), 11: docs[10] if 10 in docs else text(70)}
    docs[12], docs[13] = docs[4][:40] + text(60), docs[11].copy()
    return {k: " ".join(v) for k, v in docs.items()}, " ".join(passage)


def alike_windows(x, y, width, shift):
    """All (start, end) in x, `width` or wider, of Jaccard similarity 0.8 with the stretch of y that lies `shift` further."""
    out = []
    for s in range(len(x)):
        for e in range(s + width, len(x) + 1):
            if s + shift >= 0 and e + shift <= len(y):
                p, q = set(x[s:e]), set(y[s + shift : e + shift])
                if 5 * len(p & q) >= 4 * len(p | q):
                    out.append((s, e))
    return out


@pytest.mark.parametrize("n", [50, 55, 60, 70, 80])
def test_passages_with_a_changed_word_at_each_place(n):
    rng = random.Random(n)
    fresh = lambda k: [rng.getrandbits(32) for _ in range(k)]
    for changed in range(n):
        passage, (before, after), (before2, after2) = fresh(n), (fresh(7), fresh(9)), (fresh(12), fresh(6))
        other = [*passage[:changed], *fresh(1), *passage[changed + 1 :]]
        a, b = np.array(before + passage + after, np.uint32), np.array(before2 + other + after2, np.uint32)
        x, y = (windows.shingle_hashes(v.astype(np.uint64)).tolist() for v in (a, b))
        brute = alike_windows(x, y, 46, 5)
        assert brute
        found = windows.verified(a, b)
        assert len(found) == 1
        s, e, s2, e2 = found[0]
        assert s2 == s + 5 and e2 == e + 5 and e - s >= 50 and (s, e - 4) in brute
        hits = [i for i in range(len(x)) if x[i] in set(y)]
        assert s <= hits[0] and e >= hits[-1] + 5  # all that they share is in it


@given(st.integers(0, 10**6), st.integers(40, 130), st.integers(0, 6))
@settings(max_examples=40, deadline=None)
def test_passages_with_changed_words_against_brute_force(seed, n, changes):
    rng = random.Random(seed)
    fresh = lambda k: [rng.getrandbits(32) for _ in range(k)]
    passage = fresh(n)
    other = passage.copy()
    for i in rng.sample(range(n), changes):
        other[i] = rng.getrandbits(32)
    a, b = np.array(fresh(10) + passage + fresh(10), np.uint32), np.array(fresh(10) + other + fresh(10), np.uint32)
    x, y = (windows.shingle_hashes(v.astype(np.uint64)).tolist() for v in (a, b))
    found, brute, shared = windows.verified(a, b), alike_windows(x, y, 46, 0), set(y)
    assert bool(found) == bool(brute)
    covered = {i for s, e, _, _ in found for i in range(s, e - 4)}
    assert {i for s, e in brute for i in range(s, e) if x[i] in shared} <= covered
    assert all((s, e - 4) in brute for s, e, _, _ in found)


def test_passages_that_moved_or_repeat_themselves():
    rng = random.Random(8)
    fresh = lambda k: [rng.getrandbits(32) for _ in range(k)]
    p, q = fresh(60), fresh(70)
    a, b = np.array(p + fresh(30) + q, np.uint32), np.array(q + fresh(20) + p, np.uint32)
    assert sorted(windows.verified(a, b)) == [(0, 60, 90, 150), (90, 160, 0, 70)]
    same = np.full(100, 7, np.uint32)
    assert windows.verified(same, same[:80]) == [(0, 100, 0, 80)]
    wide = fresh(300)
    long = np.array(wide[:150] + fresh(40) + wide[150:], np.uint32)
    got = windows.verified(long, np.array(wide, np.uint32))
    assert (got[0][0], got[-1][1], got[0][2], got[-1][3]) == (0, 340, 0, 300)


def test_shared_passages_are_found_and_clean_ones_left(spark):
    docs, _ = corpus()
    got = {r["doc_id"]: r for r in windows.sharing_documents(frame(spark, list(docs.items()))).collect()}
    assert set(got) == {1, 2, 3, 6, 7, 8, 9, 11, 13}
    groups = defaultdict(set)
    for d, r in got.items():
        groups[r["class_id"]].add(d)
    assert sorted(map(sorted, groups.values())) == [[1, 2, 3], [6, 7], [8, 9], [11, 13]] and set(groups) == {1, 6, 8, 11}
    spans = {d: [(x["start"], x["end"]) for x in r["spans"]] for d, r in got.items()}
    assert spans[1] == [(100, 160)] and spans[2] == [(0, 60)] and spans[3] == [(30, 90)]
    assert spans[8] == [(100, 900)] and spans[9] == [(40, 840)] and got[11]["copies"] == 2


def test_salts_change_nothing(spark, monkeypatch):
    docs, passage = corpus(9)
    docs |= {i: f"{i} " * 60 + " ".join(f"w{i}x{j}" for j in range(40)) + " " + passage for i in range(100, 160)}
    plain = sorted(windows.sharing_documents(frame(spark, list(docs.items()))).collect())
    monkeypatch.setattr(windows, "PROBE", 1)
    monkeypatch.setattr(windows, "SALTS", 3)
    assert sorted(windows.sharing_documents(frame(spark, list(docs.items()))).collect()) == plain
    assert {r["class_id"] for r in plain if r["doc_id"] >= 100} == {1}


def crowd_of_phrases(seed, words, pairs=40, others=400):
    """Pairs that alone share a passage partly made of 12-word phrases, among texts that have the phrases in other surroundings."""
    rng = random.Random(seed)
    text = lambda n: ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8))) for _ in range(n)]
    common = [text(12) for _ in range(6)]
    docs = {1000 + i: text(30) + common[i % 6] + text(25) + common[(i + 1) % 6] + text(20) for i in range(others)}
    for i in range(pairs):
        passage = common[i % 6] + text((words - 36) // 2) + common[(i + 2) % 6] + text(words - 36 - (words - 36) // 2) + common[(i + 4) % 6]
        docs[2 * i] = text(40) + passage + text(30)
        docs[2 * i + 1] = text(25) + passage + text(45)
    return {k: " ".join(v) for k, v in docs.items()}


@pytest.mark.parametrize("words", [55, 100])
def test_passages_of_common_phrases_are_found_among_others_that_have_these(spark, words):
    docs = crowd_of_phrases(words, words)
    got = {r["doc_id"]: r["class_id"] for r in windows.sharing_documents(frame(spark, list(docs.items()))).collect()}
    found = sum(got.get(2 * i + 1) == 2 * i == got.get(2 * i) for i in range(40))
    assert found >= 38 and all(d < 80 for d in got)  # recall 0.95, and no text that only has the phrases


def test_long_boilerplate_hides_no_passage(spark):
    rng = random.Random(2)
    text = lambda n: ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8))) for _ in range(n)]
    line = text(40)
    docs = {1000 + i: text(30) + line + text(40) for i in range(400)}
    for i in range(40):
        passage = line + text(20)
        docs[2 * i], docs[2 * i + 1] = text(40) + passage + text(30), text(25) + passage + text(45)
    got = {r["doc_id"]: r["class_id"] for r in windows.sharing_documents(frame(spark, [(k, " ".join(v)) for k, v in docs.items()])).collect()}
    assert sum(got.get(2 * i + 1) == 2 * i == got.get(2 * i) for i in range(40)) >= 37 and all(d < 80 for d in got)


def test_near_passages_against_all_pairs(spark):
    """Pairs of texts that share a passage of 50 to 120 words with some words changed, by brute force over all pairs."""
    rng = random.Random(12)
    text = lambda n: ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8))) for _ in range(n)]
    docs = {}
    for i in range(60):
        passage = text(rng.randint(50, 120))
        other = [w if rng.random() > 0.025 else text(1)[0] for w in passage]
        docs[2 * i], docs[2 * i + 1] = text(rng.randint(5, 60)) + passage + text(rng.randint(5, 60)), text(rng.randint(5, 60)) + other + text(rng.randint(5, 60))
    hashes = {k: windows.word_hashes(" ".join(v).encode())[0] for k, v in docs.items()}
    brute = {(a, b) for a in docs for b in docs if a < b and windows.verified(hashes[a], hashes[b])}
    got = {r["doc_id"]: r["class_id"] for r in windows.sharing_documents(frame(spark, [(k, " ".join(v)) for k, v in docs.items()])).collect()}
    found = {(a, b) for a, b in brute if a in got and got[a] == got.get(b)}
    assert len(brute) > 35 and len(found) >= 0.95 * len(brute) and set(got) <= {x for p in brute for x in p}


def test_texts_with_one_hash_are_told_apart(spark, monkeypatch):
    real = F.xxhash64
    monkeypatch.setattr(windows.F, "xxhash64", lambda c, *more: real(c if isinstance(c, str) else F.substring(c, 1, 1), *more))
    rows = windows.with_text_id(frame(spark, [(1, "abc"), (2, "abd"), (3, "abc"), (4, None), (5, "")])).collect()
    ids = {r["doc_id"]: r["text_id"] for r in rows}
    assert len(rows) == 5 and ids[1] == ids[3] != ids[2] and ids[4] == ids[5]


def test_repeats_keep_columns_of_any_name(spark):
    docs, _ = corpus()
    rows = frame(spark, list(docs.items())).withColumns({c: F.lit(7) for c in ("text_id", "spans", "copies", "kept_id", "mark", "start", "_digest")})
    left = windows.without_repeats(rows)
    assert left.columns == rows.columns and left.where("spans = 7 and mark = 7 and copies = 7 and text_id = 7").count() == len(docs) - 1


def test_repeats_are_cut_once(spark):
    docs, passage = corpus()
    left = {r["doc_id"]: r["text"] for r in windows.without_repeats(frame(spark, list(docs.items()))).collect()}
    assert sum(passage in t for t in left.values()) == 1
    assert left[4] == docs[4] and left[10] == docs[10] and left[12] == docs[12] and (11 in left) and (13 not in left)
    assert sum(len(t) for t in left.values()) < sum(len(t) for t in docs.values()) - 800 * 4
    for d, t in left.items():
        assert set(t.split()) <= set(docs[d].split())


def test_without_keeps_the_rest_as_it_was():
    assert windows.without("a  b\nc d\te", [(1, 3)]) == "a   d\te"
    assert windows.without("a b c", [(0, 2)]).split() == ["c"] and windows.without("a b c", [(1, 3)]) == "a "
    assert windows.without("é b é", [(0, 1), (2, 3)]).split() == ["b"]


def test_windows_odd_rows(spark):
    got = windows.sharing_documents(frame(spark, ODD)).collect()
    assert got == []
    long = " ".join(f"w{i}" for i in range(70))
    got = windows.sharing_documents(frame(spark, [(4, long), (4, long), (None, long), (9, long + " x")])).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["class_id"], r["copies"]) for r in got) == [(False, 4, 4, 3), (False, 4, 4, 3), (False, 9, 4, 1), (True, 0, 4, 3)]
    assert windows.sharing_documents(frame(spark, ODD).limit(0)).count() == 0
    assert windows.without_repeats(frame(spark, ODD)).count() == len(ODD)


def brute_hits(text, items, length=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    w, hit, found = words(text), set(), set()
    for item, t in items:
        p = words(t)
        for b in range(max(1, len(p) - length + 1)) if p else []:
            x = p[b : b + length]
            for i in range(len(w) - len(x) + 1):
                if w[i : i + len(x)] == x:
                    hit |= set(range(i, i + len(x)))
                    found.add("" if item is None else str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_index_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary = ["the", "Of", "été", "ÉTÉ", "x9", "and", "zz", "İstanbul", "q"]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choices(vocabulary, k=n))
    items = [(i, text(rng.choice([0, 1, 3, 9, 10, 14, 30]))) for i in range(25)] + [(3, text(12)), (None, text(11)), (77, None), (5, "")]
    docs = [(i, text(rng.randint(0, 40))) for i in range(40)]
    docs += [(100 + i, text(15) + " " + (rng.choice(items)[1] or "").upper() + " " + text(5)) for i in range(30)] + [(None, items[0][1]), (1, items[4][1]), (1, None), (9, "the of " * 400)]
    got = index.contamination(frame(spark, docs), spark.createDataFrame([(*i, "e") for i in items], "item_id long, text string, entry string")).collect()
    want = sorted((str(d), *brute_hits(t, items)) for d, t in docs)
    assert sorted((str(r["doc_id"]), *r[1:]) for r in got) == want
    kept = index.uncontaminated(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert kept.count() == sum(not x[-1] for x in want)
    empty = index.contamination(frame(spark, docs), spark.createDataFrame([], "item_id long, text string"))
    assert empty.where("contaminated").count() == 0 and empty.count() == len(docs)
    assert index.contamination(frame(spark, docs).limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_proximity_against_brute_force(spark):
    docs = [(1, "alpha one two beta"), (2, "alpha one two three four beta"), (3, "beta alpha"), (4, "alpha x beta")]
    items = [(1, "alpha one two beta")]
    terms = index.entry_terms(index.entries(spark.createDataFrame(items, "item_id long, text string")))
    counts = spark.createDataFrame([("alpha", 1), ("beta", 2), ("one", 8), ("two", 9)], "term string, occurrences long")
    found = index.phrases(terms, counts)
    tests = index.test_terms(terms, found)
    rows = index.forward(frame(spark, docs))
    ids = {r["row"]: r["doc_id"] for r in rows.collect()}
    lists = index.postings(rows, tests)
    for slack, want in ((0, {1}), (1, {1, 4}), (2, {1, 2, 4}), (4, {1, 2, 3, 4})):
        assert {ids[r["row"]] for r in index.proximity_matches(lists, tests, found, slack).collect()} == want


def test_only_ascii_capitals_are_lowered(spark):
    points = spark.range(1, 0x30000).where("id < 55296 or id > 57343")
    rows = points.select(F.concat(F.lit("aA"), F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "utf-32"), F.lit("Zσ")).alias("text"))
    assert rows.where(index.lowered(F.col("text")) != F.translate("text", index.UPPER, index.LOWER)).count() == 0


def test_decontamination_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b c", [1], "x", 2), (2, "q", None, None, None), (1, "other", [3], "y", 4), (None, "a b c", [5], "z", 6)], "doc_id long, text string, hits array<int>, words string, row long")
    docs = docs.withColumns({c: F.lit(7) for c in ("entry", "mark", "places", "found_words", "place_doc", "start", "n")})
    left = index.uncontaminated(docs, spark.createDataFrame([(1, "b C")], "item_id long, text string"))
    assert left.columns == docs.columns and sorted((r["doc_id"], r["text"], r["hits"], r["row"]) for r in left.collect()) == [(1, "other", [3], 4), (2, "q", None, None)]


def test_index_plan_runs_no_python(spark, sf_dir):
    plan = queries.op5_positional_index(spark, sf_dir)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
