import base64
import hashlib
from collections import Counter, defaultdict
from itertools import accumulate

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tessella.llm import alignment, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def libraries():
    one, two = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    one.encode_special_tokens = True
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        data = {int(i): base64.b64decode(t) for t, i in map(bytes.split, f)}
    return one, two, data


def brute(texts, libraries):
    """Each text's columns, token by token."""
    one, two, data = libraries

    def piece(i):
        p = two.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if two.is_byte(i) else p.replace("▁", " ").encode()

    found, links = [], []
    for t in texts:
        a = one.encode(" " + t, add_special_tokens=False).ids if t else []
        b = two.encode(t) if t else []
        x, y = [data[i] for i in a], [piece(i) for i in b]
        if not t or b"".join(x) != b" " + t.encode() or b"".join(y) != b" " + t.encode():
            found.append((0, 0, "", []))
            links.append([])
            continue
        ends = [list(accumulate(map(len, z))) for z in (x, y)]
        both = set(ends[0]) & set(ends[1])
        links.append([(i, j) for i, e in zip(a, ends[0]) for j, f in zip(b, ends[1]) if e == f] if len(a) < 300 else [(dict(zip(ends[0], a))[e], dict(zip(ends[1], b))[e]) for e in sorted(both)])
        groups, p, q = [], 0, 0
        for e in sorted(both):
            g, h = [], []
            while p < len(a) and ends[0][p] <= e:
                g.append(str(a[p]))
                p += 1
            while q < len(b) and ends[1][q] <= e:
                h.append(str(b[q]))
                q += 1
            groups.append(",".join(g) + "|" + ",".join(h))
        found.append((len(a), len(b), hashlib.sha256(";".join(groups).encode()).hexdigest(), both))
    counts = Counter(x for ls in links for x in ls)
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return [(a, b, len(c), len(ls), sum(counts[x] == most[x[1]] for x in ls), sum(counts[x] for x in ls), s) for (a, b, s, c), ls in zip(found, links)]


ODD = [None, "", " ", "a", "a\n\n\tb  c", "▁ mark", "<|endoftext|> </s><s><unk> <0x0A> plain", "naïve 😀 日本語 ́x", "\x00\x01 nul", "word " * 3000, "x" * 5000, "a\n\n\tb  c", "\r\n end   "]


@pytest.mark.parametrize("hot", [alignment.HOT, 5, 0])
def test_odd_texts_against_brute_force(spark, libraries, hot):
    rows = [(k if k != 3 else None, t, 1, 2) for k, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int, pair int").repartition(3)
    got = alignment.alignment_sums(docs, A, B, hot).collect()
    want = {(d, *w) for (d, *_), w in zip(rows, brute(ODD, libraries))}
    have = {(r["doc_id"], *[r[c] for c in COLUMNS]) for r in got}
    assert len(got) == len(ODD) and sorted(map(str, have - want)) == sorted(map(str, want - have))


def test_query_against_brute_force(spark, sf_dir, libraries):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = {(r["doc_id"], *w) for r, w in zip(docs, brute([r["text"] for r in docs], libraries))}
    found = queries.op11_arrow_alignment(spark, sf_dir)
    assert {(r["doc_id"], *[r[c] for c in COLUMNS]) for r in found.collect()} == want
    assert {k for c, k in found.dtypes if c != "groups_sha256"} == {"bigint"}


def test_empty_table_and_partial_counts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    assert alignment.alignment_sums(docs.limit(0), A, B).count() == 0
    lists = spark.createDataFrame([([i % 7, i % 5, 3],) for i in range(400)], "pairs array<int>")
    want = Counter(x for i in range(400) for x in (i % 7, i % 5, 3))
    for partial in (1, 6, 1 << 20):
        assert {r["pair"]: r["n"] for r in alignment.counted(lists, partial).collect()} == want


def test_texts_are_cut_into_chunks_whole():
    texts = ["a" * 10, None, "b" * 5, "c" * 40, "", "d"]
    parts = list(alignment.chunks(texts, 16))
    assert [i for x, y in parts for i in range(x, y)] == list(range(6)) and (2, 3) not in parts
    assert list(alignment.chunks([], 16)) == []
