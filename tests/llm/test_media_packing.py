import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F

from tessella.llm import gif, packing, queries

ODD = [None, "", "a", "one two  three\n\nfour", " lead", "trail ", "don't\tstop", "é ü ñ", "x\x00y", "wörd " * 3000, "same same", "same same"]


@given(st.binary(max_size=3000), st.integers(2, 8))
@settings(max_examples=60, deadline=None)
def test_lzw_round_trip(data, least):
    data = bytes(x & ((1 << least) - 1) for x in data)
    assert gif.lzw_decode(gif.lzw_encode(data, least), least, len(data)) == data


def test_lzw_long_and_repeated():
    rng = np.random.default_rng(1)
    for data in (rng.integers(0, 256, 60_000, dtype=np.uint8).tobytes(), b"ab" * 40_000, bytes(70_000)):
        assert gif.lzw_decode(gif.lzw_encode(data), 8, len(data)) == data


def test_late_clear_code_is_read():
    # A table that stays full: codes go on with 12 bits and no clear code.
    data = np.random.default_rng(2).integers(0, 256, 9000, dtype=np.uint8).tobytes()
    codes, known, prefix = [], {bytes([i]): i for i in range(256)}, b""
    entry = 258
    for x in data:
        if prefix + bytes([x]) in known:
            prefix += bytes([x])
            continue
        codes.append(known[prefix])
        if entry < 4096:
            known[prefix + bytes([x])] = entry
            entry += 1
        prefix = bytes([x])
    codes += [known[prefix], 257]
    widths = np.minimum(np.concatenate([gif.WIDTHS[8], np.full(len(codes), 12)]), 12)[: len(codes)]
    bits = np.concatenate([gif.pack_codes([256], np.array([9])), gif.pack_codes(codes, widths)])
    assert gif.lzw_decode(np.packbits(bits, bitorder="little").tobytes(), 8, len(data)) == data


def test_disposal_transparency_and_timing():
    palette = np.array([[255, 0, 0], [0, 255, 0], [0, 0, 255], [9, 9, 9]], np.uint8)
    data = bytearray(gif.encode_frames([(np.zeros((2, 2), np.uint8), 5), (np.array([[1, 3], [3, 1]], np.uint8), 7), (np.full((1, 1), 2, np.uint8), 9)], palette))
    marks = [i for i in range(len(data)) if data[i : i + 3] == b"\x21\xf9\x04"]
    data[marks[1] + 3] = 3 << 2 | 1  # the second frame: index 3 is transparent, what was there before comes back
    data[marks[1] + 6] = 3
    a, b, c = gif.decode_frames(bytes(data))
    assert [f.delay_cs for f in (a, b, c)] == [5, 7, 9]
    assert b.canvas[0, 0, :3].tolist() == [0, 255, 0] and b.canvas[0, 1, :3].tolist() == [255, 0, 0]
    assert c.canvas[0, 0, :3].tolist() == [0, 0, 255] and c.canvas[1, 1, :3].tolist() == [255, 0, 0]
    assert gif.histogram(a.canvas)[48] == 4


def test_broken_files_give_an_error_row(spark):
    rows = gif.gif_frames(spark.createDataFrame([(1, bytearray(b"nothing")), (2, None)], "doc_id long, media binary")).collect()
    assert {r["doc_id"] for r in rows} == {1, 2} and all(r["error"] for r in rows)


def test_media_query_equals_direct_digests(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.op3_gif_media(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    for r in got:
        raw = (docs[r["doc_id"]] or "").encode()
        whole = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(whole))
        assert r["payload_sha256"] == hashlib.sha256(whole).hexdigest() and r["tail_crc32"] == zlib.crc32(whole[-64:])
        assert sum(r["histogram"]) == len(whole) and r["n_frames"] == -(-len(whole) // (64 * gif.FRAME_ROWS))


def test_media_odd_texts(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)], "doc_id long, text string, media string")
    got = {r["doc_id"]: r for r in gif.digests(gif.gif_column(docs, "text")).collect()}
    assert len(got) == len(ODD) and got[0]["payload_sha256"] == got[1]["payload_sha256"] and got[0]["payload_bytes"] == 64
    assert got[10]["media_sha256"] == got[11]["media_sha256"]
    assert gif.digests(gif.gif_column(docs.limit(0), "text")).count() == 0


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


@given(st.text(alphabet=st.sampled_from(list("ab'sl1. \n\t  \x1c\x00é-")) | st.characters(codec="utf-8"), max_size=60))
@settings(max_examples=400, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_parts_give_the_same_ids(tokenizer, text):
    if not hasattr(test_parts_give_the_same_ids, "e"):
        test_parts_give_the_same_ids.e = packing.PartEncoder(queries.tokenizer_path())
    e = test_parts_give_the_same_ids.e
    texts = [text, text + " " + text, "a " + text + "\n" + text]
    assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def pieces_cover(rows, docs, tokenizer, window=packing.WINDOW):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == {d for d, _, _ in docs}
    for d, text, _ in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r["start"]):
            part = np.array(ids[at : at + r["length"]], "<u4").tobytes()
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(part)
            assert r["ids"] is None or bytes(r["ids"]) == part
            at += r["length"]
        assert at == len(ids)
    for found in by_sequence.values():
        at = 0
        for r in sorted(found, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window and at & (at - 1) == 0
    return by_sequence


def test_packing_query_holds_each_token_once(spark, sf_dir, tokenizer):
    docs = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = [Row(**r.asDict(), ids=None) for r in queries.op9_mixture_packing(spark, sf_dir).collect()]
    pieces_cover(rows, docs, tokenizer)


def test_windows_follow_the_targets(spark, tokenizer):
    docs = [(i, f"word{i} and more " * 200, "ab"[i % 2]) for i in range(60)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = packing.pack(frame, queries.tokenizer_path(), targets={"a": 3, "b": 1}, bucket_bytes=1 << 30).collect()
    found = pieces_cover(rows, docs, tokenizer)
    used = sum(r["length"] for s in sorted(found)[:16] for r in found[s] if r["source"] == "a")
    assert abs(used / (16 * packing.WINDOW) - 0.75) < 0.02


def test_buckets_carry_deficits(spark, tokenizer):
    docs = [(i, f"text {i} of some words " * 80, "a" if i % 5 else None) for i in range(80)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = packing.pack(frame, queries.tokenizer_path(), bucket_bytes=40_000).collect()
    assert len({r["sequence_id"] >> 32 for r in rows}) > 2
    pieces_cover(rows, docs, tokenizer)


def test_tasks_have_about_as_much_to_read(spark):
    docs = [(None if i % 3 else i, f"text {i} " * 40, "a") for i in range(3000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = packing.pack(frame, queries.tokenizer_path(), bucket_bytes=60_000)
    tokens = [r[1] for r in rows.groupBy(F.spark_partition_id()).agg(F.sum("length")).collect()]
    assert len(tokens) == rows.rdd.getNumPartitions() > 10 and max(tokens) < 1.5 * sorted(tokens)[len(tokens) // 2]


def test_packing_odd_texts(spark, tokenizer):
    docs = [(i, t, None if i % 2 else "s") for i, t in enumerate([*ODD, "<|endoftext|>", "a <|endoftext|> b<|endoftext|>\n"])]
    frame = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, source string, bucket int, kind int")
    pieces_cover(packing.pack(frame, queries.tokenizer_path()).collect(), docs, tokenizer)
    assert packing.pack(frame.limit(0), queries.tokenizer_path()).count() == 0
