"""Token counts, packing and token files against the libraries themselves."""
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from propensity_spark.functions.session import scratch_path
from propensity_spark.llm import packing, token_cache, token_files
from propensity_spark.llm.bpe import ChunkEncoder, encoder
from propensity_spark.llm.queries import PIECE_BPE, WORD_BPE
from tests.llm.conftest import TEXTS, by_id


def plain(text, end):
    tokenizer = encoder(WORD_BPE).tokenizer
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


ODD = st.text(st.sampled_from("aAéÉß .,'<|>\n\t\x0b\x1c ́İΣς1½漢\x01😀-"), max_size=30)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(ODD, st.text(max_size=20)), max_size=4))
def test_chunks_give_the_ids_of_the_library(texts):
    texts = [t.encode("utf-8", "replace").decode() for t in texts]
    got = ChunkEncoder.encode_batch(encoder(WORD_BPE), [t.encode() for t in texts])
    assert [x.tolist() for x in got] == [plain(t, 0)[:-1] for t in texts]


def test_small_cache_forgets_without_harm():
    small = ChunkEncoder(WORD_BPE, limit=5)
    for t in TEXTS * 2:
        got, = small.encode_batch([(t or "").encode()])
        assert got.tolist() == plain(t, 0)[:-1]


def test_counts_and_cache(odd_docs, no_docs, spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    cache = scratch_path(spark, "cache")
    want = sorted(((r["doc_id"], len((r["text"] or "").encode()), len(model.encode(r["text"] or "")))
                   for r in odd_docs.collect()), key=repr)
    first = token_cache.count_tokens(odd_docs, cache, PIECE_BPE, limit=4)
    assert by_id(first.select("doc_id", "n_bytes", "n_tokens")) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 4) for r in first.collect())
    stored = spark.read.parquet(cache)
    texts = len({t or "" for t in TEXTS}) + 2
    assert stored.count() == texts == stored.select("digest").distinct().count()
    # What is stored is believed, not counted again.
    token_cache.count_tokens(odd_docs.limit(3), cache, PIECE_BPE)
    assert spark.read.parquet(cache).count() == texts
    path = scratch_path(spark, "cache")
    stored.withColumn("n_tokens", F.lit(77).cast("long")).write.parquet(path)
    assert {r["n_tokens"] for r in token_cache.count_tokens(odd_docs, path, PIECE_BPE).collect()} == {77}
    # Another version has counts of its own.
    token_cache.count_tokens(odd_docs, cache, public_tokenizers.path("byte_bpe_50k.json"))
    assert spark.read.parquet(cache).select("version").distinct().count() == 2
    assert token_cache.count_tokens(no_docs, scratch_path(spark, "cache"), PIECE_BPE).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 70), max_size=40), st.booleans())
def test_assign_fills_every_sequence(lengths, last):
    rooms = packing.capacities(sum(lengths), 16, last)
    pieces, left = packing.assign(lengths, rooms)
    covered = {(d, i) for d, s, n, _, _ in pieces for i in range(s, s + n)} | {
        (d, i) for d, s, n in left for i in range(s, s + n)}
    assert len(covered) == sum(lengths) == sum(p[2] for p in pieces) + sum(x[2] for x in left)
    for s, room in enumerate(rooms):
        placed = sorted((o, n) for _, _, n, q, o in pieces if q == s)
        assert [o for o, _ in placed] == np.cumsum([0] + [n for _, n in placed]).tolist()[:-1]
        assert sum(n for _, n in placed) == room
    assert not last or not left


def test_cheapest_sequence_with_room_first():
    pieces, left = packing.assign([10, 6, 5, 5, 3, 3], [16, 16])
    # 10 and 6 open the two; then each goes to the cheaper; the last 3 fit nowhere whole and are cut.
    assert left == [] and [(d, n, s) for d, _, n, s, _ in pieces] == [
        (0, 10, 0), (1, 6, 1), (2, 5, 1), (3, 5, 0), (4, 3, 1), (5, 2, 1), (5, 1, 0)]


@pytest.mark.parametrize("size,block", [(2048, 1 << 20), (64, 100), (16, 1)])
def test_packing_keeps_every_id_once(odd_docs, size, block):
    docs = odd_docs.coalesce(2)
    rows = packing.pack(docs, WORD_BPE, 1, size=size, block_tokens=block).collect()
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    short = 0
    for places in by_sequence.values():
        places.sort()
        assert [o for o, _ in places] == np.cumsum([0] + [n for _, n in places]).tolist()[:-1]
        used = sum(n for _, n in places)
        assert used <= size and math.log2(used).is_integer()
        short += used < size
    assert short <= 2 * math.log2(size)
    want = sorted((r["doc_id"], len(plain(r["text"], 1))) for r in odd_docs.collect() if r["doc_id"] not in (None, 3, 4))
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append(r)
    assert set(got) == {r["doc_id"] for r in odd_docs.collect()}
    texts = {r["doc_id"]: r["text"] for r in odd_docs.collect()}
    for doc_id, n in want:
        ids = plain(texts[doc_id], 1)
        pieces = sorted(got[doc_id], key=lambda r: r["start"])
        assert [p["start"] for p in pieces] == np.cumsum([0] + [p["length"] for p in pieces]).tolist()[:-1]
        assert sum(p["length"] for p in pieces) == n and {p["doc_tokens"] for p in pieces} == {n}
        assert all(p["ids_crc32"] == crc(ids[p["start"]:p["start"] + p["length"]]) for p in pieces)
    assert sum(r["length"] for r in rows) == sum(len(plain(r["text"], 1)) for r in odd_docs.collect())


def test_packing_of_nothing(no_docs):
    assert packing.pack(no_docs, WORD_BPE, 1).count() == 0


@pytest.mark.parametrize("size", [16, 2048])
def test_files_give_back_every_document(odd_docs, spark, size):
    folder = scratch_path(spark, "files")
    token_files.write(odd_docs.repartition(3), folder, WORD_BPE, 2, size=size)
    got = token_files.read_documents(spark, folder).orderBy("start").collect()
    rows = sorted(odd_docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    assert [r["doc_id"] for r in got] == [r["doc_id"] for r in rows]
    assert [r["start"] for r in got] == np.cumsum([0] + [r["n_tokens"] for r in got]).tolist()[:-1]
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got), key=repr) == sorted(
        ((r["doc_id"], len(plain(r["text"], 2)), crc(plain(r["text"], 2))) for r in rows), key=repr)


def test_files_hold_fixed_size_lists_that_are_mapped_not_copied(odd_docs, spark):
    folder = scratch_path(spark, "files")
    table = token_files.write(odd_docs.coalesce(1), folder, WORD_BPE, 2, size=32)
    for row in table.groupBy("file").agg(F.sum("n_tokens").alias("n")).collect():
        before = pa.total_allocated_bytes()
        batches = list(token_files.sequences(folder, row["file"]))
        assert pa.total_allocated_bytes() - before < 10_000
        assert {str(b.schema.field(0).type) for b in batches} == {"fixed_size_list<item: uint16>[32]"}
        masks = np.concatenate([b.column(1).flatten().to_numpy(zero_copy_only=False) for b in batches])
        ids = np.concatenate([b.column(0).flatten().to_numpy() for b in batches])
        assert masks.sum() == row["n"] and masks[:row["n"]].all() and not ids[row["n"]:].any()


def test_any_sequence_is_reached_by_its_number(odd_docs, spark):
    folder = scratch_path(spark, "files")
    table = token_files.write(odd_docs.repartition(3), folder, WORD_BPE, 2, size=16)
    want = []
    for row in table.select("file_number", "file").distinct().orderBy("file_number").collect():
        for batch in token_files.sequences(folder, row["file"]):
            want += list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
    got = token_files.Sequences(spark, folder, size=16)
    assert len(got) == len(want) > 3 * token_files.BATCH
    assert [(ids.to_pylist(), mask.to_pylist()) for ids, mask in (got[k] for k in range(len(got)))] == want
    for k in (-1, len(got)):
        with pytest.raises(IndexError):
            got[k]
    name = got.files[0]
    with pytest.raises(IndexError):
        token_files.read_sequence(folder, name, 10**6)
    path = f"{folder}/ids/{name}"
    ids, mask = token_files.read_sequence(folder, name, 1)
    with open("/proc/self/maps") as maps:
        ranges = [[int(x, 16) for x in line.split()[0].split("-")] for line in maps if path in line]
    for buffer in (ids.buffers()[1], mask.buffers()[1]):  # views of the mapped file
        assert any(a <= buffer.address < b for a, b in ranges)


def test_a_document_of_many_batches(spark):
    docs = spark.createDataFrame([(1, "short"), (2, "word and other words " * 30000), (3, "end")], "doc_id long, text string")
    folder = scratch_path(spark, "files")
    token_files.write(docs.coalesce(1), folder, WORD_BPE, 2, size=32)
    got = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in token_files.read_documents(spark, folder).collect()}
    for doc_id, text in docs.collect():
        assert got[doc_id] == (len(plain(text, 2)), crc(plain(text, 2)))


def test_counts_of_text_that_is_no_utf8(spark):
    docs = spark.sql("SELECT 1L AS doc_id, CAST(X'61FF62' AS STRING) AS text UNION ALL SELECT 2L, 'a\ufffdb'")
    got = {r["doc_id"]: r for r in token_cache.count_tokens(docs, scratch_path(spark, "cache"), PIECE_BPE).collect()}
    assert got[1]["n_tokens"] == got[2]["n_tokens"] > 0 and (got[1]["n_bytes"], got[2]["n_bytes"]) == (3, 5)


def test_files_of_nothing(no_docs, spark):
    folder = scratch_path(spark, "files")
    token_files.write(no_docs, folder, WORD_BPE, 2)
    assert token_files.read_documents(spark, folder).count() == 0
