"""Token files against plain encoding of each text."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from utterscope.llm import token_files as tf
from utterscope.llm.queries import QUERIES

BYTES = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(BYTES)
PLAIN.encode_special_tokens = True
ENCODER = tf.Encoder(BYTES)

TEXTS = [
    None, "", "a", " ", "\n\n x", "don't 'stop', I'll go　on  \t end ", "été, déjà; ×, 3÷,2 ñ.\r\n¡Sí!",
    "日本語 テスト。 ok", "<|endoftext|> a<|endoftext|>", "tab\tand\x0bmore\x1c x\x85y", "x" * 3000, "word " * 20000,
    "é, á b", "\x00\x00 nul", "😀 😀, 😀a",
]


def brute(rows):
    """(doc_id, start, n_tokens, ids_crc32) by one loop over the sorted rows."""
    out, start = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*PLAIN.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def same_pieces(texts):
    ids, ends = ENCODER.encode(pa.array(texts, pa.string()))
    starts = [0, *ends[:-1]]
    for text, start, end in zip(texts, starts, ends):
        assert ids[start:end].tolist() == PLAIN.encode(text, add_special_tokens=False).ids, text


def test_pieces_of_odd_texts():
    same_pieces([t or "" for t in TEXTS])
    same_pieces([])
    same_pieces(["", ""])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab 1\n\t.,'s×éñ  \x85\x1ć日😀<|>÷Ā"), max_size=40), max_size=6))
def test_pieces_of_any_text(texts):
    same_pieces(texts)


def test_a_full_memory_starts_anew(monkeypatch):
    monkeypatch.setattr(tf, "REMEMBERED", 8)
    for _ in range(3):
        same_pieces(["one two three four", "five six seven eight, nine", "one two"])


def test_other_tokenizers_encode_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder, plain = tf.Encoder(path), Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    ids, ends = encoder.encode(pa.array(["Hello  there", "", "ok"]))
    assert ids.tolist() == sum((plain.encode(t, add_special_tokens=False).ids for t in ("Hello  there", "", "ok")), [])
    assert ends.tolist()[-1] == len(ids)


def test_odd_rows(spark, tmp_path):
    rows = list(enumerate(TEXTS, 3)) + [(None, "no id"), (-5, "below zero")]
    frame = spark.createDataFrame([(i, t, 1, "h") for i, t in rows], "doc_id long, text string, row int, hash string")
    path = str(tmp_path / "files")
    tf.write_token_files(frame, path, BYTES)
    got = tf.token_digests(tf.read_token_files(spark, path)).collect()
    assert sorted(map(tuple, got), key=lambda r: (r[0] is not None, r[0] or 0)) == brute(rows)


def test_repeated_rows_lie_one_after_the_other(spark, tmp_path):
    frame = spark.createDataFrame([(1, "a b")] * 7 + [(2, "c")], "doc_id long, text string").repartition(3)
    path = str(tmp_path / "files")
    tf.write_token_files(frame, path, BYTES, per_file=2)
    got = sorted(map(tuple, tf.token_digests(tf.read_token_files(spark, path)).collect()))
    assert [r[:3] for r in got] == [(1, 3 * i, 3) for i in range(7)] + [(2, 21, 2)]


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "files")
    tf.write_token_files(spark.createDataFrame([], "doc_id long, text string"), path, BYTES)
    assert tf.token_digests(tf.read_token_files(spark, path)).collect() == []


def test_query_matches_plain_encoding(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op13_token_files"](spark, SMALL)
    assert got.columns[:4] == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_files_have_indexes_and_prune(spark, tmp_path):
    path = str(tmp_path / "files")
    frame = spark.range(0, 40000, 2).selectExpr("id as doc_id", "concat('text ', id) as text").repartition(4)
    tf.write_token_files(frame, path, BYTES, stripe_bytes=64 * 1024, row_group=1000)
    reader = spark._jvm.org.apache.orc.OrcFile
    conf = spark._jsc.hadoopConfiguration()
    stripes, filters = 0, 0
    for file in sorted((tmp_path / "files").glob("*.orc")):
        opened = reader.createReader(spark._jvm.org.apache.hadoop.fs.Path(str(file)), reader.readerOptions(conf))
        assert opened.getRowIndexStride() == 1000
        rows = opened.rows()
        for i in range(opened.getStripes().size()):
            footer = rows.readStripeFooter(opened.getStripes().get(i))
            kinds = [footer.getStreams(j).getKind().toString() for j in range(footer.getStreamsCount())]
            filters += "BLOOM_FILTER_UTF8" in kinds
            # Columns in order: the row itself, part, place, doc_id, before, n_tokens, ids, and their elements.
            assert footer.getColumns(7).getKind().toString() == "DIRECT_V2"
            stripes += 1
        rows.close()
        opened.close()
    assert stripes == filters > 0
    found = tf.find_documents(spark, path, [4000, 4001])
    assert "In(doc_id" in found._jdf.queryExecution().toString() and [r.doc_id for r in found.collect()] == [4000]


def test_a_damaged_length_stops_the_reading(spark):
    files = spark.createDataFrame([(0, 0, 1, 0, 3, [1, 2])], tf.FILE_SCHEMA)
    with pytest.raises(Exception, match="not as long"):
        tf.token_digests(files).collect()
