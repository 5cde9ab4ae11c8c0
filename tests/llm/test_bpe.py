"""Ids and decoded texts against the tokenizers library on whole texts."""

import hashlib
import os

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from crewmetrics.llm import bpe, queries
from crewmetrics.llm.scratch import written

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
TEXTS = [
    None, "", " \n\t ", "a", "<|endoftext|>", "a  <|endoftext|>\n<|endoftext|> b,c<|endoftext|>.", "x\n\ny \n z\nq .\n,é\n日本 語 x　y",
    "don't I'll 3,4.5 a:b  c\r\nd,\n e,\x1c\n", "é, ü. ß\nö\n\u0085x", "A\n" * 3000, "..,,;a,.b", " lead", "trail ", "\nx\n", "\U0001f600 \U0001f600,\n.", "a\x00b, \x00",
]


def plain(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    return tuple(ids), LIBRARY.decode(ids, skip_special_tokens=False)


def test_as_the_library(shared, odd):
    rows = [(i if i % 5 else None, x, "own") for i, x in enumerate(TEXTS)] * 2  # null keys and repeated rows
    docs = written(shared.createDataFrame(rows, "doc_id long, text string, chunk string").repartition(3))
    found = sorted((r.doc_id or -1, tuple(r.ids), r.decoded) for r in bpe.encode_decode(docs, PATH).collect())
    assert found == sorted((r[0] or -1, *plain(r[1])) for r in rows)
    found = {r.key: (tuple(r.ids), r.decoded) for r in bpe.encode_decode(written(odd.drop("key").withColumnRenamed("doc_id", "key")), PATH, key="key").collect()}
    assert found == {r.doc_id: plain(r.text) for r in odd.select("doc_id", "text").collect()}


def test_string_keys_and_empty_tables(shared):
    docs = shared.createDataFrame([("k", "one two"), (None, None)], "bucket string, words string")
    found = {r.bucket: (tuple(r.ids), r.decoded) for r in bpe.encode_decode(docs, PATH, "bucket", "words").collect()}
    assert found == {"k": plain("one two"), None: plain(None)}
    empty = bpe.encode_decode(docs.limit(0), PATH, "bucket", "words")
    assert empty.columns == ["bucket", "ids", "decoded"] and empty.count() == 0
    assert bpe.encode_decode(docs.where("words IS NULL"), PATH, "bucket", "words").first().decoded == ""


def test_each_distinct_word_is_encoded_once(shared, documents):
    table = bpe.word_table(bpe.chunks(written(documents.repartition(4)), 8, "doc_id", "text", True), PATH).where("id IS NULL").collect()
    words = [w for r in table for w in bpe._unpacked(pa.scalar(bytes(r.words), pa.binary())).to_pylist()]
    assert len(words) == len(set(words)) > 1000
    assert len(table) == len({r.bucket for r in table}) == 8
    assert len({a.chunk for r in table for a in r.asked}) == 4


def test_an_input_that_reads_differently_raises(shared):
    def fresh(batches):
        for batch in batches:
            yield batch.assign(text=[f"w{os.urandom(4).hex()}" for _ in range(len(batch))])

    docs = shared.range(40, numPartitions=2).withColumnRenamed("id", "doc_id").mapInPandas(fresh, "doc_id long, text string")
    with pytest.raises(Exception, match="changed between two readings"):
        bpe.encode_decode(docs, PATH).collect()


def test_ids_that_stand_for_no_text():
    texts = bpe._texts(bpe.np.frombuffer(b"ab\xe3\x81ok\xff", bpe.np.uint8), bpe.np.array([0, 2, 4, 6, 7]))
    assert texts.to_pylist() == ["ab", "�", "ok", "�"]


def test_added_tokens_that_reach_out_are_refused(shared, tmp_path):
    own = Tokenizer.from_file(PATH)
    own.add_tokens(["two words"])
    own.save(str(tmp_path / "own.json"))
    with pytest.raises(ValueError, match="added token"):
        bpe.pieces(shared, str(tmp_path / "own.json"))


def test_query(shared, folder, documents):
    found = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op12_bpe(shared, folder).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in documents.select("doc_id", "text").collect():
        ids, text = plain(r.text)
        assert found.pop(r.doc_id) == (len(ids), digest(",".join(map(str, ids))), digest(text))
    assert not found
