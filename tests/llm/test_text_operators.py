"""Token counts, packing, quality and substring dedup against plain loops."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from crewmetrics.llm import packing, quality, queries, substring_dedup, token_counts, tokens, words
from tests.llm import brute

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@given(st.lists(st.text(alphabet=st.sampled_from(list("ab, .'\n\t\x0b\x1c\x85\u00a0\u2003\u3000é日1<|endoftext|>")), max_size=30), max_size=6))
@settings(max_examples=150, deadline=None)
def test_pieces_encode_like_whole_texts(texts):
    library, encoder = Tokenizer.from_file(PATH) if not hasattr(test_pieces_encode_like_whole_texts, "held") else test_pieces_encode_like_whole_texts.held, tokens.Encoder.of(PATH)
    test_pieces_encode_like_whole_texts.held = library
    whole = [library.encode(t, add_special_tokens=False).ids for t in texts]
    ids, first = encoder.ids(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])] == whole
    assert encoder.lengths(pa.array(texts, pa.string())).tolist() == [len(x) for x in whole]


@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from(list("ab \n\x0b\u00a0é")), max_size=20)), max_size=6))
@settings(max_examples=150, deadline=None)
def test_words_are_the_runs_between_blanks(texts):
    held = words.Words(pa.array(texts, pa.string()))
    got = [[w.decode() for w in held.raw[a:b].to_pylist()] for a, b in zip(held.first[:-1], held.first[1:])]
    assert got == [brute.words(t) for t in texts]


def test_words_of_a_slice():
    held = words.Words(pa.array(["a b", "c d e", None, "f"])[1:])
    assert held.raw.to_pylist() == [b"c", b"d", b"e", b"f"] and held.counts().tolist() == [3, 0, 1]


def test_pieces_in_small_calls(monkeypatch, library):
    monkeypatch.setattr(tokens, "TEXT_BYTES", 16)
    monkeypatch.setattr(tokens, "CALL_BYTES", 32)
    encoder = tokens.Encoder(PATH)
    texts = ["one two three four five six seven", "eight nine ten eleven one two", "x" * 300 + " y", "", " ", "a\nb<|endoftext|> c  d \u00a0 e"]
    whole = [library.encode(t, add_special_tokens=False).ids for t in texts]
    for _ in range(2):
        for t, want in zip(texts, whole, strict=True):
            assert encoder.lengths(pa.array([t])).tolist() == [len(want)]
        ids, first = encoder.ids(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])] == whole


def test_ids_that_do_not_stand_for_bytes_raise():
    encoder = tokens.Encoder(PATH)
    encoder.sizes[encoder.library.token_to_id("\u0120two")] = 3
    with pytest.raises(ValueError, match="bytes"):
        encoder.lengths(pa.array(["one two three"]))


def test_token_counts(shared, documents, odd, library):
    for table in (documents, odd):
        texts = {r.doc_id: r.text or "" for r in table.collect()}
        got = token_counts.token_counts(table, PATH, limit=100).collect()
        assert len(got) == len(texts)
        for r in got:
            n = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 100)
    assert token_counts.token_counts(odd.limit(0), PATH, limit=1).collect() == []


def check_packing(rows, texts, library, size):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for key, pieces in by_doc.items():
        ids = library.encode(texts[key], add_special_tokens=False).ids + [0]
        at = 0
        for r in sorted(pieces, key=lambda r: r.piece):
            assert r.start == at and zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes()) == r.ids_crc32
            assert r.length == size or r.piece == 0
            at += r.length
        assert at == len(ids) and (len(pieces) == 1 or len(ids) > size)
    for held in by_sequence.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
    return len(by_sequence)


def test_packing(shared, documents, odd, library):
    for table, size in ((documents, 2048), (odd, 64)):
        texts = {r.doc_id: r.text or "" for r in table.collect()}
        packed = packing.pack(table, PATH, size, keep_ids=True)
        rows = packed.collect()
        n = check_packing(rows, texts, library, size)
        least = -(-sum(r.length for r in rows) // size)
        assert n <= 1.03 * least + 1
        whole = {r.sequence_id: r for r in packing.sequences(packed).collect()}
        for r in rows:
            assert whole[r.sequence_id].ids[4 * r.offset : 4 * (r.offset + r.length)] == r.ids
    assert packing.pack(odd.limit(0), PATH).collect() == []


def test_two_rounds_of_packing_and_repeated_rows(shared, odd, library):
    twice = odd.unionByName(odd).repartition(5)
    rows = packing.pack(twice, PATH, 32, open_bins=2).collect()
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    assert sum(r.length for r in rows) == 2 * sum(len(library.encode(t).ids) + 1 for t in texts.values())


def test_open_bins_close_the_fullest():
    bins = packing.OpenBins(10, 2)
    assert bins.place(6, "a") is None and bins.place(5, "b") is None
    held, free = bins.place(7, "c")  # a third bin: the fullest closes
    assert [x for _, x in held] == ["c"] and free == 3
    held, free = bins.place(4, "d")  # least room that is enough: beside a
    assert [x for _, x in held] == ["a", "d"] and free == 0
    assert sorted(tuple(x for _, x in h) for h, _ in bins.rest()) == [("b",)]


def test_quality_statistics(shared, documents, odd):
    for table in (documents, odd):
        texts = {r.doc_id: r.text for r in table.collect()}
        for r in quality.statistics(table).collect():
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute.quality(texts[r.doc_id]), r


def test_quality_verdicts_hold_out(shared):
    """The forest and its threshold, fitted on some labelled rows, hold on the others."""
    docs, labels = (shared.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in quality.quality(docs, labels.where("doc_id % 2 = 0")).collect()}
    told = {r.doc_id: r.quality for r in labels.where("doc_id % 2 = 1").collect()}
    good = [got[k] for k, q in told.items() if q == 1 and not got[k].base_failed]
    bad = [got[k] for k, q in told.items() if q == 0]
    assert sum(r.kept for r in good) >= 0.99 * len(good) and sum(r.kept for r in bad) <= 0.05 * len(bad)
    assert all(not r.kept for r in got.values() if r.base_failed)


def test_quality_without_labels(shared, odd):
    none = shared.createDataFrame([], "doc_id long, quality int")
    rows = quality.quality(odd, none).collect()
    assert all(r.kept != r.base_failed and r.anomaly is None for r in rows) and len(rows) == odd.count()
    only_null = shared.createDataFrame([(0, None), (None, 1)], "doc_id long, quality int")
    assert quality.fit(odd, only_null) is None
    kept = quality.keep_good(odd, none)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.kept}
    assert quality.quality(odd.limit(0), none).collect() == []


def check_substring(table, window):
    expected = brute.substring([(r.doc_id, r.text) for r in table.collect()], window)
    got = substring_dedup.repeats(table, window, keep_text=True).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == expected and len(got) == len(expected)
    texts = {r.doc_id: r.text for r in table.collect()}
    for r in got:
        own, gone = brute.words(texts[r.doc_id]), set()
        for span in r.spans:
            gone.update(range(span.first, span.first + span.n))
        assert " ".join(w for i, w in enumerate(own) if i not in gone) == r.kept_text and len(gone) == r.n_removed


@pytest.mark.parametrize("window", [20, 7, 3])
def test_substring_dedup(shared, documents, odd, window, monkeypatch):
    check_substring(odd, window)
    if window > 3:
        check_substring(documents, window)


def test_substring_dedup_over_many_chunks(shared, documents, monkeypatch):
    check_substring(documents.repartition(13), 20)


def test_substring_dedup_of_repeated_and_nameless_rows(shared):
    text = " ".join(f"v{i}" for i in range(30))
    table = shared.createDataFrame([(1, text), (1, text), (None, text), (None, "a " + text)], "doc_id long, text string")
    got = sorted(((r.doc_id is None, r.n_words, r.n_removed) for r in substring_dedup.repeats(table).collect()))
    assert got == [(False, 30, 0), (False, 30, 0), (True, 30, 30), (True, 31, 30)]
    assert substring_dedup.repeats(table.limit(0)).collect() == []


def test_queries_give_the_stated_columns(shared, folder):
    assert queries.op10_token_counts(shared, folder).columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert queries.op7_best_fit_packing(shared, folder).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert {"doc_id", "n_words", "n_removed", "kept_sha256"} <= set(queries.op2_substring_dedup(shared, folder).columns)
    assert {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"} <= set(queries.op9_quality_rules(shared, folder).columns)
