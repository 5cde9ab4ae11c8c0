"""Byte-level BPE by a table of distinct words: each is encoded once, ids come back by position, pieces by a join on the id.

A word is a stretch of text that the tokenizer never joins with its neighbours: it begins before a single space or
line feed between two characters that are no white space, behind such a line feed, or between an ASCII letter or digit
and a stop mark.  The ids of a text are then the ids of its words, one after the other, and so is the decoded text.

Texts are read in chunks.  A chunk asks for each of its distinct words once, so a word that every text holds
reaches the shuffle as one entry for each chunk; entries travel in packed rows, one for each chunk and bucket of words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crewmetrics.llm.tokens import Encoder
from crewmetrics.llm.words import buffers, mixed, slices, text_column

#: bytes of text in a chunk, and for one bucket of words
CHUNK_BYTES, BUCKET_BYTES = 12 << 20, 8 << 20
#: the id-to-piece table is broadcast: a vocabulary with more entries is refused
MAX_VOCABULARY = 2_000_000

_WHITE = np.zeros(256, bool)
_WHITE[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_STOP = np.zeros(256, bool)
_STOP[list(b",.;:!?")] = True
_R = np.uint64(0x9E3779B97F4A7C15)
_R_INVERSE = np.uint64(pow(int(_R), -1, 1 << 64))


def word_starts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where words begin in texts that lie one after the other; of characters beyond ASCII, only those of two bytes with
    lead C3-DF are known to be no white space."""
    cut = np.zeros(len(data) + 1, bool)
    cut[bounds] = True
    if len(data) > 2:
        lone = np.flatnonzero((data[1:-1] == 0x20) | (data[1:-1] == 0x0A)) + 1
        left, right, lead = data[lone - 1], data[lone + 1], data[np.maximum(lone - 2, 0)]
        solid = np.where(left < 0x80, ~_WHITE[left], (lead >= 0xC3) & (lead <= 0xDF)) & np.where(right < 0x80, ~_WHITE[right], (right >= 0xC3) & (right <= 0xDF))
        lone = lone[solid]
        cut[lone] = True
        cut[lone[data[lone] == 0x0A] + 1] = True
        cut[1:-1] |= _STOP[data[1:]] & _ALNUM[data[:-1]]
    return np.flatnonzero(cut[:-1]) if len(data) else np.zeros(0, np.int64)


def _binary(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    offsets = np.append(starts, len(data)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _hashed(words: pa.Array) -> np.ndarray:
    """A number for each word, from its bytes alone."""
    data, bounds = buffers(words)
    powers = np.cumprod(np.full(len(data), _R, np.uint64))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers)))
    back = np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(len(data), _R_INVERSE, np.uint64))))
    return mixed((sums[bounds[1:]] - sums[bounds[:-1]]) * back[bounds[:-1]])


def _squeezed(numbers: np.ndarray) -> bytes:
    """Numbers below 2**32, byte plane by byte plane, as small ones are frequent."""
    return zstandard.ZstdCompressor(3).compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _widened(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def _packed(values: pa.Array) -> bytes:
    """Binary values: the size of their lengths, the lengths, the bytes."""
    data, bounds = buffers(values)
    lengths = _squeezed(np.diff(bounds))
    return len(lengths).to_bytes(4, "little") + lengths + zstandard.ZstdCompressor(3).compress(data.tobytes())


def _unpacked(packed: pa.Scalar) -> pa.Array:
    raw = packed.as_py()
    size = int.from_bytes(raw[:4], "little")
    starts = np.concatenate(([0], np.cumsum(_widened(raw[4 : 4 + size]).astype(np.int64))))
    return _binary(np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[4 + size :]), np.uint8), starts[:-1])


def chunks(docs: DataFrame, buckets: int, key: str, text: str, ask: bool) -> DataFrame:
    """The texts chunk by chunk: the distinct words that a chunk asks for, or the numbers of its words.

    ``chunk, bucket, words`` (a row for each bucket), or ``chunk, keys, firsts`` (word bounds of the texts), ``codes`` (each
    word's number, by falling frequency), ``owner`` (the bucket of each number).  A chunk's name holds a digest of its texts.
    """
    kind = docs.schema[key].dataType.simpleString()
    schema = "chunk string, bucket int, words binary" if ask else f"chunk string, keys array<{kind}>, firsts binary, codes binary, owner binary"

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in slices(batch, text, CHUNK_BYTES):
                data, bounds = buffers(text_column(part.column(text)))
                digest = hashlib.blake2b(np.ascontiguousarray(data), digest_size=8)
                digest.update(bounds)
                starts = word_starts(data, bounds)
                coded = _binary(data, starts).dictionary_encode()
                codes, held = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
                order = pc.sort_indices(held).to_numpy(zero_copy_only=False).astype(np.int64)
                order = order[np.argsort(-np.bincount(codes, minlength=len(held))[order], kind="stable")]
                held = held.take(pa.array(order))
                owner = (_hashed(held) % np.uint64(buckets)).astype(np.int64)
                number += 1
                name = f"{task}-{number}-{digest.hexdigest()}"
                if ask:
                    grouped = held.take(pa.array(np.argsort(owner, kind="stable")))
                    counts = np.bincount(owner, minlength=buckets)
                    ends = np.cumsum(counts)
                    asked = np.flatnonzero(counts)
                    words = [_packed(grouped.slice(ends[b] - counts[b], counts[b])) for b in asked]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(asked)), pa.array(asked.astype(np.int32)), pa.array(words, pa.binary())], ["chunk", "bucket", "words"])
                    continue
                rank = np.empty(len(order), np.uint32)
                rank[order] = np.arange(len(order), dtype=np.uint32)
                keys, packed = part.column(key), [_squeezed(x) for x in (np.searchsorted(starts, bounds), rank[codes], owner)]
                row = [pa.array([name]), pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), *(pa.array([x], pa.binary()) for x in packed)]
                yield pa.RecordBatch.from_arrays(row, ["chunk", "keys", "firsts", "codes", "owner"])

    return docs.select(key, text).mapInArrow(split, schema)


def word_table(asked: DataFrame, tokenizer: str) -> DataFrame:
    """The distinct words by bucket, each encoded once, beside which of them each chunk asks for, in its order.

    A bucket is a row ``words, ids, asked`` (array of chunk and places in ``words``), and a row for each ``id`` in use.
    """
    schema = "bucket int, id int, words binary, ids binary, asked array<struct<chunk:string,places:binary>>"
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.struct([("chunk", pa.string()), ("places", pa.binary())]))]

    def encode(table: pa.Table) -> pa.Table:
        held = [_unpacked(x) for x in table["words"]]
        coded = pa.concat_arrays(held).dictionary_encode()
        places = np.split(coded.indices.to_numpy(zero_copy_only=False), np.cumsum([len(x) for x in held])[:-1])
        ids, bounds = Encoder.of(tokenizer).ids_of_pieces(coded.dictionary)
        ids = ids.astype("<u4")
        used = np.unique(ids).astype(np.int32)
        whole = [{"chunk": c, "places": _squeezed(p)} for c, p in zip(table["chunk"].to_pylist(), places, strict=True)]
        none, bucket = [None] * len(used), table["bucket"][0].as_py()
        columns = [
            [bucket] * (1 + len(used)), [None, *used.tolist()], [_packed(coded.dictionary), *none],
            [_packed(_binary(ids.view(np.uint8), bounds[:-1] * 4)), *none], [whole, *none],
        ]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["bucket", "id", "words", "ids", "asked"])

    return asked.groupBy("bucket").applyInArrow(encode, schema)


def _byte_of() -> dict[str, int]:
    """Byte-level vocabularies write a byte as its own printable character, the others as those from U+0100 on, in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(hidden)}


def pieces(spark: SparkSession, tokenizer: str) -> DataFrame:
    """``id, piece``: the bytes that each id stands for; bounded by the vocabulary."""
    library = Encoder.of(tokenizer).library
    for token in library.get_added_tokens_decoder().values():
        if token.lstrip or token.rstrip or token.single_word or token.normalized or any(c in token.content for c in " \n,.;:!?"):
            raise ValueError(f"the added token {token.content!r} takes in its surroundings or may be cut")
    vocabulary = library.get_vocab(with_added_tokens=True)
    if len(vocabulary) > MAX_VOCABULARY:
        raise ValueError(f"a vocabulary of more than {MAX_VOCABULARY} entries is not broadcast")
    byte = _byte_of()
    rows = [(i, bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode()) for t, i in vocabulary.items()]
    return spark.createDataFrame(sorted(rows), "id int, piece binary")


def replies(table: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``chunk, bucket, ids, known, pieces``: what each chunk asked for; the ids in use are joined with their pieces."""
    joined = table.select("bucket", "id", "ids", "asked").join(F.broadcast(vocabulary), "id", "left")

    def reply(rows: pa.Table) -> pa.Table:
        at = int(np.flatnonzero(rows["id"].is_null().to_numpy(zero_copy_only=False))[0])
        ids, asked = _unpacked(rows["ids"][at]), rows["asked"][at].as_py()
        found = rows.filter(rows["id"].is_valid()).sort_by("id").combine_chunks()
        known = found["id"].to_numpy()
        piece = pa.concat_arrays(found["piece"].chunks) if len(known) else pa.array([], pa.binary())
        out = []
        for a in asked:
            own = pc.take(ids, pa.array(_widened(a["places"]).astype(np.int64)))
            used = np.unique(buffers(own)[0].view("<u4"))
            out.append((a["chunk"], rows["bucket"][at].as_py(), _packed(own), _squeezed(used), _packed(pc.take(piece, pa.array(np.searchsorted(known, used))))))
        kinds = [pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["chunk", "bucket", "ids", "known", "pieces"])

    return joined.groupBy("bucket").applyInArrow(reply, "chunk string, bucket int, ids binary, known binary, pieces binary")


def _decoded(ids: pa.Array, known: np.ndarray, piece: pa.Array) -> pa.Array:
    """The bytes of words from the pieces of their ids."""
    data, bounds = buffers(ids)
    raw, ends = buffers(pc.take(piece, pa.array(np.searchsorted(known, data.view("<u4")))))
    return _binary(raw, ends[bounds[:-1] // 4])


def encode_decode(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, ids, decoded`` for each row: its token ids, and the text that they stand for.

    ``tokenizer`` is the file of a byte-level BPE that executors can open; special strings inside a text become their id.
    A null text is empty: no ids, an empty decoded text.  Repeated rows and null keys are kept, other columns are not
    read, an empty table gives an empty result.  A text is held whole by one task, as its row is.

    ``docs`` is read twice and must give the same rows in the same order, as files do; write the result of a shuffle
    as a table first.  A chunk that reads differently gets no answer, which raises.
    """
    spark, kind = docs.sparkSession, docs.schema[key].dataType
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))
    found = replies(word_table(chunks(docs, buckets, key, text, True), tokenizer), pieces(spark, tokenizer))
    schema = T.StructType([T.StructField(key, kind), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def place(rows: pa.Table, found: pa.Table) -> pa.Table:
        if not rows.num_rows:  # answers to a chunk that the second reading doesn't have
            raise ValueError("the documents changed between two readings: write them as a table first")
        out = []
        for row in range(rows.num_rows):
            keys = rows["keys"].combine_chunks().slice(row, 1).flatten()
            firsts, codes, owner = (_widened(rows[c][row].as_py()) for c in ("firsts", "codes", "owner"))
            firsts = firsts.astype(np.int64)
            if not len(codes):
                empty = pa.ListArray.from_arrays(pa.array(np.zeros(len(keys) + 1, np.int32)), pa.array([], pa.int32()))
                out.append(pa.table([keys, empty, pa.array([""] * len(keys), pa.string())], schema.names))
                continue
            order = np.argsort(found["bucket"].to_numpy()).tolist() if found.num_rows else []
            held = [_unpacked(found["ids"][i]) for i in order]
            if sum(map(len, held)) != len(owner):
                raise ValueError("the documents changed between two readings: write them as a table first")
            held = pa.concat_arrays(held)
            known, at = np.unique(np.concatenate([_widened(found["known"][i].as_py()) for i in order]), return_index=True)
            piece = pc.take(pa.concat_arrays([_unpacked(found["pieces"][i]) for i in order]), pa.array(at))
            number = np.empty(len(owner), np.int64)
            number[np.argsort(owner, kind="stable")] = np.arange(len(owner))
            places = pa.array(number[codes])
            data, bounds = buffers(pc.take(held, places))
            ids = pa.ListArray.from_arrays(pa.array((bounds[firsts] // 4).astype(np.int32)), pa.array(data.view("<i4")))
            raw, ends = buffers(pc.take(_decoded(held, known, piece), places))
            out.append(pa.table([keys, ids, _texts(raw, ends[firsts])], schema.names))
        return pa.concat_tables(out)

    return chunks(docs, buckets, key, text, False).groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(place, schema)


def _texts(raw: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Decoded texts; what is no UTF-8 becomes U+FFFD, text by text."""
    whole = raw.tobytes()
    try:
        whole.decode()
    except UnicodeDecodeError:
        return pa.array([whole[a:b].decode(errors="replace") for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.string())
    return pa.Array.from_buffers(pa.string(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(whole)])
