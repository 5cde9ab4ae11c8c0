"""MinHash near-duplicates: a multi-index Hamming join over b-bit signatures, confirmed on full shingle sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crewmetrics.llm.components import components
from crewmetrics.llm.scratch import written
from crewmetrics.llm.words import Words, mixed, rolling, slices

#: a signature has CHUNKS x CHUNK symbols of 16 bits, one for each random order of the shingles
CHUNKS, CHUNK = 12, 4
SYMBOLS = CHUNKS * CHUNK
#: symbols in which two signatures may differ: then some chunk has at most one error
DISTANCE = 2 * CHUNKS - 1
#: shingles in a star's group, and members in one block of a shared key
GROUP_SHINGLES, BLOCK = 64_000, 4096
#: groups' shingles in a cluster that one task compares, and the shingles that a node counts for beside its own
CLUSTER_GROUPS, NODE_SHINGLES = 16, 100

_ORDERS = np.random.default_rng(20).integers(0, 2**63, SYMBOLS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text, as 64-bit hashes of ``size`` words with A-Z lower-cased.

    A text with fewer words has them all as one shingle, one without words none.
    """
    words = Words(column)
    h, _ = words.hashed(lower=True)
    grams = rolling(h, size)
    sets = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= size:
            sets.append(np.unique(grams[a : b - size + 1]))
        else:
            sets.append(mixed(rolling(h[a:b], b - a) + np.uint64(b - a)) if b > a else np.zeros(0, np.uint64))
    return sets


def signature(shingles: np.ndarray) -> np.ndarray:
    """For each order the smallest shingle, as 16 bits."""
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        np.minimum(least, (shingles[at : at + 4096, None] * _ORDERS).min(axis=0), out=least)
    return (mixed(least) >> np.uint64(48)).astype(np.uint16)


def digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def signed(docs: DataFrame, size: int, key: str, text: str) -> DataFrame:
    """``key, n_shingles, digest, signature`` for each row; no digest and no signature without shingles."""
    schema = T.StructType([
        T.StructField(key, docs.schema[key].dataType), T.StructField("n_shingles", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("signature", T.BinaryType()),
    ])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                sets = shingle_sets(part.column(text), size)
                yield pa.RecordBatch.from_arrays([
                    part.column(key), pa.array([len(s) for s in sets], pa.int64()), pa.array([digest(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                ], schema.names)

    return docs.select(key, text).mapInArrow(sign, schema)


def index_keys(symbols: np.ndarray) -> np.ndarray:
    """Keys of signatures (rows): each chunk with each of its symbols left open, so that equal chunks and those with one error meet."""
    chunks = symbols.reshape(-1, CHUNKS, CHUNK).astype(np.uint64)
    number = np.arange(CHUNKS, dtype=np.uint64) * np.uint64(CHUNK)
    keys = []
    for left_open in range(CHUNK):
        others = [i for i in range(CHUNK) if i != left_open]
        key = number + np.uint64(left_open)
        for i in others:
            key = key << np.uint64(16) | chunks[:, :, i]
        keys.append(mixed(key))
    return np.concatenate(keys, axis=1)


def _keyed(classes: DataFrame) -> DataFrame:
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column("node").to_numpy()
            symbols = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint16).reshape(-1, SYMBOLS)
            for at in range(0, len(nodes), 2048):
                keys = index_keys(symbols[at : at + 2048])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(nodes[at : at + 2048], keys.shape[1]))], ["key", "node"])

    return classes.select("node", "signature").mapInArrow(explode, "key long, node long")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def _set(value: pa.Scalar) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), np.uint64)


def _stars(percent: int):
    """Links between a group's pivot and its members."""

    def verify(table: pa.Table) -> pa.Table:
        roles, nodes = table["role"].to_pylist(), table["node"].to_pylist()
        pivots = [i for i, r in enumerate(roles) if r]
        found = []
        if pivots:
            centre = _set(table["shingles"][pivots[0]])
            found = [nodes[i] for i, r in enumerate(roles) if not r and similar(centre, _set(table["shingles"][i]), percent)]
        return pa.table({"a": pa.array(found, pa.int64()), "b": pa.array([table["pivot"][0].as_py()] * len(found), pa.int64())})

    return verify


def _agree(symbols: np.ndarray, one: np.ndarray) -> np.ndarray:
    """For each signature its distance to ``one`` and the first of their common keys, by its place in ``index_keys``."""
    equal = (symbols == one).reshape(-1, CHUNKS, CHUNK)
    in_chunk = equal.sum(axis=2)
    common = np.concatenate([in_chunk - equal[:, :, i] == CHUNK - 1 for i in range(CHUNK)], axis=1)
    return SYMBOLS - in_chunk.sum(axis=1), common.argmax(axis=1)


def _candidates(symbols: np.ndarray, size: np.ndarray, i: int, other: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Those of ``other`` that are of a possible size and within the distance of ``i``, and the first key that each shares with it."""
    other = other[100 * np.minimum(size[other], size[i]) >= percent * np.maximum(size[other], size[i])]
    distance, earliest = _agree(symbols[other], symbols[i])
    return other[distance <= DISTANCE], earliest[distance <= DISTANCE]


def _forest(percent: int):
    """Trees that span the candidate pairs of a block of a shared key: pairs of different components, within the distance.

    A row for each node of a tree but its smallest, so no more rows than members.
    """

    def span(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        node, root, size, part = (table[c].to_numpy() for c in ("node", "root", "n_shingles", "part"))
        first, last = table["first"][0].as_py(), table["last"][0].as_py()
        symbols = np.frombuffer(b"".join(table["signature"].to_pylist()), np.uint16).reshape(-1, SYMBOLS)
        right, tree = np.flatnonzero(part == last), np.arange(len(node))
        for i in np.flatnonzero(part == first):
            other = right[(root[right] != root[i]) & (tree[right] != tree[i])]
            if first == last:
                other = other[other > i]
            other, _ = _candidates(symbols, size, i, other, percent)
            if len(other):
                joined = np.unique(np.append(tree[other], tree[i]))
                tree[np.isin(tree, joined)] = joined[0]
        inner = np.flatnonzero(tree != np.arange(len(node)))
        return pa.table({"a": pa.array(node[inner], pa.int64()), "b": pa.array(node[tree[inner]], pa.int64())})

    return span


def _confirmed(percent: int):
    """Of the candidate pairs of a group, links on full sets: as many as join what has not been joined here.

    In a group of a shared key, a pair counts if that is the first of its common keys.
    """

    def verify(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        node, part = table["node"].to_numpy(), table["part"].to_numpy()
        first, last, key = (table[c][0].as_py() for c in ("first", "last", "key"))
        sets = [_set(x) for x in table["shingles"]]
        symbols, size = np.stack([signature(x) for x in sets]), np.array([len(x) for x in sets])
        place = None if key is None else np.flatnonzero(index_keys(symbols[:1])[0].view(np.int64) == key)[0]
        begin = np.cumsum(size) - size
        _, numbers = np.unique(np.concatenate(sets), return_inverse=True)
        root = np.unique(table["root"].to_numpy(), return_inverse=True)[1]
        marked, found, right = np.zeros(len(numbers), bool), [], np.flatnonzero(part == last)
        for i in np.flatnonzero(part == first):
            other = right[root[right] != root[i]]
            if first == last:
                other = other[other > i]
            other, earliest = _candidates(symbols, size, i, other, percent)
            if place is not None:
                other = other[earliest == place]
            if not len(other):
                continue
            own = numbers[begin[i] : begin[i] + size[i]]
            marked[own] = True
            ends = np.cumsum(size[other])
            inside = marked[numbers[np.repeat(begin[other] - ends + size[other], size[other]) + np.arange(ends[-1])]]
            marked[own] = False
            common = np.add.reduceat(inside.astype(np.int64), ends - size[other])
            other = other[100 * common >= percent * (size[other] + size[i] - common)]
            joined, at = np.unique(root[other], return_index=True)
            found += [(node[i], node[x]) for x in other[at]]
            root[np.isin(root, joined)] = root[i]
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return verify


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_shingles, component_id, kept`` for each row; ``component_id`` is the smallest id that links reach.

    Texts are linked if their sets of distinct ``shingle``-word shingles (whole texts, A-Z lower-cased) have
    ``100 * common >= percent * all``.  Equal sets are one class.  Classes whose signatures differ in at most
    ``DISTANCE`` symbols share a key (two that are 80 % alike differ in more with a chance under 1 in 100,000);
    links are confirmed on full sets.  First every class is held against the smallest class of its keys, the pivot.
    Then, in keys that still hold several components, all members of different components within the distance
    are found, in blocks: no cap, and no pairs are written, but trees that span them, so at most a row for each member.
    What the trees join is a cluster.  Its sets meet once, in one task that compares all its pairs within the distance and
    gives back no more links than join them; a cluster too large for that is compared key by key, in blocks.

    Null and empty texts and those without words have 0 shingles and are linked with nothing.  Rows without an id count
    as members; their component is the smallest id that there is, else null.  Rows that repeat an id are rows of
    their own text.  Ids may have any type with an order.  Other columns are not read.
    """
    rows = written(signed(docs, shingle, key, text))
    grouped = rows.where("n_shingles > 0").groupBy("digest", "n_shingles").agg(F.min(key).alias("id"), F.any_value("signature").alias("signature"))
    classes = written(grouped.withColumn("node", F.monotonically_increasing_id()))
    keys = _keyed(classes)
    crowded = keys.groupBy("key").agg(F.min("node").alias("pivot"), F.count("*").alias("members")).where("members > 1")
    shared = written(keys.join(crowded, "key"))

    # every class with a neighbour: the group where it meets its pivot, and the groups where it is one
    nearest = shared.groupBy("node").agg(F.min("pivot").alias("pivot")).join(classes.select("node", "n_shingles"), "node")
    spread = nearest.where("pivot < node").groupBy("pivot").agg(F.ceil(F.sum("n_shingles") / GROUP_SHINGLES).cast("int").alias("parts"))
    member = nearest.where("pivot < node").join(spread, "pivot").select(
        "node", F.struct("pivot", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), F.lit(False).alias("role")).alias("place")
    )
    centre = spread.select(F.col("pivot").alias("node"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).select(
        "node", F.struct(F.col("node").alias("pivot"), "part", F.lit(True).alias("role")).alias("place")
    )
    placed = member.unionByName(centre).groupBy("node").agg(F.collect_list("place").alias("places"))
    wanted = nearest.select("node").join(placed, "node", "left").join(classes.select("node", "id", "digest"), "node")
    sets = written(_sets_of(docs, wanted, shingle, key, text), "none")

    parted = sets.select("node", "shingles", F.explode("places").alias("place")).select("node", "shingles", "place.*")
    links = written(parted.groupBy("pivot", "part").applyInArrow(_stars(percent), "a long, b long"))
    rest = _rest(shared, classes, links, sets, percent)
    roots = components(links.unionByName(rest))

    classed = classes.select("digest", "n_shingles", "id", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = classed.groupBy("root").agg(F.min("id").alias("component_id"))
    by_class = classed.join(named, "root").select(F.col("digest").alias("_digest"), F.col("n_shingles").alias("_size"), "component_id")
    joined = rows.join(by_class, (rows["digest"] == by_class["_digest"]) & (rows["n_shingles"] == by_class["_size"]), "left")
    found = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col(key))
    return joined.select(key, "n_shingles", found.alias("component_id"), F.col(key).eqNullSafe(found).alias("kept"))


def _sets_of(docs: DataFrame, wanted: DataFrame, size: int, key: str, text: str) -> DataFrame:
    """``node, places, shingles`` of wanted classes, from the text of their smallest id (of rows that repeat it, from the one with that set)."""

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                sets = shingle_sets(part.column("_text"), size)
                same = [digest(s) == d for s, d in zip(sets, part.column("digest").to_pylist(), strict=True)]
                held = pa.RecordBatch.from_arrays([part.column("node"), part.column("places"), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "places", "shingles"])
                yield held.filter(pa.array(same))

    texts = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    joined = texts.join(wanted, texts["_id"].eqNullSafe(wanted["id"])).select("node", "places", "digest", "_text")
    schema = T.StructType([wanted.schema["node"], wanted.schema["places"], T.StructField("shingles", T.BinaryType())])
    return joined.mapInArrow(shingle, schema)


def _rest(shared: DataFrame, classes: DataFrame, links: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between the components that the stars have left."""
    roots = components(links)
    rooted = shared.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    several = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("members")).where("low < high")
    parts = F.ceil(F.col("members") / BLOCK).cast("int")
    open_keys = written(rooted.join(several.select("key", parts.alias("parts")), "key"))
    members = _in_blocks(open_keys).join(classes.select("node", "n_shingles", "signature"), "node")
    near = members.select("key", "first", "last", "part", "node", "root", "n_shingles", "signature")
    trees = written(near.groupBy("key", "first", "last").applyInArrow(_forest(percent), "a long, b long"))

    clusters = components(trees).withColumnRenamed("root", "cluster").join(classes.select("node", F.col("n_shingles").alias("_size")), "node")
    weight = F.sum(F.col("_size") + NODE_SHINGLES)
    room = CLUSTER_GROUPS * GROUP_SHINGLES
    weighed = written(clusters.join(clusters.groupBy("cluster").agg((weight > room).alias("large")), "cluster"))
    whole = weighed.where("not large").select("node", "cluster", F.lit(None).cast("long").alias("key"), F.lit(1).alias("parts"))
    by_key = open_keys.select("key", "node").join(weighed.where("large"), "node")
    crowds = by_key.groupBy("cluster", "key").agg(F.ceil(weight / room).cast("int").alias("parts"), F.count("*").alias("members")).where("members > 1")
    keyed = by_key.join(crowds, ["cluster", "key"]).select("node", "cluster", "key", "parts")
    met = _in_blocks(whole.unionByName(keyed)).join(sets.select("node", "shingles"), "node").join(roots, "node", "left")
    met = met.select("cluster", "key", "first", "last", "part", "node", F.coalesce("root", "node").alias("root"), "shingles")
    return written(met.groupBy("cluster", "key", "first", "last").applyInArrow(_confirmed(percent), "a long, b long"))


def _in_blocks(rows: DataFrame) -> DataFrame:
    """``rows`` for each pair of blocks that they are in, ``first <= last``; ``part`` is a row's own of the ``parts``."""
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    beside = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return beside.withColumn("first", F.least("part", "with")).withColumn("last", F.greatest("part", "with")).drop("parts", "with")


def deduplicated(docs: DataFrame, shingle: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, all columns as they are; rows with the same id and text stay or go together."""
    named = docs.select(F.struct(F.col(key).alias("id"), F.xxhash64(text).alias("print")).alias("_row"), F.col(text).alias("_text"))
    found = near_duplicates(named, shingle, percent, "_row", "_text")
    lost = found.where(~F.col("kept")).select("_row").distinct()
    row = lost["_row"]
    return docs.join(lost, docs[key].eqNullSafe(row["id"]) & (F.xxhash64(docs[text]) == row["print"]), "left_anti")
