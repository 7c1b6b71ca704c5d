"""Pairs of texts whose sets of shingles are similar, found without loss."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelattice.llm.common import finished, give_back, stored, text_batches, texts_of
from codelattice.llm.components import connected_components
from codelattice.llm.simhash import fingerprints_of, hamming_links, shingle_hashes

SHINGLE_WORDS = 5
SIMILARITY = 0.8
SAMPLE_TEXTS = 5_000
COMMON_IN_SAMPLE = 3
COMMON_MOST = 100_000
SIEVE = 1 << 20
#: Parities are compared within a key, counts among its rows that are left.
PARITY_BITS, BUCKETS = 128, 512
#: Pairs whose counts are compared at a time.
CHUNK = 1 << 12


def shingle_set(text: str, words: int = SHINGLE_WORDS) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    return np.unique(np.array(shingle_hashes(text, words), np.uint64))


def text_node(text: str) -> int:
    """A signed 64-bit hash of a text's words in order, by which equal texts meet."""
    return int(np.uint64(xxhash.xxh64_intdigest(b" ".join(text.encode().lower().split()))).view(np.int64))


def parities(own: np.ndarray) -> np.ndarray:
    """Two longs of bits, each the parity of how many shingles fall to it."""
    odd = np.bincount((own % np.uint64(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64)


def bucket_counts(own: np.ndarray) -> bytes:
    """How many shingles fall in each bucket, up to 255."""
    return np.minimum(np.bincount((own % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS), 255).astype(np.uint8).tobytes()


def least_common(size: np.ndarray, other: np.ndarray, similarity: Fraction) -> np.ndarray:
    """How many shingles two sets of these sizes share at least if they are ``similarity`` alike."""
    top, bottom = similarity.numerator, similarity.numerator + similarity.denominator
    return -(-(size + other) * top // bottom)


def common_shingles(docs: DataFrame, words: int) -> np.ndarray:
    """Shingles that many texts of a sample hold, the least common first; it orders the search and loses nothing."""
    n = docs.count()
    every = max(1, n // SAMPLE_TEXTS)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            sets = [shingle_set(t, words) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], ["h"])

    sample = docs.filter(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).select("text").mapInArrow(spread, "h long")
    counted = sample.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") >= COMMON_IN_SAMPLE).orderBy(F.col("n").desc(), "h").limit(COMMON_MOST)
    return counted.toArrow().column("h").to_numpy()[::-1].copy()


def _met(frame: pd.DataFrame, similarity: Fraction) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of rows of equal ``key`` that may be alike; ``frame`` is sorted by key and size and holds whole keys.

    A shingle that one set of a pair has alone changes one parity, so sets with
    more different parities than shingles that may be apart are no pair. Nor are
    those whose counts by bucket differ by more, where ``frame`` has ``counts``.
    """
    key, node, root, size, at = (frame[c].to_numpy() for c in ("key", "node", "root", "size", "at"))
    odd = np.ascontiguousarray(frame[["odd0", "odd1"]].to_numpy()).view(np.uint64)
    counts = np.frombuffer(b"".join(frame["counts"]), np.uint8).reshape(-1, BUCKETS) if "counts" in frame else None
    size, at = size.astype(np.int64), at.astype(np.int64)
    first, step = np.arange(len(key)), 0
    while len(first):
        step += 1
        first = first[first + step < len(key)]
        second = first + step
        # Sizes rise within a key, so what is too large once stays so.
        open_ = (key[first] == key[second]) & (size[first] * similarity.denominator >= size[second] * similarity.numerator)
        first, second = first[open_], second[open_]
        reach = np.minimum(at[first], at[second]) + 1 + np.minimum(size[first] - at[first], size[second] - at[second]) - 1
        common = least_common(size[first], size[second], similarity)
        good = (root[first] != root[second]) & (reach >= common)
        one, other, most = first[good], second[good], (size[first] + size[second] - 2 * common)[good]
        good = np.bitwise_count(odd[one] ^ odd[other]).sum(1, dtype=np.int64) <= most
        one, other, most = one[good], other[good], most[good]
        if counts is not None and len(one):
            good = np.concatenate([_apart(counts[one[i : i + CHUNK]], counts[other[i : i + CHUNK]]) <= most[i : i + CHUNK] for i in range(0, len(one), CHUNK)])
            one, other = one[good], other[good]
        if len(one):
            yield one, other


def _apart(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    return (np.maximum(one, other) - np.minimum(one, other)).sum(1, dtype=np.int64)


def _pairs(frame: pd.DataFrame, similarity: Fraction) -> Iterator[pd.DataFrame]:
    """(a, b), the nodes that ``_met`` leaves."""
    node = frame["node"].to_numpy()
    for first, second in _met(frame, similarity):
        a, b = node[first], node[second]
        yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()


def _open(frame: pd.DataFrame, similarity: Fraction) -> Iterator[pd.DataFrame]:
    """(key, node, at) of the rows that ``_met`` leaves with any other, each row once."""
    open_ = np.zeros(len(frame), bool)
    for first, second in _met(frame, similarity):
        open_[first] = open_[second] = True
    if open_.any():
        yield frame.loc[open_, ["key", "node", "at"]]


def signatures(docs: DataFrame, words: int, similarity: Fraction) -> DataFrame:
    """(doc_id, fp, node, size, keys, counts, odd0, odd1) of each row: op3's fingerprint, a hash of the words, the first shingles of the text's set, its counts by bucket and its parities.

    Two sets that are ``similarity`` alike share one shingle at least among the
    first ``size - ceil(similarity * size) + 1`` of each, in any order common to
    all. The order is by hash, with shingles that are common in a sample last;
    the sample bears on the time only.
    """
    sent = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, words))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = sent.value.view(np.uint64)
        by_hash = np.argsort(common)
        known = common[by_hash]
        for batch in text_batches(batches):
            texts, keys, sizes, odd, counts = texts_of(batch), [], [], [], []
            for text in texts:
                own = shingle_set(text, words)
                odd.append(parities(own)), counts.append(bucket_counts(own))
                if len(known) and len(own):
                    place = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    late = known[place] == own
                    own = np.concatenate([own[~late], common[np.sort(by_hash[place[late]])]])
                n = len(own)
                sizes.append(n)
                keys.append(own[: n - -(-n * similarity.numerator // similarity.denominator) + 1].view(np.int64))
            ends = pa.array(np.cumsum([0, *map(len, keys)]), pa.int32())
            columns = [
                batch.column("doc_id"),
                pa.array(fingerprints_of(texts).view(np.int64)),
                pa.array([text_node(t) for t in texts], pa.int64()),
                pa.array(sizes, pa.int32()),
                pa.ListArray.from_arrays(ends, pa.array(np.concatenate(keys))),
                pa.array(counts, pa.binary()),
                *map(pa.array, np.stack(odd, 1)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fp", "node", "size", "keys", "counts", "odd0", "odd1"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(sign, f"doc_id {kind}, fp long, node long, size int, keys array<long>, counts binary, odd0 long, odd1 long")


def _by_key(rows: DataFrame, of: Callable[[pd.DataFrame, Fraction], Iterator[pd.DataFrame]], similarity: Fraction, schema: str) -> DataFrame:
    """What ``of`` makes of frames of whole keys, sorted by key and size."""

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # the last key may go on in the next frame
        for frame in frames:
            if not len(frame):
                continue
            last = frame.key.iloc[-1]
            whole = int(np.searchsorted(frame.key.to_numpy(), last))
            if whole or (held and held[-1].key.iloc[-1] != last):
                yield from of(pd.concat([*held, frame.iloc[:whole]], ignore_index=True), similarity)
                held = []
            held.append(frame.iloc[whole:])
        if held:
            yield from of(pd.concat(held, ignore_index=True), similarity)
        give_back()

    return rows.repartition("key").sortWithinPartitions("key", "size").mapInPandas(meet, schema)


def candidates(nodes: DataFrame, similarity: Fraction) -> DataFrame:
    """(a, b), nodes of different ``root`` that share a key and may be alike by sizes, places, parities and counts.

    Keys meet twice. First each row of a key is kept, once, that may be alike
    with any other by sizes, places and parities; parities say little of sets of
    more than twice their bits, and texts that share a passage would be as many
    pairs as the square of their number. Only the rows that are left, a few, get
    the counts of their node, which tell such texts apart, and meet again. The
    pairs of one key are gone through step by step, so a key costs the time of
    the square of its texts of like size, but no more memory than its rows, and
    no more rows come of it than it has, and than pairs that are nearly alike.
    """
    signs = ["root", "size", "odd0", "odd1"]
    rows = nodes.select("node", *signs, F.posexplode("keys").alias("at", "key"))
    left = _by_key(rows, _open, similarity, "key long, node long, at int")
    again = left.join(nodes.select("node", *signs, "counts"), "node")
    return _by_key(again, _pairs, similarity, "a long, b long").distinct()


def verified(docs: DataFrame, pairs: DataFrame, words: int, similarity: Fraction) -> DataFrame:
    """The ``pairs`` (a, b) of nodes whose whole sets of shingles are alike."""

    needed = stored(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
    # Most texts are in no pair: a sieve of fixed size keeps them from being shuffled.
    places = needed.select(F.pmod("node", F.lit(SIEVE)).alias("place")).distinct().toArrow().column("place").to_numpy()
    sieve = np.zeros(SIEVE, bool)
    sieve[places] = True
    sent = docs.sparkSession.sparkContext.broadcast(sieve)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            node = np.array([text_node(t) for t in texts_of(batch)], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(node), batch.column("text")], ["node", "text"]).filter(pa.array(sent.value[node % SIEVE]))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(text_batches(batches, "text_a"), "text_b"):
            keep = []
            for one, other in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist(), strict=True):
                x, y = shingle_set(one, words), shingle_set(other, words)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common * similarity.denominator >= (len(x) + len(y) - common) * similarity.numerator)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    texts = stored(docs.select("text").mapInArrow(name, "node long, text string").join(needed, "node", "left_semi").dropDuplicates(["node"]))
    of = lambda c: texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """Stored (doc_id, component_id) of each row of ``docs``, component_id the smallest id reachable over links.

    Two texts are linked as by ``simhash.near_duplicates``, or if their sets of
    ``words``-word shingles have a Jaccard similarity of ``similarity`` or more.
    All such pairs are found: those that op3's links do not join already are
    searched for by shared shingles, bounded by parities and counts and verified by their whole sets.

    Edge cases: as in ``simhash.near_duplicates``. Texts with the same words in
    order are one node, and texts without words have no shingles.
    """
    return finished(docs.sparkSession, lambda: _grouped(docs, words, Fraction(str(similarity))))


def _grouped(docs: DataFrame, words: int, exact: Fraction) -> DataFrame:
    signed = stored(signatures(docs, words, exact))
    classes = stored(signed.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = connected_components(hamming_links(classes.select("fp"))).withColumnRenamed("node", "fp")
    rooted = stored(signed.select("node", "fp").distinct().join(roots, "fp", "left").select("node", F.coalesce("root", "fp").alias("root")))
    nodes = signed.filter(F.col("size") > 0).select("node", "size", "keys", "odd0", "odd1", "counts").dropDuplicates(["node"]).join(rooted, "node")
    pairs = stored(candidates(nodes, exact))
    alike = stored(verified(docs, pairs, words, exact))
    of = lambda c: rooted.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    links = alike.join(of("a"), "a").join(of("b"), "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
    tops = connected_components(links).select(F.col("node").alias("root"), F.col("root").alias("top"))
    grouped = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")).join(tops, "root", "left").withColumn("top", F.coalesce("top", "root"))
    smallest = grouped.groupBy("top").agg(F.min("first_id").alias("component_id"))
    members = stored(grouped.join(smallest, "top").select("fp", "component_id"))
    return signed.select("doc_id", "fp").join(members, "fp").select("doc_id", "component_id")
