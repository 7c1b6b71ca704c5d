"""Benchmark items that occur, whole or nearly, in documents."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations
from math import ceil, comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelattice.llm.common import stored, table, text_batches, texts_of

SHINGLE_WORDS = 5
SIMILARITY = 0.8
RADIUS = 20
#: Three wide blocks leave a ninth of random pairs; items by the ten thousands are looked up by blocks of 16 bits.
BLOCKS = 3
LOOKED_UP, LOOKUP_BLOCKS, TABLE_BITS = 1 << 15, 4, 20
ITEM_BYTES = 8 << 20
SIEVE_BITS = 1 << 27
PAIR_BLOCK = 1 << 16

_BREAK = np.ones(256, bool)
_BREAK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_BASE = 0x5851F42D4C957F2D
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * _MIX
    values = (values ^ (values >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ (values >> np.uint64(32))


def hashed_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of all texts in order, and the words of each text.

    Words are runs of letters, digits and bytes beyond ASCII, in lower case, so
    marks and line ends make no difference.
    """
    encoded = [text.lower().encode() + b" " for text in texts]
    flat = np.frombuffer(b"".join(encoded), np.uint8)
    if not len(flat):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    gap = _BREAK[flat]
    before = np.r_[True, gap[:-1]]
    starts, ends = np.flatnonzero(before & ~gap), np.flatnonzero(gap & ~before)
    power, back = _powers(len(flat))
    sums = np.r_[np.uint64(0), np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * power, dtype=np.uint64)]
    hashes = _mixed((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))
    text_ends = np.cumsum([len(e) for e in encoded])
    return hashes, np.diff(np.r_[0, np.searchsorted(starts, text_ends)])


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        each = [np.multiply.accumulate(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)]) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
        _POWERS[:] = each
    return _POWERS[0][:n], _POWERS[1][:n]


def shingles(hashes: np.ndarray, words: int) -> np.ndarray:
    """A hash of each run of ``words`` words; runs over text borders are the caller's to skip."""
    n = len(hashes) - words + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(words):
        out = out * np.uint64(_BASE) + hashes[i : i + n]
    return _mixed(out)


def fingerprint(counted: np.ndarray, size: int | np.ndarray) -> np.ndarray:
    """SimHash from how many of ``size`` shingles have each of 64 bits."""
    return np.packbits(2 * counted > np.asarray(size)[..., None], axis=-1, bitorder="little").view(np.uint64)[..., 0]


def bit_rows(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of each run of ``lengths`` from ``starts``, one after another."""
    return np.repeat(starts - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(lengths.sum())


def flips(bits: int, most: int) -> np.ndarray:
    """All values of ``bits`` bits of which ``most`` at most are set."""
    return np.array([sum(1 << b for b in some) for n in range(most + 1) for some in combinations(range(bits), n)], np.uint64)


class BlockTable:
    """Item places by the value of one block of bits.

    A query looks up its own value with all flips of up to ``most`` bits. Where
    the table has fewer values than there are flips, each of its values is
    compared instead; both find the same items.
    """

    def __init__(self, codes: np.ndarray, start: int, end: int, most: int):
        self.start, self.mask, self.most = np.uint64(start), np.uint64((1 << (end - start)) - 1), most
        self.kind = np.uint32 if end - start <= 32 else np.uint64
        own = self.of(codes)
        self.items = np.argsort(own, kind="stable")
        self.values, counts = np.unique(own, return_counts=True)
        self.edges = np.r_[0, np.cumsum(counts)]
        self.flips = None
        if end - start <= TABLE_BITS and sum(comb(end - start, n) for n in range(most + 1)) < len(self.values):
            self.flips = flips(end - start, most)
            self.edges = np.searchsorted(own[self.items], np.arange((1 << (end - start)) + 1))

    def of(self, codes: np.ndarray) -> np.ndarray:
        return ((codes >> self.start) & self.mask).astype(self.kind)

    @property
    def probes(self) -> int:
        """Lookups or comparisons of a query."""
        return len(self.values if self.flips is None else self.flips)

    def close(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, item) places of all pairs that differ in at most ``most`` bits of the block."""
        if self.flips is None:
            query, at = np.divmod(np.flatnonzero(np.bitwise_count(self.of(queries)[:, None] ^ self.values) <= self.most), max(1, len(self.values)))
            if len(self.values) == len(self.items):
                return query, self.items[at]
        else:
            at = (self.of(queries)[:, None] ^ self.flips).astype(np.int64).ravel()
            query = np.repeat(np.arange(len(queries)), len(self.flips))
            held = np.flatnonzero(self.edges[at + 1] > self.edges[at])
            query, at = query[held], at[held]
        sizes = self.edges[at + 1] - self.edges[at]
        return np.repeat(query, sizes), self.items[spans(self.edges[at], sizes)]


class BlockIndex:
    """Item fingerprints in a table for each block of bits.

    The tables' limits add up to ``radius - blocks + 1``: a pair beyond the limit
    of each block would have more than ``radius`` differences, so the pairs within
    the limit of one block hold all within the radius.
    """

    def __init__(self, codes: np.ndarray, blocks: int, radius: int):
        self.codes, self.radius = codes, radius
        edges = [64 * i // blocks for i in range(blocks + 1)]
        total = radius - blocks + 1
        limits = [(total + i) // blocks for i in range(blocks)]
        self.tables = [BlockTable(codes, a, b, most) for a, b, most in zip(edges, edges[1:], limits, strict=False)]

    def candidates(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, item) places of the pairs that are close in a block, once for each such block."""
        return tuple(np.concatenate(each) for each in zip(*(t.close(queries) for t in self.tables), strict=True))

    def near(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, item) places of all pairs within the radius."""
        found = [np.zeros(0, np.int64)]
        step = max(1, PAIR_BLOCK // max(1, *(t.probes for t in self.tables)))
        n = max(1, len(self.codes))
        for start in range(0, len(queries), step):
            some = queries[start : start + step]
            q, i = self.candidates(some)
            close = np.bitwise_count(some[q] ^ self.codes[i]) <= self.radius
            found.append(np.unique((q[close] + start) * n + i[close]))
        return np.divmod(np.concatenate(found), n)


class Items:
    """One block of benchmark items, by their number of words."""

    def __init__(self, ids: list, texts: list[str], words: int, radius: int, blocks: int):
        hashes, sizes = hashed_words(texts)
        ends = np.cumsum(sizes)
        self.by_size, known = {}, {}
        for size in np.unique(sizes[sizes > 0]):
            at = np.flatnonzero(sizes == size)
            run = min(words, int(size))
            each = [shingles(hashes[ends[i] - size : ends[i]], run) for i in at]
            codes = np.array([fingerprint(bit_rows(e).sum(0, dtype=np.int64), len(e)) for e in each], np.uint64)
            own = np.unique(np.concatenate(each))
            self.by_size[int(size)] = ([ids[i] for i in at], [Counter(e.tolist()) for e in each], BlockIndex(codes, blocks if len(codes) < LOOKED_UP else LOOKUP_BLOCKS, radius), own, run)
            known.setdefault(run, []).append(own)
        self.known = {run: np.unique(np.concatenate(all_of)) for run, all_of in known.items()}


def members(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Places of the values that the sorted ``known`` has."""
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return np.flatnonzero(known[at] == values)


def weighted_similarity(one: Counter, other: Counter) -> float:
    """Shingles in common over all, each as often as it occurs."""
    common = sum((one & other).values())
    return common / (sum(one.values()) + sum(other.values()) - common)


def least_shared(one: int, other: int, similarity: float) -> int:
    """How many shingles two windows of so many share at least if they are ``similarity`` alike."""
    return max(1, ceil(similarity * (one + other) / (1 + similarity) - 1e-9))


def openings(hits: np.ndarray, per: int, least: int) -> np.ndarray:
    """First places of the windows of ``per`` shingles that have ``least`` of the sorted ``hits``."""
    if len(hits) < least:
        return hits[:0]
    left, right = hits[least - 1 :] - per + 1, hits[: len(hits) - least + 1]
    left = np.maximum(left, np.r_[left[0], right[:-1] + 1])
    return spans(left, np.maximum(right - left + 1, 0))


def leaks_in(hashes: np.ndarray, sizes: np.ndarray, items: Items, similarity: float) -> list[tuple]:
    """(text, item id, first word, words, hamming, similarity): the best window for each text and item."""
    best: dict[tuple, tuple] = {}
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    rolls = {run: shingles(hashes, run) for run in items.known}
    shared = {run: members(rolls[run], known) for run, known in items.known.items()}
    for size, (ids, counted, index, own, run) in items.by_size.items():
        rolled = rolls[run]

        def judge(opened: np.ndarray, shingled: int, n_words: int, codes: np.ndarray, size=size, ids=ids, counted=counted, index=index, rolled=rolled) -> None:
            for q, i in zip(*index.near(codes), strict=True):
                begin = int(opened[q])
                score = weighted_similarity(Counter(rolled[begin : begin + shingled].tolist()), counted[i])
                if score >= similarity:
                    text = int(owner[begin])
                    found = (score, -begin, int(np.bitwise_count(codes[q] ^ index.codes[i])), n_words)
                    key = text, i, size
                    if key not in best or found[:2] > best[key][1][:2]:
                        best[key] = (ids[i], found)

        hits = shared[run][members(rolled[shared[run]], own)]
        if not len(hits):
            continue
        # A window with fewer shingles of these items than a similar one shares is none; all others are fingerprinted.
        per = size - run + 1
        first = openings(hits, per, least_shared(per, per, similarity))
        first = first[(first >= 0) & (first + size <= len(hashes))]
        first = first[owner[first] == owner[first + size - 1]]
        for start in range(0, len(first), PAIR_BLOCK // 8):
            opened = first[start : start + PAIR_BLOCK // 8]
            needed, place = np.unique((opened[:, None] + np.arange(per)).ravel(), return_inverse=True)
            gaps = np.cumsum(np.r_[True, np.diff(needed) > 1])
            sums = np.cumsum(np.vstack([np.zeros((1, 64), np.int32), bit_rows(rolled[needed])]), axis=0, dtype=np.int32)
            left = place.reshape(-1, per)[:, 0]
            assert (gaps[left] == gaps[left + per - 1]).all()
            judge(opened, per, size, fingerprint(sums[left + per] - sums[left], np.full(len(opened), per)))
        # A text shorter than the items is one window; the shingles of the smaller over those of the larger bound the similarity.
        whole = np.unique(owner[hits])
        whole = whole[(sizes[whole] >= run) & (sizes[whole] < size) & (sizes[whole] - run + 1 >= (similarity - 1e-9) * per)]
        for text in whole:
            begin, n = ends[text] - sizes[text], int(sizes[text])
            some = n - run + 1
            judge(np.array([begin]), some, n, fingerprint(bit_rows(rolled[begin : begin + some]).sum(0, dtype=np.int64), some)[None])
    return [(text, item, int(-f[1] - (ends[text] - sizes[text])), f[3], f[2], f[0]) for (text, _, _), (item, f) in best.items()]


class Sieve:
    """Which shingles items have, in a table of fixed size, and the items' numbers of words."""

    def __init__(self, words: int, similarity: float, bits: int = SIEVE_BITS):
        self.words, self.similarity, self.held, self.sizes = words, similarity, np.zeros(bits // 8, np.uint8), set()

    def _has(self, values: np.ndarray) -> np.ndarray:
        at = values % np.uint64(8 * len(self.held))
        return (self.held[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1

    def add(self, texts: list[str]) -> None:
        items = Items(list(range(len(texts))), texts, self.words, 0, 1)
        self.sizes.update(items.by_size)
        for own in items.known.values():
            at = own % np.uint64(8 * len(self.held))
            np.bitwise_or.at(self.held, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def may_hold(self, hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether each text may hold an item; those that do always may."""
        out = np.zeros(len(sizes), bool)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        for run in {min(self.words, size) for size in self.sizes}:
            hits = np.flatnonzero(self._has(shingles(hashes, run)))
            hits = hits[owner[hits] == owner[hits + run - 1]]
            for per in (size - run + 1 for size in self.sizes if min(self.words, size) == run):
                reach = least_shared(per, per, self.similarity) - 1
                first, last = hits[: max(0, len(hits) - reach)], hits[reach:]
                out[owner[first[(last - first < per) & (owner[first] == owner[last])]]] = True
            # Texts shorter than an item, as a whole.
            some = sizes - run + 1
            share = 2 * self.similarity / (1 + self.similarity)
            out |= (some > 0) & (some < max(self.sizes)) & (np.bincount(owner[hits], minlength=len(sizes)) >= share * some - 1e-9)
        return out


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, words: int = SHINGLE_WORDS, similarity: float = SIMILARITY, radius: int = RADIUS, blocks: int = BLOCKS, item_bytes: int = ITEM_BYTES
) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, hamming, similarity) for each item in a document.

    Every item is compared with the windows of its own number of words, and
    with a text that has fewer words than the item as a whole. A window is
    given a SimHash of its ``words``-word shingles; an index over blocks of bits yields all items within ``radius`` bits of it, and those
    are verified by the similarity of the two sets of shingles, each counted
    as often as it occurs. At similarity 0.8 ten bits differ on average with a
    deviation of three, so the radius of 20 loses about one in two thousand
    of the weakest. Windows with fewer shingles of items of that size than
    similar ones share are passed over. The best window of a document and item is
    returned, the earliest of equals.

    The items are the query set. They go to the workers in blocks of
    about ``item_bytes`` of text, dealt by a hash. With more than one block the
    documents are read once with a sieve of all items' shingles, of fixed size,
    and those that may hold an item are stored and read for each block; no
    document is shuffled or sent anywhere.

    Edge cases: null and empty texts, and items without words, match nothing.
    An item of fewer than ``words`` words has one shingle, all its words, and
    matches where these stand in order. Items with equal texts are reported
    each. Repeated rows are reported each; nulls among ids stay null. A very long
    text is searched by one task, in blocks of windows. No column but the ids and
    texts is read, so others may have any name.
    """
    spark = docs.sparkSession
    item_kind, doc_kind = benchmark.schema["item_id"].dataType.simpleString(), docs.schema["doc_id"].dataType.simpleString()
    sized = stored(benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size")))
    # Blocks by hash, enough of them that each is about item_bytes; the sum alone comes to the driver.
    total = sized.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    n_blocks = max(1, -(-int(total) // item_bytes))
    schema = f"doc_id {doc_kind}, item_id {item_kind}, first_word long, n_words long, hamming int, similarity double"

    def block_of(block: int) -> pa.Table:
        return sized.filter(F.pmod(F.xxhash64("text", "item_id"), F.lit(n_blocks)) == block).orderBy("item_id", "text").select("item_id", "text").toArrow()

    docs = docs.select("doc_id", "text")
    if n_blocks > 1:
        sieve = Sieve(words, similarity)
        for block in range(n_blocks):
            sieve.add(block_of(block).column("text").to_pylist())
        shaken = spark.sparkContext.broadcast(sieve)

        def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in text_batches(batches):
                yield batch.filter(pa.array(shaken.value.may_hold(*hashed_words(texts_of(batch)))))

        docs = stored(docs.mapInArrow(sift, docs.schema))
    parts = []
    for block in range(n_blocks):
        rows = block_of(block)
        ids, texts = rows.column("item_id"), rows.column("text").to_pylist()
        sent = spark.sparkContext.broadcast((ids.to_pylist(), texts))
        item_type = ids.type

        def search(batches: Iterator[pa.RecordBatch], sent=sent, item_type=item_type) -> Iterator[pa.RecordBatch]:
            items = Items(*sent.value, words, radius, blocks)
            for batch in text_batches(batches):
                found = leaks_in(*hashed_words(texts_of(batch)), items, similarity)
                columns = [*zip(*found, strict=True)] if found else [()] * 6
                kinds = [item_type, pa.int64(), pa.int64(), pa.int32(), pa.float64()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(columns[0], pa.int64())), *(pa.array(c, k) for c, k in zip(columns[1:], kinds, strict=True))],
                    ["doc_id", "item_id", "first_word", "n_words", "hamming", "similarity"],
                )

        part = docs.mapInArrow(search, schema)
        if n_blocks > 1:  # one block is held at a time
            part = stored(part)
            sent.destroy()
        parts.append(part)
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no item was found. Rows without id are kept."""
    found = stored(find_leaks(docs, benchmark).select("doc_id").distinct())
    return docs.join(found, "doc_id", "left_anti").select(docs.columns)


def op2_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
