"""Language-model scores by context-tree weighting over bytes."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codelattice.llm.common import finished, give_back, in_training, is_held_out, stored, table, text_batches, texts_of

DEPTH = 6
#: Contexts of so many bytes are dealt to tasks with all longer ones; shorter ones are few.
LEAST = 3
START, END = 0xFE, 0xFF  # bytes that UTF-8 never has
BLOCK_BYTES, BLOCK_ROWS = 16 << 20, 1 << 20
LEAST_BUCKETS = 64
COUNT_BYTES = 8 << 20
FREQUENT_WORDS = 250_000
AT_ONCE = 1 << 18
MODULUS, HELD_OUT = 5, 1
_MIX = np.uint64(0x9E3779B97F4A7C15)


# ---------------------------------------------------------------- blocks of texts


def blocks_of(docs: DataFrame, training: Column, block_bytes: int) -> DataFrame:
    """(block, rows) of ``docs``: texts of about ``block_bytes``, with their ids and whether they are learned from.

    A block is a compressed Arrow stream in one value, so that it is written,
    shuffled and read as a whole, and its rows are told apart by their places.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in text_batches(batches, limit=block_bytes):
            grown = pa.compute.sum(pa.compute.binary_length(batch.column("text"))).as_py() or 0
            if held and (size + grown > block_bytes or sum(b.num_rows for b in held) + batch.num_rows > BLOCK_ROWS):
                yield _packed(number, held)
                number, held, size = number + 1, [], 0
            held.append(batch)
            size += grown
        if held:
            yield _packed(number, held)

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(training, F.lit(False)).alias("learned")).mapInArrow(pack, "block long, rows binary")


def _packed(number: int, batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batches[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        for batch in batches:
            stream.write_batch(batch)
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "rows"])


def _unpacked(rows: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(rows.as_buffer()).read_all()


# ---------------------------------------------------------------- byte grams


def byte_grams(texts: pa.ChunkedArray, depth: int) -> tuple[np.ndarray, Iterator[np.ndarray]]:
    """How many symbols each text has, and a number for each: the ``depth`` bytes before it, then itself.

    The symbols are a text's bytes and its end. Their numbers come in order, in slices.
    """
    sizes = pa.compute.binary_length(texts).to_numpy().astype(np.int64) + 1
    flat = np.full(int((sizes + depth).sum()), START, np.uint8)
    ends = np.cumsum(sizes + depth)
    flat[ends - 1] = END
    at = 0
    for chunk in texts.chunks:
        offsets = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
        data = np.frombuffer(chunk.buffers()[2] or b"", np.uint8)
        for first, last in zip(offsets[:-1], offsets[1:], strict=True):
            flat[ends[at] - 1 - (last - first) : ends[at] - 1] = data[first:last]
            at += 1

    def slices() -> Iterator[np.ndarray]:
        for first in range(depth, len(flat), AT_ONCE):
            n = min(AT_ONCE, len(flat) - first)
            grams = np.zeros(n, np.uint64)
            for back in range(depth + 1):
                grams <<= np.uint64(8)
                grams |= flat[first - depth + back : first - depth + back + n]
            yield grams[flat[first : first + n] != START]

    return sizes, slices()


def summed(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, place = np.unique(grams, return_inverse=True)
    return distinct, np.bincount(place, counts, len(distinct))


def counted(texts: pa.ChunkedArray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct grams of texts and how often each occurs."""
    grams, counts = [np.zeros(0, np.uint64)], [np.zeros(0)]
    for part in byte_grams(texts, depth)[1]:
        distinct, n = np.unique(part, return_counts=True)
        grams.append(distinct), counts.append(n)
        if sum(map(len, grams[1:])) > 2 * max(AT_ONCE, len(grams[0])):  # what repeats is summed before more comes
            merged = summed(np.concatenate(grams), np.concatenate(counts))
            grams, counts = [merged[0]], [merged[1]]
    return summed(np.concatenate(grams), np.concatenate(counts))


def bucket_of(grams: np.ndarray, least: int, buckets: int) -> np.ndarray:
    """Where a gram is dealt to: grams whose last ``least`` bytes of context agree meet."""
    mixed = ((grams >> np.uint64(8)) & np.uint64((1 << 8 * least) - 1)) * _MIX
    return ((mixed >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def _turned(grams: np.ndarray, depth: int, least: int) -> np.ndarray:
    """Grams with the last ``least`` bytes of context in front, where sorted ones differ little."""
    low = np.uint64(8 * least)
    context = grams >> np.uint64(8)
    near, far = context & np.uint64((1 << 8 * least) - 1), context >> low
    return (((near << np.uint64(8 * (depth - least))) | far) << np.uint64(8)) | (grams & np.uint64(255))


def _back(turned: np.ndarray, depth: int, least: int) -> np.ndarray:
    context, high = turned >> np.uint64(8), np.uint64(8 * (depth - least))
    near, far = context >> high, context & np.uint64((1 << 8 * (depth - least)) - 1)
    return (((far << np.uint64(8 * least)) | near) << np.uint64(8)) | (turned & np.uint64(255))


def _squeezed(values: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(values), codec="zstd", asbytes=True)


def _released(value: bytes, n: int, kind) -> np.ndarray:
    return np.frombuffer(pa.decompress(value, n * np.dtype(kind).itemsize, codec="zstd"), kind)


def _gram_bytes(grams: np.ndarray, depth: int, least: int) -> bytes:
    """Grams that are in order when turned, by their differences."""
    return _squeezed(np.diff(_turned(grams, depth, least), prepend=np.uint64(0)))


def _grams(value: bytes, n: int, depth: int, least: int) -> np.ndarray:
    return _back(np.cumsum(_released(value, n, np.uint64), dtype=np.uint64), depth, least)


PART = "block long, n int, grams binary, counts binary"


def gram_parts(blocks: DataFrame, depth: int, least: int, buckets: int) -> DataFrame:
    """(bucket, parts): of each block that has grams of the bucket, the distinct ones and how often each occurs in texts that are learned from."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, rows in zip(batch.column("block").to_pylist(), batch.column("rows"), strict=True):
                table_ = _unpacked(rows)
                ours, n = counted(table_.filter(table_.column("learned")).column("text"), depth)
                others, _ = counted(table_.filter(pa.compute.invert(table_.column("learned"))).column("text"), depth)
                grams, n = summed(np.concatenate([ours, others]), np.concatenate([n, np.zeros(len(others))]))
                order = np.argsort(_turned(grams, depth, least))
                order = order[np.argsort(bucket_of(grams[order], least, buckets), kind="stable")]
                grams, n = grams[order], n[order].astype(np.uint32)
                used, starts = np.unique(bucket_of(grams, least, buckets), return_index=True)
                cuts = [slice(x, y) for x, y in zip(starts, [*starts[1:], len(grams)], strict=True)]
                columns = [
                    pa.array(used.astype(np.int32)),
                    pa.array(np.full(len(used), block)),
                    pa.array([c.stop - c.start for c in cuts], pa.int32()),
                    pa.array([_gram_bytes(grams[c], depth, least) for c in cuts], pa.binary()),
                    pa.array([_squeezed(n[c]) for c in cuts], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "block", "n", "grams", "counts"])
        give_back()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts = None, []
        row = lambda: pa.RecordBatch.from_arrays([pa.array([current], pa.int32()), pa.array([parts], pa.list_(kind))], ["bucket", "parts"])
        kind = pa.struct([("block", pa.int64()), ("n", pa.int32()), ("grams", pa.binary()), ("counts", pa.binary())])
        for batch in batches:
            for part in batch.to_pylist():
                bucket = part.pop("bucket")
                if current is not None and bucket != current:
                    yield row()
                    parts = []
                current = bucket
                parts.append(part)
        if current is not None:
            yield row()
        give_back()

    dealt = blocks.mapInArrow(count, f"bucket int, {PART}").repartition("bucket").sortWithinPartitions("bucket", "block")
    return dealt.mapInArrow(gather, f"bucket int, parts array<struct<{PART.replace(' ', ':').replace(',:', ',')}>>")


def _merged(parts: list[dict], depth: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct grams of a bucket and their counts over all blocks."""
    grams, counts = [], []
    for part in parts:
        grams.append(_grams(part["grams"], part["n"], depth, least))
        counts.append(_released(part["counts"], part["n"], np.uint32).astype(np.float64))
        if sum(map(len, grams[1:])) > 4 * max(AT_ONCE, len(grams[0])):  # what repeats is summed before more comes
            merged = summed(np.concatenate(grams), np.concatenate(counts))
            grams, counts = [merged[0]], [merged[1]]
    return summed(np.concatenate(grams), np.concatenate(counts))


# ---------------------------------------------------------------- the tree


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series for x of one half and more, six steps up, where it is exact to ten digits."""
    y = x + 6
    series = (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return series - np.log(x * (x + 1) * (x + 2)) - np.log((x + 3) * (x + 4) * (x + 5))


def log_estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Krichevsky-Trofimov log probability of a sequence with so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1) - np.log(np.pi)


class Level:
    """Nodes of one depth and one number k of known bits, by sorted (context, known bits).

    ``weighted`` is the log of a node's weighted probability and ``own`` the
    share that its own estimate has in it, 1 where no context is longer.
    """

    def __init__(self, keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, longer: np.ndarray | None):
        self.keys, self.zeros, self.ones = keys, zeros, ones
        estimate = log_estimate(zeros, ones)
        if longer is None:
            self.weighted, self.own = estimate, np.ones(len(keys))
        else:
            self.weighted = np.logaddexp(estimate, longer) + np.log(0.5)
            self.own = np.exp(np.log(0.5) + estimate - self.weighted)

    def mix(self, mixed: np.ndarray, rest: np.ndarray) -> None:
        """Adds the own estimates to what shorter contexts left."""
        self.mixed = mixed + rest * self.own * (self.ones + 0.5) / (self.zeros + self.ones + 1)
        self.rest = rest * (1 - self.own)

    def probability(self) -> np.ndarray:
        return self.mixed + self.rest / 2


def bit_levels(grams: np.ndarray, counts: np.ndarray, depth: int, longer: list[np.ndarray] | None) -> list[Level]:
    """The eight levels of sorted, distinct grams of ``depth`` context bytes and a symbol."""
    out = []
    for k in range(8):
        keys = grams >> np.uint64(8 - k)
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        ones = np.add.reduceat(counts * ((grams >> np.uint64(7 - k)) & np.uint64(1)).astype(np.float64), starts)
        out.append(Level(keys[starts], np.add.reduceat(counts, starts) - ones, ones, longer and longer[k]))
    return out


def shorter(keys: np.ndarray, depth: int, k: int) -> np.ndarray:
    """The keys without the oldest of their ``depth`` bytes."""
    return keys & np.uint64((1 << (8 * (depth - 1) + k)) - 1)


def subtree(grams: np.ndarray, counts: np.ndarray, depth: int, least: int) -> dict[int, list[Level]]:
    """Levels from ``depth`` up to ``least`` of the sorted, distinct grams of some whole contexts of ``least`` bytes."""
    levels = {depth: bit_levels(grams, counts, depth, None)}
    for d in range(depth - 1, least - 1, -1):
        grams, counts = summed(grams & np.uint64((1 << 8 * (d + 1)) - 1), counts)
        plain = bit_levels(grams, counts, d, None)
        below = levels[d + 1]
        longer = [np.bincount(np.searchsorted(plain[k].keys, shorter(below[k].keys, d + 1, k)), below[k].weighted, len(plain[k].keys)) for k in range(8)]
        levels[d] = [Level(x.keys, x.zeros, x.ones, y) for x, y in zip(plain, longer, strict=True)]
    return levels


def mix_down(levels: dict[int, list[Level]], mixed: list[np.ndarray], rest: list[np.ndarray]) -> None:
    """From the shortest contexts, for which ``mixed`` and ``rest`` hold, to the longest."""
    first = min(levels)
    for k in range(8):
        levels[first][k].mix(mixed[k], rest[k])
        for d in range(first + 1, max(levels) + 1):
            above, level = levels[d - 1][k], levels[d][k]
            at = np.searchsorted(above.keys, shorter(level.keys, d, k))
            level.mix(above.mixed[at], above.rest[at])


def rows_of(levels: dict[int, list[Level]]) -> tuple[np.ndarray, np.ndarray]:
    """Node numbers and bit probabilities of all levels."""
    keys, p = [np.zeros(0, np.uint64)], [np.zeros(0, np.float32)]
    for d, level in levels.items():
        for k, x in enumerate(level):
            known = x.keys & np.uint64((1 << k) - 1)
            keys.append(node_key(np.uint64(d), x.keys >> np.uint64(k), known | np.uint64(1 << k)))
            p.append(x.probability().astype(np.float32))
    return np.concatenate(keys), np.concatenate(p)


def top_of_tree(parts: DataFrame, depth: int, least: int) -> dict[int, list[Level]]:
    """The levels of contexts shorter than ``least`` bytes, mixed.

    A zero and a one that followed a context give a Krichevsky-Trofimov
    probability. Upwards, a node's weighted probability is the mean of its own
    and of the product of its longer contexts'. Buckets build the trees of
    their contexts of ``least`` bytes; Spark sums these to contexts of one byte
    less, and only those come to the driver: at most 255 nodes for each pair of
    bytes that text has, whatever the table's size.
    """

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.column("parts"):
                grams, n = _merged(row.as_py(), depth, least)
                if n.any():
                    for k, x in enumerate(subtree(grams[n > 0], n[n > 0], depth, least)[least]):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x.keys), k)), pa.array(x.keys.view(np.int64)), pa.array(x.zeros), pa.array(x.ones), pa.array(x.weighted)], ["k", "key", "zeros", "ones", "weighted"])
        give_back()

    ends = parts.select("parts").mapInArrow(roots, "k long, key long, zeros double, ones double, weighted double")
    above = F.expr(f"key & (shiftleft(1L, cast({8 * (least - 1)} + k as int)) - 1)").alias("key")
    rows = ends.groupBy("k", above).agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "weighted"))).toArrow().sort_by([("k", "ascending"), ("key", "ascending")])
    top: dict[int, list[Level]] = {d: [] for d in range(least)}
    for k in range(8):
        own = rows.filter(pa.compute.equal(rows.column("k"), k))
        keys, zeros, ones, longer = (own.column(c).to_numpy() for c in ("key", "zeros", "ones", "weighted"))
        top[least - 1].append(Level(keys.astype(np.uint64), zeros, ones, longer))
        for d in range(least - 1, 0, -1):
            level = top[d][k]
            up, place = np.unique(shorter(level.keys, d, k), return_inverse=True)
            top[d - 1].append(Level(up, *(np.bincount(place, x, len(up)) for x in (level.zeros, level.ones, level.weighted))))
    mix_down(top, [np.zeros(len(x.keys)) for x in top[0]], [np.ones(len(x.keys)) for x in top[0]])
    return top


class Nodes:
    """Bit probabilities by node, sorted."""

    def __init__(self, keys: np.ndarray, p: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.p = keys[order], np.clip(p[order], 1e-7, 1 - 1e-7)

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the wanted nodes there are, and their probabilities."""
        if not len(self.keys):
            return np.zeros(len(wanted), bool), np.zeros(0, np.float32)
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        found = self.keys[at] == wanted
        return found, self.p[at[found]]


def code_lengths(grams: np.ndarray, own: Nodes, top: Nodes, depth: int, least: int) -> np.ndarray:
    """log2 of the probability of each gram's last byte, bit by bit by the longest context that has been seen."""
    symbol, context = grams & np.uint64(255), grams >> np.uint64(8)
    total = np.zeros(len(grams))
    for k in range(8):
        node = np.uint64(1 << k) + (symbol >> np.uint64(8 - k))
        bit = (symbol >> np.uint64(7 - k)) & np.uint64(1)
        p = np.full(len(grams), 0.5)
        left = np.arange(len(grams))
        for d in range(depth, -1, -1):
            found, value = (own if d >= least else top).find(node_key(np.uint64(d), context[left] & np.uint64((1 << 8 * d) - 1), node[left]))
            p[left[found]] = value
            left = left[~found]
            if not len(left):
                break
        total += np.log2(np.where(bit == 1, p, 1 - p))
    return total.astype(np.float32)


def node_key(depth, context, node):
    return (depth << np.uint64(60)) | (context << np.uint64(8)) | node


class Lengths:
    """Code lengths by gram: a table of places by hash, and a search for those that share a place."""

    def __init__(self, grams: np.ndarray, lengths: np.ndarray):
        order = np.argsort(grams)
        self.grams, self.lengths = grams[order], lengths[order]
        bits = max(4, len(grams).bit_length())
        self.shift = np.uint64(64 - bits)
        slot = (grams * _MIX) >> self.shift
        self.by_place, self.value = np.full(1 << bits, 0xFFFFFFFFFFFFFFFF, np.uint64), np.zeros(1 << bits, np.float32)
        self.by_place[slot], self.value[slot] = grams, lengths

    def of(self, grams: np.ndarray) -> np.ndarray:
        slot = (grams * _MIX) >> self.shift
        out = self.value[slot]
        other = np.flatnonzero(self.by_place[slot] != grams)
        if len(other):
            out[other] = self.lengths[np.searchsorted(self.grams, grams[other])]
        return out


def gram_lengths(parts: DataFrame, top: dict[int, list[Level]], depth: int, least: int) -> DataFrame:
    """(block, n, grams, lengths): the code length of every gram of each block, in parts by bucket.

    ``p`` of a node is the mix of the estimates of all its depths, each trusted
    as far as the ratio of its own to its weighted probability says, the rest
    being one half. A bucket's counts are summed and its trees built again,
    under what they are under; then the grams of one block after another are priced.
    """
    sent = parts.sparkSession.sparkContext.broadcast(([(x.keys, x.mixed, x.rest) for x in top[least - 1]], rows_of(top)))

    def nodes(grams: np.ndarray, counts: np.ndarray) -> Nodes:
        if not len(grams):
            return Nodes(np.zeros(0, np.uint64), np.zeros(0, np.float32))
        levels = subtree(grams, counts, depth, least)
        at = [np.searchsorted(keys, shorter(x.keys, least, k)) for k, (x, (keys, _, _)) in enumerate(zip(levels[least], sent.value[0], strict=True))]
        mix_down(levels, [m[i] for i, (_, m, _) in zip(at, sent.value[0], strict=True)], [r[i] for i, (_, _, r) in zip(at, sent.value[0], strict=True)])
        return Nodes(*rows_of(levels))

    def price(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above = Nodes(*sent.value[1])
        for batch in batches:
            for row in batch.column("parts"):
                blocks = row.as_py()
                every, n = _merged(blocks, depth, least)
                known = code_lengths(every, nodes(every[n > 0], n[n > 0]), above, depth, least)
                found = [_squeezed(known[np.searchsorted(every, _grams(x["grams"], x["n"], depth, least))]) for x in blocks]
                columns = [pa.array([x[c] for x in blocks], t) for c, t in (("block", pa.int64()), ("n", pa.int32()), ("grams", pa.binary()))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.binary())], ["block", "n", "grams", "lengths"])
                del blocks, every, n, known, found, columns
                give_back()

    return parts.select("parts").mapInArrow(price, "block long, n int, grams binary, lengths binary")


# ---------------------------------------------------------------- words


def words_of(text: str) -> list[bytes]:
    return text.encode().lower().split()  # bytes: A-Z only, blanks are 20 and 09 to 0D


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts; the end of a text counts as the empty word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, limit=COUNT_BYTES):
            counts: Counter = Counter()
            for text in texts_of(batch):
                counts.update(words_of(text))
            counts[b""] = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    return docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _frequent(counts: DataFrame, most: int) -> tuple[dict[bytes, int], bool]:
    """The most frequent words, ``most`` at the most, and whether these are all."""
    level = F.floor(F.log2("n") * 8).cast("int")
    sizes = sorted(((r.level, r.words) for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("words")).collect()), reverse=True)
    lowest, total = None, 0
    for name, words in sizes:
        if total + words > most:
            break
        lowest, total = name, total + words
    if lowest is None:
        return {}, not sizes
    rows = counts.filter(level >= lowest).toArrow()
    return dict(zip(rows.column("word").to_pylist(), rows.column("n").to_pylist(), strict=True)), lowest == sizes[-1][0]


# ---------------------------------------------------------------- scores


def score_texts(docs: DataFrame, training: Column, depth: int = DEPTH, block_bytes: int = BLOCK_BYTES, frequent_words: int = FREQUENT_WORDS) -> DataFrame:
    """Stored rows of doc_id with n_tokens, n_known, train_tokens, base_score, score and n_bytes.

    ``score`` is the log10 probability of the text's bytes and its end under a
    context tree of ``depth`` bytes over all rows where ``training`` holds.
    ``base_score`` is that of its words under their counts in the same rows.

    Texts are put into blocks, and the distinct grams of each block (contexts
    with the byte after them) are dealt to buckets by the last bytes of the
    context. A bucket has all counts of its contexts, builds their trees and returns
    the code length of each gram to the blocks that hold it, where they are
    added up by text. The tree is thus in parts everywhere: neither a task nor
    the driver holds more than the trees of a bucket, and the number of passes
    over the texts doesn't grow with it. Counts of the most
    frequent words go to the workers too, those of all others are joined.

    Edge cases: a null or empty text is only an end. Without training rows every
    bit has probability one half. Rows are told apart by the place that they
    are written at once, so repeated and null ids are fine, and so is a
    ``docs`` whose order changes when it is computed again. A very long text is
    a block of its own, scored by one task. Columns beside the id and the text
    are not read.
    """
    if not 1 <= depth <= 6:
        raise ValueError("depth: 1 to 6 bytes")
    return finished(docs.sparkSession, lambda: _scored(docs, training, depth, block_bytes, frequent_words))


def _scored(docs: DataFrame, training: Column, depth: int, block_bytes: int, frequent_words: int) -> DataFrame:
    least = min(LEAST, depth)
    spark = docs.sparkSession
    blocks = stored(blocks_of(docs, training, block_bytes))
    parts = stored(gram_parts(blocks, depth, least, max(LEAST_BUCKETS, 2 * blocks.count())))
    lengths = gram_lengths(parts, top_of_tree(parts, depth, least), depth, least)
    counts = stored(word_counts(docs.filter(training)))
    row = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total, distinct = int(row[0]), int(row[1])
    frequent, complete = _frequent(counts, frequent_words)
    sent_words = spark.sparkContext.broadcast(frequent)
    floor = float(np.log10(total + 0.5 * (distinct + 1)))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent_words.value
        current, grams, priced = None, [], []
        for batch in batches:
            for place, block in enumerate(batch.column("block").to_pylist()):
                if block != current:
                    current, grams, priced = block, [], []
                rows = batch.column("rows")[place]
                if not rows.is_valid:  # the lengths of a block come before its texts
                    n, some, length = (batch.column(c)[place].as_py() for c in ("n", "grams", "lengths"))
                    grams.append(_grams(some, n, depth, least)), priced.append(_released(length, n, np.float32))
                    continue
                table_ = _unpacked(rows)
                texts = table_.column("text")
                every, each = np.concatenate(grams), np.concatenate(priced)
                grams, priced = [], []
                known_lengths = Lengths(every, each)
                del every, each
                bits, sizes = text_bits(texts, known_lengths, depth)
                del known_lengths
                words = [_word_parts(text.as_py(), known, complete, floor) for text in texts]
                columns = [pa.array((current << 20) + np.arange(len(texts))), table_.column("doc_id").combine_chunks(), pa.array(bits * float(np.log10(2))), pa.array(sizes - 1)]
                columns += [pa.array([x[i] for x in words], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int32())))]
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "score", "n_bytes", "n_tokens", "n_known", "base_score", "rare", "times"])
                del table_, texts, words, columns, bits, sizes
                give_back()

    nothing = F.lit(None).cast("binary")
    both = lengths.withColumn("rows", nothing).unionByName(blocks.select("block", F.lit(None).cast("int").alias("n"), nothing.alias("grams"), nothing.alias("lengths"), "rows"))
    dealt = both.repartition("block").sortWithinPartitions("block", F.col("rows").isNotNull())
    schema = f"row long, doc_id {kind}, score double, n_bytes long, n_tokens long, n_known long, base_score double, rare array<binary>, times array<int>"
    done = stored(dealt.mapInArrow(score, schema))
    if not complete:
        rare = done.filter(F.size("rare") > 0).select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
        found = rare.join(counts, "word", "left").select("row", "times", F.coalesce("n", F.lit(0)).alias("n"))
        sums = found.groupBy("row").agg(
            F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more_known"), F.sum(F.col("times") * (F.log10(F.col("n") + 0.5) - floor)).alias("more_score")
        )
        done = done.join(sums, "row", "left").withColumn("n_known", F.col("n_known") + F.coalesce("more_known", F.lit(0))).withColumn("base_score", F.col("base_score") + F.coalesce("more_score", F.lit(0.0)))
    return done.select("doc_id", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score", "n_bytes")


def text_bits(texts: pa.ChunkedArray, lengths: Lengths, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The sum of its grams' code lengths for each text, and how many it has."""
    sizes, slices = byte_grams(texts, depth)
    ends = np.cumsum(sizes)
    bits, done = np.zeros(len(texts)), 0
    for grams in slices:
        if not len(grams):
            continue
        first, last = np.searchsorted(ends, [done, done + len(grams) - 1], side="right")
        starts = np.maximum(ends[first : last + 1] - sizes[first : last + 1], done) - done
        bits[first : last + 1] += np.add.reduceat(lengths.of(grams).astype(np.float64), starts)
        done += len(grams)
    return bits, sizes


def _word_parts(text: str, known: dict[bytes, int], complete: bool, floor: float) -> tuple:
    """Tokens, known ones and their score, and the words whose counts aren't here."""
    words = words_of(text)
    words.append(b"")
    counts = [known.get(w) for w in words]
    have = np.array([c for c in counts if c is not None], np.float64)
    score = float(np.log10(have + 0.5).sum()) - floor * len(have)
    missing = Counter(w for w, c in zip(words, counts, strict=True) if c is None) if len(have) < len(words) else {}
    if complete and missing:
        absent = sum(missing.values())
        return len(words), len(have), score + absent * (float(np.log10(0.5)) - floor), [], []
    return len(words), len(have), score, list(missing), list(missing.values())


def op9_context_tree_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_texts(docs.select("doc_id", "text"), in_training(F.col("doc_id"), MODULUS, HELD_OUT))
    return scored.select(
        "doc_id",
        is_held_out(F.col("doc_id"), MODULUS, HELD_OUT).alias("held_out"),
        "n_tokens",
        "n_known",
        "train_tokens",
        "base_score",
        "score",
        (-F.col("score") * F.lit(float(np.log2(10))) / F.greatest("n_bytes", F.lit(1))).alias("bits_a_byte"),
    )
