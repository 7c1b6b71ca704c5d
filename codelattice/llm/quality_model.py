"""Quality of texts by a small byte-level convolutional network in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codelattice.llm.common import in_training, is_held_out, stored, table, text_batches, texts_of

CHUNK, OVERLAP = 1024, 32
WIDTH, STRIDE = 8, 4
EMBEDDING, FILTERS = 8, 24
#: Bounds of the labelled rows that training reads, for each label: how many, and the bytes of their texts, which are read whole.
SAMPLE_ROWS = 2000
SAMPLE_BYTES = 8 << 20
EPOCHS, STEP, BATCH = 10, 5e-3, 64
SLICE_CHUNKS = 128
THRESHOLD = 0.3
MODULUS, HELD_OUT = 5, 0
SLICE_BYTES = 1 << 20


def chunks_of(data: bytes) -> np.ndarray:
    """Overlapping chunks over the whole text as rows of byte numbers; 0 stands for no byte, b + 1 for byte b.

    An empty text is one chunk without bytes.
    """
    step = CHUNK - OVERLAP
    n = max(1, -(-(len(data) - OVERLAP) // step))
    padded = np.zeros((n - 1) * step + CHUNK, np.int16)
    padded[: len(data)] = np.frombuffer(data, np.uint8).astype(np.int16) + 1
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::step]


class ByteNetwork:
    """Bytes -> embedding -> filters over ``WIDTH`` bytes -> largest and mean response of each chunk -> of the text -> probability."""

    SHAPES = {"table": (257, EMBEDDING), "filters": (WIDTH * EMBEDDING, FILTERS), "bias": (FILTERS,), "top": (2 * FILTERS,), "offset": (1,)}

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        scale = {"table": 0.5, "filters": (2 / (WIDTH * EMBEDDING)) ** 0.5, "bias": 0, "top": 0.1, "offset": 0}
        self.weights = {k: (rng.standard_normal(s) * scale[k]).astype(np.float32) for k, s in self.SHAPES.items()}

    def responses(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Filter responses at every place of every chunk, and what the filters saw."""
        w = self.weights
        embedded = w["table"][chunks].reshape(len(chunks), -1)
        seen = np.lib.stride_tricks.sliding_window_view(embedded, WIDTH * EMBEDDING, axis=1)[:, :: STRIDE * EMBEDDING]
        seen = np.ascontiguousarray(seen).reshape(-1, WIDTH * EMBEDDING)
        out = seen @ w["filters"]
        out += w["bias"]
        np.maximum(out, 0, out=out)
        return out.reshape(len(chunks), -1, FILTERS), seen

    def features(self, chunks: np.ndarray) -> np.ndarray:
        """Largest and mean response of each filter, chunk by chunk."""
        out, _ = self.responses(chunks)
        return np.concatenate([out.max(1), out.mean(1)], 1)

    def probability(self, pooled: np.ndarray) -> np.ndarray:
        z = pooled.astype(np.float64) @ self.weights["top"].astype(np.float64) + float(self.weights["offset"][0])
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))

    def scores(self, texts: list[str]) -> np.ndarray:
        """One probability a text: chunk maxima are pooled by their maximum, chunk means by their mean over all chunks."""
        pooled = np.zeros((len(texts), 2 * FILTERS), np.float32)
        pending, owners = [], []

        def flush() -> None:
            if not pending:
                return
            chunks, owner = np.concatenate(pending), np.concatenate(owners)
            got = self.features(chunks)
            np.maximum.at(pooled[:, :FILTERS], owner, got[:, :FILTERS])
            np.add.at(pooled[:, FILTERS:], owner, got[:, FILTERS:])
            pending.clear(), owners.clear()

        held, sizes = 0, np.ones(len(texts), np.float32)
        for i, text in enumerate(texts):
            chunks = chunks_of(text.encode())
            sizes[i] = len(chunks)
            for start in range(0, len(chunks), SLICE_BYTES // CHUNK):
                part = chunks[start : start + SLICE_BYTES // CHUNK]
                pending.append(part), owners.append(np.full(len(part), i))
                held += part.size
                if held >= SLICE_BYTES:
                    flush()
                    held = 0
        flush()
        pooled[:, FILTERS:] /= sizes[:, None]
        return self.probability(pooled)

    def gradients(self, chunks: np.ndarray, owner: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss of texts whose chunks are the rows where ``owner`` has their number.

        Chunks go through in slices, twice: the pooled responses are those of
        whole texts, and a long text takes no more memory than a slice.
        """
        n = len(labels)
        slices = [slice(i, i + SLICE_CHUNKS) for i in range(0, len(chunks), SLICE_CHUNKS)]
        seen_once = [self.responses(chunks[slices[0]])] if len(slices) == 1 else None
        pooled, counts, highest = np.zeros((n, 2 * FILTERS), self.weights["filters"].dtype), np.bincount(owner, minlength=n).astype(np.float32), []
        for part in slices:
            out, _ = seen_once[0] if seen_once else self.responses(chunks[part])
            highest.append(out.max(1))
            np.maximum.at(pooled[:, :FILTERS], owner[part], highest[-1])
            np.add.at(pooled[:, FILTERS:], owner[part], out.mean(1) / counts[owner[part]][:, None])
        error = ((self.probability(pooled) - labels) / n).astype(np.float32)
        grads = {"top": pooled.T @ error, "offset": error.sum(keepdims=True)}
        back = error[:, None] * self.weights["top"]
        below = {k: np.zeros(self.weights[k].shape, np.float64) for k in ("filters", "bias", "table")}
        for part, top in zip(slices, highest, strict=True):
            out, seen = seen_once[0] if seen_once else self.responses(chunks[part])
            self._backwards(chunks[part], out, seen, top, owner[part], pooled, back, counts, below)
        return grads | {k: v.astype(np.float32) for k, v in below.items()}

    def _backwards(self, chunks, out, seen, highest, owner, pooled, back, counts, below) -> None:
        """Adds the gradients of one slice of chunks to ``below``."""
        g = np.repeat((back[owner, FILTERS:] / counts[owner][:, None] / out.shape[1])[:, None], out.shape[1], 1)
        row, filter_ = np.nonzero((highest == pooled[owner, :FILTERS]) & (highest > 0))
        np.add.at(g, (row, out.argmax(1)[row, filter_], filter_), back[owner[row], filter_])
        g *= out > 0
        g = g.reshape(-1, FILTERS)
        below["filters"] += seen.T @ g
        below["bias"] += g.sum(0)
        to_bytes = (g @ self.weights["filters"].T).reshape(len(chunks), -1, WIDTH, EMBEDDING)
        spread = np.zeros((len(chunks), CHUNK, EMBEDDING), np.float32)
        for k in range(WIDTH):
            at = np.arange(to_bytes.shape[1]) * STRIDE + k
            spread[:, at] += to_bytes[:, :, k]
        flat, kinds = spread.reshape(-1, EMBEDDING), chunks.reshape(-1)
        below["table"] += np.stack([np.bincount(kinds, flat[:, e], 257) for e in range(EMBEDDING)], 1)

    def fit(self, texts: list[bytes], labels: np.ndarray, seed: int = 2) -> ByteNetwork:
        """Adam over shuffled batches of whole texts."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        t = 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(texts))
            for start in range(0, len(order), BATCH):
                picked = order[start : start + BATCH]
                each = [chunks_of(texts[i]) for i in picked]
                owner = np.repeat(np.arange(len(picked)), [len(c) for c in each])
                grads = self.gradients(np.concatenate(each), owner, labels[picked])
                t += 1
                rate = STEP * (1 - epoch / EPOCHS)
                for k, g in grads.items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.weights[k] -= (rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self


def _constant(network: ByteNetwork, offset: float) -> ByteNetwork:
    network.weights["top"][:] = 0
    network.weights["offset"][:] = offset
    return network


def learn(docs: DataFrame, labels: DataFrame, rows_a_label: int = SAMPLE_ROWS, bytes_a_label: int = SAMPLE_BYTES) -> ByteNetwork:
    """The network fitted to a bounded sample of the texts that have a quality of 0 or 1.

    Of each label, the ``rows_a_label`` rows with the smallest hash of their id
    are looked at in that order and taken, with their whole texts, as long as
    ``bytes_a_label`` hold them; these texts are all that comes to the driver. The score is
    that of a table in which both labels are equally frequent: the rarer is
    repeated in the fit, and the offset makes up for the rest. Where only one label has texts, every text scores close to it,
    and one half without any.
    """
    rows = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("quality").cast("int").alias("quality"), "doc_id")
    shares = {r.quality: r["count"] for r in rows.groupBy("quality").count().collect()}
    network = ByteNetwork()
    total = sum(shares.values())
    if len(shares) < 2:
        return _constant(network, 0 if not total else (6 if 1 in shares else -6))
    ids = [rows.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows_a_label) for q in (0, 1)]
    picked = ids[0].union(ids[1]).distinct()  # at most twice rows_a_label ids: fit to be broadcast
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    found = stored(found.select("quality", F.xxhash64("doc_id").alias("turn"), F.xxhash64("text").alias("tie"), "text", F.octet_length("text").cast("long").alias("size")))
    # Sizes alone tell which rows go in; ids that the table repeats may bring more rows than were picked.
    before = Window.partitionBy("quality").orderBy("turn", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fitting = found.filter(F.col("size") <= bytes_a_label).select("quality", "turn", "tie", "size").withColumn("reached", F.sum("size").over(before)).withColumn("place", F.row_number().over(Window.partitionBy("quality").orderBy("turn", "tie")))
    last = {r.quality: r for r in fitting.filter((F.col("reached") <= bytes_a_label) & (F.col("place") <= rows_a_label)).groupBy("quality").agg(F.max_by(F.struct("turn", "tie"), "place").alias("last")).collect()}
    taken = reduce(Column.__or__, [(F.col("quality") == q) & (F.struct("turn", "tie") <= F.struct(F.lit(r.last.turn), F.lit(r.last.tie))) for q, r in last.items()], F.lit(False))
    got = found.filter((F.col("size") <= bytes_a_label) & taken).select("quality", F.col("text").cast("binary").alias("text")).toArrow()
    pairs = sorted(zip(got.column("quality").to_pylist(), got.column("text").to_pylist(), strict=True))  # the same fit however rows arrive
    quality, texts = np.array([q for q, _ in pairs], np.float32), [t for _, t in pairs]
    if len(set(quality.tolist())) < 2:  # labels without texts
        return _constant(network, 0 if not len(quality) else (6 if quality[0] else -6))
    rare = min((0, 1), key=lambda q: int((quality == q).sum()))
    times = int(np.clip(np.round((quality != rare).sum() / max(1, (quality == rare).sum())), 1, 10))
    use = np.array([i for i, q in enumerate(quality) for _ in range(times if q == rare else 1)])
    network.fit([texts[i] for i in use], quality[use])
    fitted = quality[use].mean()
    network.weights["offset"] -= np.float32(np.log(fitted / (1 - fitted)))
    return network


def score_quality(docs: DataFrame, labels: DataFrame, training: Column, passed: list[str] | None = None) -> DataFrame:
    """Each row with ``score`` (0 to 1, higher: label 1 likelier) and ``predicted`` (score >= 0.3).

    The network is learned from the labelled rows where ``training``, on
    doc_id, holds, and scores whole texts, a slice of chunks at a time, so a
    very long text takes no more memory. No row is shuffled for that.

    Edge cases: null and empty texts are one chunk without bytes and score
    like others. Labels other than 0 and 1, and null ones, are not learned
    from. Ids with several labels count once for each. Columns of the new names are
    replaced, others pass (``passed``, if given).
    """
    network = learn(docs, labels.filter(training))
    fresh = ["score", "predicted"]
    own = [c for c in (passed if passed is not None else docs.columns) if c not in fresh]
    rows = docs.select(F.struct(*own).alias("row"), F.col("text"))
    weights = network.weights

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = ByteNetwork()
        known.weights = weights
        for batch in text_batches(batches):
            found = known.scores(texts_of(batch))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(found), pa.array((found >= THRESHOLD).astype(np.int32))], ["row", *fresh])

    return rows.mapInArrow(score, f"row {rows.schema['row'].dataType.simpleString()}, score double, predicted int").select("row.*", *fresh)


def op8_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    found = score_quality(docs, labels, in_training(F.col("doc_id"), MODULUS, HELD_OUT), passed=["doc_id"])
    return found.select("doc_id", is_held_out(F.col("doc_id"), MODULUS, HELD_OUT).alias("held_out"), "score", "predicted")
