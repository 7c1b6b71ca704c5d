"""SimHash fingerprints of whole texts and their links within a Hamming radius."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelattice.llm.common import finished, stored, table, text_batches, texts_of
from codelattice.llm.components import connected_components

SHINGLE_WORDS = 3
SEED = 42
RADIUS = 3
#: Blocks of bits on which two codes within the radius agree, beyond one for each bit that may differ.
AGREEING, FINER = 2, 3
CELL_ROWS = 20_000
FAN_OUT = 8
QUERY_BLOCK = 1024


def shingle_hashes(text: str, words: int = SHINGLE_WORDS) -> list[int]:
    """XXH64 of each run of ``words`` words, repeats included; of all words where there are fewer."""
    parts = text.encode().lower().split()  # bytes: A-Z only, blanks are 20 and 09 to 0D
    if not parts:
        return []
    hashed = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return [hashed(b" ".join(parts), SEED)]
    return [hashed(b" ".join(run), SEED) for run in zip(*(parts[i:] for i in range(words)), strict=False)]


def fingerprints_of(texts: list[str], words: int = SHINGLE_WORDS) -> np.ndarray:
    """A bit is 1 if over half of the text's hashes have it; 0 for a text without words."""
    hashes = [shingle_hashes(text, words) for text in texts]
    sizes = np.array([len(h) for h in hashes], np.int64)
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    flat = np.fromiter((h for one in hashes for h in one), np.uint64, int(sizes.sum()))
    bits = np.unpackbits(flat.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ends = np.cumsum(sizes[full])
    for at, start, end in zip(full, ends - sizes[full], ends, strict=True):
        ones = bits[start:end].sum(0, dtype=np.int64)
        out[at] = np.packbits(2 * ones > end - start, bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp) of each row; the 64 bits of fp are those of a signed long."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fingerprints_of(texts_of(batch), words).view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the sequence of Gray codes, where neighbours differ in one bit."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Hierarchical Hamming index over distinct codes in Gray order.

    Codes next to each other in that order share most of their bits. Each node
    holds the bits on which all codes below it agree and its parent's do not:
    a mask and a pattern. Going down, the differences from a query in these
    bits add up, and a node whose sum exceeds the radius goes with all below
    it. Every code is a leaf; its own node holds the bits that are left.

    Only pairs that agree on all bits of the mask ``shared`` are looked for:
    codes are in Gray order of these bits first, and a difference in one of
    them is enough to leave out a node.
    """

    def __init__(self, codes: np.ndarray, fan_out: int = FAN_OUT, shared: int = 0):
        self.shared = np.uint64(shared)
        self.codes = codes[np.lexsort((gray_rank(codes), gray_rank(codes & self.shared)))]
        self.fan_out = fan_out
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        agreed, pattern = [np.full(len(codes), full)], [self.codes]
        while len(pattern[-1]) > 1:
            starts = np.arange(0, len(pattern[-1]), fan_out)
            every = np.bitwise_and.reduceat(pattern[-1], starts)
            some = np.bitwise_or.reduceat(pattern[-1], starts)
            below = np.bitwise_and.reduceat(agreed[-1], starts)
            agreed.append(below & ~(every ^ some))
            pattern.append(every)
        self.levels = []
        for depth, (mask, bits) in enumerate(zip(agreed, pattern, strict=True)):
            above = agreed[depth + 1][np.arange(len(mask)) // fan_out] if depth + 1 < len(agreed) else np.uint64(0)
            self.levels.append((mask & ~above, bits))

    def search(self, queries: np.ndarray, radius: int, skip=None) -> tuple[np.ndarray, np.ndarray]:
        """(query, leaf) places within the radius. ``skip(level, query, node)`` says which branches to leave out."""
        top = len(self.levels) - 1
        query = np.arange(len(queries))
        node = np.zeros(len(queries), np.int64)
        differences = np.zeros(len(queries), np.int64)
        for level in range(top, -1, -1):
            mask, bits = self.levels[level]
            if level < top:
                query = np.repeat(query, self.fan_out)
                differences = np.repeat(differences, self.fan_out)
                node = (node[:, None] * self.fan_out + np.arange(self.fan_out)).ravel()
                there = node < len(mask)
                query, node, differences = query[there], node[there], differences[there]
            apart = (queries[query] ^ bits[node]) & mask[node]
            differences = differences + np.bitwise_count(apart)
            near = (differences <= radius) & ((apart & self.shared) == 0)
            if skip is not None:
                near &= ~skip(level, query, node)
            query, node, differences = query[near], node[near], differences[near]
        return query, node


def forest(codes: np.ndarray, radius: int, queries: np.ndarray | None = None, shared: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all codes within the radius of each other that agree on ``shared``, one at most for each code.

    With ``queries``, only pairs of a query and a code count. Queries go through
    the index in blocks; a branch whose codes are all connected with the query
    already is left out, so a large group of near copies costs one link a code.
    """
    index = GrayIndex(codes, shared=shared)
    own = index.codes
    every = own if queries is None else np.unique(np.concatenate([own, queries]))
    at = np.arange(len(own)) if queries is None else np.searchsorted(every, own)
    asked = np.arange(len(own)) if queries is None else np.searchsorted(every, queries)
    label = np.arange(len(every))
    step, start = 16, 0
    while start < len(asked):
        block = asked[start : start + step]
        low, high = [label[at]], [label[at]]
        while len(low[-1]) > 1:
            starts = np.arange(0, len(low[-1]), index.fan_out)
            low.append(np.minimum.reduceat(low[-1], starts))
            high.append(np.maximum.reduceat(high[-1], starts))
        mine = label[block]
        query, leaf = index.search(every[block], radius, lambda level, q, n, low=low, high=high, mine=mine: (low[level][n] == mine[q]) & (high[level][n] == mine[q]))
        a, b = block[query], at[leaf]
        while len(a):  # join labels until the block's pairs agree
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                break
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            lower = np.arange(len(every))
            np.minimum.at(lower, np.maximum(x, y), np.minimum(x, y))
            while (lower[lower] != lower).any():
                lower = lower[lower]
            label = lower[label]
        start, step = start + step, min(2 * step, QUERY_BLOCK)
    linked = np.flatnonzero(label != np.arange(len(every)))
    return every[linked], every[label[linked]]


def agreeing_masks(bits: list[int], radius: int, agreeing: int) -> list[int]:
    """Masks of which every two codes that differ in ``radius`` of the ``bits`` or fewer agree on one at least.

    The bits are cut into ``radius + agreeing`` blocks, of which so many
    differences leave ``agreeing`` untouched; each such choice is a mask.
    """
    blocks = radius + agreeing
    parts = [sum(1 << bit for bit in bits[len(bits) * i // blocks : len(bits) * (i + 1) // blocks]) for i in range(blocks)]
    return [sum(chosen) for chosen in combinations(parts, agreeing)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _cells(frame: pd.DataFrame, radius: int) -> Iterator[pd.DataFrame]:
    """Links within whole cells of one mask; ``frame`` is sorted by cell.

    Cells side by side share one index, in which the mask keeps them apart.
    The two parts of a cut cell are searched against each other.
    """
    shared = int(frame["mask"].iloc[0]) & 0xFFFFFFFFFFFFFFFF
    codes, side = frame.fp.to_numpy().view(np.uint64), frame.side.to_numpy()
    if (side == 0).any():
        yield _links(*forest(np.unique(codes[side == 0]), radius, shared=shared))
    for _, two in frame[side > 0].groupby(["pattern", "p", "q"], sort=False):
        rows, of = two.fp.to_numpy().view(np.uint64), two.side.to_numpy()
        if (of == 1).any() and (of == 2).any():
            yield _links(*forest(rows[of == 1], radius, rows[of == 2], shared))


def _links(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})


def hamming_links(codes: DataFrame, radius: int = RADIUS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Links (a, b) that connect all distinct ``fp`` within ``radius`` bits, if not each pair.

    Of five blocks of bits, two codes within three bits agree on two, so each
    choice of two blocks is a mask, and a mask with the bits that a code has
    there is a cell and the key of the shuffle: ten rows a code. A cell of more than
    ``cell_rows`` codes is cut by blocks of its other bits in the same way, into
    cells of twenty finer masks. Where codes crowd even there, the
    cell is cut into parts by a hash; each part is a cell, and each two parts
    another, so that no task gets a whole hot cell and no pair is lost.
    Cells side by side in a partition go through one hierarchical index in Gray
    order; every link comes from a search there.
    """
    bits = list(range(64))
    masks = agreeing_masks(bits, radius, AGREEING)
    finer = {_signed(m): [_signed(m | x) for x in agreeing_masks([b for b in bits if not m >> b & 1], radius, FINER)] for m in masks}
    cell = ["mask", "pattern"]
    keyed = lambda frame, of: frame.select("fp", F.explode(of).alias("mask")).select("fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("pattern"))
    crowded = lambda frame: stored(frame.groupBy(*cell).agg(F.count("*").alias("n")).filter(F.col("n") > cell_rows))
    wide = keyed(codes, F.array(*(F.lit(_signed(m)) for m in masks)))
    hot = crowded(wide)
    below = F.create_map(*(x for m, of in finer.items() for x in (F.lit(m), F.array(*map(F.lit, of)))))
    narrow = keyed(wide.join(hot, cell, "left_semi"), F.element_at(below, F.col("mask")))
    hotter = crowded(narrow).withColumn("parts", F.ceil(F.col("n") / cell_rows)).drop("n")
    whole = wide.join(hot, cell, "left_anti").withColumn("parts", F.lit(1).cast("long"))
    rows = whole.unionByName(narrow.join(hotter, cell, "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long"))))
    cut = rows.withColumn("part", F.pmod(F.xxhash64("fp"), "parts"))
    others = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("parts") - 1),
        lambda other: F.struct(
            F.least("part", other).alias("p"),
            F.greatest("part", other).alias("q"),
            F.when(F.col("part") == other, 0).when(F.col("part") < other, 1).otherwise(2).alias("side"),
        ),
    )
    dealt = cut.select("fp", *cell, F.explode(others).alias("x")).select("fp", *cell, "x.*")

    def link(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for frame in frames:
            held.append(frame)
            while sum(map(len, held)) >= cell_rows:
                together = pd.concat(held, ignore_index=True)
                breaks = np.flatnonzero(np.logical_or.reduce([np.diff(together[c].to_numpy()) != 0 for c in (*cell, "p", "q")])) + 1
                # Up to where the mask changes, or else to the last cell that is known to be whole.
                turns = np.flatnonzero(np.diff(together["mask"].to_numpy())) + 1
                end = int(turns[0]) if len(turns) else int(breaks[-1]) if len(breaks) else 0
                held = [together.iloc[end:]]
                if not end:
                    break
                yield from _cells(together.iloc[:end], radius)
        if held:
            together = pd.concat(held, ignore_index=True)
            for _, part in together.groupby("mask", sort=False):
                yield from _cells(part, radius)

    return dealt.repartition(*cell, "p", "q").sortWithinPartitions(*cell, "p", "q").mapInPandas(link, "a long, b long").filter("a is not null")


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, radius: int = RADIUS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(doc_id, fp, component_id) of each row of ``docs``, stored.

    Fingerprints link at ``radius`` or fewer differing bits; component_id is the
    smallest id reachable over links. Exact copies meet in one fingerprint
    before any pair is looked for, and only fingerprints take part in the links.

    Edge cases: texts without words, null or empty, have fingerprint zero and
    are linked like others. Rows that repeat an id are one node of the graph
    for each of their fingerprints. A null id is never a component_id, unless
    all ids of the component are null. An empty table gives an empty result. A
    very long text is fingerprinted by one task. Only ``doc_id`` and ``text`` are
    read, so other columns may have any name.
    """
    return finished(docs.sparkSession, lambda: _grouped(docs, words, radius, cell_rows))


def _grouped(docs: DataFrame, words: int, radius: int, cell_rows: int) -> DataFrame:
    marked = stored(fingerprints(docs, words))
    classes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = connected_components(hamming_links(classes.select("fp"), radius, cell_rows))
    grouped = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = grouped.groupBy("root").agg(F.min("first_id").alias("component_id"))
    members = stored(grouped.join(smallest, "root").select("fp", "component_id"))
    return marked.join(members, "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """The rows whose id is the smallest of its component, for one of its rows at least.

    ``found`` has the components (doc_id, component_id), if not those of op3.
    What goes is far less than what stays, so the texts meet the ids that go:
    where these are few, Spark sends them around and shuffles no text.

    Rows that repeat an id stay or go together. Rows without id can't be told
    from each other, so all of them stay.
    """
    found = near_duplicates(docs) if found is None else found
    going = found.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("stays"))
    gone = stored(going.filter(~F.col("stays")).select(F.col("doc_id").alias("_gone")))
    return docs.join(gone, docs.doc_id == F.col("_gone"), "left_anti")


def op3_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
