"""Language of texts and of their parts, from scripts and learned letter sequences."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codelattice.llm.common import in_training, is_held_out, table, text_batches, texts_of

BUCKETS = 1 << 16
SWITCH_PENALTY = 8.0
LEAST_WORD = -30.0
MIN_SCRIPT_SHARE = 0.01
MAX_LANGUAGES = 1000
UNKNOWN = "und"
MODULUS, HELD_OUT = 4, 2
CELLS = 1 << 18

#: First code points of ranges, and the script of each up to the next.
SCRIPT_STARTS = np.array([0x0, 0x370, 0x400, 0x530, 0x590, 0x600, 0x700, 0x900, 0x980, 0xA00, 0xB80, 0xC00, 0xE00, 0xE80, 0x10A0, 0x1100, 0x1200, 0x1E00, 0x1F00, 0x2000, 0x2E80, 0x3040, 0x3100, 0x3130, 0x3190, 0x3400, 0xA000, 0xAC00, 0xD7B0, 0xF900, 0xFB00, 0xFB50, 0xFE00, 0xFF66, 0xFFA0, 0x20000, 0x323B0])
SCRIPT_NAMES = "latin greek cyrillic armenian hebrew arabic other indic indic indic indic indic thai other georgian hangul ethiopic latin greek other han kana other hangul kana han other hangul other han other arabic other kana hangul han other".split()
SCRIPTS = sorted(set(SCRIPT_NAMES))
_SCRIPT = np.array([SCRIPTS.index(name) for name in SCRIPT_NAMES])
_WORDS = re.compile(r"[^\W\d_]+").findall


def words_of(text: str) -> list[str]:
    return _WORDS(text.lower())


def script_of(words: list[str]) -> np.ndarray:
    """Script of each word's first letter."""
    points = np.array([ord(w[0]) for w in words], np.int64)
    return _SCRIPT[np.searchsorted(SCRIPT_STARTS, points, side="right") - 1]


def sequences(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all three-letter sequences of each word, its two borders being letters too; and how many it has."""
    flat = np.frombuffer("".join(f"\x01{w}\x02" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w) for w in words], np.int64)
    if not len(words):
        return np.zeros(0, np.int64), sizes
    mixed = flat[:-2] * np.uint64(0x9E3779B97F4A7C15) + flat[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + flat[2:] * np.uint64(0x165667B19E3779F9)
    mixed ^= mixed >> np.uint64(33)
    bucket = (mixed * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(48)
    starts = np.cumsum(sizes + 2) - (sizes + 2)
    inside = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)
    return bucket[inside].astype(np.int64), sizes


class Model:
    """Log probabilities of sequence buckets by language, and which languages use a script."""

    def __init__(self, languages: list[str], counts: np.ndarray, letters: np.ndarray):
        self.languages = languages
        total = counts.sum(1, keepdims=True)
        self.scores = np.log((counts + 0.5) / (total + 0.5 * BUCKETS)).T.astype(np.float32) if languages else np.zeros((BUCKETS, 0), np.float32)
        share = letters / np.maximum(letters.sum(1, keepdims=True), 1)
        self.uses = (share >= MIN_SCRIPT_SHARE).T  # script, language

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log probability of each word under each language, relative to its best; -inf for languages that don't use its script.

        A word in a script of no learned language scores 0 for all: see ``read``.
        """
        bucket, sizes = sequences(words)
        if not len(words) or not self.languages:
            return np.zeros((len(words), len(self.languages)), np.float32)
        sums = np.add.reduceat(self.scores[bucket], np.cumsum(sizes) - sizes, axis=0)
        candidates = self.uses[script_of(words)]
        sums = np.where(candidates, sums, -np.inf)
        best = sums.max(1, keepdims=True)
        return np.where(np.isfinite(best), sums - np.where(np.isfinite(best), best, 0), 0).astype(np.float32)

    def read(self, words: list[str]) -> np.ndarray:
        """Whether a learned language uses the word's script."""
        return self.uses[script_of(words)].any(1)


def best_paths(scores: list[np.ndarray], penalty: float) -> list[np.ndarray]:
    """The language of each word of each text: highest sum of word scores less ``penalty`` for each change.

    Texts are sorted by length and go through in groups, one word of all at a
    time; equal sums go to the language that comes first.
    """
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(scores)
    order = sorted(range(len(scores)), key=lambda i: len(scores[i]))
    while order:
        longest = len(scores[order[-1]])
        group = order[-max(1, CELLS // max(longest, 1)) :]
        del order[len(order) - len(group) :]
        if longest == 0:
            continue
        n_langs = scores[group[0]].shape[1]
        lengths = np.array([len(scores[i]) for i in group])
        grid = np.zeros((longest, len(group), n_langs), np.float32)
        for column, i in enumerate(group):
            grid[: len(scores[i]), column] = scores[i]
        sums = grid[0].astype(np.float64)
        origin = np.zeros((longest, len(group), n_langs), np.int16)
        own = np.arange(n_langs, dtype=np.int16)
        for t in range(1, longest):
            top = sums.argmax(1)
            moved = sums.max(1)[:, None] - penalty
            stays = sums >= moved
            origin[t] = np.where(stays, own, top[:, None])
            sums = np.where(stays, sums, moved) + grid[t]  # beyond a text's end the scores are 0
        state = sums.argmax(1)
        path = np.zeros((longest, len(group)), np.int16)
        at = np.arange(len(group))
        for t in range(longest - 1, -1, -1):
            path[t] = state
            state = origin[t, at, state]
        for column, i in enumerate(group):
            out[i] = path[: lengths[column], column].astype(np.int64)
    return out


def learn(docs: DataFrame) -> Model:
    """The model of all rows with text and lang.

    Sequences are counted by batch and summed by Spark; a language has
    ``BUCKETS`` counts whatever the table's size, and only these sums come to
    the driver. More than ``MAX_LANGUAGES`` languages raise an error.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            rows: dict[str, list[str]] = {}
            for text, lang in zip(texts_of(batch), batch.column("lang").to_pylist(), strict=True):
                rows.setdefault(lang, []).extend(words_of(text))
            lang, bucket, n = [], [], []
            for name, words in rows.items():
                codes, distinct = pd.factorize(np.array(words, object))
                if not len(distinct):
                    lang.append(name), bucket.append(np.zeros(1, np.int64)), n.append(np.zeros(1, np.int64))
                    continue
                times = np.bincount(codes)
                buckets, sizes = sequences(list(distinct))
                counts = np.bincount(buckets, np.repeat(times, sizes), BUCKETS)
                scripts = np.bincount(script_of(list(distinct)), times * sizes, len(SCRIPTS))
                both = np.r_[counts, scripts].astype(np.int64)
                lang.append(name), bucket.append(np.flatnonzero(both)), n.append(both[both > 0])
            lengths = [len(b) for b in bucket]
            names = pa.array(np.repeat(np.array(lang, object), lengths), pa.string())
            yield pa.RecordBatch.from_arrays([names, pa.array(np.concatenate(bucket)), pa.array(np.concatenate(n))], ["lang", "bucket", "n"])

    rows = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang")
    sums = rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    known = rows.select("lang").distinct().limit(MAX_LANGUAGES + 1).count()
    if known > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages")
    found = sums.toPandas()
    languages = sorted(found.lang.unique())
    counts, letters = np.zeros((len(languages), BUCKETS)), np.zeros((len(languages), len(SCRIPTS)))
    place = {lang: i for i, lang in enumerate(languages)}
    at, bucket, n = found.lang.map(place).to_numpy(np.int64), found.bucket.to_numpy(np.int64), found.n.to_numpy(np.float64)
    deep = bucket < BUCKETS
    counts[at[deep], bucket[deep]] = n[deep]
    letters[at[~deep], bucket[~deep] - BUCKETS] = n[~deep]
    return Model(languages, counts, letters)


def label_batch(texts: list[str], model: Model, penalty: float) -> list[tuple[str, float, list[tuple[str, int, int]]]]:
    """(language, score, spans) of each text; a span is a language, its first word and the word after its last."""
    words = [words_of(text) for text in texts]
    flat = np.array([w for one in words for w in one], object)
    if not len(flat) or not model.languages:
        return [(UNKNOWN, 0.0, [])] * len(texts)
    codes, distinct = pd.factorize(flat)
    letters = np.array([sum(map(str.isalpha, w)) for w in distinct], np.int64)
    scores, known = model.word_scores(list(distinct)), model.read(list(distinct))
    ends = np.cumsum([len(w) for w in words])
    parts = np.split(codes, ends[:-1])
    paths = best_paths([scores[p] for p in parts], penalty)
    out = []
    for part, path in zip(parts, paths, strict=True):
        weight = letters[part] if len(part) else np.zeros(0)
        if not weight.sum():
            out.append((UNKNOWN, 0.0, []))
            continue
        share = np.bincount(path, weight * known[part], len(model.languages)) / weight.sum()
        top = int(share.argmax())
        mine = part[(path == top) & known[part]]
        mean = np.maximum(scores[mine], LEAST_WORD).mean(0, dtype=np.float64) if len(mine) else np.zeros(1)
        sure = 1 / np.exp(mean - mean[top if len(mine) else 0]).sum()
        cuts = np.flatnonzero(np.r_[True, path[1:] != path[:-1]])
        spans = [(model.languages[path[a]], int(a), int(b)) for a, b in zip(cuts, np.r_[cuts[1:], len(path)], strict=True)]
        out.append((model.languages[top], float(share[top] * sure), spans))
    return out


def identify(docs: DataFrame, training: Column | Model, penalty: float = SWITCH_PENALTY, passed: list[str] | None = None) -> DataFrame:
    """Each row with ``lang_pred``, ``score`` and ``spans``.

    The model is learned from the rows where ``training`` holds, unless it is
    given itself. Words (runs of
    letters, in lower case) are scored by the languages that use their script.
    Viterbi's algorithm finds the sequence of languages with the highest sum
    of word scores less ``penalty`` for each change; its runs are the spans.
    lang_pred has the most letters. score is its share of all letters, times
    the probability of an average one of its words under it, over the sum of
    these under all languages: near 1 for plain text of one language, lower
    for mixed text and for words that any language might have. Letters of
    scripts that no language uses are in no share, so a text of these
    alone has score 0. Equal shares go to the language first by name.

    Prediction reads the text alone, without a shuffle. Edge cases: a null
    text, one without letters, or no training rows give ``und`` with score 0
    and no spans. Columns of the new names are replaced, others pass.
    """
    model = training if isinstance(training, Model) else learn(docs.filter(training))
    fresh = ["lang_pred", "score", "spans"]
    own = [c for c in (passed if passed is not None else docs.columns) if c not in fresh]
    rows = docs.select(F.struct(*own).alias("row"), F.col("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("lang", pa.string()), ("first_word", pa.int32()), ("after_word", pa.int32())])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            found = label_batch(texts_of(batch), sent.value, penalty)
            spans = [[dict(zip(("lang", "first_word", "after_word"), s, strict=True)) for s in x[2]] for x in found]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([x[0] for x in found]), pa.array([x[1] for x in found], pa.float64()), pa.array(spans, pa.list_(span))], ["row", *fresh])

    schema = f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double, spans array<struct<lang:string,first_word:int,after_word:int>>"
    return rows.mapInArrow(label, schema).select("row.*", *fresh)


def drop_unidentified(docs: DataFrame) -> DataFrame:
    """The rows whose text has a letter, so that it has a language.

    The languages are learned from the rows with a lang, but for those held
    out. Where no row has one, nothing can be told apart and all rows stay that
    have a letter. Null and empty texts go; repeated rows and null ids are
    judged by their texts.
    """
    model = learn(docs.filter(in_training(F.col("doc_id"), MODULUS, HELD_OUT)))
    if not model.languages:
        return docs.filter(F.regexp_like("text", F.lit(r"\p{L}")))
    return identify(docs, model).filter(F.col("lang_pred") != UNKNOWN).select(docs.columns)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs, in_training(F.col("doc_id"), MODULUS, HELD_OUT), passed=["doc_id"])
    return found.select("doc_id", is_held_out(F.col("doc_id"), MODULUS, HELD_OUT).alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))
