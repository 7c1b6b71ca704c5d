"""Merge-type subword encoding by a table of each prefix's last token."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelattice.llm.common import BATCH_BYTES, table, text_batches, texts_of

SPACE = "▁"
CACHED_CHUNKS = 400_000
CACHED_PAIRS = 500_000
LONGEST_CACHED = 48
NEVER = float("-inf")


class PrefixTable:
    """Encodes and decodes with a vocabulary of pieces, merge scores and byte pieces.

    ``pieces``, ``scores`` and ``kinds`` are lists by id; a kind is "normal",
    "byte" or "other". Merging always takes the pair whose joined piece has the
    highest score, the leftmost of equals. For such merging the encoding of a
    prefix ends in one certain token: the one that is a piece, and that is
    compatible with the last token of the prefix before it, in the sense that
    the two merge to themselves when they stand alone. An automaton over the
    pieces finds the pieces that end at each place.
    """

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[str], parts: dict[str, tuple[str, str]] | None = None):
        self.pieces = pieces
        self.score = {p: s for p, s, k in zip(pieces, scores, kinds, strict=True) if k == "normal"}
        self.id = {p: i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == "normal"}
        self.byte_id = {int(p[3:-1], 16): i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == "byte"}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.plain = [None if i in self.byte_of else p.replace(SPACE, " ") for i, p in enumerate(pieces)]
        self.runs = {len(p) for p in self.score if p.strip(SPACE) == ""}
        words = [p for p in self.score if p.strip(SPACE)]
        if len({self.score[p] for p in words}) < len(words):
            raise ValueError("pieces that aren't blanks need scores of their own")
        if any(SPACE in p[1:] for p in words):
            raise ValueError("a blank inside a piece: texts can't be cut at blanks")
        lines = "" if any("\n" in p for p in words) else "\n"
        self.chunks = re.compile(f"{SPACE}*[^{SPACE}{lines}]+|{SPACE}+" + "|\n" * bool(lines)).findall
        self.parts = self.last_merges(words) if parts is None else parts
        self.ordered = all(self.score.get(x, 0.0) > self.score[p] for p, two in self.parts.items() for x in two if len(x) > 1)
        self.spines: dict[tuple[str, int], list[tuple[str, float]]] = {}
        self.automaton = ahocorasick.Automaton()
        for piece in words:
            if len(piece) == 1 or piece in self.parts:
                self.automaton.add_word(piece, piece)
        self.automaton.add_word(SPACE, SPACE)
        self.automaton.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}
        #: Ids of chunks that decode to themselves, and the decoded texts of the others of the text at hand.
        self.known: dict[str, str] = {}
        self.odd: dict[str, str] = {}

    def last_merges(self, words: list[str]) -> dict[str, tuple[str, str]]:
        """The two parts from which each piece is made at last; none for one that merging never makes."""
        twos = {p: self.merged(p, 2) for p in words if len(p) > 1}
        return {p: tuple(two) for p, two in twos.items() if len(two) == 2 and self.merged(p) == [p]}

    def merged(self, text: str, until: int = 1) -> list[str]:
        """Plain merging, for a piece or two, until so many parts are left."""
        parts = list(text)
        while len(parts) > until:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: str, right: str) -> bool:
        """Whether no merge across the border comes before those inside."""
        if not self.ordered:
            return self.merged(left + right) == [left, right]
        joined, i, j = self.score, 0, 0
        ends, starts = self.spine(left, -1), self.spine(right, 0)
        while True:
            (a, a_ends), (b, b_ends) = ends[i], starts[j]
            across = joined.get(a + b)
            if across is not None and across > a_ends and across >= b_ends:
                return False
            if a_ends >= b_ends:
                if a_ends == NEVER:
                    return True
                i += 1
            else:
                j += 1

    def spine(self, piece: str, side: int) -> list[tuple[str, float]]:
        """What stands at one end of ``piece`` while it is merged, each with the score at which it ends."""
        known = self.spines.get((piece, side))
        if known is None:
            known = [(piece, NEVER)]
            while (parts := self.parts.get(known[0][0])) is not None:
                known.insert(0, (parts[side], self.score[known[0][0]]))
            if len(piece) > 1 or piece in self.score:
                self.spines[piece, side] = known
        return known

    def blank_run(self, length: int) -> list[str]:
        """Blanks merge last and at equal scores, so from the left."""
        stack: list[int] = []
        for _ in range(length):
            stack.append(1)
            while len(stack) > 1 and stack[-2] + stack[-1] in self.runs:
                stack[-2:] = [stack[-2] + stack[-1]]
        return [SPACE * n for n in stack]

    def tokens(self, chunk: str) -> list[str]:
        word = chunk.lstrip(SPACE)
        blanks = len(chunk) - len(word)
        if not word:
            return self.blank_run(blanks)
        text = (SPACE if blanks else "") + word
        last: list[str] = []
        pairs, done = self.pairs, 0
        for end, piece in self.automaton.iter(text):
            if end < done:
                continue
            while done < end:  # no piece has it: a token of its own
                last.append(text[done])
                done += 1
            before = end - len(piece)
            if before >= 0:
                key = last[before], piece
                fits = pairs.get(key)
                if fits is None:
                    if len(pairs) >= CACHED_PAIRS:
                        pairs.clear()
                    fits = pairs[key] = self.compatible(*key)
                if not fits:
                    continue
            last.append(piece)
            done += 1
        last.extend(text[done:])
        back, at = [], len(text)
        while at:
            back.append(last[at - 1])
            at -= len(back[-1])
        if blanks > 1:
            alone = back[-1] == SPACE
            back[len(back) - alone :] = reversed(self.blank_run(blanks - 1 + alone))
        return back[::-1]

    def ids(self, chunk: str) -> list[int]:
        tokens = self.tokens(chunk)
        found = [self.id.get(token) for token in tokens]
        if None not in found:
            return found
        return [i for token, known in zip(tokens, found, strict=True) for i in ([known] if known is not None else [self.byte_id[b] for b in token.encode()])]

    def decode(self, ids: list[int], first: bool = True) -> str:
        """The text of ``ids``; one blank at its start is the one that encoding put there."""
        out, pending = [self.plain[i] for i in ids], bytearray()
        if None not in out:
            text = "".join(out)
            return text[1:] if first and text[:1] == " " else text
        out = []
        for i in ids:
            if i in self.byte_of:
                pending.append(self.byte_of[i])
                continue
            if pending:
                out.append(pending.decode(errors="replace"))
                pending = bytearray()
            out.append(self.plain[i])
        out.append(pending.decode(errors="replace"))
        text = "".join(out)
        return text[1:] if first and text[:1] == " " else text

    def learn(self, chunk: str) -> str:
        """The ids of ``chunk``, joined by commas; what they decode to is kept in ``odd`` if it isn't the chunk itself."""
        ids = self.ids(chunk)
        found, decoded = ",".join(map(str, ids)), self.decode(ids, first=False)
        if decoded != chunk.replace(SPACE, " "):
            self.odd[chunk] = decoded
        elif len(chunk) <= LONGEST_CACHED:
            if len(self.known) >= CACHED_CHUNKS:
                self.known.clear()
            self.known[chunk] = found
        return found

    def encode(self, text: str) -> tuple[int, str, str]:
        """Number of ids, the ids joined by commas, and the text that they decode to. A chunk never holds part of a byte sequence."""
        if not text:
            return 0, "", ""
        known, learn, self.odd = self.known.get, self.learn, {}
        chunks = self.chunks(SPACE + text.replace(" ", SPACE))
        joined = ",".join([known(c) or learn(c) for c in chunks])
        decoded = [self.odd.get(c, c) for c in chunks] if self.odd else chunks
        return joined.count(",") + 1, joined, "".join(decoded).replace(SPACE, " ")[1:]


def vocabulary(path: str) -> tuple[list[str], list[float], list[str]]:
    """Pieces, scores and kinds by id from a sentencepiece model file of the merge type.

    The file must leave texts as they are but for blanks, put one blank before
    them, and have a piece for each byte.
    """
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    rules = model.normalizer_spec
    if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix or model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback:
        raise ValueError(f"{path}: not a model that keeps texts and merges pieces")
    kinds = {1: "normal", 6: "byte"}
    if any(p.type in (4, 5) for p in model.pieces):
        raise ValueError(f"{path}: user-defined or unused pieces")
    return [p.piece for p in model.pieces], [p.score for p in model.pieces], [kinds.get(p.type, "other") for p in model.pieces]


_TABLES: dict[int, PrefixTable] = {}


def encode_texts(docs: DataFrame, model_path: str, keep_text: bool = False, passed: list[str] | None = None) -> DataFrame:
    """Each row with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``; ``ids`` and
    ``decoded`` too if ``keep_text``.

    Rows are independent, so there is no shuffle. The vocabulary is read on the
    driver and sent with the function: its size is that of the model file. Every
    Python worker remembers at most ``CACHED_CHUNKS`` chunks between blanks and
    ``CACHED_PAIRS`` pairs of pieces.

    Edge cases: a null or empty text has no ids and decodes to the empty text.
    Long texts without a blank are one chunk, encoded in time that grows with
    their length. ``passed`` are the columns to return before the new ones
    (all, if not given); columns of the new names are replaced.
    """
    fresh = ["n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if keep_text else [])]
    own = [c for c in (passed if passed is not None else docs.columns) if c not in fresh]
    rows = docs.select(F.struct(*own).alias("row"), F.col("text"))
    found = [*vocabulary(model_path)]
    found.append(PrefixTable(*found).parts)
    key = hash((tuple(found[0]), tuple(found[1])))
    kinds = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string", "ids": "string", "decoded": "string"}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _TABLES:
            _TABLES.clear()
            _TABLES[key] = PrefixTable(*found)
        known = _TABLES[key]
        for batch in text_batches(batches, limit=BATCH_BYTES):
            done = [known.encode(text) for text in texts_of(batch)]
            sha = lambda column: [hashlib.sha256(x[column].encode()).hexdigest() for x in done]  # noqa: B023, E731
            columns = [batch.column("row"), pa.array([x[0] for x in done], pa.int64()), pa.array(sha(1)), pa.array(sha(2))]
            if keep_text:
                columns += [pa.array([x[i] for x in done], pa.string()) for i in (1, 2)]
            yield pa.RecordBatch.from_arrays(columns, ["row", *fresh])

    schema = f"row {rows.schema['row'].dataType.simpleString()}, " + ", ".join(f"{c} {kinds[c]}" for c in fresh)
    return rows.mapInArrow(encode, schema).select("row.*", *fresh)


def model_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op10_subword_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"), model_path(), passed=["doc_id"])
