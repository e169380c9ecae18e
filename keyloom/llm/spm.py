"""SentencePiece encoding and decoding by a streaming Viterbi search.

The search keeps scores and backpointers of the last boundaries only, as many
as the longest piece has characters: older boundaries can't be extended. Ids
are committed whenever the backpointer paths of all of them meet in one
boundary, so memory doesn't grow with the text.

Where no piece has a space mark after another character, all paths meet
before each space mark; segments between such places are encoded alone and
kept in a bounded cache.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The mark that stands for a space.
MARK = "▁"
#: What a character outside the vocabulary costs below the least score; segments kept, and the longest kept.
UNKNOWN, CACHE, CACHED = 10.0, 800_000, 64
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with ids and scores; ids of the 256 byte pieces; pieces of all ids as bytes, for decoding."""

    ids: dict[str, int]
    scores: dict[str, float]
    bytes_: list[int]
    spelled: list[bytes]

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """Read a .model file with byte pieces, identity normalisation and a space mark before the text; ValueError for others."""
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        n = proto.normalizer_spec
        if n.precompiled_charsmap or n.remove_extra_whitespaces or not n.add_dummy_prefix or not n.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models that leave texts as they are and put a space mark before them can be used")
        m = sentencepiece.SentencePieceProcessor(model_file=path)
        ids, scores, spelled, byte_ids = {}, {}, [], [-1] * 256
        for i in range(m.get_piece_size()):
            piece = m.id_to_piece(i)
            if m.is_byte(i):
                b = int(piece[3:5], 16)
                byte_ids[b] = i
                spelled.append(bytes([b]))
            elif m.is_control(i) or m.is_unknown(i) or m.is_unused(i):
                spelled.append(b"")
            else:
                ids[piece], scores[piece] = i, m.get_score(i)
                spelled.append(piece.replace(MARK, " ").encode())
        if min(byte_ids) < 0:
            raise ValueError("the vocabulary lacks byte pieces, so it can't spell every text")
        return cls(ids, scores, byte_ids, spelled)


class StreamingViterbi:
    """The best-scoring segmentation of a stream of characters.

    Equal scores: the longer last piece. A character that is no piece is
    spelled in bytes, at the least score less UNKNOWN. feed() gives the ids
    that are settled, finish() the rest.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.longest = max(map(len, vocabulary.ids), default=1)
        self.suffixes: dict[str, float | None] = {}  # of pieces; with a score if it is a piece
        for piece, score in vocabulary.scores.items():
            for k in range(1, len(piece)):
                self.suffixes.setdefault(piece[k:], None)
            self.suffixes[piece] = score
        usable = [s for s in vocabulary.scores.values() if s > -1e8]
        self.unknown = min(usable, default=0.0) - UNKNOWN
        self.reset()

    def reset(self) -> None:
        self.text = ""  # what isn't committed
        self.back: list[int] = []  # length of the best last piece at each of its boundaries
        self.window = [0.0]  # scores of the boundaries that a piece may start from, the last being the present one

    def feed(self, characters: str) -> list[int]:
        ids: list[int] = []
        step = 4 * self.longest
        for a in range(0, len(characters), step):
            self._extend(characters[a : a + step])
            if len(self.back) >= step:
                ids += self._commit(self._meeting())
                del self.window[: -self.longest]
        return ids

    def _extend(self, characters: str) -> None:
        suffixes, unknown, window, back = self.suffixes, self.unknown, self.window, self.back
        first = len(self.text) + 1
        text = self.text = self.text + characters
        for end in range(first, len(text) + 1):
            score = suffixes.get(text[end - 1])
            best, length = window[-1] + (unknown if score is None else score), 1
            for k in range(2, end + 1):
                score = suffixes.get(text[end - k : end], "none")
                if score is None:
                    continue
                if score == "none":
                    break
                score += window[-k]
                if score >= best:
                    best, length = score, k
            back.append(length)
            window.append(best)

    def _meeting(self) -> int:
        """The last boundary that the paths of all live boundaries share."""
        back, end = self.back, len(self.back)
        live = set(range(max(0, end - self.longest + 1), end + 1))
        while len(live) > 1:
            last = max(live)
            live.remove(last)
            live.add(last - back[last - 1])
        return live.pop()

    def _commit(self, boundary: int) -> list[int]:
        text, back, own, ids = self.text, self.back, self.v.ids, []
        end = boundary
        while end:
            k = back[end - 1]
            piece = text[end - k : end]
            i = own.get(piece)
            if i is None:
                ids += [self.v.bytes_[b] for b in reversed(piece.encode())]
            else:
                ids.append(i)
            end -= k
        ids.reverse()
        self.text, self.back = text[boundary:], back[boundary:]
        return ids

    def finish(self) -> list[int]:
        out = self._commit(len(self.back))
        self.reset()
        return out


class Encoder(dict):
    """Ids of texts; the dictionary keeps the ids of segments as bytes."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.v, self.search = vocabulary, StreamingViterbi(vocabulary)
        inner = {c for p in vocabulary.ids for c in p}
        parts = any(MARK in p.lstrip(MARK) for p in vocabulary.ids)
        alone = "".join(c for c in "\n\t\r" if c not in inner)
        some = f"[{re.escape(alone)}]|" if alone else ""
        self.segments = None if parts else re.compile(f"{some}{MARK}*[^{MARK}{re.escape(alone)}]+|{MARK}+")

    def __missing__(self, segment: str) -> bytes:
        ids = self.search.feed(segment)
        ids += self.search.finish()
        out = array("i", ids).tobytes()
        if len(segment) <= CACHED:
            if len(self) >= CACHE:
                self.clear()
            self[segment] = out
        return out

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        if MARK in text:  # a literal mark isn't a space: it is spelled in bytes
            spelled = np.array([self.v.bytes_[b] for b in MARK.encode()], np.int32)
            parts, out = text.split(MARK), []
            for k, part in enumerate(parts):
                if k:
                    out.append(spelled)
                if part or not k:
                    out.append(self._marked((MARK if not k else "") + part.replace(" ", MARK)))
            return np.concatenate(out)
        return self._marked(MARK + text.replace(" ", MARK))

    def _marked(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        parts = self.segments.findall(text) if self.segments else [text]
        return np.frombuffer(b"".join(map(self.__getitem__, parts)), np.int32)

    def decode(self, ids: Iterable[int]) -> str:
        out = b"".join(map(self.v.spelled.__getitem__, ids)).decode("utf-8", "replace")
        return out[1:] if out.startswith(" ") else out


def encode(docs: DataFrame, model: str | Vocabulary = DEFAULT_MODEL, text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """Ids of whole texts, and whether they decode to the text again.

    Adds ids (array of int), n_tokens (long) and round_trip (boolean: decoding
    the ids gives the text) to the given columns of docs (None: all); existing
    columns of these names are replaced. The segmentation is the one with the
    greatest sum of the scores in the model file.

    An empty text has no ids; a null text has null ids, no tokens and a null
    round_trip. Rows are independent, so nulls, repeats and ties in other
    columns change nothing. The file is read on the driver and its vocabulary,
    whose size the file fixes, is broadcast.
    """
    vocabulary = model if isinstance(model, Vocabulary) else Vocabulary.load(model)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    outputs = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("round_trip", T.BooleanType())]
    kept = [f for f in docs.schema.fields if f.name not in {o.name for o in outputs} and (columns is None or f.name in columns)]
    names = ["__text" if f.name == text else f"c{i}" for i, f in enumerate(kept)]
    own = docs.select(*[F.col(f.name).alias(n) for n, f in zip(names, kept, strict=True) if n != "__text"], F.col(text).alias("__text"))
    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, kept, strict=True)] + outputs)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                texts = part.column("__text").to_pylist()
                made = [None if t is None else encoder.encode(t) for t in texts]
                same = [None if t is None else encoder.decode(i.tolist()) == t for t, i in zip(texts, made, strict=True)]
                sizes = np.array([0 if i is None else len(i) for i in made], np.int64)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                values = np.concatenate([i for i in made if i is not None] or [np.zeros(0, np.int32)])
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), mask=pa.array([i is None for i in made]))
                yield pa.RecordBatch.from_arrays([part.column(n) for n in names] + [ids, pa.array(sizes), pa.array(same, pa.bool_())], names=schema.names)

    out = own.mapInArrow(rows, schema)
    return out.select(*[F.col(n).alias(f.name) for n, f in zip(names, kept, strict=True)], *[o.name for o in outputs])


def decode(tokens: DataFrame, model: str | Vocabulary = DEFAULT_MODEL, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """tokens with the column `out`: the text of its ids. No ids give the empty text; null ids, and ids that the vocabulary hasn't or a null among them, give null."""
    vocabulary = model if isinstance(model, Vocabulary) else Vocabulary.load(model)
    shared = tokens.sparkSession.sparkContext.broadcast(vocabulary)

    @F.pandas_udf(T.StringType())
    def spell(column):
        encoder = Encoder(shared.value)
        size = len(encoder.v.spelled)
        return column.map(lambda x: None if x is None or any(i is None or i != i or not 0 <= i < size for i in x) else encoder.decode([int(i) for i in x]))

    return tokens.withColumn(out, spell(F.col(ids)))
