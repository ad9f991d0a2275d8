"""SentencePiece models on the tokenizers library.

The model file is protobuf; its pieces, scores, types, normaliser settings and byte fallback are read from the wire
format and rebuilt as a ``tokenizers`` model: unigram scores as they are, or for a BPE model the merges that the
piece scores imply. Texts are marked with the metaspace and cut before every run of marks; that is exact when no
piece holds a mark after another character, which is checked, otherwise the whole text is one segment. A worker remembers
the ids of segments, which it encodes in multithreaded batches. Every row is then checked whole: the sentencepiece library encodes
its text (parity) and decodes its ids (round trip; the tokenizers library does where nothing is verified). Memory is bounded by ``KEPT`` segments and one
piece of texts.

Nulls, empties, repeats: a null or empty text has no ids, parity and a round trip. A text that itself holds the
metaspace character decodes to a space there, so its round trip is false. Every row is encoded and checked, very long
texts whole, repeated rows alike. An empty table gives no rows. Extra columns are ignored, or kept where asked.
"""

from __future__ import annotations

import gc
import os
import struct
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from mailsift.llm.words import in_small_batches, pieces, text_buffer, tidy

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
THREADS = 2
#: Distinct segments a worker keeps.
KEPT = 100_000
#: New segments that are encoded and checked together.
TOGETHER = 8192
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def wire_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message: integers, or bytes for the rest."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield key >> 3, data[at : at + size]
        at += size


@dataclass
class PieceModel:
    """What a model file says. Field numbers below are those of the public message definition."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    unigram: bool = True
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True

    @classmethod
    def parse(cls, data: bytes) -> PieceModel:
        model = cls()
        for number, value in wire_fields(data):
            if number == 1:
                entry = dict(wire_fields(value))
                score = struct.unpack("<f", entry[2])[0] if 2 in entry else 0.0
                model.pieces.append((entry.get(1, b"").decode(), score, entry.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(wire_fields(value))
                model.unigram, model.byte_fallback = trainer.get(3, 1) == 1, bool(trainer.get(35, 0))
            elif number == 3:
                rules = dict(wire_fields(value))
                model.charsmap = rules.get(2, b"")
                model.dummy_prefix, model.squeeze = bool(rules.get(3, 1)), bool(rules.get(4, 1))
        return model

    @property
    def unknown_id(self) -> int | None:
        return next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), None)

    @property
    def separable(self) -> bool:
        """Whether no piece crosses the place before a run of marks."""
        return not any(MARK in text.lstrip(MARK) for text, _, kind in self.pieces if kind in (NORMAL, USER_DEFINED))

    def merges(self) -> list[tuple[str, str]]:
        """Pairs that form a piece, best piece first; a piece's splits are tried from the shortest left part on."""
        scores = {text: (-score, i) for i, (text, score, kind) in enumerate(self.pieces) if kind in (NORMAL, USER_DEFINED, UNUSED)}
        ranked = []
        for text, rank in scores.items():
            for cut in range(1, len(text)):
                left, right = text[:cut], text[cut:]
                if left in scores and right in scores:
                    ranked.append((rank, cut, left, right))
        return [(left, right) for _, _, left, right in sorted(ranked)]

    def tokenizer(self):
        """The model without its normaliser: input is marked text."""
        from tokenizers import Tokenizer, decoders, models

        if self.unigram:
            core = models.Unigram([(text, score) for text, score, _ in self.pieces], unk_id=self.unknown_id, byte_fallback=self.byte_fallback)
        else:
            unknown = self.pieces[self.unknown_id][0] if self.unknown_id is not None else None
            core = models.BPE(
                vocab={text: i for i, (text, _, _) in enumerate(self.pieces)}, merges=self.merges(), unk_token=unknown,
                fuse_unk=True, byte_fallback=self.byte_fallback,
            )
        made = Tokenizer(core)
        made.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
        return made

    def normalizer(self):
        """The character map and the squeezing of spaces; None when texts stay as they are."""
        from tokenizers import Regex, normalizers

        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.squeeze:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        return normalizers.Sequence(steps) if steps else None


@contextmanager
def without_cycle_search():
    """Many short lists of numbers and strings are made inside; searching them for cycles again and again finds none."""
    was_on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was_on:
            gc.enable()


class Encoder:
    """Encodes texts segment by segment and remembers segments."""

    def __init__(self, data: bytes, threads: int = THREADS, verify: bool = True) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        self.model = PieceModel.parse(data)
        self.tokenizer, self.normalizer = self.model.tokenizer(), self.model.normalizer()
        self.separable = self.model.separable
        self.byte_piece = np.array([kind == BYTE for _, _, kind in self.model.pieces])
        written = [bytes([int(text[3:5], 16)]) if kind == BYTE else text.encode() for text, _, kind in self.model.pieces]
        self.piece_sizes = np.array(list(map(len, written)), np.int64)
        self.piece_starts = np.cumsum(self.piece_sizes) - self.piece_sizes
        self.piece_bytes = np.frombuffer(b"".join(written), np.uint8)
        self.reference = None
        if verify:
            import sentencepiece

            self.reference = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.model.pieces = []  # all that was needed of them is built
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.ids: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []

    def segments(self, text: str) -> list[str]:
        """Segments of a text, each without its first mark."""
        if self.normalizer is not None:
            text = self.normalizer.normalize_str(text)
        if not text:
            return []
        marked = text.replace(" ", MARK)
        if not self.separable or not self.model.dummy_prefix:
            return [marked]
        parts = marked.split(MARK)
        if "" not in parts:
            return parts
        out, run = [], 0
        for part in parts[:-1]:
            if part:
                out.append(MARK * run + part)
                run = 0
            else:
                run += 1
        return [*out, MARK * run + parts[-1]]

    def learn(self, fresh: list[str]) -> None:
        """Encodes new segments."""
        first = MARK if self.model.dummy_prefix else ""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast([first + segment for segment in fresh], add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self.ids.append(np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum())))
        self.sizes.append(sizes)

    def checked(self, texts: list[str], ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """(parity, round trip) of whole texts: the reference's ids are the same, and decoding gives the text back."""
        flat, cuts = ids.tolist(), bounds.tolist()
        rows = [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
        fine = np.ones((len(texts), 2), bool)
        if self.reference is not None:
            fine[:, 0] = [a == b for a, b in zip(self.reference.encode(texts, num_threads=1), rows)]
        wanted = texts if self.normalizer is None else map(self.normalizer.normalize_str, texts)
        back = self.decode(rows) if self.reference is None else self.reference.decode(rows, num_threads=1)
        fine[:, 1] = [MARK not in text and a == b for text, a, b in zip(texts, back, wanted)]
        return fine

    def spelled(self, flat: np.ndarray, sizes: np.ndarray, marked: list[str]) -> np.ndarray:
        """For each text of marked words whether the bytes of its ``sizes`` ids are its own."""
        data, offsets = text_buffer(pa.array(marked, pa.large_string()))
        length = self.piece_sizes[flat]
        ends = np.concatenate([[0], np.cumsum(length)])
        bytes_back = np.diff(ends[np.concatenate([[0], np.cumsum(sizes)])])
        fits = bytes_back == np.diff(offsets)
        source = np.arange(ends[-1]) + np.repeat(self.piece_starts[flat] - ends[:-1], length)
        back = self.piece_bytes[source][np.repeat(fits, bytes_back)]
        wrong = np.concatenate([[0], np.cumsum(back != data[np.repeat(fits, np.diff(offsets))])])
        cuts = np.concatenate([[0], np.cumsum(np.where(fits, bytes_back, 0))])
        return fits & (np.diff(wrong[cuts]) == 0)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, the bounds of each text, and (parity, round trip) of each text."""
        if len(self.number) > KEPT:
            self.forget()
        number, fresh, listed, per_text = self.number, [], [], np.zeros(len(texts), np.int64)
        with without_cycle_search():
            for at, text in enumerate(texts):
                found = self.segments(text)
                per_text[at] = len(found)
                for segment in found:
                    if segment not in number:
                        number[segment] = len(number)
                        fresh.append(segment)
                listed.append(np.fromiter(map(number.__getitem__, found), np.int64, len(found)))
            for first in range(0, len(fresh), TOGETHER):
                self.learn(fresh[first : first + TOGETHER])
        if not number:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64), np.ones((len(texts), 2), bool)
        for store in (self.ids, self.sizes):
            if len(store) > 1:
                store[:] = [np.concatenate(store)]
        ids, sizes = self.ids[0], self.sizes[0]
        starts = np.cumsum(sizes) - sizes
        which = np.concatenate(listed)
        length = sizes[which]
        ends = np.cumsum(length)
        source = np.arange(int(length.sum())) + np.repeat(starts[which] - ends + length, length)
        cuts = np.concatenate([[0], np.cumsum(per_text)])
        bounds = np.concatenate([[0], ends])[cuts]
        found = ids[source]
        with without_cycle_search():
            return found, bounds, self.checked(texts, found, bounds)

    def decode(self, rows: list[list[int]]) -> list[str]:
        texts = self.tokenizer.decode_batch(rows, skip_special_tokens=False)
        return [t[1:] if self.model.dummy_prefix and t.startswith(" ") else t for t in texts]


_made: dict[int, Encoder] = {}


def _encoder(data: bytes, verify: bool) -> Encoder:
    """One encoder per worker process and model."""
    key = hash((data, verify))
    if key not in _made:
        _made.clear()
        _made[key] = Encoder(data, verify=verify)
    return _made[key]


_ADDED = "token_ids array<int>, n_tokens long, n_bytes long, parity boolean, round_trip boolean"


def encode_texts(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), model: str = MODEL, verify: bool = True) -> DataFrame:
    """The ``keep`` columns, token_ids, n_tokens, n_bytes (ids that stand for single bytes), parity and round_trip of every row.

    A ``keep`` column with one of these five names is left out.
    """
    names = [part.split()[0] for part in _ADDED.split(", ")]
    keep = tuple(name for name in keep if name.lower() not in names)
    with open(model, "rb") as file:
        sent = docs.sparkSession.sparkContext.broadcast(file.read())
    rows = in_small_batches(docs).select(*keep, F.col("text").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(sent.value, verify)
        for piece in pieces(batches, "__text"):
            ids, bounds, fine = encoder.encode(pc.fill_null(piece.column("__text"), "").to_pylist())
            single = np.concatenate([[0], np.cumsum(encoder.byte_piece[ids])])[bounds]
            yield pa.RecordBatch.from_arrays(
                [*(piece.column(name) for name in keep),
                 pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids)),
                 pa.array(np.diff(bounds)), pa.array(np.diff(single)), pa.array(fine[:, 0]), pa.array(fine[:, 1])],
                names=[*keep, *names],
            )
        encoder.forget()  # an idle worker holds the model, not what it has learnt

    schema = T.StructType([*rows.drop("__text").schema.fields, *T.StructType.fromDDL(_ADDED).fields])
    return rows.mapInArrow(tidy(run), schema)


def decode_ids(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and text of rows of token ids."""
    with open(model, "rb") as file:
        sent = encoded.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(sent.value, False)
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                some = batch.slice(first, 256)
                rows = [row or [] for row in some.column("token_ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(encoder.decode(rows), pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "token_ids").mapInArrow(tidy(run), "doc_id long, text string")
