"""Token ids of documents in seekable Zstandard files.

Documents are put in ascending doc_id order by range partitions, encoded with a tokenizer of the tokenizers library
and closed with ``END``. A file (``shard``) is a run of consecutive documents in the public seekable format of
Zstandard: independent frames, then a skippable frame with the seek table (compressed size, decompressed size and
checksum of every frame) that ends in the format's magic number. The first frame is the directory: for each document
its id, number of ids and number of frames. Every document has frames of its own, of at most ``FRAME_IDS`` ids, so a
reader decompresses the directory and the asked documents only. Checksums are the low 32 bits of XXH64 over the
decompressed bytes, in the seek table, and again inside each frame; both are verified.

Files go through Spark's text sink, one row a file with the magic number as the line separator, so that any file
system Spark knows can hold them and only committed tasks leave files: a lost executor's files are written again, the
same. (The sink names them ``.txt``.) Readers take Spark's binary file source and never more than a split at a time.

Scale: texts are shuffled once, by range; rows of one id are dealt by text and by a number of their own, so a
repeated id or text is no hot partition. A task holds one shard of ``SHARD_BYTES`` compressed bytes, one piece of texts
and at most ``KEPT`` distinct segments (texts are cut where the tokenizer's own pattern always cuts, before white space
that follows other characters, and each distinct segment is encoded once). Where a document starts is a running sum
over files and needs no order over rows in one task.

Nulls, empties, repeats: a null or empty text has the single id ``END``. A very long text is many frames. A null
doc_id comes first and stays null. Rows that share an id are ordered by their text's hash (ties: equal texts, in any
order) and each keeps an entry; asking for an id gives all its rows. An empty table writes no shard and reads as no
rows. Extra columns, of any name, are ignored.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from mailsift.llm.words import BYTE_CODES, IN_WORD, _powers_for, in_small_batches, mix, pieces, text_buffer, tidy
from mailsift.operators.ordered import running_totals
from mailsift.session import cut_lineage, ensure_checkpoint_dir

END = 0
LEVEL = 3
#: Ids in one frame at most, compressed bytes of a shard after which the next one begins.
FRAME_IDS = 1 << 20
SHARD_BYTES = 16 << 20
#: Distinct segments a worker keeps, and the longest that is worth keeping.
KEPT = 1 << 20
LONGEST = 64
#: Fresh segments are handed to the tokenizer in chains of about this many bytes.
CHAIN_BYTES = 1 << 16
THREADS = 2

# Fixed values of the seekable format: magic of the skippable frame and of the footer, flag of checksums.
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
WITH_CHECKSUMS = 0x80

_FOOTER = struct.pack("<I", SEEKABLE)
_ENTRY = np.dtype([("packed", "<u4"), ("raw", "<u4"), ("check", "<u4")])
_LISTED = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("ids", "<u8"), ("frames", "<u4")])


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def segments(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, text offsets, and starts, ends and codes of the segments of all texts.

    A segment begins where white space follows a character that is not; characters of three bytes that could be
    white space count as such, which only makes a segment longer.
    """
    data, offsets = text_buffer(texts)
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return data, offsets, none, none, np.zeros(0, np.uint64)
    back = lambda k: np.concatenate([np.zeros(min(k, n), np.uint8), data[: max(n - k, 0)]])
    last, second, third = back(1), back(2), back(3)
    plain = (last < 0x80) & IN_WORD[last]
    two = (last >= 0x80) & (second >= 0xC3) & (second < 0xE0)
    three = (last >= 0x80) & (second >= 0x80) & (second < 0xC0) & ((third == 0xE0) | ((third >= 0xE4) & (third < 0xF0)))
    begins = ~IN_WORD[data] & (plain | two | three)
    begins[offsets[:-1][offsets[:-1] < n]] = True
    starts = np.flatnonzero(begins)
    ends = np.append(starts[1:], n)
    forth, inverse = _powers_for(n)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_CODES[data] * forth[:n], out=total[1:])
        codes = mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    return data, offsets, starts, ends, codes


def _runs(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Numbers ``at[i], at[i] + 1, ...``, ``size[i]`` of them for every i."""
    stop = np.cumsum(size)
    return np.arange(int(size.sum())) + np.repeat(at - stop + size, size)


class SegmentEncoder:
    """Encodes batches of texts; each distinct segment once, as long as it is remembered."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        total = self.tokenizer.get_vocab_size()
        self.width = np.dtype("<u2" if total <= 1 << 16 else "<u4")
        added = self.tokenizer.get_added_tokens_decoder()
        # A byte-level piece has one character a byte, an added token is plain text.
        self.bytes_of = np.array(
            [len(added[i].content.encode()) if i in added else len(self.tokenizer.id_to_token(i) or "") for i in range(total)], np.int64
        )
        self.forget()

    def forget(self) -> None:
        self.codes = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)
        self.ids = np.zeros(0, self.width)

    def _tokenize(self, texts: list[bytes]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        return [np.array(e.ids, self.width) for e in found]

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number of each segment. Segments from inside a text begin with white space and end without,
        so the tokenizer cuts a chain of them into the same ids; others are encoded one by one."""
        sizes = np.zeros(len(starts), np.int64)
        parts, order = [], []
        chain = np.flatnonzero(inner)
        length = (ends - starts)[chain]
        links = np.split(chain, np.flatnonzero(np.diff(np.cumsum(length) // CHAIN_BYTES)) + 1) if len(chain) else []
        for link, ids in zip(links, self._tokenize([data[_runs(starts[k], (ends - starts)[k])].tobytes() for k in links])):
            stop = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum((ends - starts)[link]), "left") + 1
            sizes[link] = np.diff(stop, prepend=0)
            parts.append(ids)
            order.append(link)
        alone = np.flatnonzero(~inner)
        for k, ids in zip(alone, self._tokenize([data[starts[k] : ends[k]].tobytes() for k in alone])):
            sizes[k] = len(ids)
            parts.append(ids)
        order = np.concatenate([*order, alone]).astype(np.int64)
        at = np.zeros(len(starts), np.int64)
        at[order] = np.cumsum(sizes[order]) - sizes[order]
        ids = np.concatenate([np.zeros(0, self.width), *parts])
        return ids[_runs(at, sizes)], sizes

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts without end ids, and the bounds of each text in them."""
        data, offsets, starts, ends, codes = segments(texts)
        if len(self.codes) > KEPT:
            self.forget()
        asked, first, which = np.unique(codes, return_index=True, return_inverse=True)
        place = np.searchsorted(self.codes, asked)
        known = np.zeros(len(asked), bool)
        inside = place < len(self.codes)
        known[inside] = self.codes[place[inside]] == asked[inside]
        fresh = np.flatnonzero(~known)
        begin, end = starts[first[fresh]], ends[first[fresh]]
        inner = ~np.isin(begin, offsets) & ~np.isin(end, offsets)
        ids, sizes = self._learn(data, begin, end, inner)
        # Where each asked segment's ids lie: among the kept ones, or behind them among the fresh ones.
        pool = np.concatenate([self.ids, ids])
        at, size = np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64)
        at[known], size[known] = self.at[place[known]], self.sizes[place[known]]
        at[fresh], size[fresh] = len(self.ids) + np.cumsum(sizes) - sizes, sizes
        short = end - begin <= LONGEST
        kept = fresh[short]
        self.at = np.insert(self.at, place[kept], len(self.ids) + np.cumsum(sizes[short]) - sizes[short])
        self.ids = np.concatenate([self.ids, ids[np.repeat(short, sizes)]])
        self.sizes = np.insert(self.sizes, place[kept], sizes[short])
        self.codes = np.insert(self.codes, place[kept], asked[kept])
        length = size[which]
        bounds = np.concatenate([[0], np.cumsum(length)])[np.searchsorted(starts, offsets, "left")]
        return pool[_runs(at[which], length)], bounds


_made: dict[str, SegmentEncoder] = {}


def _encoder(path: str) -> SegmentEncoder:
    """One encoder per worker process and tokenizer."""
    if path not in _made:
        _made.clear()
        _made[path] = SegmentEncoder(path)
    return _made[path]


class ShardWriter:
    """Builds one shard after another; the file's last four bytes are left to the sink."""

    def __init__(self, width: str, level: int = LEVEL) -> None:
        import zstandard

        self.width = np.dtype(width)
        self.packer = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self._begin()

    def _begin(self) -> None:
        self.frames: list[bytes] = []
        self.entries: list[tuple[int, int, int]] = []
        self.listed: list[tuple[int, int, int, int]] = []
        self.size = 0

    def _frame(self, raw: bytes) -> bytes:
        import xxhash

        packed = self.packer.compress(raw)
        self.entries.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        return packed

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        ids = ids.astype(self.width, copy=False)
        cuts = range(0, len(ids), FRAME_IDS)
        for first in cuts:
            self.frames.append(self._frame(ids[first : first + FRAME_IDS].tobytes()))
            self.size += len(self.frames[-1])
        self.listed.append((doc_id or 0, doc_id is not None, len(ids), len(cuts)))

    def finish(self) -> bytes:
        """The shard so far without its last four bytes; begins the next one."""
        entries, self.entries = self.entries, []
        directory = self._frame(bytes([self.width.itemsize]) + np.array(self.listed, _LISTED).tobytes())
        table = np.array([*self.entries, *entries], _ENTRY).tobytes()
        footer = struct.pack("<IB", len(entries) + 1, WITH_CHECKSUMS)
        head = struct.pack("<II", SKIPPABLE, len(table) + len(footer) + len(_FOOTER))
        shard = b"".join([directory, *self.frames, head, table, footer])
        self._begin()
        return shard


class Shard:
    """Reads a shard from its bytes or any file that can seek; only asked frames are decompressed."""

    def __init__(self, source) -> None:
        import io

        import zstandard

        self.file = io.BytesIO(source) if isinstance(source, (bytes, memoryview)) else source
        self.unpacker = zstandard.ZstdDecompressor()
        size = self.file.seek(0, os.SEEK_END)
        count, flags, magic = struct.unpack("<IBI", self._bytes(size - 9, 9))
        if magic != SEEKABLE or flags != WITH_CHECKSUMS:
            raise ValueError("not a seekable file with checksums")
        self.table = np.frombuffer(self._bytes(size - 9 - count * _ENTRY.itemsize, count * _ENTRY.itemsize), _ENTRY)
        self.begins = np.concatenate([[0], np.cumsum(self.table["packed"].astype(np.int64))])
        head = struct.unpack("<II", self._bytes(int(self.begins[-1]), 8))
        if head != (SKIPPABLE, len(self.table) * _ENTRY.itemsize + 9):
            raise ValueError("the seek table does not follow the frames")
        directory = self.frame(0)
        self.width = np.dtype(f"<u{directory[0]}")
        self.listed = np.frombuffer(directory, _LISTED, offset=1)
        self.first_frame = 1 + np.cumsum(self.listed["frames"].astype(np.int64)) - self.listed["frames"]
        self.starts = np.cumsum(self.listed["ids"].astype(np.int64)) - self.listed["ids"].astype(np.int64)

    def _bytes(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def frame(self, number: int) -> bytes:
        import xxhash

        entry = self.table[number]
        raw = self.unpacker.decompress(self._bytes(int(self.begins[number]), int(entry["packed"])))
        if len(raw) != entry["raw"] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != entry["check"]:
            raise ValueError(f"frame {number} is damaged")
        return raw

    def ids(self, row: int) -> np.ndarray:
        """Ids of the document in this row of the directory."""
        first = int(self.first_frame[row])
        return np.frombuffer(b"".join(self.frame(k) for k in range(first, first + int(self.listed["frames"][row]))), self.width)


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end: int = END, shard_bytes: int = SHARD_BYTES) -> None:
    """Writes the ids of all documents to seekable files under ``path``, in ascending doc_id order."""
    place = tokenizer or tokenizer_path()
    rows = in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keyed = rows.withColumns({"_hash": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    ordered = keyed.repartitionByRange("doc_id", "_hash", "_row").sortWithinPartitions("doc_id", "_hash", "_row").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(place)
        writer = ShardWriter(encoder.width)
        made = lambda: pa.RecordBatch.from_arrays([pa.array([writer.finish()], pa.binary())], names=["shard"])
        for piece in pieces(batches):
            ids, bounds = encoder.encode(piece.column("text"))
            for doc_id, first, last in zip(piece.column("doc_id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                writer.add(doc_id, np.append(ids[first:last], encoder.ids.dtype.type(end)))
                if writer.size >= shard_bytes:
                    yield made()
        if writer.listed:
            yield made()

    shards = ordered.mapInArrow(tidy(run), "shard binary").select(F.col("shard").cast("string").alias("value"))
    options = {"lineSep": _FOOTER.decode("latin-1"), "encoding": "ISO-8859-1", "maxRecordsPerFile": "1", "compression": "none"}
    shards.write.options(**options).text(path)


def _order(path: str) -> list:
    """Sort keys of a file: its task, then its number within the task."""
    name = F.regexp_extract(path, r"part-(\d+)-.*?-c(\d+)[^/]*$", 1), F.regexp_extract(path, r"part-(\d+)-.*?-c(\d+)[^/]*$", 2)
    return [part.cast("long") for part in name]


def _contents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).filter("length > 0")


def _shard_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total = [int(Shard(content).listed["ids"].sum()) for content in batch.column("content").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(total, pa.int64())], names=["path", "total"])


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """path and start of every shard: the ids of all shards before it."""
    totals = _contents(spark, path).select("path", "content").mapInArrow(tidy(_shard_totals), "path string, total long")
    task, number = _order("path")
    keyed = cut_lineage(totals.select("path", "total", task.alias("task"), number.alias("number")))
    return running_totals(keyed, {"start": F.col("total")}, ["task", "number"], inclusive=False).select("path", "start")


def read_tokens(spark: SparkSession, path: str, wanted: list[int] | None = None) -> DataFrame:
    """doc_id, start, n_tokens and packed (ids as little-endian unsigned 32-bit integers) of all or the wanted documents.

    ``wanted`` is a list of ids to look up: of each shard, its directory and their frames are decompressed.
    """
    asked = None if wanted is None else np.unique(np.array(wanted, np.int64))
    rows = _contents(spark, path).select("path", "content").join(shard_starts(spark, path).withColumnRenamed("start", "base"), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, base in zip(batch.column("content"), batch.column("base").to_pylist()):
                shard = Shard(memoryview(content.as_buffer()))
                known = shard.listed["known"].astype(bool)
                chosen = np.arange(len(known)) if asked is None else np.flatnonzero(known & np.isin(shard.listed["doc_id"], asked))
                for some in np.array_split(chosen, len(chosen) // 256 + 1):
                    if len(some):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(shard.listed["doc_id"][some], mask=~known[some]), pa.array(base + shard.starts[some]),
                             pa.array(shard.listed["ids"][some].astype(np.int64)),
                             pa.array([shard.ids(row).astype("<u4").tobytes() for row in some], pa.large_binary()).cast(pa.binary())],
                            names=["doc_id", "start", "n_tokens", "packed"],
                        )

    return rows.select("content", "base").mapInArrow(tidy(run), "doc_id long, start long, n_tokens long, packed binary")


def new_folder(spark: SparkSession) -> str:
    """A folder of its own in the shared folder of the cluster."""
    return f"{ensure_checkpoint_dir(spark)}/tokens/{uuid.uuid4().hex}"
