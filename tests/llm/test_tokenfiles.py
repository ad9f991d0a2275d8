"""Seekable token files: round trips against the tokenizer itself, odd rows, damage, partial reads."""

import glob
import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from tokenizers import Tokenizer

from mailsift.llm import queries, tokenfiles

FOLDER = "/root/testdata/sf0.001"
ODD = [
    "", None, " ", "a  b\n\n c ", "x y  z　 w", "<|endoftext|> hi<|endoftext|>", "it's  they'll\t\tgo\n", "\u0085 a", "é à ç  d",
    "中文 字 か な", "  lead", "trail  ", "a\x1c b \x1f c", "😀 😀  x", "x" * 5000 + " " + "y " * 3000, "᠎ a b", "a b   c",
]
TOKENIZER = Tokenizer.from_file(tokenfiles.tokenizer_path())


def plain(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, tokenfiles.END]


def test_segments_encode_as_whole_texts():
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choice("ab é \n 7'., ") for _ in range(rng.randrange(60))) for _ in range(400)]
    encoder = tokenfiles.SegmentEncoder(tokenfiles.tokenizer_path())
    for _ in range(2):
        ids, bounds = encoder.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [plain(t)[:-1] for t in texts]


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokenfiles, "KEPT", 3)
    encoder = tokenfiles.SegmentEncoder(tokenfiles.tokenizer_path())
    for text in ["one two three four five", "five four", "six one two"]:
        assert encoder.encode(pa.array([text]))[0].tolist() == plain(text)[:-1]


@pytest.fixture(scope="module")
def written(spark):
    rows = [(i * 3 - 20, t) for i, t in enumerate(ODD)] + [(None, "no id"), (None, None), (7, "same"), (7, "same"), (7, "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS start", "2 AS packed", "3 AS _hash")
    path = tokenfiles.new_folder(spark)
    tokenfiles.write_tokens(docs.repartition(5), path, shard_bytes=200)
    return path, rows


def test_round_trip(spark, written):
    path, rows = written
    found = sorted(tokenfiles.read_tokens(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x))
    assert [r.start for r in found] == [sum(r.n_tokens for r in found[:i]) for i in range(len(found))]
    ids = lambda r: np.frombuffer(bytes(r.packed), "<u4").tolist()
    key = lambda x: (str(x[0]), x[1])
    assert sorted(((r.doc_id, ids(r)) for r in found), key=key) == sorted(((i, plain(t)) for i, t in rows), key=key)


def test_wanted_documents_only(spark, written):
    path, rows = written
    found = tokenfiles.read_tokens(spark, path, [7, -20, 999]).collect()
    assert sorted(r.doc_id for r in found) == sorted([-20] + [i for i, _ in rows if i == 7])
    whole = {(r.start, bytes(r.packed)) for r in tokenfiles.read_tokens(spark, path).collect()}
    assert {(r.start, bytes(r.packed)) for r in found} <= whole


def test_files_follow_the_public_format(written):
    """A plain Zstandard reader gets all frames of a file and skips the seek table; every shard is a file of its own."""
    files = sorted(glob.glob(f"{written[0].removeprefix('file:')}/part-*"))
    assert len(files) > 1
    for name in files:
        data = open(name, "rb").read()
        shard = tokenfiles.Shard(open(name, "rb"))
        with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True) as reader:
            raw = reader.read()
        assert raw == b"".join(shard.frame(k) for k in range(len(shard.table)))


def test_only_asked_frames_are_read():
    writer = tokenfiles.ShardWriter("<u2")
    for i in range(50):
        writer.add(i, np.arange((i + 1) * 100, dtype="<u2"))
    data = writer.finish() + tokenfiles._FOOTER

    class Counting(io.BytesIO):
        taken = 0

        def read(self, size=-1):
            Counting.taken += size
            return super().read(size)

    shard = tokenfiles.Shard(Counting(data))
    before = Counting.taken
    assert shard.ids(3).tolist() == list(range(400))
    assert Counting.taken - before == shard.table[4]["packed"]


def test_long_documents_take_many_frames(monkeypatch):
    monkeypatch.setattr(tokenfiles, "FRAME_IDS", 10)
    writer = tokenfiles.ShardWriter("<u4")
    for size in (25, 1, 10):
        writer.add(size, np.arange(size))
    shard = tokenfiles.Shard(writer.finish() + tokenfiles._FOOTER)
    assert shard.listed["frames"].tolist() == [3, 1, 1] and [len(shard.ids(k)) for k in range(3)] == [25, 1, 10]


def test_damage_is_seen():
    writer = tokenfiles.ShardWriter("<u2")
    writer.add(1, np.arange(1000))
    data = bytearray(writer.finish() + tokenfiles._FOOTER)
    shard = tokenfiles.Shard(bytes(data))
    data[int(shard.begins[1]) + 30] ^= 1
    with pytest.raises(Exception):
        tokenfiles.Shard(bytes(data)).ids(0)
    with pytest.raises(ValueError):
        tokenfiles.Shard(bytes(data[:-1]) + b"x")


def test_empty_table(spark):
    path = tokenfiles.new_folder(spark)
    tokenfiles.write_tokens(spark.createDataFrame([], "doc_id long, text string"), path)
    assert tokenfiles.read_tokens(spark, path).collect() == []


def test_query_against_brute_force(spark):
    rows = sorted(spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect())
    want, start = {}, 0
    for doc_id, text in rows:
        ids = plain(text)
        want[doc_id] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    found = queries.QUERIES["op11_token_files"](spark, FOLDER).collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in found} == want and len(found) == len(rows)
