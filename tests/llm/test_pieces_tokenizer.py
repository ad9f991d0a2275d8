"""Parity with the sentencepiece library, round trips, and a unigram model made by hand."""

import struct

import pyarrow as pa  # noqa: F401
import pytest
from pyspark.sql import functions as F

from mailsift.llm import pieces_tokenizer as P

TEXTS = ["Hello  world\nfoo", "", " ", "  a  ", " é 日本 \t x", "<s> <unk> <0x0A>", "x" * 3000, "a b a b a b", "\U0001F600 smile", None, "a▁b"]


@pytest.fixture(scope="module")
def reference():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=P.MODEL)


def test_parity_and_round_trip(spark, reference):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumn("n_tokens", F.lit(1))
    encoded = P.encode_texts(docs)
    found = {r.doc_id: r for r in encoded.collect()}
    for i, text in enumerate(TEXTS):
        assert found[i].token_ids == reference.encode(text or ""), text
        assert found[i].parity and found[i].round_trip == ("▁" not in (text or ""))
        assert found[i].n_tokens == len(found[i].token_ids)
    back = {r.doc_id: r.text for r in P.decode_ids(encoded).collect()}
    assert all(back[i] == (text or "") for i, text in enumerate(TEXTS) if "▁" not in (text or ""))
    assert P.encode_texts(docs.filter("false").drop("n_tokens")).collect() == []


def message(*fields):
    out = b""
    for number, value in fields:
        if isinstance(value, bool) or isinstance(value, int):
            out += bytes(varint(number << 3)) + bytes(varint(int(value)))
        elif isinstance(value, float):
            out += bytes(varint(number << 3 | 5)) + struct.pack("<f", value)
        else:
            out += bytes(varint(number << 3 | 2)) + bytes(varint(len(value))) + value
    return out


def varint(n):
    out = []
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return [*out, n]


def test_unigram_model_from_the_wire_format():
    pieces = [("<unk>", 0.0, 2), ("▁ab", -1.0, 1), ("▁a", -2.0, 1), ("b", -2.5, 1), ("▁", -4.0, 1)] + [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)]
    data = b"".join(message((1, message((1, t.encode()), (2, s), (3, k)))) for t, s, k in pieces)
    data += message((2, message((3, 1), (35, True)))) + message((3, message((3, True), (4, False))))
    encoder = P.Encoder(data)
    ids, bounds, fine = encoder.encode(["ab a b", "abb é"])
    assert ids[bounds[0] : bounds[1]].tolist() == encoder.reference.encode("ab a b") and fine.all()
    assert encoder.decode([ids[bounds[1] : bounds[2]].tolist()]) == ["abb é"]


def test_spelling_equals_the_librarys_decoding():
    encoder = P.Encoder(open(P.MODEL, "rb").read())
    marked = ["▁" + t for t in ["hello", "", "\U0001F600é", "日本\n\t", "x" * 500, "\x00\x7f", "▁▁y"]]
    ids = [e.ids for e in encoder.tokenizer.encode_batch(marked, add_special_tokens=False)]
    wrong = ids[1:] + ids[:1]
    for rows in (ids, wrong):
        decoded = encoder.tokenizer.decode_batch(rows, skip_special_tokens=False)
        flat = P.np.array([i for row in rows for i in row], P.np.int32)
        found = encoder.spelled(flat, P.np.array([len(row) for row in rows]), marked)
        assert found.tolist() == [back == text.replace("▁", " ") for back, text in zip(decoded, marked)]
    assert not encoder.spelled(P.np.array([i for row in wrong for i in row], P.np.int32), P.np.array(list(map(len, wrong))), marked).any()


def test_more_new_segments_than_one_round_and_repeated_rows(spark, reference, monkeypatch):
    monkeypatch.setattr(P, "TOGETHER", 3)
    monkeypatch.setattr(P, "KEPT", 5)
    encoder = P.Encoder(open(P.MODEL, "rb").read())
    texts = [" ".join(f"w{i}é{j}" for j in range(i)) for i in range(12)] * 2
    for first in range(0, len(texts), 5):
        some = texts[first : first + 5]
        ids, bounds, fine = encoder.encode(some)
        assert fine.all()
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [reference.encode(t) for t in some]


def test_every_row_is_checked_whole():
    encoder = P.Encoder(open(P.MODEL, "rb").read())
    texts = ["one two", "", "one two", "two  one é", "a▁b"]
    library, asked, decoded = encoder.reference, [], []

    class Reference:
        def encode(self, some, **options):
            asked.extend(some)
            return [ids[:-1] if text == "two  one é" else ids for text, ids in zip(some, library.encode(some, **options))]

        def decode(self, rows, **options):
            decoded.extend(rows)
            return [t.replace("one two", "one") for t in library.decode(rows, **options)]

    encoder.reference = Reference()
    ids, bounds, fine = encoder.encode(texts)
    assert asked == texts and decoded == [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
    assert fine.tolist() == [[True, False], [True, True], [True, False], [False, True], [True, False]]
    encoder.reference = None
    assert encoder.encode(texts)[2].tolist() == [[True, True]] * 4 + [[True, False]]
