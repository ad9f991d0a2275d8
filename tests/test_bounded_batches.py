"""Work on texts is taken apart a bounded piece at a time, whatever the size of a batch."""

import pandas as pd
import pyarrow as pa

from mailsift.functions import hashing
from mailsift.sources import mime

TEXTS = pd.Series(["one two three " * 20_000, None, "", "b a b", *(f"w{i} w{i + 1} x" * 300 for i in range(900))])


def test_pieces_keep_every_text_in_order():
    parts = list(hashing.in_pieces(TEXTS, 5000))
    assert pd.concat(parts).tolist() == TEXTS.tolist() and len(parts) > 100
    assert all(len(part) == 1 or part.str.len().sum() <= 5000 for part in parts)
    assert list(hashing.in_pieces(TEXTS[:0])) == []


def test_hashes_come_in_bounded_pieces():
    frames = list(hashing.hash_ngrams.func(iter([TEXTS])))
    assert len(frames) > 1
    found = pd.concat(frames)
    whole = hashing.ngram_counts(TEXTS)
    assert len(found) == len(whole)
    for row, (buckets, counts) in zip(found.itertuples(index=False), whole):
        assert row.buckets.tolist() == buckets.tolist() and row.counts.tolist() == counts.tolist()
    prints = list(hashing.simhash64.func(iter([TEXTS])))
    assert len(prints) > 1 and pd.concat(prints).tolist() == hashing.simhash_batch(TEXTS).tolist()


def test_messages_are_parsed_in_bounded_pieces(spark):
    raw = [f"From: u{i}@x.example\nSubject: s{i}\n\n".encode() + b"text " * (40 * i) for i in range(60)] + [None, b""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(raw))), pa.array(raw, pa.binary())], names=["email_id", "raw_content"])
    parts = list(mime.in_pieces(batch, "raw_content", 20_000))
    assert len(parts) > 10 and pa.Table.from_batches(parts).column("raw_content").to_pylist() == raw
    assert all(part.num_rows == 1 or sum(len(v or b"") for v in part.column("raw_content").to_pylist()) <= 20_000 for part in parts)
    assert list(mime.in_pieces(batch.slice(0, 0), "raw_content")) == []
    stored = spark.createDataFrame(list(enumerate(raw)), "email_id long, raw_content binary").coalesce(1)
    found = {r.email_id: r for r in mime.parse_messages(stored).collect()}
    assert found[7].sender == "u7@x.example" and found[7].sender_domain == "x.example" and found[7].body_display == ("text " * 280).strip()
    assert len(found) == len(raw) and found[60].subject is None and found[61].body_raw == ""
