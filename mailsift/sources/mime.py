"""Headers and body text of raw messages, parsed batch-wise with the standard library."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timezone
from email import message_from_bytes
from email.header import decode_header, make_header
from email.message import Message
from email.utils import getaddresses, parsedate_to_datetime
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from mailsift.functions.text import domain_of

PARSED = (
    "sender string, recipients string, subject string, received_at timestamp, auth_results string, "
    "reply_to string, body_raw string, body_display string"
)
#: Bytes of raw messages that a worker parses together.
PIECE_BYTES = 1 << 20
_TAG = re.compile(r"<[^>]*>")


def _joined(message: Message, name: str) -> str | None:
    values = message.get_all(name)
    text = ", ".join(str(v) for v in values) if values else ""
    return text if text.strip() else None


def _guarded(read, message: Message):
    """A malformed field is null; it never fails the row."""
    try:
        return read(message)
    except Exception:
        return None


def _sender(message: Message) -> str | None:
    found = getaddresses([str(v) for v in message.get_all("From", [])])
    return (found[0][1] or None) if found else None


def _subject(message: Message) -> str | None:
    value = message.get("Subject")
    text = str(make_header(decode_header(value))) if value is not None else ""
    return text if text.strip() else None


def _date(message: Message):
    value = message.get("Date")
    if value is None:
        return None
    moment = parsedate_to_datetime(str(value))
    return moment.replace(tzinfo=timezone.utc) if moment.tzinfo is None else moment.astimezone(timezone.utc)


def _bodies(message: Message) -> tuple[str, str]:
    raw, shown = [], []
    for part in message.walk():
        kind = part.get_content_type()
        if kind not in ("text/plain", "text/html"):
            continue
        payload = part.get_payload(decode=True)
        if payload is None:
            continue
        try:
            text = payload.decode(part.get_content_charset() or "utf-8", errors="replace")
        except LookupError:
            text = payload.decode("utf-8", errors="replace")
        raw.append(text + "\n")
        shown.append((_TAG.sub(" ", text) if kind == "text/html" else text) + "\n")
    return "".join(raw), "".join(shown).strip()


def _parse(content: bytes | None) -> tuple:
    if not content:
        return (None, None, None, None, None, None, "", "")
    message = message_from_bytes(bytes(content))
    raw, shown = _guarded(_bodies, message) or ("", "")
    return (
        _guarded(_sender, message), _guarded(lambda m: _joined(m, "To"), message), _guarded(_subject, message),
        _guarded(_date, message), _guarded(lambda m: _joined(m, "Authentication-Results"), message),
        _guarded(lambda m: _joined(m, "Reply-To"), message), raw, shown,
    )


def in_pieces(batch: pa.RecordBatch, content: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in order, at most ``limit`` bytes of content (or one row) at a time."""
    total = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(content)), 0)).astype(np.int64))
    first = 0
    while first < batch.num_rows:
        before = total[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(total, before + limit, "right")))
        yield batch.slice(first, last - first)
        first = last


def parse_messages(messages: DataFrame, content: str = "raw_content") -> DataFrame:
    """Adds the parsed columns and sender_domain to a table of raw messages."""
    added = StructType.fromDDL(PARSED)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in in_pieces(batch, content):
                parsed = list(zip(*(_parse(value) for value in some.column(content).to_pylist())))
                kinds = [pa.timestamp("us", "UTC") if name == "received_at" else pa.string() for name in added.names]
                yield pa.RecordBatch.from_arrays(
                    [*some.columns, *(pa.array(values, kind) for values, kind in zip(parsed, kinds))], names=[*some.schema.names, *added.names],
                )

    return messages.mapInArrow(parse, StructType([*messages.schema.fields, *added.fields])).withColumn(
        "sender_domain", domain_of(F.col("sender"))
    )
