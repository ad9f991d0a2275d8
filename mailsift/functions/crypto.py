"""Keyed pseudonyms and envelope encryption built from Spark's own digest and AES functions."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import BinaryType

from mailsift import vocabulary as V
from mailsift.functions.text import is_present

BLOCK = 64
PSEUDONYM_HEX = 24
DATA_KEY_BYTES = 32


def hmac_sha256(message: Column, key: bytes) -> Column:
    """Hex HMAC-SHA-256, composed from ``sha2`` with both pads precomputed."""
    if len(key) > BLOCK:
        key = hashlib.sha256(key).digest()
    padded = key.ljust(BLOCK, b"\0")
    inner = F.lit(bytearray(b ^ 0x36 for b in padded))
    outer = F.lit(bytearray(b ^ 0x5C for b in padded))
    digest = F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(outer, F.unhex(digest)), 256)


def pseudonym(sender_key: Column, key: bytes) -> Column:
    named = F.when(is_present(sender_key), sender_key).otherwise(F.lit(V.UNKNOWN_SENDER))
    return F.concat(F.lit("snd_"), F.substring(hmac_sha256(named, key), 1, PSEUDONYM_HEX))


def aes_seal(plain: Column, key: Column) -> Column:
    """AES-GCM: 12-byte IV, ciphertext, 16-byte tag."""
    return F.aes_encrypt(plain, key, F.lit("GCM"))


def aes_open(sealed: Column, key: Column) -> Column:
    return F.aes_decrypt(sealed, key, F.lit("GCM"))


def try_aes_open(sealed: Column, key: Column) -> Column:
    """Null when the key is wrong or the content was tampered with."""
    return F.try_aes_decrypt(sealed, key, F.lit("GCM"))


@F.pandas_udf(BinaryType())
def _fresh_keys(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for rows in batches:
        yield pd.Series([os.urandom(DATA_KEY_BYTES) for _ in range(len(rows))])


fresh_data_key = _fresh_keys.asNondeterministic()


def master_key(version: Column, keys: dict[str, bytes]) -> Column:
    """The master key of a version, null for an unknown one."""
    names = iter(keys.items())
    first, value = next(names)
    chosen = F.when(version == first, F.lit(bytearray(value)))
    for name, value in names:
        chosen = chosen.when(version == name, F.lit(bytearray(value)))
    return chosen
