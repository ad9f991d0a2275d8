"""Text expressions: counting, stripping, masking and defanging."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from mailsift import vocabulary as V

WHITESPACE = " \t\n\r\f\x0b"

# The patterns whose matches are masked.
LOCAL_CLASS = r"[A-Za-z0-9._%+\-]"
DOMAIN_PATTERN = r"[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
PII_URL = r"https?://\S+|www\.\S+"
PII_EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
PII_CARD = r"\b\d{4}(?:[ -]?\d{4}){2,4}\b"
PII_PHONE = r"\+?\(?\d[\d ().\-]{5,}\d"
CARD_TOKEN = "[card-number]"
PHONE_TOKEN = "[phone]"
PHONE_DIGITS = (7, 15)


def strip(text: Column) -> Column:
    """Trim every ASCII whitespace character, not only spaces."""
    return F.btrim(text, F.lit(WHITESPACE))


def is_present(text: Column) -> Column:
    return F.coalesce(F.length(strip(text)) > 0, F.lit(False))


def blank_to_null(text: Column) -> Column:
    return F.when(is_present(text), text)


def count_char(text: Column, char: str) -> Column:
    return F.coalesce(F.length(text) - F.length(F.replace(text, F.lit(char), F.lit(""))), F.lit(0))


def letters_only(text: Column) -> Column:
    """Everything but letters cut out, run by run; far cheaper than a match per letter."""
    return F.regexp_replace(text, r"\P{L}+", "")


def uppercase_share(letters: Column) -> Column:
    """Upper-case share of a string of letters, six decimals; zero when it is empty or null."""
    upper = F.length(F.regexp_replace(letters, r"\P{Lu}+", ""))
    return F.when(F.length(letters) > 0, F.floor(upper / F.length(letters) * 1e6 + 0.5) / 1e6).otherwise(F.lit(0.0))


def strip_html(text: Column) -> Column:
    return F.regexp_replace(text, r"<[^>]*>", " ")


def collapse_whitespace(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"\s+", " "))


def preview(text: Column, max_chars: int = 140) -> Column:
    """A one-line card preview, ended with an ellipsis when it had to be shortened."""
    flat = collapse_whitespace(text)
    cut = F.concat(F.rtrim(F.substring(flat, 1, max_chars - 1)), F.lit("…"))
    return F.when(~is_present(text), F.lit(None)).otherwise(F.when(F.length(flat) <= max_chars, flat).otherwise(cut))


def sender_key(sender: Column, domain: Column) -> Column:
    def normal(c: Column) -> Column:
        return F.nullif(F.lower(strip(c)), F.lit(""))

    return F.coalesce(normal(sender), normal(domain), F.lit(V.UNKNOWN_SENDER))


def domain_of(address: Column) -> Column:
    """Text after the last ``@``; null without one or when nothing follows it."""
    return F.when(F.instr(address, "@") > 0, F.nullif(F.substring_index(address, "@", -1), F.lit("")))


def mask_address(address: Column) -> Column:
    """First character of the local part kept, the rest starred."""
    value = strip(address)
    domain = F.substring_index(value, "@", -1)
    local_length = F.length(value) - F.length(domain) - 1
    usable = (F.instr(value, "@") > 0) & (local_length > 0) & (F.length(domain) > 0)
    kept = F.when(local_length == 1, F.lit("***@")).otherwise(F.concat(F.substring(value, 1, 1), F.lit("***@")))
    return F.when(F.length(value) > 0, F.when(usable, F.concat(kept, domain)).otherwise(F.lit("***")))


# Noncharacters that mark the parts of an address between the passes below.
_OPEN, _REST, _CLOSE = "\ufdd0", "\ufdd1", "\ufdd2"


def redact_emails(text: Column) -> Column:
    """Mask every address inside free text.

    One pass finds the addresses, left to right, and marks first character and rest of the local part; the
    others turn marks into stars. A match begins where a run of local-part characters begins or where
    the match before ended, and the run is never given back, so a text is read once.
    """
    begin = rf"(?:\G|(?<!{LOCAL_CLASS}))"
    marked = F.regexp_replace(
        text, f"{begin}({LOCAL_CLASS})({LOCAL_CLASS}*+)@({DOMAIN_PATTERN})", f"{_OPEN}$1{_REST}$2{_CLOSE}@$3"
    )
    single = F.regexp_replace(marked, f"{_OPEN}.{_REST}{_CLOSE}", "***")
    masked = F.regexp_replace(single, f"{_OPEN}(.){_REST}[^{_CLOSE}]+{_CLOSE}", "$1***")
    return F.when(F.contains(text, F.lit("@")), masked).otherwise(text)


_PII = re.compile(f"({PII_URL})|({PII_EMAIL})|({PII_CARD})|({PII_PHONE})", re.ASCII)


def _mask_match(match: re.Match) -> str:
    kind, text = match.lastindex, match.group()
    if kind == 2:
        local, _, domain = text.rpartition("@")
        return ("***@" if len(local) == 1 else local[0] + "***@") + domain
    if kind == 3:
        return CARD_TOKEN
    if kind == 4:
        low, high = PHONE_DIGITS
        return PHONE_TOKEN if low <= sum(ch.isdigit() for ch in text) <= high else text
    return text


@F.pandas_udf(StringType())
def mask_pii(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """URLs kept; addresses, card numbers and phone numbers masked, in that order of preference."""
    for texts in batches:
        yield texts.map(lambda t: _PII.sub(_mask_match, t), na_action="ignore")


def might_hold_pii(text: Column) -> Column:
    """Cheap JVM-side test that lets clean text skip the Python worker."""
    return F.coalesce(text.rlike(r"@|\d[\d ().\-]{5,}\d"), F.lit(False))


def defang(text: Column) -> Column:
    """Break fences and role markers in untrusted text."""
    fenced = F.regexp_replace(text, "={3,}", "[=]")
    return F.replace(F.replace(fenced, F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >"))


def from_display_name(raw: Column, fallback: Column) -> Column:
    """Display name of the first ``From:`` line, else the fallback address."""
    line = strip(F.regexp_extract(raw, r"(?im)^From:\s*(.+)$", 1))
    named = F.instr(line, "<") > 1
    name = strip(F.substring_index(line, "<", 1))
    unquoted = F.when(
        name.startswith('"') & name.endswith('"') & (F.length(name) >= 2),
        strip(F.substring(name, F.lit(2), F.length(name) - 2)),
    ).otherwise(name)
    return F.when(named & is_present(unquoted), unquoted).otherwise(fallback)
