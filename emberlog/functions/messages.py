"""Message text: error test and error signatures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from emberlog.functions.regex import DIGIT_START, WORD_END

# A message is an error if its lower-case form contains one of these.
ERROR_KEYWORDS = (
    "error", "panic", "fatal", "exception", "fail", "refused", "timeout",
    "oomkilled", "crashloopbackoff", "segfault", "x509", "deadline exceeded",
)

# The variable parts of a message and their placeholders, in this order.
SIGNATURE_RULES = (
    (r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "<UUID>"),
    (r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}[.\d]*Z?", "<TS>"),
    (DIGIT_START + r"\d{0,2}\.\d{1,3}\.\d{1,3}\.\d{1,3}" + WORD_END, "<IP>"),
    (r"0x[0-9a-fA-F]+", "<HEX>"),
    (DIGIT_START + r"\d*\.?\d*(?:ms|us|µs|ns|s|m|h)" + WORD_END, "<DUR>"),
    (DIGIT_START + r"\d{3,}" + WORD_END, "<N>"),
)

# Signatures that make a capture critical whatever the error rate.
CRITICAL_WORDS = ("OOMKilled", "panic", "FATAL", "segfault", "core dumped")


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def is_error(msg: Column) -> Column:
    return contains_any(F.lower(msg), ERROR_KEYWORDS)


def is_error_once(msg: Column) -> Column:
    """The same test for use in filters, where Spark repeats a shared sub-expression for every
    keyword: as a lambda variable the lower-case message is computed once."""
    return F.get(F.transform(F.array(F.lower(msg)), lambda m: contains_any(m, ERROR_KEYWORDS)), F.lit(0))


def normalize_message(msg: Column) -> Column:
    """Replace ids, addresses, times and numbers by placeholders, giving a stable signature."""
    for pattern, placeholder in SIGNATURE_RULES:
        msg = F.regexp_replace(msg, pattern, placeholder)
    return msg


def rfc3339(ts: Column) -> Column:
    """UTC timestamp text with the shortest fraction, e.g. 2024-01-15T10:32:01.5Z."""
    text = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.regexp_replace(text, r"\.?0+\z", ""), F.lit("Z"))
