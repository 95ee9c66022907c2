"""Find and replace personal data in message text."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from emberlog.functions.regex import DIGIT_START, WORD, WORD_END, java_regex, java_replacement


@dataclass(frozen=True)
class Pattern:
    name: str
    regex: str  # in Java's dialect
    replacement: str
    needs: str = ""  # text that every match contains, or a cheap regex (after "~") that finds it


_SPACE = r"\t\n\f\r "
# A word boundary and then one character of an address' name part.
_NAME_START = rf"(?:[{WORD}](?<![{WORD}].)|[.%+\-](?<=[{WORD}].))"

# Names, patterns and replacements, applied in this order.
BUILTIN = (
    Pattern("credit_card", DIGIT_START + r"[ -]*?(?:\d[ -]*?){12,18}" + WORD_END, "[REDACTED:cc]"),
    Pattern("email", _NAME_START + r"[A-Za-z0-9._%+\-]*+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}" + WORD_END, "[REDACTED:email]", "@"),
    Pattern("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "[REDACTED:jwt]", "eyJ"),
    Pattern("bearer", rf"(?iu)(?:Bearer[{_SPACE}]+|Authorization:[{_SPACE}]*Bearer[{_SPACE}]+)[A-Za-z0-9_\-.]+",
            "[REDACTED:bearer]", "~(?iu)bearer"),
    Pattern("ip_v4", rf"(?=\d{{1,3}}\.)(?<![{WORD}])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]\d|\d)\.){{3}}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]\d|\d)" + WORD_END, "[REDACTED:ip]", "."),
    Pattern("ssn", DIGIT_START + r"\d{2}-\d{2}-\d{4}" + WORD_END, "[REDACTED:ssn]", "-"),
    Pattern("phone", rf"(?:\+\d{{1,3}}[{_SPACE}.-]?)?\(?\d{{3}}\)?[{_SPACE}.-]?\d{{3}}[{_SPACE}.-]?\d{{4}}" + WORD_END,
            "[REDACTED:phone]", "~[0-9]{3}"),
)
CARD = BUILTIN[0]


def custom_pattern(name: str, regex: str, replacement: str) -> Pattern:
    """A user pattern; its replacement may use ``$1`` or ``${name}``."""
    return Pattern(name, java_regex(regex), java_replacement(replacement, regex))


def select_patterns(names: Iterable[str] | None = None, custom: Iterable[Pattern] = ()) -> list[Pattern]:
    """Builtins by name in the order given (all of them by default), then the custom ones."""
    if not names:
        return [*BUILTIN, *custom]
    known = {p.name: p for p in BUILTIN}
    for name in (names := list(names)):
        if name not in known:
            raise ValueError(f"unknown redaction pattern: {name}")
    return [*(known[n] for n in names), *custom]


def luhn_valid(number: Column) -> Column:
    """Checksum of 13 to 19 digits; only digits, spaces and dashes may occur."""
    digits = F.transform(
        F.split(F.reverse(F.regexp_replace(number, "[ -]", "")), ""), lambda d: F.try_to_number(d, F.lit("9")).cast("int"))
    weighted = F.transform(
        digits, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    total = F.aggregate(weighted, F.lit(0), lambda acc, d: acc + d)
    return F.coalesce(number.rlike(r"^[ -]*(?:[0-9][ -]*){13,19}\z") & (total % 10 == 0), F.lit(False))


def _card_matches(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CARD.regex), F.lit(0))


def card_hits(text: Column) -> Column:
    """Number of card numbers with a right checksum."""
    found = F.size(F.filter(_card_matches(text), luhn_valid))
    return F.when(text.rlike(CARD.regex), found).otherwise(F.lit(0))


def redact_cards(text: Column) -> Column:
    """Replace only the matches whose checksum is right: the gaps between the matches are put
    together again with each match or its replacement."""
    gaps = F.split(text, CARD.regex, -1)
    kept = F.transform(_card_matches(text),
                       lambda m: F.when(luhn_valid(m), F.lit(CARD.replacement)).otherwise(m))
    return F.array_join(F.transform(
        F.arrays_zip(gaps.alias("gap"), kept.alias("kept")),
        lambda z: F.concat(z["gap"], F.coalesce(z["kept"], F.lit("")))), "")


def _replace(text: Column, pattern: Pattern) -> Column:
    """One pattern. Most texts are passed over by a cheap test."""
    if pattern == CARD:
        return F.when(text.rlike(CARD.regex), redact_cards(text)).otherwise(text)
    changed = F.regexp_replace(text, pattern.regex, pattern.replacement)
    if not pattern.needs:
        return changed
    possible = text.rlike(pattern.needs[1:]) if pattern.needs.startswith("~") else text.contains(pattern.needs)
    return F.when(possible, changed).otherwise(text)


def _apply(text: Column, pattern: Pattern) -> Column:
    # As a lambda variable the text is computed once, though the pattern's step uses it often.
    return F.get(F.transform(F.array(text), lambda t: _replace(t, pattern)), F.lit(0))


def redact(text: Column, names: Iterable[str] | None = None, custom: Iterable[Pattern] = ()) -> Column:
    for pattern in select_patterns(names, custom):
        text = _apply(text, pattern)
    return text


def redact_with_hits(df: DataFrame, column: str, names: Iterable[str] | None = None,
                     custom: Iterable[Pattern] = ()) -> DataFrame:
    """Redact ``column`` in place and add one ``hits_<pattern>`` count per pattern.

    Cards count every validated match, the others count once per changed message. Each step
    is its own projection, so that no step's text is computed twice."""
    for pattern in select_patterns(names, custom):
        before = F.col(column)
        hits = f"hits_{pattern.name}"
        if pattern == CARD:
            df = df.withColumn(hits, card_hits(before).cast("bigint"))
            df = df.withColumn(column, F.when(F.col(hits) > 0, redact_cards(before)).otherwise(before))
        else:
            df = df.withColumn("_after", _replace(before, pattern))
            df = df.withColumn(hits, (F.col("_after") != before).cast("bigint"))
            df = df.withColumn(column, F.col("_after")).drop("_after")
    return df
