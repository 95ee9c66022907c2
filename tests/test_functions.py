import re

import pytest
from pyspark.sql import functions as F

from emberlog.functions import labels as lab, messages, redaction, regex, scoring


def test_normalize(text_column):
    cases = {
        "request id=a1b2c3d4-e5f6-7890-abcd-ef1234567890 failed": "request id=<UUID> failed",
        "connection refused to 10.0.1.42:8080": "connection refused to <IP>:<N>",
        "logged at 2024-01-15T10:32:01.123456Z": "logged at <TS>",
        "memory at 0x7ffeefbff4a0 corrupted": "memory at <HEX> corrupted",
        "took 230ms": "took <DUR>",
        "duration=1.5s": "duration=<DUR>",
        "HTTP 500 on port 443": "HTTP 500 on port 443",
        "ü1234 x12345": "ü<N> x12345",  # only ASCII letters make words
        "": "",
    }
    got = text_column(messages.normalize_message, list(cases))
    assert got == list(cases.values())
    assert text_column(messages.normalize_message, got) == got


def test_is_error(text_column):
    texts = ["ERROR: x", "OOMKilled", "dial tcp: i/o Timeout", "x509: bad cert", "all good", "failover done", ""]
    assert text_column(messages.is_error, texts) == [True, True, True, True, False, True, False]


@pytest.mark.parametrize("pattern, text, found", [
    (r"c$", "abc\n", False), (r"c$", "abc", True), (r"(?m)b$", "ab\nc", True), (r"\bx\b", "üxü", True),
    (r"a\sb", "a\x0bb", False), (r"[\s]b", "a b", True), (r"a.b", "a\rb", True), (r"a.b", "a\nb", False),
    (r"(?i)straße", "STRAßE", True), (r"(?i)ÜBER", "über", True), (r"[$]5", "$5", True), (r"\$5", "$5", True),
    (r"(?P<n>ab)", "xabx", True), (r"[^\]]x", "]x", False),
    (r"^[[:alpha:]_]+$", "ab_c", True), (r"[[:^digit:]]", "123", False), (r"[[(]x", "[x", True), (r"[]a]b", "]b", True),
    (r"[a&&b]c", "&c", True), (r"^[[:word:]]+$", "a1_", True), (r"[^]]", "]", False),
])
def test_regex_dialect(text_column, pattern, text, found):
    assert text_column(lambda c: regex.matches(c, pattern), [text]) == [found]


def test_replacement_templates():
    assert regex.java_replacement("<$1>", "(a)") == "<$1>"
    assert regex.java_replacement("${n}-$$", "(?P<n>a)") == "${n}-\\$"
    assert regex.java_replacement("a\\b$2", "(a)") == "a\\\\b"


def test_rfc3339(spark):
    rows = spark.sql("select timestamp'2024-01-15 10:32:01.5' a, timestamp'2024-01-15 10:30:00' b")
    assert rows.select(messages.rfc3339(F.col("a")), messages.rfc3339(F.col("b"))).first()[:] == (
        "2024-01-15T10:32:01.5Z", "2024-01-15T10:30:00Z")


def test_labels(spark):
    df = spark.createDataFrame([({"b": "2", "a": "1"},), ({"z": "9", "app": "api"},), ({"app": ""},), ({"app": "", "aa": "q"},),
                                ({},), (None,)], "m map<string,string>")
    assert [r[0] for r in df.select(lab.flatten_labels(F.col("m"))).collect()] == [
        "a=1;b=2", "app=api;z=9", "app=", "aa=q;app=", "", ""]
    assert [r[0] for r in df.select(lab.service_label(F.col("m"))).collect()] == ["1", "api", None, "q", None, None]
    assert [r[0] for r in df.select(lab.label_equals(F.col("m"), "x", "")).collect()] == [True] * 6
    assert [r[0] for r in df.select(lab.label_present(F.col("m"), "x", "")).collect()] == [False] * 6


def _luhn(text):
    digits = re.sub("[ -]", "", text)
    if not re.fullmatch(r"\d{13,19}", digits):
        return False
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def test_luhn(text_column):
    numbers = ["4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1112", "1234567890123456", "0" * 13, "0" * 12,
               "0" * 19, "0" * 20, "4111x11111111111", "5500005555555559", "371449635398431"]
    assert text_column(redaction.luhn_valid, numbers) == [_luhn(n) for n in numbers]


def test_redact(text_column):
    cases = {
        "card: 4111111111111111": "card: [REDACTED:cc]",
        "4111-1111-1111-1111": "[REDACTED:cc]",
        "connect 127.0.0.1:8080": "connect [REDACTED:ip]:8080",
        "user+tag@example.com here": "[REDACTED:email] here",
        "call (555) 123-4567": "call [REDACTED:phone]",
        "Authorization: Bearer xyz789": "[REDACTED:bearer]",
        "AUTHORIZATION: BEARER abc": "[REDACTED:bearer]",
        "ssn 123-45-6789": "ssn [REDACTED:ssn]",
        "eyJhbGci.eyJzdWIi.SflKx": "[REDACTED:jwt]",
        "version 1.2.3": "version 1.2.3",
        "": "",
    }
    assert text_column(redaction.redact, list(cases)) == list(cases.values())


def test_redact_cards_only_with_right_checksum(text_column):
    cases = {
        "number 1234567890123456": "number 1234567890123456",
        "two 4111111111111111 and 1234567890123456.": "two [REDACTED:cc] and 1234567890123456.",
        "4111111111111111": "[REDACTED:cc]",
        "x4111111111111111": "x4111111111111111",
    }
    assert text_column(lambda c: redaction.redact(c, ["credit_card"]), list(cases)) == list(cases.values())


def test_redact_subset_and_custom(text_column):
    custom = [redaction.custom_pattern("id", r"id=(\w+)", "id=<$1>"), redaction.custom_pattern("cash", r"\$\d+", "$$?")]
    got = text_column(lambda c: redaction.redact(c, ["email"], custom), ["a@b.io 10.0.0.1 id=7 cost $15"])
    assert got == ["[REDACTED:email] 10.0.0.1 id=<7> cost $?"]
    with pytest.raises(ValueError):
        redaction.select_patterns(["nope"])


def test_redact_hits(spark):
    df = spark.createDataFrame([("4111111111111111 4111111111111111 a@b.io c@d.io",), ("plain",)], "msg string")
    rows = redaction.redact_with_hits(df, "msg").collect()
    assert rows[0].msg == "[REDACTED:cc] [REDACTED:cc] [REDACTED:email] [REDACTED:email]"
    assert (rows[0].hits_credit_card, rows[0].hits_email, rows[0].hits_ssn) == (2, 1, 0)
    assert rows[1].msg == "plain" and rows[1].hits_credit_card == 0


@pytest.mark.parametrize("rate, critical, expected", [(0.5, False, "low"), (2.5, False, "medium"), (10, False, "high"),
                                                      (0.1, True, "high"), (5, False, "medium"), (1, False, "low")])
def test_severity(spark, rate, critical, expected):
    assert spark.range(1).select(scoring.severity(F.lit(float(rate)), F.lit(critical))).first()[0] == expected


@pytest.mark.parametrize("error, volume, new, expected", [
    (-60, 0, True, ("improvement", 0.9)), (-30, 0, False, ("improvement", 0.7)), (60, 0, True, ("regression", 0.7)),
    (150, 0, True, ("regression", 0.85)), (300, 0, True, ("regression", 0.95)), (10, 80, False, ("different", 0.6)),
    (80, 0, False, ("different", 0.5)), (3, 0, False, ("stable", 0.95)), (15, 0, False, ("stable", 0.8)),
    (15, 0, True, ("different", 0.5)), (40, 0, False, ("stable", 0.5)), (-20, 0, False, ("stable", 0.8))])
def test_verdict(spark, error, volume, new, expected):
    v = scoring.verdict(F.lit(float(error)), F.lit(float(volume)), F.lit(new))
    assert tuple(spark.range(1).select(v).first()[0]) == expected


def test_percent(spark):
    df = spark.createDataFrame([(0, 0), (0, 3), (10, 44), (10, 8), (1000, 997), (200, 205), (200, 195)], "a bigint, b bigint")
    pct = scoring.percent_change(F.col("a"), F.col("b"))
    assert [r[0] for r in df.select(scoring.percent_text(pct)).collect()] == ["+0%", "+100%", "+340%", "-20%", "-0%", "+2%", "-2%"]
