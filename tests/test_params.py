from datetime import datetime, timedelta, timezone

import pytest

from emberlog import params

REF = datetime(2024, 1, 15, 12, 0, tzinfo=timezone.utc)


def test_times():
    assert params.parse_time("2024-01-15T10:32:00Z", REF, REF) == datetime(2024, 1, 15, 10, 32, tzinfo=timezone.utc)
    assert params.parse_time("2024-01-15T10:32:00.123456789+02:00", REF, REF).microsecond == 123456
    assert params.parse_time("10:32", REF, REF) == datetime(2024, 1, 15, 10, 32, tzinfo=timezone.utc)
    assert params.parse_time("-1h30m", REF, REF) == REF - timedelta(minutes=90)
    assert params.parse_time("", REF, REF) is None
    for bad in ("yesterday", "25:00", "-5x", "30m"):
        with pytest.raises(ValueError):
            params.parse_time(bad, REF, REF)
    assert params.parse_slice_time("30m", REF) == REF - timedelta(minutes=30)
    assert params.parse_slice_time("9:05", REF) == REF.replace(hour=9, minute=5)


def test_sizes_and_ages():
    assert params.parse_size("50GB") == 50 * 2**30
    assert params.parse_size("1.5 kb") == 1536
    assert params.parse_size("100") == 100
    assert params.parse_age("7d") == timedelta(days=7)
    assert params.parse_age("1.5d") == timedelta(hours=36)
    assert params.parse_age("90m") == timedelta(minutes=90)
    for bad in ("", "GB", "5PB"):
        with pytest.raises(ValueError):
            params.parse_size(bad)
    for bad in ("d", "7w"):
        with pytest.raises(ValueError):
            params.parse_age(bad)


def test_labels_faults_rules():
    assert params.parse_label("app=a=b") == ("app", "a=b")
    with pytest.raises(ValueError):
        params.parse_label("=x")
    assert params.parse_fault("service-down=api").service == "api"
    for bad in ("service-down", "error-spike=api", "boom"):
        with pytest.raises(ValueError):
            params.parse_fault(bad)
    assert params.parse_redact("") == (False, [])
    assert params.parse_redact("true") == (True, [])
    assert params.parse_redact("email, ssn") == (True, ["email", "ssn"])
    with pytest.raises(ValueError):
        params.AlertRule("r", "cpu", "gt", 1)
