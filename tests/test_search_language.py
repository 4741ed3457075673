"""The search language (B1 to B7, B23, F3) on the driver, its traps, and small plans."""

from datetime import date, datetime, timedelta

import pytest

from tagloom.plans import search as S, search_language as L

NOW = datetime(2025, 1, 1)


def test_b01_tokens():
    q = L.parse('cat -dog "two words" -"x y" rating:s -width:>5 a*b -c?d')
    assert q.include == ["cat", "two words"] and q.exclude == ["dog", "x y"]
    assert q.wildcards == [(False, "a*b"), (True, "c?d")]
    assert q.meta == {"rating": [L.Meta("s", False)], "width": [L.Meta(">5", True)]}


def test_b01_quotes_are_no_wildcards_and_aliases_come_first():
    assert L.parse('"a*b"').include == ["a*b"]
    assert L.parse("kitty", {"kitty": "cat*"}).wildcards == [(False, "cat*")]
    assert L.parse('""').include == [] and L.parse("").include == [] and L.parse(None).include == []


def test_trap_4_colon_tag_is_a_meta_key():
    q = L.parse("re:zero")
    assert q.include == [] and "re" in q.meta


@pytest.mark.parametrize(
    "text, want",
    [
        ("1..5", L.Range("between", 1, 5)), ("..5", L.Range("le", 5)), ("1..", L.Range("ge", 1)), (">=2", L.Range("ge", 2)), ("<=2", L.Range("le", 2)),
        (">2", L.Range("gt", 2)), ("<2", L.Range("lt", 2)), ("3,1,,2", L.Range("in", [3, 1, 2])), ("7", L.Range("eq", 7)),
    ],
)
def test_b02_ranges(text, want):
    assert L.parse_range(text, int) == want


def test_b03_dates():
    assert L.parse_dates("2024-02-03").value == date(2024, 2, 3)
    for bad in ("yesterday", "2024-01-01..soon", "..soon", ">=soon", "2024-01-01,soon"):
        assert L.parse_dates(bad) == L.Range("eq", None)
    assert L.parse_dates("2024-01-01..2024-02-01") == L.Range("between", date(2024, 1, 1), date(2024, 2, 1))


def test_b04_ages():
    assert L.parse_age("<1w", NOW) == L.Range("gt", NOW - timedelta(weeks=1))
    assert L.parse_age("2w..1y", NOW) == L.Range("between", NOW - timedelta(days=365), NOW - timedelta(weeks=2))
    assert L.parse_age("1d", NOW) == L.Range("between", NOW - timedelta(days=1, hours=12), NOW - timedelta(hours=12))
    assert L.parse_age(">5parsecs", NOW) == L.Range("lt", NOW)
    assert L.parse_age(">3mo", NOW).value == NOW - timedelta(days=90)


def test_b05_sizes():
    assert L.parse_size("1.5m") == L.Range("between", int(1.5 * 1024**2), int(1.5 * 1024**2) + 1024**2 - 1)
    assert L.parse_size("100") == L.Range("eq", 100)
    assert L.parse_size("100kb..") == L.Range("ge", 102400)
    assert L.parse_size(">junk") == L.Range("gt", 0)


def test_b06_trap_3_literals_are_escaped_once():
    import re

    assert re.match(L.wildcard("a(*"), "A(bc") and not re.match(L.wildcard("a.b"), "axb")
    assert re.match(L.wildcard("ab?"), "ab") and re.match(L.wildcard("ab?"), "abc")


def test_b28_like_escapes():
    assert L.escape_like("50%_\\") == "50\\%\\_\\\\"


def test_b24_invalid_class_is_an_error(spark):
    with pytest.raises(ValueError):
        S.classes("anime,Bogus")


def test_b22_bad_number_raises(spark):
    with pytest.raises(ValueError):
        L.parse_range("many", int)


def test_f03_last_order_wins(spark):
    shown = lambda q: str(S.order(L.parse(q)))
    assert shown("sort:md5 order:id") == shown("order:id sort:md5") == shown("order:id")
    assert shown("order:id order:md5") == shown("sort:md5") != shown("order:id")


def test_b25_listing_with_unknown_limit_is_empty(spark):
    df = spark.createDataFrame([("safe",), ("explicit",)], "rating string")
    assert df.filter(S.ceiling("medium", listing=True)).count() == 0
    assert df.filter(S.ceiling("medium")).count() == 1 and df.filter(S.ceiling(None)).count() == 2


def test_traps_5_and_6_nulls_and_zero_height(spark):
    df = spark.createDataFrame([(1, None, 10, 0), (2, 5, 10, 5), (3, 9, 0, 5)], "id long, file_size long, width int, height int")
    assert [r["id"] for r in S.page(df, S.order(L.parse("order:filesize")), 3).orderBy("position").collect()] == [1, 3, 2]
    assert [r["id"] for r in S.page(df, S.order(L.parse("order:landscape")), 3).orderBy("position").collect()] == [1, 2, 3]
