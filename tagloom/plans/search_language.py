"""The tag search language: text to a small syntax tree, on the driver."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timedelta

# Fixed values of the language: the token pattern, units and names.
TOKEN = re.compile(r'(-?)(?:([a-zA-Z0-9_]+):)?("[^"]*"|[^\s"]+)')
SIZE_UNITS = {"b": 1, "k": 1024, "kb": 1024, "m": 1024**2, "mb": 1024**2, "g": 1024**3, "gb": 1024**3}
AGE_UNITS = (("mo", timedelta(days=30)), ("y", timedelta(days=365)), ("w", timedelta(weeks=1)), ("d", timedelta(days=1)), ("h", timedelta(hours=1)), ("mi", timedelta(minutes=1)), ("s", timedelta(seconds=1)))
RATINGS = {"s": "safe", "q": "questionable", "e": "explicit", "safe": "safe", "questionable": "questionable", "explicit": "explicit"}
COUNTED = {"tagcount": None, "gentags": "general", "arttags": "artist", "chartags": "character", "copytags": "copyright", "metatags": "meta"}


@dataclass(frozen=True)
class Range:
    """A comparison: op is eq, ge, le, gt, lt, between or in."""

    op: str
    value: object = None
    high: object = None


@dataclass(frozen=True)
class Meta:
    value: str
    negated: bool


@dataclass
class Query:
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    wildcards: list[tuple[bool, str]] = field(default_factory=list)  # (negated, pattern)
    meta: dict[str, list[Meta]] = field(default_factory=dict)


@dataclass(frozen=True)
class Token:
    """One token: kind is 'meta' (with its key), 'wildcard' or 'tag'."""

    kind: str
    text: str
    negated: bool
    key: str = ""


def scan(text: str | None, aliases: dict[str, str] | None = None) -> Iterator[Token]:
    """Tokens ``[-][key:]value``. A quoted value is never a wildcard, aliases are replaced before wildcards are looked for, and an empty value is no token."""
    known = aliases or {}
    for found in TOKEN.finditer(text or ""):
        sign, key, shown = found.groups()
        bare = shown.strip('"')
        if key:
            yield Token("meta", bare, bool(sign), key.lower())
        elif bare:
            name = known.get(bare.lower(), bare)
            pattern = bare is shown and not {"*", "?"}.isdisjoint(name)
            yield Token("wildcard" if pattern else "tag", name if pattern else name.lower(), bool(sign))


def parse(text: str | None, aliases: dict[str, str] | None = None) -> Query:
    """The syntax tree of a query text."""
    tokens = list(scan(text, aliases))
    meta: dict[str, list[Meta]] = {t.key: [] for t in tokens if t.kind == "meta"}
    for t in tokens:
        if t.kind == "meta":
            meta[t.key].append(Meta(t.text, t.negated))
    tags = [t for t in tokens if t.kind == "tag"]
    return Query([t.text for t in tags if not t.negated], [t.text for t in tags if t.negated], [(t.negated, t.text) for t in tokens if t.kind == "wildcard"], meta)


#: Signs before a value; of two that fit, the longer one is meant.
COMPARISONS = {">=": "ge", "<=": "le", ">": "gt", "<": "lt"}


def parse_range(value: str, convert) -> Range:
    """``a..b`` (both ends included), ``..b``, ``a..``, ``>= <= > <``, ``a,b,c``, else equality."""
    match value.split(".."):
        case ["", high]:
            return Range("le", convert(high))
        case [low, ""]:
            return Range("ge", convert(low))
        case [low, high]:
            return Range("between", convert(low), convert(high))
    sign = max((s for s in COMPARISONS if value.startswith(s)), key=len, default="")
    if sign:
        return Range(COMPARISONS[sign], convert(value.removeprefix(sign)))
    listed = value.split(",")
    return Range("in", [convert(v) for v in listed if v]) if listed[1:] else Range("eq", convert(value))


def parse_dates(value: str) -> Range:
    """A range of dates; where any date of it is none, the whole asks for media without a date."""
    try:
        return parse_range(value, lambda text: datetime.strptime(text, "%Y-%m-%d").date())
    except ValueError:
        return Range("eq", None)


def _age(text: str) -> timedelta:
    found = re.fullmatch(r"(\d+)([a-z]+)", text.strip().lower())
    if not found:
        return timedelta(0)
    return next((int(found[1]) * step for unit, step in AGE_UNITS if found[2].startswith(unit)), timedelta(0))


def parse_age(value: str, now: datetime) -> Range:
    """Ages are times before ``now``, so comparisons turn round; an exact age means within 12 hours."""
    found = parse_range(value, _age)
    back = {"ge": "le", "le": "ge", "gt": "lt", "lt": "gt"}
    if found.op == "between":
        return Range("between", *sorted((now - found.value, now - found.high)))
    if found.op == "eq":
        half = timedelta(hours=12)
        return Range("between", now - found.value - half, now - found.value + half)
    if found.op == "in":
        return Range("in", [now - v for v in found.value])
    return Range(back[found.op], now - found.value)


def _size(text: str) -> tuple[int, int]:
    """Bytes and the width of the unit."""
    found = re.fullmatch(r"([\d.]+)\s*([a-z]*)", text.strip().lower())
    try:
        unit = SIZE_UNITS[found[2] or "b"]
        return int(float(found[1]) * unit), unit if found[2] else 1
    except (TypeError, KeyError, ValueError):
        return 0, 1


def parse_size(value: str) -> Range:
    """File sizes; a bare value with a unit is fuzzy, anything within one unit above it."""
    found = parse_range(value, _size)
    if found.op == "eq":
        size, unit = found.value
        return Range("between", size, size + unit - 1) if unit > 1 else Range("eq", size)
    if found.op == "between":
        return Range("between", found.value[0], found.high[0])
    if found.op == "in":
        return Range("in", [v for v, _ in found.value])
    return Range(found.op, found.value[0])


def wildcard(pattern: str) -> str:
    """``*`` any run, ``?`` at most one character, all else literal; whole name, any case."""
    body = "".join(".*" if c == "*" else ".?" if c == "?" else re.escape(c) for c in pattern)
    return f"(?i)^{body}$"


def escape_like(text: str) -> str:
    """Text for LIKE ... ESCAPE '\\' without its own wildcards."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
