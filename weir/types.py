"""The language's scalar types: their Spark types, empty values, and the types that operators give."""

from __future__ import annotations

import ipaddress
from datetime import datetime, timezone
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

BOOL, USHORT, UINT, INT, ULLONG, LLONG, FLOAT, STRING, TIMEVAL, IP, IPV6 = "BOOL USHORT UINT INT ULLONG LLONG FLOAT STRING TIMEVAL IP IPV6".split()
SPARK = {BOOL: "boolean", USHORT: "int", UINT: "bigint", INT: "int", ULLONG: "decimal(20,0)", LLONG: "bigint", FLOAT: "double", STRING: "string", TIMEVAL: "timestamp", IP: "bigint", IPV6: "binary"}
NAMES = {n.lower(): t for t in SPARK for n in (t,)} | {"v_str": STRING, "ulong": ULLONG, "long": LLONG, "double": FLOAT}
INTEGERS = {USHORT, UINT, INT, ULLONG, LLONG}
NUMERIC = INTEGERS | {FLOAT}
UNSIGNED = {USHORT, UINT, ULLONG}
_FROM_SPARK = {"boolean": BOOL, "tinyint": INT, "smallint": INT, "int": INT, "bigint": LLONG, "float": FLOAT, "double": FLOAT, "string": STRING, "timestamp": TIMEVAL, "timestamp_ntz": TIMEVAL, "binary": IPV6, "date": TIMEVAL}
WORD = 1 << 32


class TypeError_(ValueError):
    """A query whose types don't fit."""


def named(name: str) -> str:
    if name.lower() not in NAMES:
        raise TypeError_(f"no type {name}")
    return NAMES[name.lower()]


def from_spark(kind: str) -> str | None:
    """The type of a DataFrame's column, or None for one that the language has no type for."""
    return FLOAT if kind.startswith("decimal") and not kind.endswith(",0)") else ULLONG if kind.startswith("decimal") else _FROM_SPARK.get(kind)


def micros(value: Column, kind: str = "timestamp_ntz") -> Column:
    """Microseconds since 1970 of a timestamp; one without a zone counts as UTC, whatever the session's zone is."""
    if kind == "timestamp":
        return F.unix_micros(value)
    since = (value - F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")).cast("interval second")
    return (since.cast("decimal(20,6)") * 1_000_000).cast("bigint")


def seconds(value: Column, kind: str = "timestamp_ntz") -> Column:
    """Whole seconds since 1970, rounded down; one without a zone counts as UTC."""
    if kind == "timestamp":
        return F.unix_seconds(value)
    days = F.date_diff(value.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    return days * 86_400 + F.hour(value) * 3600 + F.minute(value) * 60 + F.second(value)


def floored(value: Column, unit: int) -> Column:
    """value / unit, rounded down, in integers."""
    return F.call_function("div", value - F.pmod(value, F.lit(unit)), F.lit(unit)).cast("bigint")


def empty(kind: str) -> Column:
    """What stands for a value that isn't there: the language has no null."""
    if kind == IPV6:
        return F.lit(bytes(16))
    if kind == TIMEVAL:
        return F.timestamp_seconds(F.lit(0))
    return F.lit({BOOL: False, FLOAT: 0.0, STRING: ""}.get(kind, 0)).cast(SPARK[kind])


def least_value(kind: str):
    """The least value of a type, as Python has it; None where the type has none."""
    return {BOOL: False, USHORT: 0, UINT: 0, ULLONG: Decimal(0), IP: 0, INT: -(1 << 31), LLONG: -(1 << 63), FLOAT: -1.7976931348623157e308, STRING: "", IPV6: bytes(16)}.get(kind)


def greatest_value(kind: str):
    return {BOOL: True, USHORT: (1 << 16) - 1, UINT: WORD - 1, ULLONG: Decimal((1 << 64) - 1), IP: WORD - 1, INT: (1 << 31) - 1, LLONG: (1 << 63) - 1, FLOAT: 1.7976931348623157e308, IPV6: b"\xff" * 16}.get(kind)


def least(kind: str) -> Column:
    value = least_value(kind)
    return empty(kind) if value is None else F.lit(value).cast(SPARK[kind])


def greatest(kind: str) -> Column:
    value = greatest_value(kind)
    return empty(kind) if value is None else F.lit(value).cast(SPARK[kind])


def arithmetic(op: str, a: str, b: str) -> str:
    """Result type of + - * / % << >>."""
    if op in "+-*/" and TIMEVAL in (a, b):
        if a == TIMEVAL and b == TIMEVAL and op == "-":
            return INT
        if a == TIMEVAL and b in INTEGERS and op in "+-/" or op == "+" and a in INTEGERS:
            return TIMEVAL
        raise TypeError_(f"{a} {op} {b}")
    if a == IP and b in INTEGERS:
        a = UINT
    if b == IP and a in INTEGERS:
        b = UINT
    if a not in NUMERIC or b not in NUMERIC:
        raise TypeError_(f"{a} {op} {b}")
    if op in ("<<", ">>"):
        if b not in (USHORT, UINT, INT) or a == FLOAT:
            raise TypeError_(f"{a} {op} {b}")
    if FLOAT in (a, b):
        if op == "%":
            raise TypeError_(f"{a} {op} {b}")
        return FLOAT
    for kind in (ULLONG, LLONG):
        if kind in (a, b):
            return kind
    if UINT in (a, b):
        return UINT
    return INT if INT in (a, b) else USHORT


def bitwise(op: str, a: str, b: str) -> str:
    """Result type of & and |."""
    if a == b and a in (IPV6, BOOL, IP):
        return a
    if IP in (a, b) and {a, b} <= INTEGERS | {IP}:
        return IP
    if BOOL in (a, b) and {a, b} <= INTEGERS | {BOOL}:
        return BOOL
    if a in INTEGERS and b in INTEGERS:
        return arithmetic("+", a, b)
    raise TypeError_(f"{a} {op} {b}")


def negated(kind: str) -> str:
    if kind not in NUMERIC:
        raise TypeError_(f"-{kind}")
    return {USHORT: INT, UINT: INT, ULLONG: LLONG}.get(kind, kind)


def comparable(a: str, b: str) -> bool:
    return a == b or {a, b} <= NUMERIC | {IP}


def summed(kind: str) -> str:
    if kind in (UINT, USHORT, BOOL):
        return UINT
    if kind in NUMERIC:
        return kind
    raise TypeError_(f"SUM of {kind}")


def wrapped(value: Column, kind: str) -> Column:
    """The value as C's arithmetic leaves it: modulo the type's size. value: bigint or decimal."""
    if kind in (UINT, IP):
        return F.pmod(value, F.lit(WORD)).cast("bigint")
    if kind == INT:
        return (F.pmod(value + F.lit(1 << 31), F.lit(WORD)) - F.lit(1 << 31)).cast("int")
    if kind == ULLONG:
        return F.pmod(value, F.lit(Decimal(1 << 64))).cast(SPARK[ULLONG])
    return value.cast(SPARK[kind])


# Temporality: how a value moves along its stream.
INCREASING, DECREASING, CONSTANT, VARYING = "increasing", "decreasing", "constant", "varying"
_FLIP = {INCREASING: DECREASING, DECREASING: INCREASING}


def moves(op: str, a: str, b: str, kind_a: str, kind_b: str) -> str:
    """Temporality of a binary operation."""
    signed = kind_a in (INT, LLONG, FLOAT) and kind_b in (INT, LLONG, FLOAT)
    if op in ("*", "/") and signed and not a == b == CONSTANT:
        return VARYING
    if op in ("+", "*"):
        if a == CONSTANT:
            return b
        return a if b in (CONSTANT, a) else VARYING
    if op == "-":
        if a == b == CONSTANT:
            return CONSTANT
        if kind_b not in (INT, FLOAT):
            if a in (CONSTANT, DECREASING) and b == INCREASING:
                return DECREASING
            if a in (CONSTANT, INCREASING) and b == DECREASING:
                return INCREASING
        return VARYING
    if op == "/":
        if b == CONSTANT:
            return a
        if a in (CONSTANT, DECREASING) and b == INCREASING:
            return DECREASING
        if a in (CONSTANT, INCREASING) and b == DECREASING:
            return INCREASING
    return VARYING


def flipped(move: str) -> str:
    return _FLIP.get(move, move)


def parse_ip(text: str) -> int:
    return int(ipaddress.IPv4Address(text))


def parse_ipv6(text: str) -> bytes:
    return ipaddress.IPv6Address(text).packed


def parse_timeval(text: str) -> datetime:
    """'seconds.milliseconds'."""
    seconds, _, rest = text.partition(".")
    return datetime.fromtimestamp(int(seconds), timezone.utc).replace(microsecond=int((rest + "000")[:3]) * 1000)


def text_of(value: Column, kind: str) -> Column:
    """As the text sinks print it."""
    if kind == BOOL:
        return F.when(value, "TRUE").otherwise("FALSE")
    if kind == FLOAT:
        return F.format_string("%.6f", value)
    if kind == IP:
        return F.concat_ws(".", *(F.shiftright(value, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)))
    if kind == IPV6:
        h = F.lower(F.hex(value))
        return F.concat_ws(":", *(F.substring(h, 1 + 4 * k, 4) for k in range(8)))
    if kind == TIMEVAL:
        return F.concat(F.unix_seconds(value).cast("string"), F.lit("."), F.lpad((F.pmod(F.unix_millis(value), F.lit(1000))).cast("string"), 3, "0"))
    return value.cast("string")


def parsed(text: Column, kind: str) -> Column:
    """A text field as a value of the type; null if it is malformed."""
    if kind == STRING:
        return text
    if kind == BOOL:
        return F.when(text.isNotNull(), F.lower(text) == "true")
    if kind == IP:
        parts = [F.regexp_extract(text, r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$", k + 1) for k in range(4)]
        value = sum((p.try_cast("bigint") * (1 << s) for p, s in zip(parts, (24, 16, 8, 0), strict=True)), F.lit(0).cast("bigint"))
        return F.when(F.greatest(*(p.try_cast("int") for p in parts)) <= 255, value)
    if kind == IPV6:
        return F.when(text.rlike("^[0-9a-fA-F]{4}(:[0-9a-fA-F]{4}){7}$"), F.unhex(F.replace(text, F.lit(":"), F.lit(""))))
    if kind == TIMEVAL:
        return F.timestamp_millis((text.try_cast("decimal(30,3)") * 1000).cast("bigint"))
    value = text.try_cast(SPARK[kind])
    limits = {USHORT: 1 << 16, UINT: WORD}
    if kind in limits:
        return F.when((value >= 0) & (value < limits[kind]), value)
    return F.when(value >= 0, value) if kind == ULLONG else value
