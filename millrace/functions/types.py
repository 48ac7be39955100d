"""Declared types and date patterns in Spark's terms."""

from __future__ import annotations

import re

INTEGERS = {"TINYINT": "tinyint", "SMALLINT": "smallint", "INTEGER": "int", "INT": "int", "BIGINT": "bigint", "INT8": "bigint"}
WIDE = {"HUGEINT": "decimal(38,0)", "UBIGINT": "decimal(38,0)", "UTINYINT": "smallint", "USMALLINT": "int", "UINTEGER": "bigint"}
OTHERS = {
    "VARCHAR": "string", "TEXT": "string", "STRING": "string", "CHAR": "string",
    "DOUBLE": "double", "FLOAT8": "double", "FLOAT": "float", "REAL": "float",
    "BOOLEAN": "boolean", "BOOL": "boolean", "DATE": "date", "TIMESTAMP": "timestamp_ntz",
    "TIMESTAMP_NS": "timestamp_ntz", "TIMESTAMP_US": "timestamp_ntz", "TIMESTAMP_MS": "timestamp_ntz",
}
_DECIMAL = re.compile(r"(?:DECIMAL|NUMERIC)\s*(?:\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\))?$")
#: Types that a declared integer may widen to without rejecting the file.
WIDER = {"tinyint": 1, "smallint": 2, "int": 3, "bigint": 4}


def spark_type(declared: str) -> str:
    """The Spark type of a declared one; raises ValueError for what is not modelled."""
    name = declared.strip().upper()
    m = _DECIMAL.match(name)
    if m:
        return f"decimal({m[1] or 18},{m[2] or (0 if m[1] else 3)})"
    for table in (INTEGERS, WIDE, OTHERS):
        if name in table:
            return table[name]
    raise ValueError(f"unknown type {declared!r}")


def kind(declared: str) -> str:
    """integer, decimal, date, timestamp, text or plain."""
    t = spark_type(declared)
    if t.startswith("decimal"):
        return "integer" if declared.strip().upper() in WIDE else "decimal"
    return {"string": "text", "date": "date", "timestamp_ntz": "timestamp"}.get(t, "integer" if t in WIDER else "plain")


def widens(was: str, now: str) -> bool:
    """Whether values of ``was`` keep their meaning as ``now``."""
    if was == now:
        return True
    if was in WIDER:
        return WIDER.get(now, 0) >= WIDER[was] or now == "double" or now.startswith("decimal")
    return was == "float" and now == "double"


#: strftime directive to Java letters; the second form is for directives without a separator around them.
_DIRECTIVES = {
    "Y": ("y", "yyyy"), "y": ("yy", "yy"), "m": ("M", "MM"), "d": ("d", "dd"), "H": ("H", "HH"), "I": ("h", "hh"),
    "M": ("m", "mm"), "S": ("s", "ss"), "p": ("a", "a"), "b": ("MMM", "MMM"), "B": ("MMMM", "MMMM"), "j": ("D", "DDD"),
    "a": ("E", "E"), "A": ("EEEE", "EEEE"), "z": ("XX", "XX"),
}


def java_pattern(fmt: str, padded: bool = False) -> str:
    """A strftime format as a Java date pattern; lenient about leading zeros where fields are apart, unless ``padded`` (to write dates)."""
    out, at = [], 0
    while at < len(fmt):
        c = fmt[at]
        if c != "%":
            out.append(f"'{c}'" if c.isalpha() else "''" if c == "'" else c)
            at += 1
            continue
        d = fmt[at + 1 : at + 2]
        at += 2
        if d == "%":
            out.append("%")
        elif d == "f":
            if out and out[-1] == ".":
                out[-1] = "[.SSSSSS]"
            else:
                out.append("SSSSSS")
        elif d in _DIRECTIVES:
            packed = padded or fmt[at : at + 1] == "%" or (at >= 4 and fmt[at - 4] == "%")
            out.append(_DIRECTIVES[d][1 if packed else 0])
        else:
            raise ValueError(f"unknown directive %{d} in {fmt!r}")
    return "".join(out)


def swapped(fmt: str) -> str | None:
    """The twin of a format that begins with day and month (either way round); dates that begin with the year have none."""
    first, second = fmt[:2], fmt[3:5]
    if {first, second} == {"%d", "%m"} and fmt[2] != "%":
        return second + fmt[2] + first + fmt[5:]
    return None
