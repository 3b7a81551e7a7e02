"""IP address syntax as one regular expression, built from the grammar."""

from __future__ import annotations

from pyspark.sql import Column

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_V4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_HEX = r"[0-9A-Fa-f]{1,4}"


def _v6() -> str:
    """Eight groups; ``::`` stands for one or more; the last two may be dotted IPv4."""
    forms = [rf"(?:{_HEX}:){{7}}{_HEX}", rf"(?:{_HEX}:){{6}}{_V4}"]
    for left in range(8):
        head = "" if left == 0 else _HEX + rf"(?::{_HEX}){{{left - 1}}}"
        right = 7 - left
        tail = [rf"{_HEX}(?::{_HEX}){{0,{right - 1}}}"] if right >= 1 else []
        if right >= 2:
            tail.append(rf"(?:{_HEX}:){{0,{right - 2}}}{_V4}")
        forms.append(head + "::" + (rf"(?:{'|'.join(tail)})?" if tail else ""))
    return "(?:" + "|".join(forms) + r")(?:%[^%]+)?"


IP_PATTERN = rf"^(?:{_V4}|{_v6()})\z"


def is_ip(c: Column) -> Column:
    return c.rlike(IP_PATTERN)
