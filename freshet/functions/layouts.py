"""Reference-time layouts ("2006-01-02 15:04:05") as Spark date patterns."""

from __future__ import annotations

import re

from ..errors import StatementError

_PARTS = [
    ("January", "MMMM"), ("Jan", "MMM"), ("Monday", "EEEE"), ("Mon", "EEE"), ("MST", "z"), ("2006", "yyyy"), ("-07:00", "xxx"), ("-0700", "xx"), ("-07", "x"), ("Z07:00", "XXX"), ("Z0700", "XX"),
    ("01", "MM"), ("02", "dd"), ("03", "hh"), ("04", "mm"), ("05", "ss"), ("06", "yy"), ("002", "DDD"), ("15", "HH"), ("PM", "a"), ("1", "M"), ("2", "d"), ("3", "h"), ("4", "m"), ("5", "s"),
]
_FRACTION = re.compile(r"[.,](0+|9+)(?!\d)")


def pattern(layout: str, parsing: bool) -> tuple[str, bool]:
    """(Spark pattern, whether trailing zeros of the fraction have to be cut from what it formats)."""
    out, at, cut, plain = [], 0, False, ""

    def flush():
        nonlocal plain
        if plain:
            out.append("'" + plain.replace("'", "''") + "'" if re.search("[A-Za-z'\\[\\]#{}]", plain) else plain)
            plain = ""

    while at < len(layout):
        fraction = _FRACTION.match(layout, at)
        if fraction and (at and layout[at - 1] == "5"):
            flush()
            digits = len(fraction[1])
            if digits > 9:
                raise StatementError("a fraction has nine digits at most")
            if fraction[1][0] == "9":
                cut = True
                out.append(f"[{layout[at]}{'S' * digits}]" if parsing else f"{layout[at]}{'S' * digits}")
            else:
                out.append(layout[at] + "S" * digits)
            at = fraction.end()
            continue
        for mark, letters in _PARTS:
            if layout.startswith(mark, at):
                flush()
                if parsing and mark == "05" and not _FRACTION.match(layout, at + 2):
                    letters += "[.SSSSSSSSS]"  # a fraction after the seconds is accepted though the layout has none
                out.append(letters)
                at += len(mark)
                break
        else:
            plain += layout[at]
            at += 1
    flush()
    return "".join(out), cut
