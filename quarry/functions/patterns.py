"""Regular expressions between the Python and Java dialects."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal_pattern(text: str) -> str:
    """Pattern that matches ``text`` itself."""
    return r"\Q" + text.replace(r"\E", r"\E\\E\Q") + r"\E"


def java_pattern(pattern: str) -> str:
    r"""Python named groups in Java spelling; ``\w``, ``\d``, ``\s`` and ``\b`` know all of Unicode, as in Python."""
    renamed = re.sub(r"\(\?P<([A-Za-z]\w*)>", lambda m: f"(?<{m[1].replace('_', '')}>", pattern)
    return "(?U)" + re.sub(r"\(\?P=([A-Za-z]\w*)\)", lambda m: rf"\k<{m[1].replace('_', '')}>", renamed)


def java_replacement(text: str) -> str:
    r"""Python replacement text (``\1``, ``\g<1>``, ``\g<name>``) in Java spelling."""
    out, i = [], 0
    while i < len(text):
        named = re.match(r"\\g<(\w+)>", text[i:])
        number = re.match(r"\\(\d{1,2})", text[i:])
        if named:
            group = named[1]
            out.append(f"${group}" if group.isdigit() else "${" + group.replace("_", "") + "}")
            i += named.end()
        elif number:
            out.append(f"${number[1]}")
            i += number.end()
        elif text.startswith("\\n", i) or text.startswith("\\t", i):
            out.append("\n" if text[i + 1] == "n" else "\t")
            i += 2
        elif text.startswith("\\\\", i):
            out.append("\\\\")
            i += 2
        else:
            out.append("\\" + text[i] if text[i] in "$\\" else text[i])
            i += 1
    return "".join(out)


def strip_whitespace(col: Column, side: str = "both") -> Column:
    """Remove Unicode whitespace at one end or both (Spark's ``trim`` knows blanks only)."""
    ends = {"left": r"(?U)^\s+", "right": r"(?U)\s+\z", "both": r"(?U)^\s+|\s+\z"}
    if side not in ends:
        raise ValueError("side must be left, right or both")
    return F.regexp_replace(col, ends[side], "")
