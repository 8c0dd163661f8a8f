"""Rules lowered to expressions that Catalyst sees, where that is safe."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPECIAL = re.compile(r"([\\^$.|?*+()\[\]{}])")


def _literal(text: str) -> str:
    return _SPECIAL.sub(r"\\\1", text)


def lowered(column: Column, phi: list[str], psi: str, left: str = "", right: str = "", direction: str = "ltr") -> Column | None:
    """An obligatory rule phi -> psi / left __ right over literal strings as one regexp_replace; None if it isn't safe.

    Safe: every phi is one character, and no rewrite can make, break or overlap a context.
    Left contexts of left-to-right rules see outputs, so psi may share no character with
    the left context, nor may phi; likewise the right context for right-to-left rules.
    """
    if any(len(p) != 1 for p in phi) or not phi:
        return None
    live = set(left if direction == "ltr" else right) if direction != "sim" else set()
    if live & (set(psi) | set(phi)):
        return None
    look = (f"(?<={_literal(left)})" if left else "") + f"(?:{'|'.join(map(_literal, phi))})" + (f"(?={_literal(right)})" if right else "")
    return F.regexp_replace(column, look, psi.replace("\\", "\\\\").replace("$", "\\$"))
