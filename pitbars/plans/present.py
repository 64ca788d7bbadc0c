"""Turning result tables into a comparable shape.

A spec is a string of ``kind:column`` words: ``t`` instant as text, ``f`` double rounded to six
places, ``i`` long, ``b`` boolean; a bare word is passed through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIGITS = 6


def parse_spec(spec: str) -> list[tuple[str, str]]:
    out = []
    for word in spec.split():
        kind, _, name = word.rpartition(":")
        out.append((kind or "s", name))
    return out


def present(df: DataFrame, spec: str) -> DataFrame:
    cols = []
    for kind, name in parse_spec(spec):
        c = F.col(f"`{name}`")
        if kind == "t":
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif kind == "f":
            # adding zero turns -0.0 into 0.0
            c = F.round(c.cast("double"), DIGITS) + F.lit(0.0)
        elif kind == "i":
            c = c.cast("long")
        elif kind == "b":
            c = c.cast("boolean")
        cols.append(c.alias(name))
    return df.select(*cols)
