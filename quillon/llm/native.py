"""Column expressions on words that stay inside the JVM; used by the operators that take no Python on their main path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of the corpus contracts: space and \t \n \v \f \r.
WHITE = " \t\n\x0b\x0c\r"
WHITE_RUN = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The runs of non-white characters; an empty array for null, empty and white text."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WHITE_RUN))


def shingles(w: str, size: int = 5, joined: bool = False) -> Column:
    """Windows of ``size`` words of the array column ``w``: their 64-bit hashes, or their words joined by a space.

    Fewer words form one window; no words, none.
    """
    if joined:
        each = f"transform(sequence(1, size({w}) - {size - 1}), i -> array_join(slice({w}, i, {size}), ' '))"
        return F.expr(f"CASE WHEN size({w}) >= {size} THEN {each} WHEN size({w}) > 0 THEN array(array_join({w}, ' ')) ELSE cast(array() AS array<string>) END")
    parts = ", ".join(f"h[i + {k}]" for k in range(1, size))
    each = f"transform(array(transform({w}, x -> xxhash64(x))), h -> transform(slice(h, 1, size(h) - {size - 1}), (x, i) -> xxhash64(x, {parts})))[0]"
    return F.expr(f"CASE WHEN size({w}) >= {size} THEN {each} WHEN size({w}) > 0 THEN array(xxhash64(array_join({w}, ' '))) ELSE cast(array() AS array<bigint>) END")
