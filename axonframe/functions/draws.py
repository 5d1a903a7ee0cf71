"""Seeded order of rows for repeatable uniform samples."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(seed: int, *columns: str) -> Column:
    """A 60-bit number from the row's key alone: the same in any engine, run or partitioning."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")
