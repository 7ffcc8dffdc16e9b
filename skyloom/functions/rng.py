"""Uniform numbers in [0, 1) that depend only on a seed, a stream name and a row's id, not on partitioning."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = float(1 << 52)


def u01(row_id: Column, seed: int = 0, stream: str = "u") -> Column:
    """From 52 bits of md5: the same in any SQL engine."""
    text = F.concat(F.lit(f"{stream}:{seed}|"), row_id.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(SCALE)


def u01_fast(row_id: Column, seed: int = 0, stream: str = "u") -> Column:
    """From xxhash64: about five times faster; use it where no other engine must agree."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(f"{stream}:{seed}"), row_id), 11).cast("double") / F.lit(float(1 << 53))


def u01_sql(row_id: str, seed: int = 0, stream: str = "u") -> str:
    """u01 as DuckDB SQL."""
    return f"(('0x' || substr(md5('{stream}:{seed}|' || ({row_id})::VARCHAR), 1, 13))::BIGINT / {SCALE})"


def u01_py(row_id, seed: int = 0, stream: str = "u") -> float:
    return int(hashlib.md5(f"{stream}:{seed}|{row_id}".encode()).hexdigest()[:13], 16) / SCALE


def normal(row_id: Column, seed: int = 0, stream: str = "n") -> Column:
    """Standard normal by Box and Muller."""
    a, b = u01_fast(row_id, seed, stream + ".r"), u01_fast(row_id, seed, stream + ".a")
    return F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - a)) * F.cos(F.lit(2.0) * F.pi() * b)
