"""Numbers from 0 to 1 that depend on a key alone, the same in any engine with md5."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*key: Column | str | int) -> Column:
    """A number from 0 up to 1 by md5 of the key's parts, joined by colons."""
    parts = [k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in key]
    digest = F.md5(F.concat_ws(":", *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def plain_uniform(*key: str | int) -> float:
    """The same within a task."""
    return int(hashlib.md5(":".join(map(str, key)).encode()).hexdigest()[:8], 16) / 4294967296.0


def sql_uniform(*key: str) -> str:
    """DuckDB text of the same; constants of the key come quoted."""
    joined = ", ".join(f"({k})::varchar" for k in key)
    return f"(('0x' || substr(md5(concat_ws(':', {joined})), 1, 8))::bigint / 4294967296.0::double)"
