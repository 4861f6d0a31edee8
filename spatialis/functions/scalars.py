"""Column functions that several operators use."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def hashed(*keys: Column | str, salt: str) -> Column:
    """A number in [0, 1) hashed from the keys and an operator's own salt: the library's only randomness,
    the same under any partitioning."""
    parts = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(salt), *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def hashed_sql(*keys: str, salt: str) -> str:
    """`hashed` in DuckDB."""
    return f"(('0x' || substr(md5(concat_ws('|', '{salt}', {', '.join(f'cast({k} as varchar)' for k in keys)})), 1, 8))::bigint / 4294967296.0)"


def dot(a: Column | str, b: Column | str) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two vectors; null where one of them is zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def distance2(a: Column | str, b: Column | str) -> Column:
    """Squared Euclidean distance."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def all_equal(where: dict[str, object]) -> Column:
    """A conjunction of equalities."""
    return reduce(lambda a, b: a & b, (F.col(k) == F.lit(v) for k, v in where.items()), F.lit(True))


def log2p1(x: Column | str) -> Column:
    return F.log1p(x) / F.log(F.lit(2.0))
