"""Deterministic draws: every random choice is a hash of a seed, a stream name and a key, so plans are repeatable,
independent per stream, and the same on any number of executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _key(seed: int, stream: str, *key: Column | str) -> Column:
    return F.concat_ws(":", F.lit(str(seed)), F.lit(stream), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in key])


def u(seed: int, stream: str, *key: Column | str) -> Column:
    """Uniform in [0, 1) with 52 bits, exact in a double."""
    return F.conv(F.substring(F.sha2(_key(seed, stream, *key), 256), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def hash_order(seed: int, stream: str, *key: Column | str) -> Column:
    """A sort key that shuffles rows; ties can't occur unless keys are equal."""
    return F.sha2(_key(seed, stream, *key), 256)


def log_uniform(seed: int, stream: str, low: float, high: float, *key) -> Column:
    """Log-uniform in [low, high)."""
    return F.exp(F.log(F.lit(low)) + u(seed, stream, *key) * (F.log(F.lit(high)) - F.log(F.lit(low))))


def categorical(draw: Column, probabilities: list[float]) -> Column:
    """The index of the first class whose cumulated probability exceeds the draw; the last class if none does."""
    out, total = F.lit(len(probabilities) - 1), sum(probabilities)
    sums, acc = [], 0.0
    for p in probabilities[:-1]:
        acc += p / total
        sums.append(acc)
    for k in range(len(sums) - 1, -1, -1):
        out = F.when(draw < F.lit(sums[k]), F.lit(k)).otherwise(out)
    return out


def u_sql(seed: int, stream: str, *key: str) -> str:
    """The same draw in the SQL of the oracle."""
    parts = ", ".join(f"CAST({k} AS VARCHAR)" for k in key)
    return f"(CAST(('0x' || substr(sha256(concat_ws(':', '{seed}', '{stream}', {parts})), 1, 13)) AS BIGINT) / 4503599627370496.0)"


def hash_sql(seed: int, stream: str, *key: str) -> str:
    parts = ", ".join(f"CAST({k} AS VARCHAR)" for k in key)
    return f"sha256(concat_ws(':', '{seed}', '{stream}', {parts}))"
