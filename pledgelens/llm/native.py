"""Column expressions shared by the operators that stay inside Spark SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame

BLOCK = 256


def starts_sql(lengths: str) -> str:
    """Sum of the lengths before each entry of an array of numbers: sums of blocks first, then the entries behind each block's sum."""
    block = f"slice({lengths}, cast(b * {BLOCK} + 1 AS int), {BLOCK})"
    step = "(s, x) -> named_struct('at', s.at + x, 'out', array_append(s.out, s.at))"
    begin = lambda at: f"named_struct('at', {at}, 'out', cast(array() AS array<bigint>))"
    blocks = f"sequence(0, (size({lengths}) - 1) div {BLOCK})"
    sums = f"transform({blocks}, b -> aggregate({block}, 0L, (s, x) -> s + x))"
    offsets = f"aggregate({sums}, {begin('0L')}, {step}, s -> s.out)"
    entries = f"flatten(transform({offsets}, (at, b) -> aggregate({block}, {begin('at')}, {step}, s -> s.out)))"
    return f"CASE WHEN size({lengths}) = 0 THEN cast(array() AS array<bigint>) ELSE {entries} END"


def quoted(s: str) -> str:
    """A SQL string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Working column names that the table does not have: the given ones, with underscores before them until they are free."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
