"""The registered queries by name, and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    """Register a function of (spark, sf_dir) under its name; ``sql`` is its twin, None where SQL can't express it."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc32_sql(text: str) -> str:
    """CRC-32 of a text in DuckDB: each byte enters, then eight shifts, with the polynomial wherever a one falls out."""
    digits = f"hex(encode({text}))"
    steps = f"flatten(list_transform(range(0, length({digits}) // 2), lambda i: [('0x' || substr({digits}, 2 * i + 1, 2))::BIGINT, 0, 0, 0, 0, 0, 0, 0]))"
    return f"xor(list_reduce({steps}, lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1)), 4294967295::BIGINT), 4294967295::BIGINT)"
