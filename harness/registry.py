"""Named queries: a Spark callable and, where SQL can say it, the DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from harness.oracle import oracle
from lagwell.plans.scale import short_methods

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
_loaded = False


def tidy(df: DataFrame, keep: list[str], exact: bool = False) -> DataFrame:
    """Keep the named columns as they are; everything else becomes a double of 6 places."""
    if exact:
        return df.select(*keep)
    return df.selectExpr(*keep, *[f"{_rounded(f.name, f.dataType)} as `{f.name}`" for f in df.schema.fields if f.name not in keep])


def _rounded(name: str, kind: T.DataType) -> str:
    """A column as a double of 6 places. Whole numbers need no rounding; Spark's own goes through decimal text, at microseconds a value.

    Below 1e6 the scaled value is exact to a tenth of the offset, and dividing a whole number by 1e6 gives the nearest double, as text does.
    """
    x = f"cast(`{name}` as double)"
    if isinstance(kind, (T.IntegralType, T.BooleanType)):
        return f"{x} + 0D"
    x = f"({x} + 1e-9D)"
    return f"case when abs({x}) < 1e6D then signum({x}) * floor(abs({x}) * 1e6D + 0.5D) / 1e6D else round({x}, 6) end + 0D"


def query(name: str, keep: list[str], sql: str | None = None, needs=(), exact: bool = False):
    """Register fn(spark, dir) under name; sql is the body of its oracle."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, d: tidy(fn(short_methods(spark), d), keep, exact)
        if sql is not None:
            ORACLES[name] = oracle(sql, *needs, keep=keep, exact=exact)
        return fn

    return wrap


def load() -> None:
    """Import every module that registers queries, once; a module that was imported before has registered its own."""
    global _loaded
    if _loaded:
        return
    import importlib
    import importlib.util

    for m in ("lagging", "cleaning", "joining", "seasons", "starters", "runs", "ordering",
              "evaluation", "modelling", "sourcing", "daily"):
        if importlib.util.find_spec(f"harness.q_{m}"):
            importlib.import_module(f"harness.q_{m}")
    _loaded = True
