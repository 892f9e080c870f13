"""Registry of named queries and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusloom.plans.derived import CALL_ORDER, Tables
from locusloom.plans.views import with_views
from locusloom.operators.merge import DEFAULT_RULES, MergeRules, merge_multi_sample
from locusloom.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of ``Tables`` under a name, with equivalent SQL where there is one."""
    def add(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(Tables(configure(spark), sf_dir))

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = with_views(sql)
        return build
    return add


def merged(t: Tables, rules: MergeRules = DEFAULT_RULES) -> DataFrame:
    return merge_multi_sample(t.panel(), t.calls(), t.imputed(), rules, CALL_ORDER, CALL_ORDER)


def r6(column: Column | str) -> Column:
    """Six decimals, and 0.0 for a negative zero."""
    return F.round(F.col(column) if isinstance(column, str) else column, 6) + F.lit(0.0)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in columns})


def stamp(column: str) -> Column:
    """A timestamp as text with microseconds, independent of the session's zone."""
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def sql_stamp(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f')"
