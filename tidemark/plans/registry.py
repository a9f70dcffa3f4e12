"""Named queries over the driver's tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import TAIL_FAR, TAIL_LOW, TAIL_TOP

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_MODULES = ("features", "profiles", "relations", "orders", "evaluation", "comparison", "experiments", "models", "scalars")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, for sums depend on their order in the last place; integers as longs, dates as they are."""
    out = []
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType.typeName()
        if kind in ("double", "float"):
            c = F.round(c.cast("double") + F.lit(1e-9), digits) + F.lit(0.0)  # off the ties, which engines round differently
        elif kind in ("integer", "short", "byte"):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


def R(expr: str, name: str) -> str:
    """SQL for a rounded double."""
    return f"round(CAST({expr} AS DOUBLE) + 1e-9, 6) + 0.0 AS {name}"


def DICE(key: str, seed: int) -> str:
    """SQL for the number in [0, 1) that key and seed decide."""
    return f"(CAST(CAST('0x' || substr(md5(CAST({key} AS VARCHAR) || '#{seed}'), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656.0)"


def TAIL(z: str) -> str:
    """SQL for the normal tail of a column, by the same approximation as norm_sf."""
    x = f"abs({z})"
    poly = lambda ks: reduce(lambda a, k: f"({a} * {x} + {k!r}::DOUBLE)", ks[1:], f"{ks[0]!r}::DOUBLE")
    far = reduce(lambda a, k: f"({x} + {k} / {a})", ("4.0::DOUBLE", "3.0::DOUBLE", "2.0::DOUBLE", "1.0::DOUBLE"), f"({x} + 0.65::DOUBLE)")
    bell = f"exp(-{x} * {x} / 2)"
    up = f"CASE WHEN {x} < {TAIL_FAR!r}::DOUBLE THEN {bell} * {poly(TAIL_TOP)} / {poly(TAIL_LOW)} WHEN {x} < 37 THEN {bell} / {far} / 2.506628274631::DOUBLE ELSE 0.0 END"
    return f"(CASE WHEN {z} > 0 THEN {up} ELSE 1.0::DOUBLE - {up} END)"


#: The roles of the driver's tables as common table expressions; see roles.py for the same in Spark.
ROLES = """
tx AS (SELECT user_id AS customer_id, ts AS date, value AS amount, event_type AS type FROM events),
cu AS (SELECT c_custkey AS customer_id, c_acctbal AS balance, c_mktsegment AS segment, n_name AS city, CAST(c_nationkey AS BIGINT) AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey),
sc AS (SELECT l.doc_id AS id, CAST(quality AS BIGINT) AS y, CAST(toxic AS BIGINT) AS toxic, CAST(n_chars AS DOUBLE) AS s, CAST(n_chars AS DOUBLE) / (n_chars + 1500) AS p, lang, source FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
pr AS (SELECT o_orderkey AS id, o_totalprice / 1000 AS y, o_totalprice / 1000 + o_custkey % 17 - 8 AS a, o_totalprice / 1000 + (o_custkey * 7) % 23 - 11 AS b, o_orderpriority AS priority, o_orderstatus AS status, o_custkey AS cust, o_orderdate AS date FROM orders),
fo AS (SELECT strftime(o_orderdate, '%Y-%m') AS block, o_orderpriority AS treatment, round(avg(o_totalprice), 4) AS value FROM orders GROUP BY 1, 2)
"""


def query(name: str, sql: str | None = None):
    """Register fn(spark, sf_dir); sql may begin with further common table expressions after WITH."""

    def put(fn: Query) -> Query:
        _QUERIES[name] = lambda spark, sf_dir: rounded(fn(spark, sf_dir))
        if sql is not None:
            body = sql.strip()
            _SQL[name] = f"WITH {ROLES.strip()}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {ROLES.strip()} {body}"
        return fn

    return put


def _load() -> None:
    for m in _MODULES:
        importlib.import_module(f"tidemark.plans.{m}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
