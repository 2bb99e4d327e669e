"""Whitelists, statistics, coverage envelope and roles."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..errors import Conflict, Forbidden, Unauthorized
from .constraints import missing

RANK = {"read": 1, "write": 2, "admin": 3}


def add_missing(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` and those of ``rows`` whose key it lacks; of repeats in ``rows`` one."""
    return table.unionByName(rows.dropDuplicates(keys).join(table.select(keys), keys, "left_anti").select(table.columns))


def add_code(whitelist: DataFrame, code: str, label: str, **more: object) -> DataFrame:
    """``whitelist`` with one more code; a known code is a conflict."""
    if not whitelist.filter(F.col("code") == code).isEmpty():
        raise Conflict(f"{code!r} already exists")
    values = {"code": code, "label": label} | more
    row = whitelist.sparkSession.createDataFrame([tuple(values.get(c) for c in whitelist.columns)], whitelist.schema)
    return whitelist.unionByName(row)


def delete_code(whitelist: DataFrame, code: str, users: DataFrame, column: str) -> DataFrame:
    """``whitelist`` without a code, which may be unknown; one that ``users.column`` holds is a conflict."""
    rest = whitelist.filter(F.col("code") != code)
    if not missing(users.filter(F.col(column) == code), column, rest, "code").isEmpty():
        raise Conflict(f"{code!r} is in use")
    return rest


def codes(whitelist: DataFrame) -> DataFrame:
    return whitelist.select("code", "label").orderBy("code")


def code_usage(whitelist: DataFrame, users: DataFrame, column: str) -> DataFrame:
    """code, label and n_used, the rows of ``users`` with the code; codes in use that the whitelist lacks have no label."""
    used = users.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("code")).agg(F.count(F.lit(1)).alias("n_used"))
    return whitelist.select("code", "label").join(used, "code", "full").fillna(0, ["n_used"]).orderBy("code")


def stats(node: DataFrame, spec_dimension: DataFrame) -> DataFrame:
    """One row: nodes, dimensions."""
    n = node.agg(F.count(F.lit(1)).alias("nodes"), F.lit(0).alias("dimensions"))
    d = spec_dimension.agg(F.lit(0).alias("nodes"), F.count(F.lit(1)).alias("dimensions"))
    return n.unionByName(d).agg(F.max("nodes").cast("long").alias("nodes"), F.max("dimensions").cast("long").alias("dimensions"))


@dataclass(frozen=True)
class Coverage:
    partial: bool = False
    denied_scopes: list[str] = field(default_factory=list)
    sources_unreached: list[str] = field(default_factory=list)


def coverage(rows: DataFrame, k: int) -> DataFrame:
    """One row: n_rows and partial, true if a search for ``k`` may have left rows out."""
    return rows.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("partial", F.col("n_rows") >= k)


def exact_coverage(one_more: DataFrame, k: int) -> DataFrame:
    """The same from a search for ``k + 1``: partial only if there are more than ``k``."""
    return one_more.agg(F.count(F.lit(1)).alias("n")).select(F.least("n", F.lit(k)).alias("n_rows"), (F.col("n") > k).alias("partial"))


def role_of(key: str, settings: Settings | None = None) -> str | None:
    """Role of an API key; of roles with equal keys the higher one."""
    s = settings or Settings()
    return {s.api_key_read: "read", s.api_key_write: "write", s.api_key_admin: "admin"}.get(key)


def require_role(key: str, minimum: str, settings: Settings | None = None) -> str:
    role = role_of(key, settings)
    if role is None:
        raise Unauthorized("invalid api key")
    if RANK[role] < RANK[minimum]:
        raise Forbidden("insufficient role")
    return role


def role_rank(role: F.Column) -> F.Column:
    out = F.lit(None).cast("int")
    for name, rank in RANK.items():
        out = F.when(role == name, rank).otherwise(out)
    return out
