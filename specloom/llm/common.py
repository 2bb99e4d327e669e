"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.staging import drop_table, shared_dir, written  # noqa: F401

#: White space of the text contracts: space and U+0009 to U+000D.
WS_CHARS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
WS_RUN = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, through Spark's reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    """Lower-case A to Z only."""
    return F.translate(c, UPPER, UPPER.lower())


def words_of(text: Column) -> Column:
    """Array of the words of a text; empty for a null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WS_RUN), lambda w: w != "")


def column_name(df: DataFrame, stem: str) -> str:
    """``stem``, lengthened until the frame has no such column."""
    have = {c.lower() for c in df.columns}
    while stem.lower() in have:
        stem += "_"
    return stem


def running_totals(df: DataFrame, order: list[Column], totals: dict[str, str]) -> DataFrame:
    """``df`` with the running sums of columns, each row's own value included, in the order given.

    Rows are dealt out by range; what is added up over the ranges is a row a
    range, so that no task has all rows.
    """
    at, part = column_name(df, "row_at"), column_name(df, "row_part")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = written(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())).withColumn(part, F.shiftright(at, 33))
    upto = W.partitionBy(part).orderBy(at).rowsBetween(W.unboundedPreceding, W.currentRow)
    per = d.groupBy(part).agg(*[F.sum(c).alias(name) for c, name in totals.items()])
    before = per.select(F.col(part).alias("of"), *[(F.sum(name).over(W.orderBy(part)) - F.col(name)).alias(f"before_{name}") for name in totals.values()])  # a row a range
    j = d.withColumns({name: F.sum(c).over(upto) for c, name in totals.items()}).join(F.broadcast(before), F.col(part) == F.col("of")).drop("of", at, part)
    return j.withColumns({name: F.col(name) + F.col(f"before_{name}") for name in totals.values()}).drop(*[f"before_{name}" for name in totals.values()])


def null_safe(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]]) -> Column:
    return reduce(lambda a, b: a & b, [left[x].eqNullSafe(right[y]) for x, y in keys])


def key_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal keys of a sorted partition, whole however the batches fall."""
    rest: list[pa.Table] = []
    held: tuple | None = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(b.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        at = [0, *np.flatnonzero(new).tolist(), b.num_rows]
        whole = pa.Table.from_batches([b])
        for i, j in zip(at, at[1:], strict=False):
            key = tuple(c[i] for c in cols)
            if held is not None and key != held:
                yield pa.concat_tables(rest)
                rest = []
            rest.append(whole.slice(i, j - i))
            held = key
    if rest:
        yield pa.concat_tables(rest)
