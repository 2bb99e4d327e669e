"""Joins in time: the row in force at a moment, and spans that overlap."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.staging import written

#: Rows of a range of an as-of join, about.
RANGE_ROWS = 100_000
#: Rows of a key, of both sides together, up to which an overlap join compares all of them.
KEY_ROWS = 4_000
#: Bins of a level are 2^LEVEL_STEP times as wide as those of the level below.
LEVEL_STEP = 3


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], time: str, right_time: str, carry: dict[str, str], ties: list[str] | None = None, strict: bool = False) -> DataFrame:
    """``left`` with columns of the latest row of ``right`` with its keys, at or before its time.

    ``carry`` names columns of ``right`` and what they are called in the
    result; ``ties`` are columns of ``right`` that order rows of one moment,
    the last one counts (of rows alike in those too, any that is the last by
    ``carry``).  ``strict``: only rows before the time.  Null keys match
    nothing, a null time of ``left`` neither; rows of ``right`` without a time
    are never in force.  Every row of ``left`` stays, repeated ones too; its
    columns must not be called like the new ones.

    Both sides are dealt out together by ranges of keys and time and sorted, so
    that a key with very many rows runs over several ranges; there are as many
    ranges as the rows ask for.  What a range
    hands on is the row in force at its end for its last key: at most two rows
    a range are looked at to carry it on.
    """
    clash = set(carry.values()) & set(left.columns)
    if clash:
        raise ValueError(f"columns that are there already: {sorted(clash)}")
    ties = ties or []
    key, known = [f"_k{i}" for i in range(len(keys))], reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    payload = F.struct(*[F.col(c).alias(n) for c, n in carry.items()])
    tie = F.struct(*[F.col(c) for c in ties], *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)])
    kinds = right.select(payload.alias("p"), tie.alias("t")).schema
    rows = left.select(*[F.col(k).alias(n) for k, n in zip(keys, key, strict=True)], F.col(time).alias("_time"), F.lit(0 if strict else 1).alias("_side"), F.lit(None).cast(kinds["t"].dataType).alias("_tie"), F.lit(None).cast(kinds["p"].dataType).alias("_new"), F.struct(*[F.col(c) for c in left.columns]).alias("_row"))
    news = right.filter(known & F.col(right_time).isNotNull()).select(*[F.col(k).alias(n) for k, n in zip(keys, key, strict=True)], F.col(right_time).alias("_time"), F.lit(1 if strict else 0).alias("_side"), tie.alias("_tie"), payload.alias("_new"), F.lit(None).cast(left.select(F.struct(*[F.col(c) for c in left.columns])).schema[0].dataType).alias("_row"))
    both = rows.unionByName(news)
    n = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), both.count() // RANGE_ROWS)
    order = [*key, "_time", "_side", "_tie"]
    sorted_ = written(both.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))

    upto = W.partitionBy("_part", *key).orderBy("_at").rowsBetween(W.unboundedPreceding, W.currentRow)
    # dealt out by range here too, so that a task's rows do not grow with the tables
    own = sorted_.repartition(n, "_part").withColumn("_own", F.last("_new", ignorenulls=True).over(upto)).filter("_row IS NOT NULL").drop("_new", "_tie")
    # the first and the last key of each range, with the row in force at the key's end there
    ends = sorted_.groupBy("_part").agg(F.min_by(F.struct(*key), "_at").alias("lo"), F.max_by(F.struct(*key), "_at").alias("hi"))
    last = sorted_.filter("_new IS NOT NULL").groupBy("_part", *key).agg(F.max_by("_new", "_at").alias("_last"))
    edge = ends.select("_part", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("k"), "lo").select("_part", F.col("k").eqNullSafe(F.col("lo")).alias("_first"), *[F.col(f"k.{k}").alias(k) for k in key])
    edge = edge.join(last, ["_part", *key], "left")
    before = W.partitionBy(*key).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    carried = edge.withColumn("_carried", F.last("_last", ignorenulls=True).over(before)).filter(F.col("_first") & F.col("_carried").isNotNull()).select("_part", *key, "_carried")
    j = own.join(F.broadcast(carried), ["_part", *key], "left")  # a row a range at most
    found = F.when(F.col("_time").isNotNull() & reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key]), F.coalesce("_own", "_carried"))
    return j.select(found.alias("_found"), "_row").select(*[F.col(f"_row.`{c}`").alias(c) for c in left.columns], *[F.col(f"_found.`{c}`").alias(c) for c in carry.values()])


_ENDLESS = 1 << 61


def _ticks(df: DataFrame, column: str) -> Column:
    """A column of times or whole numbers as long."""
    kind = dict(df.dtypes)[column]
    if kind == "timestamp_ntz":
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(column))
    if kind == "timestamp":
        return F.unix_micros(F.col(column))
    if kind == "date":
        return F.unix_date(F.col(column)).cast("long")
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return F.col(column).cast("long")
    raise ValueError(f"{column}: spans of {kind} can't be joined")


def _spans(df: DataFrame, span: tuple[str, str], keys: list[str]) -> DataFrame:
    """The rows with keys and a span that isn't empty, written once."""
    start, end = _bounds(df, span)
    return written(df.filter(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys], start < end)))


def _bounds(df: DataFrame, span: tuple[str, str]) -> list[Column]:
    """Start and end (half open) as long."""
    return [F.coalesce(_ticks(df, c), F.lit(x)) for c, x in zip(span, (-_ENDLESS, _ENDLESS), strict=True)]


def _flat(df: DataFrame, span: tuple[str, str], keys: list[str], side: str) -> DataFrame:
    """Keys, start, end and the columns under names of the side; those that nobody reads are not moved."""
    start, end = _bounds(df, span)
    return df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], start.alias(f"_s{side}"), end.alias(f"_e{side}"), *[F.col(c).alias(f"_{side}{i}") for i, c in enumerate(df.columns)])


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[str, str], right_span: tuple[str, str]) -> DataFrame:
    """Pairs of rows with equal keys whose half-open spans overlap, as the structs ``l`` and ``r``, each pair once.

    Spans are of timestamps, dates or whole numbers, of one kind on both sides.
    A null start or end is open; empty spans and null keys match nothing; with
    no keys all rows are of one key.  Repeated rows make a pair each.

    Both sides are written once.  A key of at most ``KEY_ROWS`` rows meets
    whole, so that its rows move once; the rows of larger keys meet by bins of
    time.
    """
    a = _spans(left, left_span, keys)
    b = a if right is left and right_span == left_span else _spans(right, right_span, keys)
    l, r = _flat(a, left_span, keys, "l"), _flat(b, right_span, keys, "r")  # noqa: E741
    key = [f"_k{i}" for i in range(len(keys))]
    large = _large_keys(l, r, key) if keys else None
    if large is None:
        out = _met_by_bins(l, r, key)
    elif large.isEmpty():
        out = _met_whole(l, r, key)
    else:
        parts = [[df.join(large, key, how) for df in (l, r)] for how in ("left_anti", "left_semi")]
        out = _met_whole(*parts[0], key).unionByName(_met_by_bins(*parts[1], key))
    row = lambda df, side: F.struct(*[F.col(f"_{side}{i}").alias(c) for i, c in enumerate(df.columns)]).alias(side)
    return out.select(row(a, "l"), row(b, "r"))


def _large_keys(l: DataFrame, r: DataFrame, key: list[str]) -> DataFrame:  # noqa: E741
    """Keys of both sides with more than ``KEY_ROWS`` rows: at most a row for so many."""
    sides = l.select(*key, F.lit(1).alias("_nl"), F.lit(0).alias("_nr")).unionByName(r.select(*key, F.lit(0).alias("_nl"), F.lit(1).alias("_nr")))
    n = sides.groupBy(*key).agg(F.sum("_nl").alias("_nl"), F.sum("_nr").alias("_nr"))
    return written(n.filter(f"_nl > 0 AND _nr > 0 AND _nl + _nr > {KEY_ROWS}").select(*key))


def _met_whole(l: DataFrame, r: DataFrame, key: list[str]) -> DataFrame:  # noqa: E741
    return l.join(r, key).filter("_sl < _er AND _sr < _el")


def _met_by_bins(l: DataFrame, r: DataFrame, key: list[str]) -> DataFrame:  # noqa: E741
    """Every span has a level by its length, at which it lies in one bin or two.

    A pair meets at the coarser of its two levels, where it is taken in its
    first common bin: so a span is written once or twice a level that the other
    side has, a key's rows are spread over bins, and there are no products of
    keys.
    """

    def levelled(df: DataFrame, side: str) -> DataFrame:
        # bins of a level are 2^level wide; a span is at home where it meets two of them at most
        length = F.col(f"_e{side}") - F.col(f"_s{side}")
        bits = F.length(F.bin(length - 1)) * (length > 1).cast("int")
        return df.withColumn("_level", (F.ceil(bits / LEVEL_STEP) * LEVEL_STEP).cast("int"))

    sides = {"l": levelled(l, "l"), "r": levelled(r, "r")}
    levels = {s: sorted(x[0] for x in df.select("_level").distinct().collect()) for s, df in sides.items()}  # 22 at most

    def dealt(side: str, at: list[int], coarser: bool) -> DataFrame:
        """The spans at their own level, or at those levels of the other side that are coarser."""
        df = sides[side]
        df = df.withColumn("_level", F.explode(F.filter(F.array(*map(F.lit, at)), lambda x: x > F.col("_level")))) if coarser else df
        first, last = (F.expr(f"shiftright({c}, _level)") for c in (f"_s{side}", f"_e{side} - 1"))
        return df.withColumns({f"_first{side}": first, "_bin": F.explode(F.sequence(first, last))})

    def pairs(a: DataFrame, b: DataFrame) -> DataFrame:
        j = a.join(b, [*key, "_level", "_bin"])
        return j.filter("_sl < _er AND _sr < _el AND _bin = greatest(_firstl, _firstr)").drop("_level", "_bin", "_firstl", "_firstr")

    home = {s: dealt(s, [], False) for s in sides}
    out = pairs(home["l"], home["r"])
    if any(x > min(levels["r"], default=99) for x in levels["l"]):
        out = out.unionByName(pairs(home["l"], dealt("r", levels["l"], True)))
    if any(x > min(levels["l"], default=99) for x in levels["r"]):
        out = out.unionByName(pairs(dealt("l", levels["r"], True), home["r"]))
    return out
