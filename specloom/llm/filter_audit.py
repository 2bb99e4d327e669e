"""What each of five filters removes in each of their 120 orders, from a histogram of failure masks.

A document's failures are five bits, worked out once by DataFrame expressions.
Texts are grouped by their SHA-256, which stands for the text so that only
narrow rows move, and the group's smallest doc_id says which rows repeat an
earlier one.  All that an order of filters does to a part of the documents
follows from how many of its documents have each of the 32 masks, so the orders
are enumerated from those cells and never look at documents again.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS_RUN, table, written

#: Fixed values of the filters.
LETTERS = "ABCDE"
MIN_WORDS = 50
MIN_DISTINCT_PERCENT = 65
MAX_UPPER_PERCENT = 5
MARKS = r"[#$%&*|]"

ORDERS = ["".join(p) for p in permutations(LETTERS)]


def text_mask(text: Column) -> Column:
    """Bits A to D of a text: too few words, too few distinct ones, too many capitals, a mark.  A null text counts as empty."""
    t = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(t, WS_RUN), "")
    n = F.size(words)
    fails = [
        n < MIN_WORDS,
        100 * F.size(F.array_distinct(words)).cast("long") < MIN_DISTINCT_PERCENT * n.cast("long"),
        100 * F.length(F.regexp_replace(t, "[^A-Z]+", "")).cast("long") > MAX_UPPER_PERCENT * F.length(t).cast("long"),
        t.rlike(MARKS),
    ]
    return sum((f.cast("int") * (1 << k) for k, f in enumerate(fails)), F.lit(0))


def failure_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic: a row per row of ``docs``.

    ``part`` is the source (null: an empty string), ``mask`` has bit k for
    failing the k-th filter; E fails where a smaller doc_id has the same text,
    so rows that repeat a doc_id and its text don't fail by each other, and a
    row without a doc_id neither fails nor is earlier than another.  ``good``
    and ``toxic``: a label says so (of several labels any); a document without
    labels is neither.  Other columns play no part; an empty table gives no
    rows.
    """
    rows = written(docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text_mask(F.col("text")).alias("texts"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest")))
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("first")).filter("first IS NOT NULL").withColumnRenamed("digest", "of")
    judged = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("labelled")).agg(*[F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))])
    # both joins are on the document, so a text with very many copies is no hot key
    j = rows.join(firsts, (F.col("doc_id") == F.col("first")) & (F.col("digest") == F.col("of")), "left").join(judged, F.col("doc_id") == F.col("labelled"), "left")
    repeats = F.col("doc_id").isNotNull() & F.col("first").isNull()
    no = F.lit(False)
    return j.select("part", (F.col("texts") + repeats.cast("int") * 16).alias("mask"), F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))


def mask_cells(masks: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: at most 32 rows a part, summed before the shuffle."""
    return masks.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("good").cast("long")).alias("good"), F.sum(F.col("toxic").cast("long")).alias("toxic"))


def order_effects(cells: DataFrame) -> DataFrame:
    """A row per part, order of the filters and step, from ``mask_cells``.

    A filter at a step removes the documents that fail it and none before it.
    Over all orders, a document that fails k filters is removed by each of them
    in 120 / k orders, which gives ``shapley`` from the cells too.
    """
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # at most 32 a part
    orders = parts.withColumn("filter_order", F.explode(F.array(*map(F.lit, ORDERS)))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))))
    bit = lambda part_of: sum((F.contains(part_of, F.lit(x)).cast("int") * (1 << k) for k, x in enumerate(LETTERS)), F.lit(0))
    steps = orders.withColumns({"before": bit(F.expr("substring(filter_order, 1, step - 1)")), "own": bit(F.expr("substring(filter_order, step, 1)"))})
    before, own = F.col("before"), F.col("own")

    def total(of, what: str = "n") -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda s, c: s + F.when(of(c["mask"]), c[what]).otherwise(F.lit(0).cast("long")))

    has = lambda m, bits: m.bitwiseAND(bits) != 0
    removed = lambda m: has(m, own) & ~has(m, before)
    share = F.aggregate("cells", F.lit(0).cast("long"), lambda s, c: s + F.when(has(c["mask"], own), F.expr(str(len(ORDERS))).cast("long") * c["n"] / F.bit_count(c["mask"])).otherwise(0).cast("long"))
    return steps.select(
        "part", "filter_order", "step",
        total(lambda m: ~has(m, before.bitwiseOR(own))).alias("kept"), total(removed).alias("removed"),
        total(lambda m: has(m, own) & has(m, before)).alias("redundant"), total(lambda m: m == own).alias("unique_fails"),
        total(removed, "good").alias("good_lost"), total(removed, "toxic").alias("toxic_lost"), share.alias("shapley"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return order_effects(mask_cells(failure_masks(docs.select("doc_id", "source", "text"), labels)))


OP13_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), judged AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), masks AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         (len(ws) < 50)::INT + 2 * (100 * len(list_distinct(ws)) < 65 * len(ws))::INT
         + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
         + 16 * coalesce(x.doc_id > min(x.doc_id) OVER (PARTITION BY t), false)::INT AS mask
  FROM texts x LEFT JOIN judged j ON j.doc_id = x.doc_id
), cells AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM masks GROUP BY part, mask
), letter(x, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letter a, letter b, letter c, letter d, letter e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31
), steps AS (
  SELECT filter_order, step::INT AS step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM orders, range(1, 6) s(step)
), effects AS (
  SELECT part, filter_order, step, own,
         coalesce(sum(n) FILTER (WHERE mask & (before | own) = 0), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (WHERE mask & own <> 0 AND mask & before = 0), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (WHERE mask & own <> 0 AND mask & before <> 0), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (WHERE mask = own), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (WHERE mask & own <> 0 AND mask & before = 0), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (WHERE mask & own <> 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM effects
"""
