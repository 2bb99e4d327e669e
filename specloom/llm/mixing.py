"""Mixing sources to target weights by weighted fair queueing.

Each source is a flow whose documents come in a keyed-hash order, up to
``max_epochs`` times, in packets of at most ``quantum`` words, so that one very
long document can't hold up its source.  A packet's virtual finish time is the
words of its source up to its end, all earlier passes included, over the
source's target.  All packets are dealt out by ranges of that time and sorted,
and the mix is what comes before the running total reaches the budget, the
words of all documents; of the packet at the cut the words that are left.
Nothing else ends a source: that it comes near its target follows from the
order.

Running totals are kept in two levels, within ranges and over a row a range, for
the words queued in each source and for the mix alike.  No task needs a whole
source, and of very many sources no task needs all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import column_name, running_totals, table, words_of, written

#: Words of a packet at most.
QUANTUM = 256


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """source, source_size, n_docs, target.

    ``sizes`` has source, source_size, n_docs, a row a source.  Sources by code
    point, null last, weigh ``weights`` in turn and share the sum of all sizes;
    no target exceeds ``max_epochs`` times its source's size.  The excess goes
    to the others by weight: that is a water level, at which exactly the
    sources with the smallest cap for their weight are full.
    """
    last = F.col("source").isNull()
    s = running_totals(sizes.withColumn("one", F.lit(1).cast("long")), [last, F.col("source")], {"one": "rank"}).drop("one")
    rank = (F.col("rank") - 1) % len(weights)
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (rank + 1).cast("int"))).withColumn("cap", F.col("source_size") * max_epochs).drop("rank")
    s = s.withColumn("level", F.col("cap") / F.col("weight"))
    s = running_totals(s, [F.col("level"), last, F.col("source")], {"cap": "full_caps", "weight": "full_weight"})
    # a source is full if the level reached with it and all before it full is at least its own; the order of equal levels does not matter
    s = s.join(F.broadcast(s.agg(F.sum("source_size").alias("total"), F.sum("weight").alias("all_weight"))))  # one row
    full = F.col("full_caps") + F.col("level") * (F.col("all_weight") - F.col("full_weight")) <= F.col("total")
    s = s.withColumn("full", full)
    rest = s.agg(F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))), F.lit(0)).alias("caps"), F.sum(F.when(~F.col("full"), F.col("weight"))).alias("share"))  # one row
    s = s.join(F.broadcast(rest)).withColumn("owed", F.col("total") - F.col("caps"))
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("owed") / F.col("share"))
    return s.select("source", "source_size", "n_docs", target.alias("target"))


def _order_hash(seed: str, doc: str) -> F.Column:
    """60 bits of MD5 over seed and id: a shuffled order that any engine can repeat."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc).cast("string"), F.lit("null")))), 1, 15), 16, 10).cast("long")


def queued_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3, seed: str = "mix", carry: tuple[str, ...] = ()) -> DataFrame:
    """row, doc_id, source, size, source_size, target, queued, order hash and ``carry``: ``queued`` are the words before the document in its source."""
    rows = docs.select("doc_id", "source", *carry, F.size(words_of(F.col("text"))).cast("long").alias("size"), _order_hash(seed, "doc_id").alias("h"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    targets = source_targets(sizes, weights, max_epochs)
    # one order for documents and sources, so that what is before a source can be taken off
    order = [F.col("source").asc_nulls_first(), F.col("h"), F.col("doc_id").asc_nulls_first(), F.col("size"), F.col("row")]
    targets = written(running_totals(targets, order[:1], {"source_size": "upto"}).withColumn("before", F.col("upto") - F.col("source_size")).drop("upto", "n_docs").withColumnRenamed("source", "of"))
    flow = running_totals(rows, order, {"size": "upto"}).join(targets, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    return flow.withColumn("queued", F.col("upto") - F.col("size") - F.col("before")).drop("upto", "before")


def mix_packets(queued: DataFrame, max_epochs: int = 3, quantum: int = QUANTUM) -> DataFrame:
    """``queued_documents`` with a row per packet of each pass: epoch, packet, words, finish (null where the target is 0)."""
    n = F.ceil(F.col("size") / quantum).cast("long")
    p = queued.filter("size > 0").withColumn("_n", n).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") * max_epochs - 1)))
    p = p.withColumns({"epoch": F.expr("_i div _n").cast("int"), "packet": F.col("_i") % F.col("_n")}).drop("_n", "_i")
    p = p.withColumn("words", F.least(F.lit(quantum), F.col("size") - F.col("packet") * quantum))
    done = F.col("epoch") * F.col("source_size") + F.col("queued") + F.col("packet") * quantum + F.col("words")
    return p.withColumn("finish", F.when(F.col("target") > 0, done / F.col("target")))


def mix_order(packets: DataFrame, budget: int) -> DataFrame:
    """``packets`` with position (from 1, in order of finish) and taken: the words that fit the budget in that order, and nothing else."""
    order = [F.col("finish").asc_nulls_last(), F.col("source").asc_nulls_first(), F.col("h"), F.col("doc_id").asc_nulls_first(), F.col("row"), F.col("epoch"), F.col("packet")]
    sorted_ = running_totals(packets.withColumn("one", F.lit(1).cast("long")), order, {"words": "running", "one": "position"}).drop("one")
    left = F.lit(budget) - F.col("running") + F.col("words")
    return sorted_.withColumn("taken", F.greatest(F.lit(0).cast("long"), F.least("words", left))).drop("running")


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3, seed: str = "mix", carry: tuple[str, ...] = (), quantum: int = QUANTUM) -> DataFrame:
    """A row per document: doc_id, source, size, source_size, target, taken, first_position, last_finish, and ``carry``.

    ``size`` is the number of words (null text: 0), ``taken`` the words that the
    mix takes of it over all passes; ``first_position`` is where its first
    packet stands in the mix, ``last_finish`` the virtual time at which its last
    one is done (both null if nothing is taken).  All taken words add up to all
    words; a source is within a packet of its target, or so, as the order has
    it.  A null source is a source of its own, the last to choose a weight; rows
    that share a doc_id are queued one after the other, the shorter first;
    documents without words are never taken; an empty table gives no rows.  The
    same rows, seed and weights give the same plan.
    """
    queued = written(queued_documents(docs, weights, max_epochs, seed, carry))
    budget = queued.agg(F.sum("size")).first()[0] or 0
    packets = mix_order(mix_packets(queued, max_epochs, quantum), budget)
    has = F.col("taken") > 0
    taken = packets.groupBy("row").agg(F.sum("taken").alias("taken"), F.min(F.when(has, F.col("position"))).alias("first_position"), F.max(F.when(has, F.col("finish"))).alias("last_finish"))
    done = queued.join(taken, "row", "left").fillna(0, ["taken"])
    return done.select("doc_id", "source", *carry, "size", "source_size", "target", "taken", "first_position", "last_finish")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3, seed: str = "mix") -> DataFrame:
    """``docs`` in the mix: each row as often as its taken words make it up.

    Texts stay whole: the pass that the budget cuts counts if at least half of
    it was taken.  Rows with the same doc_id and text share their copies, and
    the columns of one of them.  Texts without words, null ones included, are
    not in the mix; null ids and sources are as in ``mix_plan``; columns of any
    name pass through; an empty table gives no rows.
    """
    a, b, n = (column_name(docs, x) for x in ("row_hash", "row_hash_2", "copies"))
    # hashes that are never null, so that the rows of a key meet and join in one shuffle
    keyed = docs.withColumns({a: F.xxhash64("doc_id", "text"), b: F.xxhash64(F.lit("second"), "doc_id", "text")})
    plan = mix_plan(keyed.select("doc_id", "source", "text", F.col(a).alias("hash_1"), F.col(b).alias("hash_2")), weights, max_epochs, seed, carry=("hash_1", "hash_2"))
    copies = F.when(F.col("size") > 0, F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.col("size")))).otherwise(0)
    wanted = plan.groupBy(F.col("hash_1").alias(a), F.col("hash_2").alias(b)).agg(F.sum(copies).cast("int").alias(n)).filter(F.col(n) > 0)
    joined = keyed.dropDuplicates([a, b]).join(wanted, [a, b])
    return joined.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n)))).select([f"`{c}`" for c in docs.columns])


def op7_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix_plan(docs).select("doc_id", "size", "source_size", "target", "taken", "first_position", "last_finish")


OP7_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h
  FROM documents
), src AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w
  FROM sized GROUP BY source
), leveled AS (
  SELECT *, 3 * source_size AS cap, (3 * source_size) / w AS level, sum(source_size) OVER () AS total,
         sum(w) OVER () AS all_w
  FROM src
), filled AS (
  SELECT *, sum(cap) OVER (ORDER BY level) + level * (all_w - sum(w) OVER (ORDER BY level)) <= total AS is_full
  FROM leveled
), targets AS (
  SELECT source, source_size,
         CASE WHEN is_full THEN cap::DOUBLE
              ELSE (w * (total - coalesce(sum(cap) FILTER (WHERE is_full) OVER (), 0)))::BIGINT
                   / (sum(w) FILTER (WHERE NOT is_full) OVER ())::BIGINT END AS target
  FROM filled
), queued AS (
  SELECT s.*, t.source_size, t.target,
         (sum(size) OVER (PARTITION BY s.source ORDER BY h, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS queued
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), packets AS (
  SELECT *, least(256, size - 256 * packet) AS words FROM (SELECT *, unnest(range((size + 255) // 256)) AS packet FROM queued), range(3) e(epoch)
), timed AS (
  SELECT *, (epoch * source_size + queued + 256 * packet + words) / target AS finish FROM packets
), served AS (
  SELECT *, sum(words) OVER mix AS running, row_number() OVER mix AS position
  FROM timed WINDOW mix AS (ORDER BY finish, source NULLS FIRST, h, doc_id NULLS FIRST, size, epoch, packet ROWS UNBOUNDED PRECEDING)
), cut AS (
  SELECT *, greatest(0, least(words, (SELECT sum(size) FROM sized) - running + words)) AS taken FROM served
), taken AS (
  SELECT doc_id, sum(taken)::BIGINT AS taken, min(position) FILTER (WHERE taken > 0) AS first_position, max(finish) FILTER (WHERE taken > 0) AS last_finish FROM cut GROUP BY doc_id
)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(t.taken, 0)::BIGINT AS taken, t.first_position, t.last_finish
FROM queued q LEFT JOIN taken t ON q.doc_id = t.doc_id
"""
