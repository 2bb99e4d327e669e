"""Ranked search by words: an inverted index as tables, and rank fusion with vectors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.staging import written

#: Runs of ASCII letters and digits and of whatever is not ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What lies between terms: the ASCII characters that TERM leaves out.
_BETWEEN = "".join(c for c in map(chr, range(128)) if not c.isalnum())
#: Terms of all queries up to which the scan is told them, so that it skips row groups.
MOST_LITERALS = 1000
#: Weights of all queries' terms, and blocks, in rows, up to which they are broadcast.
MOST_BROADCAST = 100_000
#: Documents that a task indexes, and scores that one sums, if there are enough of them.
TASK_DOCS, TASK_SCORES = 4096, 2_000_000


def terms(text: Column) -> Column:
    """The terms of a text in their order, A to Z in lower case; none for a null."""
    spaced = F.translate(text, UPPER + _BETWEEN, LOWER + " " * len(_BETWEEN))
    return F.coalesce(F.array_remove(F.split(spaced, " "), ""), F.array().cast("array<string>"))


@dataclass(frozen=True)
class LexicalIndex:
    """Tables under ``root``: postings (term, block, total, id, tf, words; the last three are arrays), blocks (term, block, n, top) and totals (n, words, blocks).

    Documents are dealt to blocks by a hash of their id, and a row of postings
    holds the documents of a block with a term, which are a few hundred at most.
    ``top`` is the most that one document of a block gets from a term, without
    the term's weight, so a sum of tops bounds every score in a block.  A task
    writes some blocks, their rows in order of term and block; so texts move
    once and postings never, and a search for few terms skips row groups.
    """

    spark: SparkSession
    root: str
    k1: float = 1.2
    b: float = 0.75

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{table}")

    def _tasks(self, least: int) -> int:
        return max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), least)

    def _gains(self, mean: float) -> Column:
        """What each document of a row of postings gets from the term, without its weight."""
        return F.zip_with("tf", "words", lambda tf, words: tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * words / F.lit(mean))))

    def build(self, docs: DataFrame, block_docs: int = 128) -> LexicalIndex:
        """Index ``docs`` (id, text); ids are unique and not null, texts may be null or empty.  Extra columns are ignored."""
        n_docs = docs.count()
        n_blocks = max(1, -(-n_docs // block_docs))
        placed = docs.select("id", "text", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).alias("block")).repartition(self._tasks(n_docs // TASK_DOCS), "block")
        each = placed.select("block", "id", terms(F.col("text")).alias("terms"))
        one = each.select("block", "id", F.size("terms").alias("words"), F.explode_outer("terms").alias("term")).filter("term IS NOT NULL")  # a plain explode would have texts split before the move too, for a filter
        # both groupings stay in their task, as a block does
        counted = one.groupBy("block", "term", "id", "words").agg(F.count(F.lit(1)).cast("int").alias("tf"))
        packed = counted.groupBy("block", "term").agg(F.collect_list(F.struct("id", "tf", "words")).alias("_docs"), F.sum("tf").alias("total"))
        rows = packed.select("term", "block", "total", *[F.col(f"_docs.{c}").alias(c) for c in ("id", "tf", "words")])
        rows.sortWithinPartitions("term", "block").write.option("compression", "zstd").parquet(f"{self.root}/postings")
        words = self.read("postings").agg(F.coalesce(F.sum("total"), F.lit(0)).cast("long").alias("words"))
        words.select(F.lit(n_docs).cast("long").alias("n"), "words", F.lit(n_blocks).cast("long").alias("blocks")).coalesce(1).write.parquet(f"{self.root}/totals")
        blocks = self.read("postings").select("term", "block", F.size("id").cast("long").alias("n"), F.array_max(self._gains(self._mean())).alias("top"))
        blocks.write.option("compression", "zstd").parquet(f"{self.root}/blocks")
        return self

    def _mean(self) -> float:
        t = self.read("totals").first()
        return max(1, t["words"]) / max(1, t["n"])

    def plan(self, queries: DataFrame, k: int, among: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """The query terms with their weights (query_id, term, idf), and the blocks (query_id, block) that may hold one of the best ``k``.

        The most promising blocks of a query are scored first; a block whose
        bound is below the score of the k-th document found there is left out.
        """
        t = self.read("totals").first()
        asked = queries.select("query_id", F.explode(terms(F.col("text"))).alias("term")).distinct()
        few = [r[0] for r in asked.select("term").distinct().limit(MOST_LITERALS + 1).collect()]
        known = self.read("blocks")
        if len(few) <= MOST_LITERALS:
            known = known.filter(F.col("term").isin(few))
        df = known.groupBy("term").agg(F.sum("n").alias("df"))
        weights = written(asked.join(df, "term").select("query_id", "term", F.log(1 + (t["n"] - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")))
        bounds = written(known.join(weights, "term").groupBy("query_id", "block").agg(F.sum(F.col("idf") * F.col("top")).alias("bound")))
        best = W.partitionBy("query_id").orderBy(F.desc("bound"), "block")
        first = bounds.withColumn("at", F.row_number().over(best)).filter(F.col("at") <= max(1, k)).select("query_id", "block")
        scored = self._scores(weights, first, among)
        rank = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
        kth = scored.withColumn("at", F.row_number().over(rank)).filter(F.col("at") <= k).groupBy("query_id").agg(F.min(F.when(F.col("at") == k, F.col("score"))).alias("kth"))
        # scores are rounded to six decimals
        open_ = bounds.join(kth, "query_id", "left").filter(F.col("kth").isNull() | (F.col("bound") >= F.col("kth") - 2e-6))
        return weights, written(open_.select("query_id", "block"))

    def _scores(self, weights: DataFrame, blocks: DataFrame, among: DataFrame | None) -> DataFrame:
        """query_id, id, score of the documents of ``blocks``."""
        t = self.read("totals").first()
        few = [r[0] for r in weights.select("term").distinct().limit(MOST_LITERALS + 1).collect()]
        postings = self.read("postings")
        if len(few) <= MOST_LITERALS:
            postings = postings.filter(F.col("term").isin(few))
        wanted = blocks.select("block").distinct()
        if wanted.count() <= MOST_BROADCAST:
            postings = postings.join(F.broadcast(wanted), "block", "left_semi")
        kind = postings.schema["id"].dataType.elementType
        found = F.arrays_zip(F.col("id"), self._gains(self._mean()).alias("gain"))
        if among is not None:
            ids = among.select(F.col("id").cast(kind).alias("id")).filter("id IS NOT NULL")
            allowed = ids.groupBy(F.pmod(F.xxhash64("id"), F.lit(t["blocks"])).alias("block")).agg(F.collect_set("id").alias("_ids"))
        else:
            allowed = None
        # gains are made after the move, as whole numbers are smaller on the way
        may = lambda rows: rows.withColumn("_found", found if allowed is None else F.filter(found, lambda x: F.array_contains("_ids", x["id"])))
        if weights.count() <= MOST_BROADCAST:
            # postings move once, to their block, and a block's scores are summed there
            n = self._tasks(min(t["blocks"], t["n"] * weights.select("query_id").distinct().count() // TASK_SCORES))
            own = blocks.groupBy("block").agg(F.collect_set("query_id").alias("_queries"))
            if allowed is not None:
                own = own.join(allowed, "block")
            here = postings.repartition(n, "block").join(own.repartition(n, "block").hint("shuffle_hash"), "block")
            each = may(here).join(F.broadcast(weights), "term").filter(F.array_contains("_queries", F.col("query_id")))
            hits = each.select("block", "query_id", "idf", F.explode("_found").alias("_one")).groupBy("block", "query_id", F.col("_one.id").alias("id"))
        else:
            here = postings if allowed is None else postings.join(allowed, "block")
            each = may(here).join(weights.join(blocks, "query_id"), ["term", "block"])
            hits = each.select("query_id", "idf", F.explode("_found").alias("_one")).groupBy("query_id", F.col("_one.id").alias("id"))
        return hits.agg(F.sum(F.col("idf") * F.col("_one.gain")).alias("score")).select("query_id", "id", F.round("score", 6).alias("score"))

    def search(self, queries: DataFrame, k: int = 12, among: DataFrame | None = None) -> DataFrame:
        """query_id, id, score, rank: the ``k`` documents of each query (query_id, text) with the highest BM25 score, ties by id.

        Documents without any of a query's terms are not found.  With ``among``
        (id), only those documents are, and none of the others takes a place.  A
        query's repeated terms count once; scores are rounded to six decimals.
        The result equals that of scoring every document.
        """
        if k < 0:
            raise ValueError("k must not be negative")
        weights, blocks = self.plan(queries, k, among)
        rank = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
        return self._scores(weights, blocks, among).withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)


def fused(first: DataFrame, second: DataFrame, k: int = 12, c: int = 60) -> DataFrame:
    """id, score: the ``k`` best of two rankings (id, rank) by the sum of 1 / (c + rank), ties by id."""
    both = first.select("id", F.col("rank").alias("_a")).join(second.select("id", F.col("rank").alias("_b")), "id", "full")
    part = lambda r: F.coalesce(1.0 / (F.lit(c) + F.col(r)), F.lit(0.0))
    return both.select("id", (part("_a") + part("_b")).alias("score")).orderBy(F.desc("score"), "id").limit(k)
