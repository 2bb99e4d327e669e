"""A vector index of cells: chunks stored by their nearest centroid, of which a search reads a few."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..sources.staging import written


@dataclass(frozen=True)
class CellIndex:
    """Tables under ``root``: centroids (cell, centroid) and chunks, in a folder a cell."""

    spark: SparkSession
    root: str

    def build(self, chunk: DataFrame, cells: int = 64, sample_rows: int = 65536, task_rows: int = 50_000, seed: int = 1) -> CellIndex:
        """Index ``chunk`` (embedding and more).

        The centroids are fitted by k-means on cosine over at most
        ``sample_rows`` chunks, drawn by a hash of the row; every chunk with a
        usable vector is stored.  Chunks whose vector is null, zero or not
        finite have no distance to anything and are left out.  Chunks are dealt
        out by ranges of cell and hash, about ``task_rows`` a task, so a hot cell
        is not one task.
        """
        bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
        usable = chunk.filter(F.col("embedding").isNotNull() & (V.l2_norm(F.col("embedding")) > 0) & ~F.exists("embedding", bad))
        unit = lambda df: df.withColumn("_unit", array_to_vector(V.normalize(F.col("embedding"))))
        order = F.xxhash64(F.lit(seed), *[f.name for f in chunk.schema if "map<" not in f.dataType.simpleString()])
        n_rows = usable.count()
        # about as many as wanted are left before one task takes them in order
        drawn = usable if n_rows <= sample_rows else usable.filter(F.pmod(order, F.lit(n_rows)) < int(1.05 * sample_rows) + 100)
        sample = unit(written(drawn.select("embedding", order.alias("_order")).orderBy("_order").limit(sample_rows)).select("embedding"))
        if sample.isEmpty():
            usable.withColumn("cell", F.lit(0)).write.parquet(f"{self.root}/chunks")  # a folder a cell would leave no schema to read
            self.spark.createDataFrame([], "cell int, centroid array<double>").write.parquet(f"{self.root}/centroids")
            return self
        model = KMeans(k=max(2, cells), distanceMeasure="cosine", seed=seed, maxIter=10, featuresCol="_unit", predictionCol="cell").fit(sample)
        rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
        self.spark.createDataFrame(rows, "cell int, centroid array<double>").coalesce(1).write.parquet(f"{self.root}/centroids")
        placed = model.transform(unit(usable)).drop("_unit")
        n = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), n_rows // task_rows)
        dealt = placed.withColumn("_order", order).repartitionByRange(n, "cell", "_order").sortWithinPartitions("cell").drop("_order")
        dealt.write.partitionBy("cell").option("compression", "zstd").parquet(f"{self.root}/chunks")
        return self

    def nearest(self, query: Sequence[float], probes: int) -> list[int]:
        """The ``probes`` cells whose centroids are nearest to ``query``."""
        rows = self.spark.read.parquet(f"{self.root}/centroids").orderBy("cell").collect()  # as many as cells
        x, q = np.array([r["centroid"] for r in rows], np.float64), np.asarray(query, np.float64)
        if not len(x):
            return []
        near = x @ q / np.maximum(np.linalg.norm(x, axis=1), np.finfo(float).tiny)
        return [rows[i]["cell"] for i in np.argsort(-near, kind="stable")[:probes]]

    def probe(self, query: Sequence[float], probes: int) -> DataFrame:
        """The chunks of the ``probes`` nearest cells, for ``search`` in place of all chunks; other cells are not read."""
        chunks = self.spark.read.parquet(f"{self.root}/chunks")
        return chunks.filter(F.col("cell").isin(self.nearest(query, probes))).drop("cell")
