"""Append-only, versioned merge of staged nodes into the node table.

Everything is set-based over a batch of archives: what a sequential pass over
the files would do one by one follows from the body before each file (``lag``)
and the number of changes so far (a running sum) within a leaf's key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from ..schemas import CHUNK, LEDGER, NODE
from ..sources.staging import written

KEY = ["parent_id", "slug", "dimension_code"]
#: Rows of three short columns that are sent to all tasks; beyond that they are shuffled.
MOST_BROADCAST = 100_000


def node_id(parent: Column, kind: Column, slug: Column, dimension: Column, version: Column) -> Column:
    """Deterministic id: the same node has the same id in every run."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (parent, kind, slug, dimension, version)]
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """``df`` in the columns of a table; those it lacks are null."""
    fields = df.sparkSession.createDataFrame([], ddl).schema.fields
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


#: The status of a leaf whose file is no longer in its capability's archive.
VANISHED = "vanished"


def current_leaves(node: DataFrame) -> DataFrame:
    """Latest version that isn't superseded of each leaf key (null versions count as latest)."""
    live = node.filter((F.col("status") != "superseded") & F.col("dimension_code").isNotNull())
    first = F.row_number().over(W.partitionBy(*KEY).orderBy(F.col("version").desc_nulls_first(), "id"))
    return live.withColumn("_rn", first).filter("_rn = 1").drop("_rn")


def leaf_history(staged: DataFrame, current: DataFrame, order: list[str], keys: list[str] = KEY, body: str = "body", carry: dict[str, str] | None = None) -> DataFrame:
    """``staged`` with version, outcome and n_before (changes of the key before the row), and columns of ``current`` by new names.

    ``order`` puts the rows of a key in the order in which they arrive;
    ``current`` has keys, body and version of what is stored.  A row is skipped
    if its body equals the one before it, created if there was none, else it is
    a new version.
    """
    stored = current.select(*[F.col(k).alias(f"_{k}") for k in keys], *[F.col(k).alias(v) for k, v in (carry or {}).items()], F.col(body).alias("_body"), F.coalesce("version", F.lit(0)).alias("_version"), F.lit(True).alias("_has"))
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    j = staged.join(stored, on, "left").drop(*[f"_{k}" for k in keys])
    line = W.partitionBy(*keys).orderBy(*order)
    before = F.when(F.row_number().over(line) == 1, F.col("_body")).otherwise(F.lag(body).over(line))
    existed = (F.row_number().over(line) > 1) | F.coalesce("_has", F.lit(False))
    j = j.withColumns({"_before": before, "_existed": existed})
    j = j.withColumn("_changed", ~(F.col("_existed") & F.col(body).eqNullSafe(F.col("_before"))))
    running = F.sum(F.col("_changed").cast("int")).over(line.rowsBetween(W.unboundedPreceding, W.currentRow))
    j = j.withColumns(
        {
            "version": (F.coalesce("_version", F.lit(0)) + running).cast("int"),
            "n_before": running - F.col("_changed").cast("int"),
            "outcome": F.when(~F.col("_changed"), "skipped").when(F.col("_existed"), "versioned").otherwise("created"),
        }
    )
    return j.drop("_body", "_version", "_has", "_before", "_existed", "_changed")


def new_archives(manifests: DataFrame, ledger: DataFrame) -> DataFrame:
    """Manifests whose (capability, commit) isn't in the ledger; of repeats in the batch the first archive."""
    fresh = manifests.join(ledger.select("capability_slug", "source_commit").distinct(), ["capability_slug", "source_commit"], "left_anti")
    first = F.row_number().over(W.partitionBy("capability_slug", "source_commit").orderBy("archive"))
    return fresh.withColumn("_rn", first).filter("_rn = 1").drop("_rn")


def _containers(staged: DataFrame, node: DataFrame) -> tuple[DataFrame, DataFrame]:
    """archive, local_id, id of all containers, and the rows of those the node table lacks."""
    null = F.lit(None).cast("string")
    caps = staged.filter("kind = 'capability'").withColumn("id", node_id(null, F.col("kind"), F.col("slug"), null, null))
    # stored containers may have ids of another writer
    have = node.filter("kind = 'capability'").groupBy(F.col("slug").alias("_slug")).agg(F.min("id").alias("_id"))
    caps = caps.join(have, F.col("slug") == F.col("_slug"), "left").withColumns({"is_new": F.col("_id").isNull(), "id": F.coalesce("_id", "id"), "parent_id": null})
    parents = caps.select("archive", F.col("local_id").alias("parent_local_id"), F.col("id").alias("parent_id"))
    fns = staged.filter("kind = 'business_function'").join(parents, ["archive", "parent_local_id"])
    fns = fns.withColumn("id", node_id(F.col("parent_id"), F.col("kind"), F.col("slug"), null, null))
    held = node.filter("kind = 'business_function'").groupBy(F.col("parent_id").alias("_parent"), F.col("slug").alias("_slug")).agg(F.min("id").alias("_id"))
    fns = fns.join(held, (F.col("parent_id") == F.col("_parent")) & (F.col("slug") == F.col("_slug")), "left").withColumns({"is_new": F.col("_id").isNull(), "id": F.coalesce("_id", "id")})
    both = caps.select("archive", "local_id", "id", "is_new", "kind", "slug", "parent_id", "attrs").unionByName(fns.select("archive", "local_id", "id", "is_new", "kind", "slug", "parent_id", "attrs"))
    both = written(both)
    # of archives with the same new capability the first one's attributes count
    first = F.row_number().over(W.partitionBy("id").orderBy("archive"))
    rows = both.filter("is_new").withColumn("_rn", first).filter("_rn = 1").drop("_rn", "is_new")
    return both.select("archive", "local_id", "id"), rows


def chunk_rows(nodes: DataFrame, embedder: V.Embedder, size: int = 200, overlap: int = 40, pipeline: str = "1") -> DataFrame:
    """Chunk table rows of ``nodes`` (id, body)."""
    c = nodes.select(F.col("id").alias("node_id"), F.posexplode(X.chunks(F.col("body"), size, overlap)).alias("ord", "chunk_text"))
    c = c.withColumns({"chunk_id": F.sha2(F.concat_ws("\x1f", "node_id", F.col("ord").cast("string")), 256), "content_hash": F.sha2("chunk_text", 256)})
    c = c.withColumns({"embedding": V.embed_column(F.col("chunk_text"), embedder), "embedding_model_version": F.lit(embedder.version), "pipeline_version": F.lit(pipeline)})
    return conform(c, CHUNK)


def _light(df: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if it is small."""
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def close_versions(node: DataFrame, closed: DataFrame) -> DataFrame:
    """``node`` with the rows of ``closed`` (id) superseded."""
    j = node.join(closed.select(F.col("id").alias("_closed")), node["id"] == F.col("_closed"), "left")
    return j.withColumn("status", F.when(F.col("_closed").isNotNull(), "superseded").otherwise(F.col("status"))).select(node.columns)


def blocking(state: dict[str, DataFrame], ids: DataFrame) -> DataFrame:
    """id, rule: those of ``ids`` (id) that rows which stay refer to, so that deleting them would break a reference.

    Chunks don't count: they go with their node.
    """
    staying = state["node"].join(ids, "id", "left_anti")
    uses = [("parent", staying, "parent_id"), ("supersedes", staying, "supersedes_id"), ("link_src", state["spec_link"], "src_id"), ("link_dst", state["spec_link"], "dst_id")]
    found = [t.select(F.col(c).alias("id")).join(ids, "id", "left_semi").distinct().withColumn("rule", F.lit(rule)) for rule, t, c in uses]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


def tombstones(node: DataFrame, staged: DataFrame, archives: DataFrame) -> DataFrame:
    """archive and a node row for each current leaf of ``node`` whose file is gone: a version without a body, of status ``VANISHED``.

    ``node`` has what is stored once ``archives`` (archive, capability_slug,
    source_commit) are merged.  The last archive of a capability, by name, says
    which files there are; leaves of its business functions count, also of
    those that it no longer has.  A leaf that has vanished already stays as it
    is, one that comes back is a new version.  Capabilities without an archive
    are not touched.
    """
    first = F.row_number().over(W.partitionBy("capability_slug").orderBy(F.desc("archive")))
    last = archives.withColumn("_rn", first).filter("_rn = 1").select("archive", "capability_slug", F.col("source_commit").alias("_commit"))
    caps = node.filter("kind = 'capability'").select("id", F.col("slug").alias("capability_slug")).join(last, "capability_slug").select("id", "archive", "_commit")
    fns = node.filter("kind = 'business_function'").select("id", F.col("parent_id").alias("_cap"), F.col("slug").alias("_function"))
    fns = fns.join(caps.withColumnRenamed("id", "_cap"), "_cap").select("id", "archive", "_commit", "_function")
    own = caps.withColumn("_function", F.lit(None).cast("string")).unionByName(fns)
    own = written(own.select(F.col("id").alias("parent_id"), "archive", "_commit", F.coalesce("_function", F.lit("")).alias("_function"), F.col("_function").isNotNull().alias("_below")))

    above = staged.filter("kind IN ('capability', 'business_function') AND dimension_code IS NULL")
    above = above.select("archive", F.col("local_id").alias("parent_local_id"), (F.col("kind") != "capability").alias("_below"), F.when(F.col("kind") == "capability", "").otherwise(F.col("slug")).alias("_function"))
    place = ["archive", "_below", "_function", "slug", "dimension_code"]
    here = staged.filter("dimension_code IS NOT NULL").select("archive", "parent_local_id", "slug", "dimension_code").join(above, ["archive", "parent_local_id"]).select(place).distinct()

    slim = node.select("id", "kind", *KEY, "version", "status").join(_light(own), "parent_id")
    live = current_leaves(slim).filter(F.col("status") != VANISHED)
    version = (F.coalesce("version", F.lit(0)) + 1).cast("int")
    return live.join(here, place, "left_anti").select(
        "archive", node_id(F.col("parent_id"), F.lit("leaf"), F.col("slug"), F.col("dimension_code"), version).alias("id"), "kind", *KEY, version.alias("version"),
        F.col("id").alias("supersedes_id"), F.col("_commit").alias("source_commit"), F.lit(VANISHED).alias("status"), F.current_timestamp().alias("created_at"),
    )


def merge_parts(
    state: dict[str, DataFrame], staged: DataFrame, manifests: DataFrame, unreached: DataFrame, embedder: V.Embedder, size: int = 200, overlap: int = 40, tombstone: bool = False
) -> dict[str, DataFrame]:
    """What merging a batch adds: rows of ``node``, ``chunk`` and ``ingestion``, ``closed`` (ids of nodes now superseded) and ``summary``.

    Archives are taken in order of their name, files in order of their path.
    An archive whose capability and commit were merged before changes nothing;
    its summary is the stored one, with idempotent_hit.  With ``tombstone``,
    stored leaves whose file an archive no longer has get a version that says
    so (``tombstones``), else they stay as they are.

    The batch and its history are written once.  Stored leaves are narrowed to
    the batch's keys before anything is sorted, and content_hash, which every
    stored leaf has, stands for the body.
    """
    node, ledger = state["node"], state["ingestion"]
    fresh = written(new_archives(manifests, ledger))
    batch = written(staged.join(fresh.select("archive", "source_commit"), "archive").withColumns({"content_hash": F.sha2("body", 256), "_row": F.monotonically_increasing_id()}))
    ids, containers = _containers(batch, node)

    leaves = batch.filter("dimension_code IS NOT NULL").select("_row", "archive", "parent_local_id", "slug", "dimension_code", "source_path", "source_commit", "content_hash", "kind")
    leaves = leaves.join(ids.select("archive", F.col("local_id").alias("parent_local_id"), F.col("id").alias("parent_id")), ["archive", "parent_local_id"])
    wanted = node.select("id", *KEY, "version", "status", "content_hash").join(leaves.select(KEY).distinct(), KEY, "left_semi")
    history = leaf_history(leaves, current_leaves(wanted), ["archive", "source_path", "_row"], body="content_hash", carry={"id": "_current"})
    line, is_new = W.partitionBy(*KEY).orderBy("archive", "source_path", "_row"), F.col("outcome") != "skipped"
    own = F.when(is_new, node_id(F.col("parent_id"), F.lit("leaf"), F.col("slug"), F.col("dimension_code"), F.col("version")))
    history = history.withColumn("id", own).withColumns(
        {
            "supersedes_id": F.coalesce(F.last("id", ignorenulls=True).over(line.rowsBetween(W.unboundedPreceding, -1)), "_current"),
            "status": F.when(F.col("version") == F.max("version").over(W.partitionBy(*KEY)), "approved").otherwise("superseded"),
            "created_at": F.current_timestamp(),
        }
    )
    history = written(history)
    changed = history.filter(is_new)
    bodies = changed.join(batch.select("_row", "body", "attrs"), "_row")
    closed = changed.filter("_current IS NOT NULL").select(F.col("_current").alias("id")).distinct()
    added = conform(containers.withColumn("created_at", F.current_timestamp()), NODE).unionByName(conform(bodies, NODE))
    gone = None
    if tombstone:
        slim = ["id", "kind", *KEY, "version", "status"]
        after = close_versions(node.select(slim), closed).unionByName(containers.select("id", "kind", "parent_id", "slug", *[F.lit(None).alias(c) for c in slim[4:]]))
        gone = written(tombstones(after.unionByName(changed.select(slim)), batch, fresh))
        over = gone.select(F.col("supersedes_id").alias("id"))  # stored, or made by an earlier archive of the batch
        closed, added = closed.unionByName(over).distinct(), close_versions(added, _light(over)).unionByName(conform(gone, NODE))

    count = lambda what: F.coalesce(F.count_if(F.col("outcome") == what), F.lit(0)).cast("int")
    per = history.groupBy("archive").agg(count("created").alias("nodes_created"), count("versioned").alias("nodes_versioned"), count("skipped").alias("nodes_skipped"), F.array_sort(F.collect_set("dimension_code")).alias("dimensions_seen"))
    # the summary's own form has the paths of an archive as one list
    lost = unreached.groupBy("archive").agg(F.array_sort(F.collect_list("path")).alias("sources_unreached"))
    none = F.array().cast("array<string>")
    zero = F.lit(0)
    lack = fresh.select("archive").limit(0).withColumn("nodes_vanished", zero) if gone is None else gone.groupBy("archive").agg(F.count(F.lit(1)).cast("int").alias("nodes_vanished"))
    summary = written(
        fresh.join(per, "archive", "left").join(lost, "archive", "left").join(lack, "archive", "left").select(
            "archive", "capability_slug", "source_commit", *[F.coalesce(c, zero).alias(c) for c in ("nodes_created", "nodes_versioned", "nodes_skipped", "nodes_vanished")],
            F.coalesce("dimensions_seen", none).alias("dimensions_seen"), F.coalesce("sources_unreached", none).alias("sources_unreached"), F.lit(False).alias("idempotent_hit"),
        )
    )
    entries = conform(summary.select("capability_slug", "source_commit", F.struct(*[c for c in summary.columns if c != "archive"]).alias("summary"), F.current_timestamp().alias("created_at")), LEDGER)
    held = ledger.unionByName(entries).select("capability_slug", "source_commit", "summary")
    repeats = manifests.join(fresh.select("archive"), "archive", "left_anti").join(held, ["capability_slug", "source_commit"])
    repeats = repeats.select("archive", F.col("summary").withField("idempotent_hit", F.lit(True)).alias("s")).select("archive", "s.*")
    return {
        "node": added,
        "chunk": chunk_rows(bodies.select("id", "body"), embedder, size, overlap),
        "ingestion": entries,
        "closed": closed,
        "summary": summary.unionByName(repeats),
    }


def merge(
    state: dict[str, DataFrame], staged: DataFrame, manifests: DataFrame, unreached: DataFrame, embedder: V.Embedder, size: int = 200, overlap: int = 40, tombstone: bool = False
) -> tuple[dict[str, DataFrame], DataFrame]:
    """(new state, summary) of merging a batch, by ``merge_parts``."""
    new = merge_parts(state, staged, manifests, unreached, embedder, size, overlap, tombstone)
    node = close_versions(state["node"], _light(new["closed"])).unionByName(new["node"])
    grown = {t: state[t].unionByName(new[t]) for t in ("chunk", "ingestion")}
    return state | grown | {"node": node}, new["summary"]


def reembed(node: DataFrame, embedder: V.Embedder, size: int = 200, overlap: int = 40) -> DataFrame:
    """A new chunk table for every node with a body, superseded ones included."""
    return chunk_rows(node.filter("body IS NOT NULL").select("id", "body"), embedder, size, overlap)


def stale_chunks(node: DataFrame, chunk: DataFrame, embedder: V.Embedder, size: int = 200, overlap: int = 40, pipeline: str = "1") -> DataFrame:
    """Chunks (node_id, ord, chunk_text) that are missing or made from other text, by another embedder or pipeline."""
    want = node.filter("body IS NOT NULL").select(F.col("id").alias("node_id"), F.posexplode(X.chunks(F.col("body"), size, overlap)).alias("ord", "chunk_text"))
    want = want.withColumns({"content_hash": F.sha2("chunk_text", 256), "embedding_model_version": F.lit(embedder.version), "pipeline_version": F.lit(pipeline)})
    key = ["node_id", "ord", "content_hash", "embedding_model_version", "pipeline_version"]
    return want.join(chunk.select(key), key, "left_anti").select("node_id", "ord", "chunk_text")
