"""The knowledge base as one object: the operations of the API over a snapshot store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Settings
from .errors import BadInput, Conflict
from .functions.vectors import Embedder, GaussianEmbedder
from .operators import constraints as C
from .operators import governance as G
from .operators import merge as M
from .operators import reads as R
from .operators import tree
from .operators.policy import RowPolicy
from .sources import archive
from .sources.staging import written
from .sources.store import SnapshotStore


class KnowledgeBase:
    """Each call takes the caller's API key first and checks its role.

    Reads return frames over the current snapshot, of the rows that ``policy``
    lets the caller's role see; writes make a new one.
    """

    def __init__(self, spark: SparkSession, root: str, embedder: Embedder | None = None, settings: Settings | None = None, policy: RowPolicy | None = None):
        self.policy = policy or RowPolicy()
        self.spark, self.settings, self.store = spark, settings or Settings(), SnapshotStore(spark, root)
        self.embedder = embedder or GaussianEmbedder(self.settings.embedding_dim)

    def _allow(self, key: str, role: str) -> None:
        G.require_role(key, role, self.settings)

    def _seen(self, key: str, *tables: str) -> tuple[dict[str, DataFrame], list[str]]:
        """Tables of the current state as the caller may see them, and the scopes that are withheld."""
        role, state = G.role_of(key, self.settings), self.store.load()
        return self.policy.apply({t: state[t] for t in tables}, role), self.policy.denied(role)

    def health(self) -> dict:
        return {"status": "ok" if self.spark.range(1).count() == 1 else "down"}

    def ingest(self, key: str, path: str, tombstone: bool = False) -> DataFrame:
        """Merge the ZIP archives under ``path``; a summary row an archive."""
        self._allow(key, "write")
        return self.ingest_files(archive.read_archives(self.spark, path), tombstone=tombstone)

    def ingest_files(self, files: DataFrame, set_aside: bool = False, tombstone: bool = False) -> DataFrame:
        """Merge ``files`` of archives; a summary row an archive.

        A bad archive is an error, or with ``set_aside`` a row of
        ``rejected()``, and the others are merged.  Dimensions that aren't
        whitelisted, and ids that are taken, are refused before anything is
        stored.  With ``tombstone``, leaves whose file is gone from their
        capability's archive get a last version without a body.
        """
        files = written(files)
        found = written(archive.manifests(files))
        if set_aside:
            bad = found.filter("error IS NOT NULL").select("archive", "error")
            if not bad.isEmpty():
                bad.write.mode("append").parquet(f"{self.store.root}/rejected")
            files, found = files.join(bad, "archive", "left_anti"), found.filter("error IS NULL")
        found = archive.require_valid(found)
        state = self.store.load()
        new = M.merge_parts(state, tree.build_nodes(files, found), found, tree.unreached(files), self.embedder, self.settings.chunk_words, self.settings.chunk_overlap, tombstone)
        if new["ingestion"].isEmpty():
            return new["summary"]
        unknown = C.missing(new["node"], "dimension_code", state["spec_dimension"], "code").first()
        if unknown is not None:
            raise BadInput(f"dimension {unknown['value']!r} is not whitelisted")
        taken = new["node"].select("id").join(state["node"].select("id"), "id", "left_semi").first()
        if taken is not None:
            raise Conflict(f"node {taken['id']!r} exists already")
        # a node that is now superseded is a deleted row and a new one; nothing is written again
        old = written(self.store.find("node", "id", new["closed"]))
        closed = old.drop("_file", "_index").withColumn("status", F.lit("superseded"))
        self.store.save({}, {"node": new["node"].unionByName(closed), "chunk": new["chunk"], "ingestion": new["ingestion"]}, {} if old.isEmpty() else {"node": old})
        return new["summary"]

    def rejected(self) -> DataFrame:
        """archive and error of the archives that were set aside."""
        fs, p = self.store._fs(f"{self.store.root}/rejected")
        ddl = "archive string, error string"
        return self.spark.read.schema(ddl).parquet(f"{self.store.root}/rejected") if fs.exists(p) else self.spark.createDataFrame([], ddl)

    def search(self, key: str, query: str, dimension: str | None = None, status: str = "approved", k: int | None = None) -> tuple[list, G.Coverage]:
        self._allow(key, "read")
        k = self.settings.top_k if k is None else k
        s, denied = self._seen(key, "node", "chunk")
        rows = R.search(s["node"], s["chunk"], self.embedder.embed([query])[0], dimension, status, k).collect()
        return rows, G.Coverage(partial=len(rows) >= k, denied_scopes=denied)

    def spec(self, key: str, head: str, dimension: str | None = None, status: str | None = "approved") -> tuple[DataFrame, G.Coverage]:
        self._allow(key, "read")
        s, denied = self._seen(key, "node")
        return R.spec(s["node"], head, dimension, status), G.Coverage(denied_scopes=denied)

    def links(self, key: str, src: str, rel: str | None = None) -> DataFrame:
        self._allow(key, "read")
        s, _ = self._seen(key, "node", "spec_link")
        return R.links(s["spec_link"], s["node"], src, rel)

    def delete_nodes(self, key: str, ids: DataFrame) -> int:
        """Delete the nodes of ``ids`` (id) and their chunks; how many nodes there were.

        Nodes that a node which stays has as its parent or as the one it
        supersedes, and nodes that a link names, can't be deleted.  Unknown ids
        are passed over.  No folder of rows is written again.
        """
        self._allow(key, "admin")
        ids, s = written(ids.select("id").filter("id IS NOT NULL").distinct()), self.store.load()
        used = M.blocking(s, ids).first()
        if used is not None:
            raise Conflict(f"node {used['id']!r} is in use ({used['rule']})")
        nodes = written(self.store.find("node", "id", ids))
        n = nodes.count()
        if n:
            self.store.save({}, delete={"node": nodes, "chunk": self.store.find("chunk", "node_id", ids)})
        return n

    def stats(self, key: str) -> dict:
        self._allow(key, "admin")
        s, _ = self._seen(key, "node", "spec_dimension")
        return G.stats(s["node"], s["spec_dimension"]).first().asDict()

    def dimensions(self, key: str) -> DataFrame:
        self._allow(key, "admin")
        return G.codes(self.store.load()["spec_dimension"])

    def add_dimension(self, key: str, code: str, label: str, description: str | None = None) -> None:
        self._allow(key, "admin")
        s = self.store.load()
        self.store.save({"spec_dimension": G.add_code(s["spec_dimension"], code, label, description=description)})

    def delete_dimension(self, key: str, code: str) -> None:
        self._allow(key, "admin")
        s = self.store.load()
        self.store.save({"spec_dimension": G.delete_code(s["spec_dimension"], code, s["node"], "dimension_code")})

    def add_link_type(self, key: str, code: str, label: str, description: str | None = None, directed: bool = True) -> None:
        self._allow(key, "admin")
        s = self.store.load()
        self.store.save({"link_type": G.add_code(s["link_type"], code, label, description=description, directed=directed)})

    def reembed(self, key: str) -> int:
        """Rebuild all chunks; their number."""
        self._allow(key, "admin")
        s = self.store.load()
        self.store.save({"chunk": M.reembed(s["node"], self.embedder, self.settings.chunk_words, self.settings.chunk_overlap)})
        return self.store.load()["chunk"].count()
