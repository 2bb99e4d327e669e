"""Extension: archives that arrive in a folder, merged as a stream."""

from __future__ import annotations

from pyspark.sql.streaming import StreamingQuery

from ..engine import KnowledgeBase
from ..sources import archive

_FILE = "path string, modificationTime timestamp, length long, content binary"


def ingest_stream(kb: KnowledgeBase, folder: str, checkpoint: str, glob: str = "*.zip", per_batch: int = 100) -> StreamingQuery:
    """Merge each new archive under ``folder``; stops when all that are there now are merged.

    The ledger makes a repeated batch change nothing, so at-least-once delivery
    is enough.  Bad archives are set aside with their error (``kb.rejected()``)
    and don't stop the stream; a batch that is repeated may list them twice.
    """
    found = kb.spark.readStream.format("binaryFile").schema(_FILE).option("pathGlobFilter", glob).option("maxFilesPerTrigger", per_batch).load(folder)

    def merge(batch, _: int) -> None:
        if not batch.isEmpty():
            kb.ingest_files(archive.unzip(batch.selectExpr("path AS archive", "content")), set_aside=True)

    return found.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
