"""Streaming into a store: each micro-batch is staged once, and sealed as segments fill."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import VectorStore


def ingest(stream: DataFrame, store: VectorStore, checkpoint: str, name: str = "ingest", flush: bool = False, **trigger) -> StreamingQuery:
    """Start a query that inserts the rows (id, vector) of ``stream`` into ``store``.

    The number of the last micro-batch stands in the manifest and is committed with its rows, so a batch that is run again
    after a failure, wherever that was, is not inserted twice; the stream's checkpoint is what a write-ahead log would be. ``flush`` seals after each batch.
    ``trigger`` goes to ``DataStreamWriter.trigger``; back-pressure comes from the source's options.
    """

    def take(rows: DataFrame, number: int) -> None:
        if store.manifest["streams"].get(name, -1) >= number:
            return
        store.manifest["streams"][name] = number
        try:
            store.insert(rows)
        except Exception:
            store.reload()  # what was committed before the error stands, the number with it
            raise
        if flush:
            store.flush()

    writer = stream.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(take)
    return (writer.trigger(**trigger) if trigger else writer).start()
