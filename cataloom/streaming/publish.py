"""Streaming twin of publish: rows arriving in a table directory are chunked,
keyed, embedded and inserted into the store once.

Each micro-batch runs the batch operators (chunk -> key -> embed) and an
insert-if-absent on (dataset_id, pk), so a batch replayed after a failure
inserts nothing twice.  Vectors are stored rounded and finite, as in the batch form.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from cataloom.functions import rules
from cataloom.operators.chunk import chunk_frame
from cataloom.operators.embed import embed_text
from cataloom.plans.publish import stored
from cataloom.sources.store import insert_if_absent


def start_publish_stream(rows: DataFrame, dataset_id: str, store_path: str, checkpoint: str,
                         dims: int = 64, embedder: Callable | None = None, include=None,
                         exclude=None, guard: str | None = rules.PUBLISH_PII,
                         available_now: bool = True) -> StreamingQuery:
    def sink(batch: DataFrame, batch_id: int) -> None:
        chunks = chunk_frame(batch, dataset_id, include, exclude, guard)
        vectors = stored(embed_text(chunks, "text_chunk", dims=dims, embedder=embedder))
        insert_if_absent(batch.sparkSession, vectors, store_path, ["dataset_id", "pk"], ledger=True)

    w = rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
