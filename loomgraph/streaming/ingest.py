"""Structured Streaming into a store: each micro-batch is one commit, and a batch that is retried is skipped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from loomgraph.operators.store import GraphStore


def into_store(stream: DataFrame, store: GraphStore, checkpoint: str, to_triples: Callable[[DataFrame], DataFrame] = lambda df: df, name: str = "stream", available_now: bool = True) -> StreamingQuery:
    """Start a query that folds a stream into ``store``.

    :param to_triples: makes triples of a micro-batch; their ``ord`` must come from the data, so that late rows lose.
    :param checkpoint: the query's checkpoint folder, shared by all executors.

    Batches are delivered at least once. The store's pointer file names the last batch of each stream that was
    committed, in the same write as the commit itself, so a batch is taken once.
    """

    def take(batch: DataFrame, number: int) -> None:
        if number <= store.last_batch(name):
            return
        store.add_all(to_triples(batch))
        store.commit(batch=(name, number))

    writer = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
