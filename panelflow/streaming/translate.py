"""Incremental translation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from panelflow.operators import translate as X
from panelflow.sources.memory import MemoryStore
from panelflow.sources.tables import CatalogStore


def translate_batches(store: CatalogStore, memory: MemoryStore, provider: X.Provider, now: Column,
                      out_table: str = "translated", **kw):
    """Batch writer: look new segments up, ask the provider for the rest, remember the answers.

    A batch reads only the memory buckets that may hold its keys. Results and learned rows go to a part per stream and
    batch: a replayed batch leaves its own part out of what it knows and overwrites its own output, a new stream over
    the same store adds to what is there, and nothing else is written again.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        part = store.part(batch, batch_id)
        known = memory.rows_for(X.distinct_requests(batch), without=part)
        done, learned = X.translate_segments(batch, known, provider, now, **kw)
        store.save_part(done, out_table, part)
        memory.learn(learned, part)

    return each
