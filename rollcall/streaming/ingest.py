"""Idempotent ingest: a stream upserts a table, each batch once, whatever runs again.

A batch becomes one entry of a store, named by its source and number. The entry is the ledger:
it appears by one rename, with the rows in it, so there is no moment at which a batch is written
and not noted. A batch that comes again after a failure finds its entry and is left alone.
Readers merge: of the rows of a key the one of the latest batch stands (or the first).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rollcall.store import Store

#: Columns of an entry beside the rows': when it was published, by order, and within a batch.
TURN = "_turn"


class Ledger:
    """A table that streams feed, by key. ``order`` names a column that tells which of two rows
    of a key in one batch is the later one; without it the larger row, column by column, is."""

    def __init__(self, store: Store, table: str, key: Sequence[str], order: str | None = None, replace: bool = True) -> None:
        self.store, self.table, self.key, self.order, self.replace = store, table, list(key), order, replace

    def noted(self) -> list[str]:
        """Entries by turn."""
        return sorted(k for n, k, _ in self.store.entries() if n == self.table)

    def _write(self, batch: DataFrame, batch_id: int, source: str) -> None:
        done = self.noted()
        if any(k.partition("-")[2] == f"{source}-{batch_id}" for k in done):
            return
        turn = int(done[-1].partition("-")[0]) + 1 if done else 0
        latest = F.struct(*([self.order] if self.order else []), *[c for c in batch.columns if c not in self.key])
        pick = F.max_by if self.replace else F.min_by
        rest = [c for c in batch.columns if c not in self.key]
        one = batch.groupBy(*self.key).agg(pick(F.struct(*rest), latest).alias("_r")).select(*self.key, *[F.col(f"_r.{c}").alias(c) for c in rest])
        self.store.publish(self.table, f"{turn:09d}-{source}-{batch_id}", one.withColumn(TURN, F.lit(turn)))

    def upsert(self, stream: DataFrame, source: str, checkpoint: str) -> StreamingQuery:
        """Feeds all that the stream has by now. One writer a table; ``source`` names the stream,
        and goes with its checkpoint: a stream that starts anew takes a new name, and its rows
        then replace themselves."""
        return stream.writeStream.foreachBatch(lambda batch, i: self._write(batch, i, source)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def current(self) -> DataFrame:
        """The table as it stands: a row a key."""
        rows = None
        for entry in self.noted():
            part = self.store.read(self.table, entry)
            rows = part if rows is None else rows.unionByName(part)
        if rows is None:
            raise ValueError(f"{self.table}: nothing was fed yet")
        rest = [c for c in rows.columns if c not in (*self.key, TURN)]
        pick = F.max_by if self.replace else F.min_by
        return rows.groupBy(*self.key).agg(pick(F.struct(*rest), TURN).alias("_r")).select(*self.key, *[F.col(f"_r.{c}").alias(c) for c in rest])

    def compact(self) -> None:
        """Merges all entries into the last one's turn and deletes the others; their names stay
        noted in an empty entry each, so that none is fed again. Not while a stream runs."""
        done = self.noted()
        if len(done) < 2:
            return
        last = int(done[-1].partition("-")[0])
        merged = self.current().withColumn(TURN, F.lit(last))
        self.store.publish(self.table, f"{last + 1:09d}-merged-{last}", merged.withColumn(TURN, F.lit(last + 1)))
        for entry in done:
            self.store.replace(self.table, entry, merged.limit(0))
