"""A ledger that fills from a stream: each record once, whatever is sent again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.sources.files import append_new


def stream_to_ledger(records: DataFrame, key: str, ledger: str, checkpoint: str) -> StreamingQuery:
    """Run what a stream has now: records whose key the ledger lacks are appended, batch by batch, then it ends.

    A batch that fails and runs again finds its own rows in the ledger, so each key is written once.
    """
    return records.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda batch, _: append_new(ledger, batch, key) and None).start()


def reason_counts(records: DataFrame, time: str, late: str, span: str, reason: str) -> DataFrame:
    """Counts of reasons by time window over a stream, closed when the watermark passes a window."""
    return records.withWatermark(time, late).groupBy(F.window(time, span), reason).agg(F.count("*").alias("n"))
