"""Documents as a stream: each one is complete within its micro-batch, so whole-document numbering holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.anonymize import Anonymizer, anonymize_texts


def anonymize_stream(docs: DataFrame, anonymizer: Anonymizer, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Writes redacted documents of a stream as Parquet, one folder for each batch, so a batch that runs again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        anonymize_texts(batch, anonymizer).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if available_now else stream).start()
