"""Incremental import of a drop folder through Structured Streaming, one ledger import per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from coffer.plans.ledger import Ledger
from coffer.sources.readers import SCHEMA


def start(ledger: Ledger, folder: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Parquet files with a row number and the import fields; a batch that fails validation stops the stream.
    An import's run record names its checkpoint and batch, so a batch that is delivered again is not imported twice."""

    def load(df: DataFrame, batch: int) -> None:
        ref = f"{checkpoint}#{batch}"
        known = ledger.table("import_runs").where((F.col("source_kind") == "stream") & (F.col("source_ref") == ref))
        if known.isEmpty() and not df.isEmpty():
            ledger.create(df=df, source=("stream", ref))

    stream = ledger.spark.readStream.schema(SCHEMA).parquet(folder)
    writer = stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
