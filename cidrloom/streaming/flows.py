"""Incremental flows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cidrloom.functions.ip import cidr_text, ip4_number
from cidrloom.operators.traces import planned_parents
from cidrloom.plans.enrich import enrich_with, lookup_text, prepared_lookup
from cidrloom.session import cut_lineage
from cidrloom.sources.traces import parse_trace_docs


def append_traces(
    spark: SparkSession, source: str, sink: str, checkpoint: str, files_per_batch: int = 100,
    every: str | None = "5 seconds", targets: DataFrame | None = None,
) -> StreamingQuery:
    """Landed trace documents (text files, one per line) parsed and appended as Parquet.

    The sink is exactly-once: a restarted query goes on after the last committed batch.  With `targets`, planned pairs
    `net, ip`, each trace gets the `range` its destination was planned under (traces of other destinations go), and a pair
    (range, destination) is appended once, however often its document lands, in whichever batch or run.  The pairs are
    keyed state of the query, one entry per target; choose the RocksDB provider where they outgrow memory.
    """
    docs = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(source)
    traces = parse_trace_docs(docs, "value").filter("trace IS NOT NULL").select("trace.*")
    if targets is not None:
        parents = cut_lineage(planned_parents(targets, "ip", "net").select(F.col("ip").alias("_ip"), cidr_text(F.col("parent")).alias("range")))
        traces = traces.withColumn("_ip", ip4_number(F.col("destination"))).join(parents, "_ip").drop("_ip")
        traces = traces.dropDuplicates(["range", "destination"])
    writer = traces.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def enrich_stream(logs: DataFrame, ip_field: str, lookup: DataFrame, sink: str, checkpoint: str, every: str | None = "5 seconds") -> StreamingQuery:
    """Stream of `log_id, record` joined to a static lookup table, one batch join per micro-batch.

    The lookup table is prepared once for all batches.  Each batch writes its own folder, so a repeated
    batch replaces itself.
    """
    join = prepared_lookup(lookup_text(lookup))

    def write(batch: DataFrame, batch_id: int) -> None:
        enrich_with(batch, ip_field, join).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    writer = logs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
