"""Structured Streaming forms: reads that arrive as files, mapped a micro-batch at a time; islands of events in event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from strandloom.config import EngineParams
from strandloom.operators import alignments, anchors, seeds
from strandloom.plans import mapping
from strandloom.sources.formats import fasta_records, reads_of


def fasta_stream(spark: SparkSession, folder: str, files_per_batch: int = 16) -> DataFrame:
    """source_file, name, seq of plain FASTA files as they come."""
    return fasta_records(spark.readStream.option("lineSep", "\n>").option("maxFilesPerTrigger", files_per_batch).text(folder))


def map_stream(spark: SparkSession, reads: DataFrame, index: DataFrame, out: str, checkpoint: str, params: EngineParams = EngineParams()) -> StreamingQuery:
    """Anchors of every micro-batch in a folder of its own, `out`/batch=N. Mapping a read needs no state; the index is read by each batch from where it is stored.
    A batch that is run again after a failure replaces its own folder, so nothing comes twice."""

    def each(batch: DataFrame, number: int) -> None:
        found = anchors.match(seeds.read_probes(reads_of(batch), params.probe, params.index), index, params.index)
        anchors.bin_filter(found, params.bins).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return reads.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def map_stream_lines(spark: SparkSession, reads: DataFrame, genomes: DataFrame, out: str, checkpoint: str, params: EngineParams = EngineParams()) -> StreamingQuery:
    """SAM records of every micro-batch as text in a folder of its own: the whole mapping plan, gaps included, over the batch's reads."""

    def each(batch: DataFrame, number: int) -> None:
        own = reads_of(batch).persist()
        lines = mapping.map_reads(own, genomes, params).lines
        alignments.sam_text(lines, own).orderBy("read_id", "line_id").select("value").write.mode("overwrite").text(f"{out}/batch={number}")
        own.unpersist()

    return reads.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Progress(StreamingQueryListener):
    """Rows and rates of each micro-batch, kept for reports and shown by `show`."""

    def __init__(self, show=lambda line: None, most: int = 1000):
        self.batches: list[tuple[int, int, float]] = []
        self.show, self.most = show, most

    def onQueryStarted(self, event) -> None:
        self.show(f"started {event.id}")

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.batches = [*self.batches, (p.batchId, p.numInputRows, p.processedRowsPerSecond)][-self.most :]
        self.show(f"batch {p.batchId}: {p.numInputRows} reads, {p.processedRowsPerSecond:.0f} a second")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.show(f"ended {event.id}")


def event_sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """user_id, start_, end_, n: sessions split by `gap`; the same on a stream (with a watermark `late`) and on a table."""
    timed = events.select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    timed = timed.withWatermark("ts", late) if late else timed
    return timed.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start_"), F.col("w.end").alias("end_"), "n")


def event_windows(events: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """event_type, start_, n, total in tumbling windows."""
    timed = events.select("event_type", "value", F.col("ts").cast("timestamp").alias("ts"))
    timed = timed.withWatermark("ts", late) if late else timed
    return timed.groupBy("event_type", F.window("ts", width).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("event_type", F.col("w.start").alias("start_"), "n", "total")
