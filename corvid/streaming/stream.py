"""Structured Streaming forms of ingest and scoring.

* ``continuous_master_append``: every new file dropped into a folder is
  appended to the master table, minus rows the master already holds.  The
  de-duplication probes the stored master (C4), not unbounded streaming
  state; each micro-batch only writes its own part.
* ``continuous_scoring``: new rows are scored by a saved model and written
  to a file sink; scoring is a narrow, stateless projection.

Both use ``trigger(availableNow=True)`` by default (process what is there,
then stop), which is also how the tests drive them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.operators import models as M
from corvid.operators.setops import anti_join_seen, row_hash
from corvid.sources import io


# micro-batches up to this many distinct rows are broadcast for the seen-row
# probe; larger ones use a shuffle join (checked per batch, not assumed)
BROADCAST_BATCH_ROWS = 2_000_000


def continuous_master_append(spark: SparkSession, drop_dir: str, schema, master_root: str,
                             checkpoint: str, fmt: str = "parquet", available_now: bool = True,
                             max_files_per_trigger: int = 100):
    """S1.  The master is a folder of per-micro-batch parts
    (``_batch=<epoch>``) holding a row hash ``_h``.  A micro-batch keeps only
    rows unseen in earlier parts: the stored master is probed with a
    semi-join on ``_h`` (the batch side broadcast when its size is under
    ``BROADCAST_BATCH_ROWS``), so the master is scanned, never rewritten or
    shuffled.  Each part is written with overwrite of its own folder, so a
    retried micro-batch is idempotent."""
    src = spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", max_files_per_trigger)
    if fmt == "csv":
        src = src.option("header", True)
    stream = src.load(drop_dir)
    cols = [f.name for f in schema.fields] if hasattr(schema, "fields") else stream.columns

    def upsert(batch: DataFrame, epoch: int) -> None:
        fresh = batch.dropDuplicates().withColumn("_h", row_hash(cols))
        if io.path_exists(spark, master_root):
            master = spark.read.parquet(master_root).where(F.col("_batch") != str(epoch))
            keys = fresh.select("_h").distinct()
            n = keys.count()
            probe = F.broadcast(keys) if n <= BROADCAST_BATCH_ROWS else keys
            seen = master.join(probe, "_h", "left_semi").select(*cols)
            fresh = anti_join_seen(fresh.drop("_h"), seen, cols).withColumn("_h", row_hash(cols))
        fresh.write.mode("overwrite").parquet(f"{master_root.rstrip('/')}/_batch={epoch}")

    w = stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def read_master(spark: SparkSession, master_root: str) -> DataFrame:
    return spark.read.parquet(master_root).drop("_batch", "_h")


def continuous_scoring(spark: SparkSession, drop_dir: str, schema, model_path: str, out_dir: str,
                       checkpoint: str, keep=("id",), fmt: str = "parquet", available_now: bool = True):
    model = M.load(model_path)
    stream = spark.readStream.schema(schema).format(fmt).load(drop_dir)
    aligned = M.align_for(model, stream, keep=list(keep))
    scored = M.score(model, aligned, list(keep))
    w = (scored.writeStream.format("parquet").option("path", out_dir)
         .option("checkpointLocation", checkpoint).outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def run_to_end(query) -> None:
    query.awaitTermination()
    if query.exception():
        raise query.exception()


