"""One pass over a stream of results into all outputs, each batch whole or not at all.

A micro-batch's results are computed once, by writing them; the JSON lines, the failures, the
completed log and the batch's distinct account ids are made from what was written, and its
counters are observed while it is written. Every output of a batch has a folder with the batch's
number, which a second try of the same batch overwrites, and the batch counts from when its
commit marker is there, which is written last. So whatever a run is stopped by, between any
two outputs, a restart with the same checkpoint leaves no row out and none twice.

Readers take committed batches only. Run statistics are sums over the markers; they need neither
the results nor another pass.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from sitemarks.operators.results import completed, failures, json_results
from sitemarks.operators.runs import result_counters, with_rates

BATCH = "batch_id"
#: Outputs below the folder, in the order in which they are written; ``commits`` is the last.
RESULTS, LINES, FAILED, COMPLETED, IDS, COMMITS = "results", "jsonl", "failures", "completed", "ids", "commits"


def _place(folder: str, output: str, batch_id: int) -> str:
    return f"{folder}/{output}/{BATCH}={batch_id}"


def _observed() -> list[Column]:
    counters = [F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(n) for n, c in result_counters().items()]
    span = [F.unix_micros(F.min("fetched_at")).alias("first_us"), F.unix_micros(F.max("fetched_at")).alias("last_us")]
    return [*counters, *span]


def _marker_ddl() -> str:
    return ", ".join(f"{name} bigint" for name in [*result_counters(), "first_us", "last_us"])


def write_batch(batch: DataFrame, batch_id: int, folder: str, pretty: bool = False) -> None:
    """All outputs of one micro-batch of results; again with the same number they replace the earlier ones."""
    spark = batch.sparkSession
    seen = Observation(f"results-{batch_id}")
    batch.observe(seen, *_observed()).write.mode("overwrite").parquet(_place(folder, RESULTS, batch_id))
    kept = spark.read.schema(batch.schema).parquet(_place(folder, RESULTS, batch_id))
    json_results(kept, pretty).select("value").write.mode("overwrite").text(_place(folder, LINES, batch_id))
    json_results(failures(kept)).select("value").write.mode("overwrite").text(_place(folder, FAILED, batch_id))
    completed(kept).write.mode("overwrite").text(_place(folder, COMPLETED, batch_id))
    ids = kept.filter("error IS NULL").select(F.explode("hub_ids").alias("hub_id")).distinct()
    ids.write.mode("overwrite").parquet(_place(folder, IDS, batch_id))
    counted = seen.get
    row = tuple(counted[name.split()[0]] for name in _marker_ddl().split(", "))
    spark.createDataFrame([row], _marker_ddl()).coalesce(1).write.mode("overwrite").parquet(_place(folder, COMMITS, batch_id))


def run_to_sinks(results: DataFrame, folder: str, checkpoint: str, pretty: bool = False) -> StreamingQuery:
    """Process what is there into all outputs and stop; started again with the same checkpoint it resumes after it."""
    return (
        results.writeStream.foreachBatch(lambda batch, number: write_batch(batch, number, folder, pretty))
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def _read(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "parquet") -> DataFrame:
    """What was written there; no rows where nothing was, as after a run over a source without files."""
    try:
        return spark.read.schema(schema).format(fmt).load(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def commits(spark: SparkSession, folder: str) -> DataFrame:
    """One row per committed batch, with its counters."""
    return _read(spark, f"{folder}/{COMMITS}", f"{_marker_ddl()}, {BATCH} bigint")


def read_committed(spark: SparkSession, folder: str, output: str, schema: StructType | str = "value string") -> DataFrame:
    """An output without the batches that are not committed. Text outputs have one column, ``value``."""
    schema = spark.createDataFrame([], schema).schema
    own = StructType([*schema.fields, StructField(BATCH, LongType())])
    rows = _read(spark, f"{folder}/{output}", own, "parquet" if output in (RESULTS, IDS) else "text")
    return rows.join(commits(spark, folder).select(BATCH), BATCH, "left_semi").select(*schema.fieldNames())


def committed_statistics(
    spark: SparkSession, folder: str, total_urls: int | None = None, elapsed_seconds: float | None = None
) -> DataFrame:
    """The row of ``runs.run_statistics`` over all committed batches, from markers and distinct ids alone."""
    sums = commits(spark, folder).agg(
        *[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in result_counters()],
        (F.max("last_us") - F.min("first_us")).alias("_micros"),
    )
    ids = read_committed(spark, folder, IDS, "hub_id bigint").agg(F.count_distinct("hub_id").alias("unique_hub_ids"))
    return with_rates(sums.join(F.broadcast(ids)), total_urls, elapsed_seconds)  # one row and one row
