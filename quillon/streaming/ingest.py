"""Bounded ingest with Structured Streaming, batches of queries and arrival models."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import search


def ingest(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, keys: list[str], version: str) -> DataFrame:
    """Read everything that lies in ``source`` once, and keep the newest row of each key.

    Each micro-batch is appended with its number, so a repeated run goes on where the
    last one stopped; a repeated key overwrites (the largest ``version``, then the
    later batch).  Returns the resulting table.
    """

    def append(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{target}/batch={number}")

    q = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    rows = spark.read.schema(StructType([*schema.fields]).add("_batch", "long")).parquet(f"{target}/batch=*")
    names = [f.name for f in schema.fields]
    newest = F.max_by(F.struct(*names), F.struct(version, "_batch"))
    return rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(newest.alias("r")).select("r.*")


def fold_shards(docs: DataFrame, queries: DataFrame, shard_col: str, shards: list[int], f16: bool = True) -> DataFrame:
    """Top-k by folding one shard after the other into the best so far."""
    max_k = queries.agg(F.max("k")).collect()[0][0] or 1
    best = None
    for s in shards:
        found = search.topk(docs.filter(F.col(shard_col) == s), queries, f16).join(queries.select("qid", "k"), "qid").drop("rank")
        best = found if best is None else search.fold(best, found, max_k)
    return search.rank(best, max_k).select("qid", "rank", "doc_id", "score")


def query_batches(queries: DataFrame, size: int) -> DataFrame:
    """``queries`` with ``batch``: their ids in chunks of ``size``."""
    return queries.withColumn("batch", F.floor(F.col("qid") / size).cast("long"))


def static_assignment(batches: DataFrame, workers: int) -> DataFrame:
    """``worker``: chunk k goes to worker k modulo their number."""
    return batches.withColumn("worker", F.pmod(F.col("batch"), F.lit(workers)).cast("long"))


def open_loop(service: DataFrame, rate: float, lanes: str = "lane") -> DataFrame:
    """Arrivals at a fixed rate and a queue for each lane.

    ``service``: ``lane``, ``i`` (from 0), ``service_ms``.  Query i arrives at
    ``i / rate`` seconds, starts when it has arrived and its predecessor has ended.
    Returns ``arrival_ms``, ``start_ms``, ``end_ms``, ``latency_ms`` besides.
    """

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("i").reset_index(drop=True)
        arrival = f["i"].to_numpy(float) * 1000.0 / rate
        start, free = [], 0.0
        for a, s in zip(arrival, f["service_ms"].to_numpy(float), strict=True):
            start.append(max(a, free))
            free = start[-1] + s
        f = f.assign(arrival_ms=arrival, start_ms=start)
        f["end_ms"] = f["start_ms"] + f["service_ms"]
        return f.assign(latency_ms=f["end_ms"] - f["arrival_ms"])

    more = StructType(list(service.schema.fields))
    for c in ("arrival_ms", "start_ms", "end_ms", "latency_ms"):
        more.add(c, "double")
    return service.groupBy(lanes).applyInPandas(run, more)


def open_loop_sql(service: DataFrame, rate: float, lanes: str = "lane", width: int = 65536) -> DataFrame:
    """The same queue as window sums: end(i) = S(i) + max over j <= i of (arrival(j) - S(j - 1)).

    Sums and maxima are taken in ranges of ``width`` places and carried from range to
    range over the ranges' totals, so no task reads a whole lane.  ``i`` counts a
    lane's requests from 0 on.
    """
    from pyspark.sql import Window

    ranges = Window.partitionBy(lanes).orderBy("_r")
    earlier, inside = ranges.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(lanes, "_r").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    s = service.withColumns({"arrival_ms": F.col("i") * 1000.0 / rate, "_r": F.floor(F.col("i") / width)})
    totals = s.groupBy(lanes, "_r").agg(F.sum("service_ms").alias("_t"))
    totals = totals.select(lanes, "_r", F.coalesce(F.sum("_t").over(earlier), F.lit(0.0)).alias("_before"))
    s = s.join(totals, [lanes, "_r"]).withColumn("_s", F.col("_before") + F.sum("service_ms").over(inside))
    s = s.withColumn("_lead", F.max(F.col("arrival_ms") - (F.col("_s") - F.col("service_ms"))).over(inside))
    leads = s.groupBy(lanes, "_r").agg(F.max("_lead").alias("_lead_r")).select(lanes, "_r", F.max("_lead_r").over(earlier).alias("_carried"))
    s = s.join(leads, [lanes, "_r"]).withColumn("end_ms", F.col("_s") + F.greatest("_lead", "_carried"))
    return s.withColumns({"start_ms": F.col("end_ms") - F.col("service_ms"), "latency_ms": F.col("end_ms") - F.col("arrival_ms")}).drop("_r", "_before", "_s", "_lead", "_carried")
