"""Text formats: filter, top-k and query files; report sinks."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.corpus import numbered
from ..plans import filters, json_filter
from ..runtime import ship


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line`` (from 0) and ``text`` of one file, right-trimmed of CR and blanks."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line", "text"))
    return lines.select(F.col("line").cast("long").alias("line"), F.regexp_replace("text", "[\r \t]+$", "").alias("text"))


def read_filters(spark: SparkSession, path: str, keep_blank: bool = True) -> DataFrame:
    """``fid``, ``expr``: a filter on every line.

    By default a blank line is a match-all filter at its place; with
    ``keep_blank=False`` blank lines are skipped and places close up.  The file's
    last line break starts no line.  The first filter that doesn't parse raises
    :class:`~quillon.plans.filters.FilterSyntaxError`.
    """
    lines = numbered_lines(spark, path)
    last = lines.agg(F.max("line")).collect()[0][0]
    lines = lines.filter(~((F.col("line") == F.lit(last)) & (F.col("text") == "")))
    if not keep_blank:
        kept = lines.filter("text <> ''")
        lines = kept.withColumn("line", F.row_number().over(Window.orderBy("line")).cast("long") - 1)
    rows = lines.collect()  # a query file: it is compiled on the driver
    for r in rows:
        filters.parse(r["text"])
    return lines.select(F.col("line").alias("fid"), F.col("text").alias("expr"))


def assign_filters(queries: DataFrame, fids: DataFrame, seed: int = 1) -> DataFrame:
    """``qid``, ``fid``: one to one if there are as many, else by a seeded hash of the query."""
    n, m = queries.count(), fids.count()
    if n == m:
        return numbered(queries.select("qid"), "qid", name="_at").join(numbered(fids.select("fid"), "fid", name="_at"), "_at").select("qid", "fid")
    if not m:
        return queries.select("qid", F.lit(None).cast("long").alias("fid"))
    held = numbered(fids.select("fid"), "fid", name="_at")
    return queries.select("qid", F.pmod(F.xxhash64("qid", F.lit(seed)), F.lit(m)).alias("_at")).join(held, "_at").select("qid", "fid")


def read_topk(spark: SparkSession, path: str, queries: int) -> DataFrame:
    """``qid``, ``k``: positive integers, blank lines ignored; more than ``queries`` are cut, fewer raise an error."""
    rows = numbered_lines(spark, path).filter("trim(text) <> ''")
    k = F.expr("try_cast(trim(text) AS INT)")
    placed = rows.select((F.row_number().over(Window.orderBy("line")) - 1).cast("long").alias("qid"), k.alias("k"))
    bad, n = placed.agg(F.count(F.when(F.coalesce("k", F.lit(0)) <= 0, 1)), F.count(F.lit(1))).collect()[0]
    if bad:
        raise ValueError(f"{bad} lines aren't positive integers")
    if n < queries:
        raise ValueError(f"{n} values for {queries} queries")
    return placed.filter(F.col("qid") < queries)


def read_query_records(spark: SparkSession, path: str) -> DataFrame:
    """``line``, ``record`` (JSON text): a file that is one array or object, else one record on each line; others than objects are ignored."""

    def split(frames):
        for f in frames:
            for text in f["value"]:
                try:
                    whole = json.loads(text)
                    rows = whole if isinstance(whole, list) else [whole]
                    pairs = [(k, r) for k, r in enumerate(rows)]
                except ValueError:
                    pairs = []
                    for k, line in enumerate(text.split("\n")):
                        if line.strip():
                            try:
                                pairs.append((k, json.loads(line)))
                            except ValueError:
                                pairs.append((k, {"unreadable": line}))
                out = [(k, json.dumps(r)) for k, r in pairs if isinstance(r, dict)]
                if out:
                    yield pd.DataFrame(out, columns=["line", "record"])

    return spark.read.text(path, wholetext=True).mapInPandas(split, "line long, record string")


def extract_queries(records: DataFrame, tags: dict[str, int], dim: int | None = None, strict: bool = False) -> DataFrame:
    """``line``, ``vec``, ``filter``, ``k``, ``problem`` (null for good records); ``strict`` raises at the first problem."""

    def one(frames):
        for f in frames:
            out = []
            for line, record in zip(f["line"], f["record"], strict=True):
                try:
                    out.append((line, *json_filter.extract(record, tags, dim), None))
                except (ValueError, TypeError) as e:
                    if strict:
                        raise ValueError(f"line {line}: {e}") from e
                    out.append((line, None, None, None, str(e)))
            yield pd.DataFrame(out, columns=["line", "vec", "filter", "k", "problem"]).astype({"k": "Int64"})

    ship(records.sparkSession)
    return records.mapInPandas(one, "line long, vec array<double>, filter string, k long, problem string")


def checked_records(records: DataFrame, dim: int | None = None) -> DataFrame:
    """The shape checks alone, as columns: ``line``, ``k``, ``dim``, ``ok``."""
    num = F.get_json_object("record", "$.result_num")
    inner = F.get_json_object("record", "$.main_tier.json_query")
    vector = F.from_json(F.get_json_object(inner, "$.vector.relevance_learning2rank"), "array<double>")
    k = F.when(num.rlike("^[0-9]+$"), num.cast("bigint"))
    ok = F.coalesce(k > 0, F.lit(False)) & vector.isNotNull() & ((F.size(vector) == dim) if dim is not None else F.lit(True))
    return records.select("line", k.alias("k"), F.size(vector).alias("dim"), F.coalesce(ok, F.lit(False)).alias("ok"))


def write_tsv(df: DataFrame, path: str, order: list[Column | str] | None = None) -> None:
    """Tab-separated text with a header."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def write_latencies(rows: DataFrame, path: str) -> None:
    """Per-query latencies: ``idx``, ``ms``, ``topk``, by ``idx``."""
    write_tsv(rows.select("idx", _ms("ms"), "topk"), path, ["idx"])


def write_shard_latencies(rows: DataFrame, path: str, shards: int) -> None:
    """Latencies of each shard: ``idx``, ``shard0_ms`` and so on, ``max_shard_ms``, ``merge_ms``, ``total_ms``, by ``idx``.

    ``rows``: ``idx``, ``shard_ms`` (an array), ``merge_ms``, ``total_ms``.  With one shard nothing is written.
    """
    if shards <= 1:
        return
    each = [_ms(F.col("shard_ms")[s], f"shard{s}_ms") for s in range(shards)]
    write_tsv(rows.select("idx", *each, _ms(F.array_max("shard_ms"), "max_shard_ms"), _ms("merge_ms"), _ms("total_ms")), path, ["idx"])


def _ms(value: Column | str, name: str | None = None) -> Column:
    return F.format_string("%.4f", value).alias(name or value)


def write_lines(lines: DataFrame, path: str) -> None:
    """The second column as one text file, by the first; a query file, not a corpus."""
    at, value = lines.columns
    lines.repartition(1).sortWithinPartitions(at).select(value).write.mode("overwrite").text(path)


def write_queries(queries: DataFrame, path: str, manifest: dict) -> None:
    """The results of :func:`extract_queries` below ``path``.

    ``queries`` (Parquet), ``filters`` and ``topk`` (lines), ``manifest`` (JSON, with
    counts, dimension and range of k) of the good ones; ``skipped_warnings`` (lines) if
    there are others.  ValueError if none is good.
    """
    spark = queries.sparkSession
    rows = queries if "problem" in queries.columns else queries.withColumn("problem", F.lit(None).cast("string"))
    good = rows.filter("problem is null").drop("problem")
    good.write.mode("overwrite").parquet(f"{path}/queries")
    good = spark.read.parquet(f"{path}/queries")
    n, dim, low, high = good.agg(F.count(F.lit(1)), F.max(F.size("vec")), F.min("k"), F.max("k")).collect()[0]
    skipped = rows.filter("problem is not null").select("line", F.format_string("line %d: %s", "line", "problem").alias("problem"))
    bad = skipped.count()
    if not n:
        raise ValueError(f"no valid queries, {bad} skipped")
    write_lines(good.select("line", "filter"), f"{path}/filters")
    write_lines(good.select("line", F.col("k").cast("string")), f"{path}/topk")
    if bad:
        write_lines(skipped, f"{path}/skipped_warnings")
    whole = manifest | {"query_count": n, "vector_dim": dim, "skipped_query_count": bad, "topk_min": low, "topk_max": high}
    spark.createDataFrame([(json.dumps(whole, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def tree_counters(records: DataFrame) -> DataFrame:
    """``line``, ``counter``, ``name``, ``n``: depth, references, node kinds, joins and sections of each record's filter tree.

    Records without a readable tree have no rows.
    """

    def count(frames):
        for f in frames:
            out = []
            for line, record in zip(f["line"], f["record"], strict=True):
                try:
                    tree = json.loads(json.loads(record)[json_filter.MAIN_TIER][json_filter.JSON_QUERY])[json_filter.VECTOR][json_filter.SYNTAX_FILTER]
                except (ValueError, KeyError, TypeError):
                    continue
                s = json_filter.tree_stats(tree)
                out += [(line, "depth", "", s["depth"]), (line, "refs", "", s["refs"])]
                out += [(line, c, name, n) for c in ("kinds", "joins", "sections") for name, n in s[c].items()]
            yield pd.DataFrame(out, columns=["line", "counter", "name", "n"])

    ship(records.sparkSession)
    return records.mapInPandas(count, "line long, counter string, name string, n long")
