"""Ground truth, recall and filter diagnosis."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import filters
from . import search


def truth(docs: DataFrame, queries: DataFrame, f16: bool = True) -> DataFrame:
    """``qid``, ``doc_id``: the exact results of every query, in one pass over the documents."""
    return search.topk(docs, queries, f16).select("qid", "doc_id")


def recall(results: DataFrame, exact: DataFrame) -> DataFrame:
    """``qid``, ``hits``, ``expected``, ``recall``; queries without any exact result are left out."""
    got = results.select("qid", "doc_id", F.lit(1).alias("hit")).distinct()
    joined = exact.select("qid", "doc_id").distinct().join(got, ["qid", "doc_id"], "left")
    return joined.groupBy("qid").agg(F.count("hit").alias("hits"), F.count(F.lit(1)).alias("expected")).withColumn("recall", F.col("hits") / F.col("expected"))


def recall_summary(per_query: DataFrame) -> DataFrame:
    return per_query.agg(F.count(F.lit(1)).alias("queries"), F.avg("recall").alias("avg_recall"), F.min("recall").alias("min_recall"), F.count(F.when(F.col("recall") < 1, 1)).alias("below_one"))


def fingerprint(parameters: DataFrame) -> DataFrame:
    """``parameters`` with ``fingerprint``: a digest of all their columns, the key of cached truth."""
    return parameters.withColumn("fingerprint", F.sha2(F.to_json(F.struct(*parameters.columns)), 256))


def cached_truth(docs: DataFrame, queries: DataFrame, folder: str, key: str, f16: bool = True) -> DataFrame:
    """The truth under ``folder/key``, computed and written if it isn't there."""
    spark = docs.sparkSession
    path = f"{folder.rstrip('/')}/{key}"
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not jvm.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm):
        truth(docs, queries, f16).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def term_rows(spark, texts: dict[int, str]) -> DataFrame:
    """``qid``, ``position``, ``tag``: every tag of every filter, in order, with repetitions."""
    rows = [(q, k, t) for q, text in texts.items() for k, t in enumerate(filters.terms(filters.parse(text)))]
    return spark.createDataFrame(rows, "qid long, position long, tag long")


def diagnose(terms: DataFrame, postings: DataFrame, frequencies: DataFrame) -> DataFrame:
    """For each query how many of its different tags have postings, and what that means.

    ``frequencies``: ``tag``, ``doc_freq`` as counted at conversion.
    """
    known = postings.select(F.col("tag").alias("_p")).distinct()
    t = terms.select("qid", "tag").distinct().join(known, F.col("tag") == F.col("_p"), "left").join(frequencies.select(F.col("tag").alias("_f"), "doc_freq"), F.col("tag") == F.col("_f"), "left")
    here, converted = F.col("_p").isNotNull(), F.coalesce("doc_freq", F.lit(0)) > 0
    out = t.groupBy("qid").agg(
        F.count(F.lit(1)).alias("terms"), F.count(F.when(here, 1)).alias("present"), F.count(F.when(~here, 1)).alias("missing"),
        F.count(F.when(converted & ~here, 1)).alias("lost"), F.count(F.when(~converted & here, 1)).alias("unexpected"),
    )
    # fixed values: the report's diagnoses
    said = (
        F.when(F.col("lost") > 0, "builder_or_loader_lost_tags_after_converter")
        .when(F.col("unexpected") > 0, "index_and_converter_frequency_file_are_inconsistent")
        .when(F.col("missing") > 0, "missing_postings_match_converter_absence_or_index_subset")
        .otherwise("no_missing_postings")
    )
    return out.withColumn("diagnosis", said)


def steps_text(steps: list[tuple]) -> str:
    """Post-order steps as text: the tags of a posting in braces, operators with their posting and stacked operands."""
    return " ".join("{" + ",".join(map(str, n[0])) + "}" if op == "POST" else f"{op}({','.join(map(str, n))})" for op, *n in steps) or "MATCH_ALL"


def report(queries: DataFrame, postings: DataFrame, frequencies: DataFrame) -> DataFrame:
    """The effective filters: ``qid``, ``ast``, ``postorder``, and what :func:`diagnose` says of their terms.

    ``queries``: ``qid``, ``filter``.  Each different filter is compiled and diagnosed
    once, batch by batch.  A filter without terms has none missing.
    """
    parts = []
    for part, texts in search._batches(queries):
        trees = [filters.parse(t) for t in texts]
        rows = [(k, filters.to_text(t), steps_text(filters.to_postorder(filters.flatten(t)))) for k, t in enumerate(trees)]
        said = diagnose(term_rows(queries.sparkSession, dict(enumerate(texts))), postings, frequencies).withColumnRenamed("qid", "fid")
        known = queries.sparkSession.createDataFrame(rows, "fid long, ast string, postorder string").join(said, "fid", "left")
        parts.append(part.select("qid", F.col("fid").cast("long").alias("fid")).join(F.broadcast(known), "fid").drop("fid"))  # a row for each filter of a batch
    out = reduce(DataFrame.unionByName, parts)
    return out.fillna(0, ["terms", "present", "missing", "lost", "unexpected"]).fillna("no_missing_postings", ["diagnosis"])


def conversions(terms: DataFrame, postings: DataFrame) -> DataFrame:
    """``qid``, ``postings`` its filter touches, those ``converted`` from units to bitmaps, and their ``units``."""
    sparse = F.col("layout") != "dense_bitmap"
    touched = terms.select("qid", "tag").distinct().join(postings, "tag")
    return touched.groupBy("qid").agg(F.count(F.lit(1)).alias("postings"), F.count(F.when(sparse, 1)).alias("converted"), F.coalesce(F.sum(F.when(sparse, F.col("unit_count"))), F.lit(0)).alias("units"))


def compiled(rows: DataFrame, expr: str = "filter") -> DataFrame:
    """``rows`` with what becomes of the filter in ``expr``, whatever the number of different filters.

    ``ast`` and ``postorder`` (text), ``depth``, ``refs``, ``tags`` (of the tree as it is
    written), ``sound`` (its post-order steps are valid), ``cut_sound`` (they still are
    without the last one), ``shape`` (an array of ``op``, ``nodes``, ``postings``,
    ``stacked``, ``most_operands``) and ``problem``.  A filter that can't be read has
    its problem and nulls; a null or blank one matches all.
    """
    from ..runtime import ship

    found = "ast string, postorder string, depth long, refs long, tags long, sound boolean, cut_sound boolean, shape array<struct<op: string, nodes: bigint, postings: bigint, stacked: bigint, most_operands: bigint>>, problem string"

    def one(text):
        try:
            tree = filters.parse(text)
        except filters.FilterSyntaxError as e:
            return (*[None] * 8, str(e))
        flat = filters.flatten(tree)
        steps, s, refs = filters.to_postorder(flat), filters.shape(flat), filters.terms(tree)
        shape = [(op, s["nodes"][op], s["postings"][op], s["stacked"][op], s["most"]) for op in s["nodes"]]
        return (filters.to_text(tree), steps_text(steps), filters.depth(tree), len(refs), len(set(refs)), filters.check_postorder(steps), filters.check_postorder(steps[:-1]), shape, None)

    @F.pandas_udf(found)
    def run(texts: pd.Series) -> pd.DataFrame:
        seen = {t: one(t) for t in texts.unique()}
        return pd.DataFrame([seen[t] for t in texts], columns=["ast", "postorder", "depth", "refs", "tags", "sound", "cut_sound", "shape", "problem"]).astype({c: "Int64" for c in ("depth", "refs", "tags")} | {c: "boolean" for c in ("sound", "cut_sound")})

    ship(rows.sparkSession)
    return rows.withColumn("_c", run(F.coalesce(expr, F.lit("")))).select(*rows.columns, "_c.*")


def operand_bucket(n):
    """1, 2, 3, 4, 5-8, 9-16, 17-32, 32+."""
    return F.when(n <= 4, n.cast("string")).when(n <= 8, "5-8").when(n <= 16, "9-16").when(n <= 32, "17-32").otherwise("32+")
