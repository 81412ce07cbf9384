"""Exact filtered top-k search.

The documents are never shuffled: a batch of queries of bounded size is broadcast,
the filter is tested before anything is scored, and each task keeps its k best for
each query before the results meet.  Ties go to the smaller id.  Documents and
queries meet in blocks, whose pairs are scored by matrix products; where the sum in
order could differ from the product's in a way that shows, it is taken instead.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, ByteType, DoubleType, IntegerType, LongType, ShortType, StructField, StructType

from ..functions import vectors
from ..plans import filters, postings_algebra
from .corpus import numbered

#: Queries to a batch; more are searched batch by batch.
BATCH = 4096
#: More different filters than this in a batch are tested on bitmaps of their tags instead of in one predicate.
MAX_FILTERS = 256
_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"


def filter_predicate(texts: list[str], fid: Column, tags: Column) -> Column:
    """Whether the filter number ``fid`` matches ``tags``."""
    trees = [filters.parse(t) for t in texts]
    out = None
    for k, tree in enumerate(trees):
        test = filters.to_column(tree, tags)
        out = F.when(fid == k, test) if out is None else out.when(fid == k, test)
    return F.coalesce(out, F.lit(False)) if out is not None else F.lit(False)


def _parts(queries: DataFrame) -> tuple[list[DataFrame], int]:
    """The queries in batches of about ``BATCH``, and their number."""
    n = queries.count()
    parts = max(1, -(-n // BATCH))
    return [queries if parts == 1 else queries.filter(F.pmod(F.xxhash64("qid"), F.lit(parts)) == b) for b in range(parts)], n


def _batches(queries: DataFrame) -> list[tuple[DataFrame, list[str]]]:
    """The queries in batches with ``fid``, and each batch's different filters."""
    out, mark = [], "\x1f"  # no filter that can be read holds the mark
    for part in _parts(queries)[0]:
        text = F.coalesce("filter", F.lit(""))
        texts = sorted(r[0] for r in part.select(text).distinct().collect())  # BATCH texts at most, about
        # one literal, however many filters there are
        place = F.array_position(F.split(F.lit(mark.join(texts)), mark), text) - 1
        out.append((part.withColumn("fid", place.cast("int")), texts))
    return out


def match(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """Every pair ``qid``, ``doc_id`` (with ``vec``, ``qvec``, ``k``) that the query's filter allows."""
    parts = []
    for part, texts in _batches(queries):
        q = F.broadcast(part.select("qid", F.col("vec").alias("qvec"), "k", "fid"))  # BATCH rows, about
        if len(texts) <= MAX_FILTERS:
            parts.append(docs.join(q, filter_predicate(texts, F.col("fid"), F.col("tags"))))
        else:
            parts.append(_matched(docs, texts).join(q, "fid").select(*docs.columns, "qid", "qvec", "k", "fid"))
    return reduce(DataFrame.unionByName, parts)


def _matched(docs: DataFrame, texts: list[str]) -> DataFrame:
    """``docs`` with ``fid``, a row for every filter that a document matches; tested a batch of documents at once."""
    from ..functions.blocks import matching_filters
    from ..runtime import ship

    ship(docs.sparkSession)
    at = docs.columns.index("tags")
    run = matching_filters([filters.flatten(filters.parse(t)) for t in texts], at)
    rows = docs.withColumn("tags", F.col("tags").cast("array<bigint>"))
    tested = rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("_fids", ArrayType(IntegerType()))]))
    return tested.select(*docs.columns, F.explode("_fids").alias("fid"))


def match_postings(docs: DataFrame, postings: DataFrame, queries: DataFrame) -> DataFrame:
    """``qid``, ``doc_id``, ``k`` of the same pairs as :func:`match`, evaluated over postings; ``queries``: ``qid``, ``filter``, ``k``."""
    parts = []
    for part, texts in _batches(queries):
        found = postings_algebra.match_batch({k: filters.parse(t) for k, t in enumerate(texts)}, postings, docs).withColumnRenamed("qid", "fid")
        parts.append(found.join(F.broadcast(part.select("qid", "k", "fid")), "fid").select("qid", "doc_id", "k"))  # BATCH rows, about
    return reduce(DataFrame.unionByName, parts)


def score(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("score", vectors.dot(F.col("vec"), F.col("qvec")))


def quantised(frame: DataFrame, f16: bool) -> DataFrame:
    return frame.withColumn("vec", vectors.vector_f16(F.col("vec")) if f16 else F.col("vec").cast("array<double>"))


def rank(scored: DataFrame, max_k: int, by: list[str] | None = None, k: Column | None = None, name: str = "rank") -> DataFrame:
    """The rows up to ``k`` (a column of at most ``max_k``) of each group, by score, then id."""
    spark = scored.sparkSession
    if int(spark.conf.get(_LIMIT)) < max_k:
        spark.conf.set(_LIMIT, str(max_k))
    order = Window.partitionBy(*(by or ["qid"])).orderBy(F.col("score").desc(), "doc_id")
    ranked = scored.withColumn(name, F.row_number().over(order)).filter(F.col(name) <= max_k)
    return ranked.filter(F.col(name) <= (F.col("k") if k is None else k)).withColumn(name, F.col(name).cast("long"))


#: Bytes of a batch that goes to a Python worker, at most; a row holds a block of documents and one of queries.
BATCH_BYTES = 8 << 20
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


#: Tasks to a core that smaller blocks are dealt to.
DEALT = 4


def block_pairs(docs: DataFrame, queries: DataFrame, shard_col: str | None = None, dealt_out: bool = False) -> list[DataFrame]:
    """``d_number``, ``d_block``, ``q_number``, ``q_block``: every block of documents with every block of queries, for each batch of queries.

    ``queries`` may have ``k`` and ``keep``.  A task packs its own documents, so they stay where they are read;
    ``dealt_out`` deals smaller blocks to all cores, for results that are far larger than the documents.
    """
    from ..functions import blocks
    from ..runtime import ship

    spark = docs.sparkSession
    ship(spark)
    if int(spark.conf.get(_BYTES).rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(_BYTES, str(BATCH_BYTES))
    vec = F.col("vec").cast("array<double>").alias("vec")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), vec, F.col("tags").cast("array<bigint>").alias("tags"), *([F.col(shard_col).alias("shard")] if shard_col else []))
    held = rows.mapInArrow(blocks.packed(blocks.SMALL if dealt_out else blocks.PART), "d_number long, d_block binary")
    if dealt_out:
        held = held.repartition(DEALT * spark.sparkContext.defaultParallelism)
    wanted = [F.col("qid").cast("long").alias("qid"), vec, F.coalesce("filter", F.lit("")).alias("filter"), *[F.col(c).cast("long").alias(c) for c in ("k", "keep") if c in queries.columns]]
    parts, n = _parts(queries)
    dealt = -(-n // (len(parts) * blocks.QUERIES))
    # even shares of a batch, BATCH rows about, whatever files they come from
    asked = [p.select(*wanted).repartition(max(1, dealt)).mapInArrow(blocks.packed(blocks.QUERIES), "q_number long, q_block binary") for p in parts]
    return [held.join(F.broadcast(a), F.lit(True)) for a in asked]


def scores(docs: DataFrame, queries: DataFrame, f16: bool = True, digits: int | None = None) -> DataFrame:
    """``qid``, ``doc_id``, ``score`` of every pair that the filters allow, rounded to ``digits`` where given; nothing is held but two blocks."""
    from ..functions.blocks import block_scores

    queries = queries.select("qid", "vec", "filter")
    return reduce(DataFrame.unionByName, [p.mapInArrow(block_scores(f16, digits), "qid long, doc_id long, score double") for p in block_pairs(docs, queries, dealt_out=True)])


def totals(docs: DataFrame, queries: DataFrame, f16: bool = True) -> DataFrame:
    """``qid``, ``pairs``, ``total``: each query's number of pairs that its filter allows and the sum of their scores."""
    from ..functions.blocks import block_totals

    queries = queries.select("qid", "vec", "filter")
    own = reduce(DataFrame.unionByName, [p.mapInArrow(block_totals(f16), "qid long, pairs long, total double") for p in block_pairs(docs, queries)])
    return own.groupBy("qid").agg(F.sum("pairs").alias("pairs"), F.sum("total").alias("total"))


def topk(docs: DataFrame, queries: DataFrame, f16: bool = True, shard_col: str | None = None, ratio: float = 1.0, shards: list[int] | None = None, digits: int | None = None) -> DataFrame:
    """``qid``, ``rank``, ``doc_id``, ``score`` of each query's ``k`` best matching documents, scores rounded to ``digits`` where given.

    ``docs``: ``doc_id``, ``vec``, ``tags``; ``queries``: ``qid``, ``vec``, ``filter``,
    ``k``.  With ``shard_col`` each shard first keeps ``ceil(ratio * k)`` (1 at least)
    of its own, which is exact at ratio 1; ``shards`` names those that take part.
    Fewer matches than k give all of them.  Queries that keep more than a block
    holds have their scores shuffled in packed runs and ranked slice by slice.
    """
    from ..functions.blocks import PART, SLICE, block_best

    if shard_col and shards is not None:
        docs = docs.filter(F.col(shard_col).isin(*shards))
    kinds = docs.schema["doc_id"].dataType, queries.schema["qid"].dataType
    if not all(isinstance(x, (ByteType, ShortType, IntegerType, LongType)) for x in kinds):
        found = topk_rows(docs, queries, f16, shard_col, ratio)
        return found if digits is None else found.withColumn("score", F.round("score", digits))
    max_k = queries.agg(F.max("k")).collect()[0][0] or 1
    if max_k > PART and not shard_col and (n := docs.count()) <= SLICE:
        bulk = queries.filter(F.col("k") > PART)
        asked, different = bulk.agg(F.count(F.lit(1)), F.count_distinct("qid")).collect()[0]
        if asked == different:  # rows that share an id are ranked together, below
            found, rest = _topk_runs(docs, bulk, f16, digits, n), queries.filter(F.col("k") <= PART)
            shared = rest.join(bulk.select("qid"), "qid", "left_semi")
            if rest.isEmpty():
                return found
            if shared.isEmpty():
                return found.unionByName(topk(docs, rest, f16, digits=digits))
    kept = F.greatest(F.lit(1), F.ceil(F.col("k") * ratio)) if shard_col else F.col("k")
    asked = queries.select("qid", "vec", "filter", "k", kept.alias("keep"))
    made = StructType([StructField("qid", LongType()), StructField("k", IntegerType()), StructField("doc_id", LongType()), StructField("score", DoubleType())])
    if shard_col:
        made.add("shard", docs.schema[shard_col].dataType)
    found = reduce(DataFrame.unionByName, [p.mapInArrow(block_best(f16, bool(shard_col)), made) for p in block_pairs(docs, asked, shard_col)])
    if shard_col:
        found = rank(found, max_k, ["qid", "shard"], kept, "_shard_rank")
    score = F.col("score") if digits is None else F.round("score", digits).alias("score")
    return rank(found, max_k).select(F.col("qid").cast(kinds[1]).alias("qid"), "rank", F.col("doc_id").cast(kinds[0]).alias("doc_id"), score)


def _topk_runs(docs: DataFrame, queries: DataFrame, f16: bool, digits: int | None, n: int) -> DataFrame:
    """:func:`topk` over ``n`` documents where no block of a query's results is to be cut; a task ranks a slice of queries at a time."""
    from ..functions import blocks

    sliced = max(1, min(blocks.SLICED, blocks.SLICE // max(1, n)))
    asked = queries.select("qid", "vec", "filter", F.col("k").alias("keep"))
    runs = []
    for b, p in enumerate(block_pairs(docs, asked)):
        own = p.mapInArrow(blocks.block_runs(f16, sliced), "slice string, run binary")
        runs.append(own.withColumn("slice", F.concat(F.lit(f"{b}-"), "slice")))
    dealt = reduce(DataFrame.unionByName, runs).repartition("slice").sortWithinPartitions("slice")
    found = dealt.mapInArrow(blocks.ranked_runs(digits), "qid long, rank long, doc_id long, score double")
    return found.select(F.col("qid").cast(queries.schema["qid"].dataType).alias("qid"), "rank", F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "score")


def topk_rows(docs: DataFrame, queries: DataFrame, f16: bool = True, shard_col: str | None = None, ratio: float = 1.0) -> DataFrame:
    """The same results as :func:`topk`, pair by pair in Spark's own operators; ids may be of any type that has an order."""
    max_k = queries.agg(F.max("k")).collect()[0][0] or 1
    scored = score(match(quantised(docs, f16), quantised(queries, f16)))
    if shard_col:
        kept = F.greatest(F.lit(1), F.ceil(F.col("k") * ratio))
        scored = rank(scored, max_k, ["qid", shard_col], kept, "_shard_rank")
    return rank(scored, max_k).select("qid", "rank", "doc_id", "score")


def topk_blocks(docs: DataFrame, queries: DataFrame, f16: bool = True) -> DataFrame:
    """:func:`topk` without shards."""
    return topk(docs, queries, f16)


def fold(best: DataFrame, more: DataFrame, max_k: int) -> DataFrame:
    """Merge a shard's results (``qid``, ``k``, ``doc_id``, ``score``) into the best so far."""
    return rank(best.unionByName(more), max_k).drop("rank")


def cycle(queries: DataFrame, n: int) -> DataFrame:
    """``n`` queries: number i is the stored one at place i modulo their number; ``qid`` runs from 0 on."""
    held = numbered(queries, "qid", name="_at")
    size = queries.count()
    return queries.sparkSession.range(n).withColumnRenamed("id", "_i").join(held, F.pmod(F.col("_i"), F.lit(max(1, size))) == F.col("_at")).withColumn("qid", F.col("_i")).drop("_i", "_at")
