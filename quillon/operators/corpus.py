"""The corpus: validation, segments, shards, id maps and postings.

A corpus has ``doc_id``, ``vec`` (array of numbers) and ``tags`` (array of ids).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bitmaps, vectors
from ..runtime import ship

#: Fixed values of the posting layouts: documents to a unit, header bytes, bytes of a unit.
UNIT_DOCS, HEADER, SPARSE_UNIT, PACKED_UNIT, ID_BYTES = 16, 8, 6, 4, 4
DENSE_WEIGHT, MOST_WEIGHT = 0xFFFF, 0xFFFE


def prepare(docs: DataFrame, f16: bool = True) -> DataFrame:
    """Null tags become empty arrays, repeated tags go, vectors are rounded to half precision."""
    v = vectors.vector_f16(F.col("vec")) if f16 else F.col("vec").cast("array<double>")
    tags = F.array_distinct(F.coalesce(F.col("tags").cast("array<bigint>"), F.array().cast("array<bigint>")))
    return docs.withColumns({"vec": v, "tags": tags})


def violations(docs: DataFrame, dim: int, segment_docs: int, total: int | None = None) -> DataFrame:
    """``rule`` and ``rows`` for each rule that the corpus breaks; none if it is sound."""
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    counts = docs.agg(
        F.count(F.when(F.col("vec").isNull() | (F.size("vec") != dim), 1)).alias("vector_dim"),
        F.count(F.when(F.col("vec").isNotNull() & ~finite, 1)).alias("vector_not_finite"),
        F.count(F.when(F.col("doc_id").isNull() | (F.col("doc_id") < 0), 1)).alias("doc_id_invalid"),
        (F.count("doc_id") - F.count_distinct("doc_id")).alias("doc_id_repeated"),
        F.when((F.count_distinct("doc_id") > 0) & (F.max("doc_id") - F.min("doc_id") + 1 != F.count_distinct("doc_id")), 1).otherwise(0).alias("doc_id_not_dense"),
        F.when(F.lit(total).isNotNull() & (F.count(F.lit(1)) != F.lit(total if total is not None else 0)), 1).otherwise(0).alias("document_count"),
        F.lit(int(segment_docs % UNIT_DOCS != 0)).alias("segment_size"),
        F.lit(int(not 1 <= dim <= 65535)).alias("dim_range"),
    )
    pairs = F.array(*[F.struct(F.lit(c).alias("rule"), F.col(c).cast("long").alias("rows")) for c in counts.columns])
    return counts.select(F.explode(pairs).alias("x")).select("x.rule", "x.rows").filter("rows > 0")


def with_segments(docs: DataFrame, segment_docs: int, offset: int = 0) -> DataFrame:
    """``segment_id`` and ``local_id`` by the id's place after ``offset``."""
    at = F.col("doc_id") - offset
    return docs.withColumns({"segment_id": F.floor(at / segment_docs).cast("long"), "local_id": F.pmod(at, F.lit(segment_docs)).cast("long")})


def numbered(rows: DataFrame, key: str, by: list[str] | None = None, name: str = "i", width: int = 65536) -> DataFrame:
    """``name``: each row's place from 0 on by the integer ``key``, in every group of ``by``; repeated keys in any order.

    Ranges of ``width`` keys are counted first, and rows are numbered range by range, so
    a task sorts one range and only the ranges' counts are summed up in a row.  Null keys come first.
    """
    by = by or []
    ranged = rows.withColumn("_range", F.floor(F.col(key) / width))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    same = reduce(lambda a, b: a & b, [F.col(f"r.{c}").eqNullSafe(F.col(f"c.{c}")) for c in (*by, "_range")])
    joined = ranged.alias("r").join(counts.alias("c"), same).select("r.*", "_before")
    inside = F.row_number().over(Window.partitionBy(*by, "_range").orderBy(key)) - 1
    return joined.withColumn(name, (F.col("_before") + inside).cast("long")).drop("_range", "_before")


def shard_of(doc_id: Column, total: int, shards: int) -> Column:
    """Contiguous ranges of equal size; what is left over belongs to the last one."""
    each = max(1, total // shards)
    return F.least(F.floor(doc_id / each), F.lit(shards - 1)).cast("long")


def id_map(docs: DataFrame) -> DataFrame:
    return docs.select("segment_id", "local_id", "doc_id")


def to_global(local: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows with ``segment_id``, ``local_id`` get their ``doc_id``; unknown places are left out."""
    return local.join(ids, ["segment_id", "local_id"])


def from_strings(names: DataFrame, ids: DataFrame, name_col: str = "sdoc_id") -> DataFrame:
    """Rows with string ids get their ``doc_id`` and places from ``ids``, which has both; unknown ones are left out."""
    return names.join(ids, name_col)


def token(field: Column, term: Column) -> Column:
    """A 64-bit surrogate of a field's term."""
    return F.xxhash64(field, term)


def to_local(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.join(ids, "doc_id")


def posting_docs(docs: DataFrame) -> DataFrame:
    """One row for each tag of each document: ``tag``, ``doc_id``, and ``segment_id``, ``local_id`` where present."""
    extra = [c for c in ("segment_id", "local_id", "shard_id") if c in docs.columns]
    return docs.select("doc_id", *extra, F.explode(F.array_distinct("tags")).alias("tag")).withColumn("tag", F.col("tag").cast("long"))


def build_postings(entries: DataFrame) -> DataFrame:
    """``tag``, ``segment_id``, ``hit_count``, ``unit_count`` (16-document units with a hit)."""
    # dealt once by posting, which a segment's size bounds; repeated entries and units are then summed up in place
    dealt = entries.select("tag", "segment_id", "local_id").repartition("tag", "segment_id").distinct()
    units = dealt.groupBy("tag", "segment_id", F.floor(F.col("local_id") / UNIT_DOCS).alias("_u")).agg(F.count(F.lit(1)).alias("_h"))
    return units.groupBy("tag", "segment_id").agg(F.sum("_h").alias("hit_count"), F.count(F.lit(1)).alias("unit_count"))


def layout(hits: Column, segment_docs: int, threshold: float, matrix: bool = False, packed: bool = True) -> Column:
    """Sparse below the density threshold (compared in single precision), else dense."""
    sparse = (hits / segment_docs).cast("float") < F.lit(threshold).cast("float")
    if matrix:
        return F.when(sparse, "id_list").otherwise("byte_map")
    return F.when(sparse, "packed" if packed else "sparse_bitmap").otherwise("dense_bitmap")


def layout_bytes(kind: Column, hits: Column, units: Column, segment_docs: int) -> Column:
    size = (
        F.when(kind == "dense_bitmap", HEADER + 2 * -(-segment_docs // UNIT_DOCS))
        .when(kind == "byte_map", HEADER + segment_docs)
        .when(kind == "id_list", HEADER + ID_BYTES * hits)
        .when(kind == "sparse_bitmap", HEADER + SPARSE_UNIT * units)
        .otherwise(HEADER + PACKED_UNIT * units)
    )
    return (F.ceil(size / 4) * 4).cast("long")


def weight(kind: Column, units: Column) -> Column:
    """0 for no hits, the units of a sparse posting, the largest value for a dense one."""
    sparse = kind.isin("packed", "sparse_bitmap", "id_list")
    return F.when(units == 0, 0).when(sparse, F.least(units, F.lit(MOST_WEIGHT))).otherwise(DENSE_WEIGHT).cast("long")


def with_layout(postings: DataFrame, segment_docs: int, threshold: float, matrix: bool = False, packed: bool = True) -> DataFrame:
    kind = layout(F.col("hit_count"), segment_docs, threshold, matrix, packed)
    out = postings.withColumn("layout", kind)
    return out.withColumns({"bytes": layout_bytes(F.col("layout"), F.col("hit_count"), F.col("unit_count"), segment_docs), "weight": weight(F.col("layout"), F.col("unit_count"))})


def segment_bitmaps(entries: DataFrame, segment_docs: int) -> DataFrame:
    """``tag``, ``segment_id``, ``words``: each posting as a document bitmap of its segment."""
    at = F.collect_set(F.col("local_id").cast("int"))
    return entries.groupBy("tag", "segment_id").agg(at.alias("_at")).select("tag", "segment_id", bitmaps.to_words(F.col("_at"), segment_docs).alias("words"))


def unit_runs(entries: DataFrame) -> DataFrame:
    """``tag``, ``segment_id``, ``run_start``, ``run_length``: runs of neighbouring units with a hit."""
    units = entries.select("tag", "segment_id", F.floor(F.col("local_id") / UNIT_DOCS).alias("unit")).distinct()
    island = F.col("unit") - F.row_number().over(Window.partitionBy("tag", "segment_id").orderBy("unit"))
    return units.withColumn("_i", island).groupBy("tag", "segment_id", "_i").agg(F.min("unit").alias("run_start"), F.count(F.lit(1)).alias("run_length")).drop("_i")


def encoded_postings(entries: DataFrame, segment_docs: int, layout: Column) -> DataFrame:
    """``tag``, ``segment_id``, ``layout``, ``posting``: each posting's bytes; ``layout`` may use ``hit_count``. A posting's ids are bounded by its segment."""
    from ..functions.posting_codec import encode

    held = entries.groupBy("tag", "segment_id").agg(F.collect_set(F.col("local_id").cast("int")).alias("_at")).withColumn("hit_count", F.size("_at"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            made = [encode(at, segment_docs, kind) for at, kind in zip(b.column("_at").to_pylist(), b.column("layout").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(made, pa.binary())], names=["tag", "segment_id", "layout", "posting"])

    ship(entries.sparkSession)
    return held.select(F.col("tag").cast("long").alias("tag"), F.col("segment_id").cast("long").alias("segment_id"), layout.alias("layout"), "_at").mapInArrow(run, "tag long, segment_id long, layout string, posting binary")


def decoded_postings(encoded: DataFrame) -> DataFrame:
    """``tag``, ``segment_id``, ``layout``, ``local_id``: the entries of encoded postings."""
    from ..functions.posting_codec import decode

    def run(batches):
        import pyarrow as pa

        for b in batches:
            found = [decode(p)[1] for p in b.column("posting").to_pylist()]
            row = pa.array([k for k, at in enumerate(found) for _ in at], pa.int64())
            ids = pa.array([int(x) for at in found for x in at], pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(c).take(row) for c in ("tag", "segment_id", "layout")], ids], names=["tag", "segment_id", "layout", "local_id"])

    ship(encoded.sparkSession)
    return encoded.select("tag", "segment_id", "layout", "posting").mapInArrow(run, "tag long, segment_id long, layout string, local_id long")


def token_exists(tokens: DataFrame, entries: DataFrame) -> DataFrame:
    """``tokens`` (with ``tag``) and whether a posting exists for them."""
    known = entries.select(F.col("tag").alias("_t")).distinct()
    return tokens.join(known, F.col("tag") == F.col("_t"), "left").withColumn("present", F.col("_t").isNotNull()).drop("_t")


def write_index(docs: DataFrame, folder: str, segment_docs: int, threshold: float) -> None:
    """Vectors, id map and postings as Parquet below ``folder``, by segment."""
    placed = with_segments(docs, segment_docs)
    entries = posting_docs(placed)
    # a file for each segment, not for each segment and task
    placed.select("segment_id", "local_id", "doc_id", "vec", "tags").repartition("segment_id").write.partitionBy("segment_id").parquet(f"{folder}/documents")
    entries.repartition("segment_id").write.partitionBy("segment_id").parquet(f"{folder}/posting_docs")
    with_layout(build_postings(entries), segment_docs, threshold).write.parquet(f"{folder}/postings")


def load_index(spark, folder: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in ("documents", "posting_docs", "postings")}
