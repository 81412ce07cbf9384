"""Corpus, index, latency and experiment statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors
from .corpus import HEADER, PACKED_UNIT

#: Lower bounds of the frequency bands, as shares of the documents.
BANDS = [("always", 0.999), ("universal", 0.90), ("common", 0.05), ("low", 0.01), ("rare", 0.0)]
#: Ranges into which a group's values are cut for order statistics.
RANGES = 64


def order_percentiles(df: DataFrame, value: str, shares: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """Order statistics: the value at place ``min(n - 1, int(p * n))`` of the sorted values, for each name in ``shares``.

    Equal values are counted first.  A sketch of each group cuts its values into ranges;
    the ranges' counts tell in which one a place lies, and only those ranges are sorted,
    so no task reads a whole group.  The result is exact whatever the sketch's error.
    """
    by = by or []
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    steps = F.array(*[F.lit(k / RANGES) for k in range(1, RANGES)])
    marks = df.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.percentile_approx(value, steps, F.lit(RANGES * 10)).alias("_marks"))
    join = lambda a, b, keys: a.join(b, keys) if keys else a.crossJoin(b)  # noqa: E731  (without groups b has one row)
    ranged = join(counts, marks, by).withColumn("_range", F.size(F.filter("_marks", lambda m: m < F.col("_v")))).drop("_marks")
    sizes = ranged.groupBy(*by, "_range").agg(F.sum("_c").alias("_s"))  # a group has RANGES rows at most
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*by, "_range", "_s", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before"), F.sum("_s").over(Window.partitionBy(*by)).alias("_n"))
    places = F.array(*[F.struct(F.lit(name).alias("name"), F.least(F.col("_n") - 1, F.floor(F.lit(p) * F.col("_n"))).alias("at")) for name, p in shares.items()])
    asked = sizes.withColumn("_p", F.explode(places)).filter((F.col("_p.at") >= F.col("_before")) & (F.col("_p.at") < F.col("_before") + F.col("_s")))
    asked = asked.select(*by, "_range", F.col("_p.name").alias("_name"), (F.col("_p.at") - F.col("_before")).alias("_at"))
    run = F.sum("_c").over(Window.partitionBy(*by, "_range", "_name").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    placed = ranged.join(asked, [*by, "_range"]).withColumn("_run", run)
    hit = placed.filter((F.col("_run") > F.col("_at")) & (F.col("_run") - F.col("_c") <= F.col("_at")))
    return hit.groupBy(*by).agg(*[F.max(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in shares])


def tag_frequencies(entries: DataFrame, tag_num: int) -> DataFrame:
    """``tag``, ``doc_freq`` for every tag below ``tag_num``, also those that don't occur."""
    seen = entries.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    every = entries.sparkSession.range(tag_num).withColumnRenamed("id", "tag")
    return every.join(seen, "tag", "left").select("tag", F.coalesce("n", F.lit(0)).alias("doc_freq"))


def conversion_summary(freq: DataFrame, docs: int, segment_docs: int) -> DataFrame:
    zero = F.col("doc_freq") == 0
    # the list is part of the report: the first 32 tags that don't occur
    unused = freq.filter(zero).select("tag").orderBy("tag").limit(32)
    first = unused.agg(F.array_join(F.transform(F.sort_array(F.collect_list("tag")), lambda t: t.cast("string")), ",").alias("first_zero_tags"))
    counts = freq.agg(F.count(F.when(~zero, 1)).alias("distinct_tags"), F.count(F.when(zero, 1)).alias("zero_tags"), F.sum("doc_freq").alias("assignments"), F.lit(-(-docs // segment_docs)).cast("long").alias("segments"))
    return counts.crossJoin(first).select("distinct_tags", "zero_tags", "first_zero_tags", "assignments", "segments")  # a row each


def bands(freq: DataFrame, docs: int) -> DataFrame:
    """How many tags lie in each frequency band."""
    share = F.col("doc_freq") / docs
    band = F.when(F.col("doc_freq") == 0, "never")
    for name, least in BANDS:
        band = band.when(share >= least, name)
    return freq.select(band.alias("band")).groupBy("band").agg(F.count(F.lit(1)).alias("tags"))


def concentration(freq: DataFrame, tops: list[int]) -> DataFrame:
    """``top_n``, ``assignments``, ``share``: how much of all assignments the commonest tags have."""
    order = Window.orderBy(F.col("doc_freq").desc(), "tag")  # a row for each tag, not for each document
    r = freq.withColumn("_r", F.row_number().over(order))
    total = F.sum("doc_freq")
    cols = [F.sum(F.when(F.col("_r") <= n, F.col("doc_freq"))).alias(f"_{n}") for n in tops]
    one = r.agg(total.alias("_t"), *cols)
    pairs = F.array(*[F.struct(F.lit(n).cast("long").alias("top_n"), F.col(f"_{n}").alias("assignments"), (F.col(f"_{n}") / F.col("_t")).alias("share")) for n in tops])
    return one.select(F.explode(pairs).alias("x")).select("x.*")


def most_common(freq: DataFrame, n: int, rarest: bool = False) -> DataFrame:
    """The n commonest (or rarest occurring) tags; ties go to the smaller tag."""
    used = freq.filter("doc_freq > 0")
    return used.orderBy(F.col("doc_freq").asc() if rarest else F.col("doc_freq").desc(), "tag").limit(n)


def fixed_histogram(df: DataFrame, value: str, buckets: int) -> DataFrame:
    """``bucket``, ``low``, ``n``: buckets of equal width, the last one closed; equal values give one bucket."""
    ends = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    v = df.select(F.col(value).cast("double").alias("_v")).join(F.broadcast(ends), F.lit(True)).filter("_v is not null")
    width = (F.col("_hi") - F.col("_lo")) / buckets
    bucket = F.when(F.col("_hi") <= F.col("_lo"), 0).otherwise(F.least(F.lit(buckets - 1), F.floor((F.col("_v") - F.col("_lo")) / width)))
    return v.select(bucket.cast("long").alias("bucket"), "_lo", width.alias("_w")).groupBy("bucket").agg((F.first("_lo") + F.col("bucket") * F.first("_w")).alias("low"), F.count(F.lit(1)).alias("n"))


def vector_stats(docs: DataFrame) -> DataFrame:
    n = vectors.norm(F.col("vec"))
    rows = docs.select(n.alias("_n"), F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double")).alias("_s"), vectors.dot(F.col("vec"), F.col("vec")).alias("_q"), F.size("vec").alias("_d"))
    mean = F.sum("_s") / F.sum("_d")
    return rows.agg(
        F.count(F.lit(1)).alias("vectors"), mean.alias("component_mean"), F.sqrt(F.greatest(F.lit(0.0), F.sum("_q") / F.sum("_d") - mean * mean)).alias("component_std"),
        F.avg("_n").alias("norm_mean"), (F.abs(F.avg("_n") - 1) < 0.1).alias("normalised"), F.count(F.when(F.col("_n") == 0, 1)).alias("zero_vectors"),
    )


def dictionary_problems(tags: DataFrame) -> DataFrame:
    """``problem``, ``n`` of a dictionary of ``term``, ``tag_id``: terms without ``#``, and entries whose id another one has already."""
    malformed = tags.filter(F.coalesce(~F.col("term").contains("#"), F.lit(True))).agg(F.count(F.lit(1)).alias("n")).select(F.lit("malformed_term").alias("problem"), "n")
    several = tags.groupBy("tag_id").agg(F.count(F.lit(1)).alias("_n")).agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("n"))
    return malformed.unionAll(several.select(F.lit("repeated_id").alias("problem"), "n"))


def reference_frequencies(references: DataFrame, freq: DataFrame, docs: int, common: float = 0.05) -> DataFrame:
    """How the tags that filters refer to occur: ``references`` has ``tag``, a row for each reference.

    ``refs``, ``resolved`` (of tags that occur), ``rate``, ``tags`` (different ones),
    ``common`` (references to tags of at least that share of the documents) and
    ``common_rate``.
    """
    per = references.groupBy("tag").agg(F.count(F.lit(1)).alias("_r")).join(freq, "tag", "left")
    used = F.coalesce("doc_freq", F.lit(0))
    refs, often = F.sum("_r"), F.coalesce(F.sum(F.when(used / docs >= common, F.col("_r"))), F.lit(0))
    resolved = F.coalesce(F.sum(F.when(used > 0, F.col("_r"))), F.lit(0))
    return per.agg(refs.alias("refs"), resolved.alias("resolved"), (resolved / refs).alias("rate"), F.count(F.lit(1)).alias("tags"), often.alias("common"), (often / refs).alias("common_rate"))


def posting_summary(postings: DataFrame, segment_docs: int) -> DataFrame:
    """Counts of layouts, units of sparse postings, bytes against an index of dense bitmaps."""
    sparse = F.col("layout") != "dense_bitmap"
    dense_size = HEADER + 2 * -(-segment_docs // 16)
    return postings.agg(
        F.count(F.when(~sparse, 1)).alias("dense"), F.count(F.when(sparse, 1)).alias("sparse"), F.coalesce(F.sum(F.when(sparse, F.col("unit_count"))), F.lit(0)).alias("units"),
        F.coalesce(F.avg(F.when(sparse, F.col("unit_count"))), F.lit(0.0)).alias("mean_units"), F.coalesce(F.max(F.when(sparse, F.col("unit_count"))), F.lit(0)).alias("max_units"),
        F.sum("bytes").alias("bytes"), (F.count(F.lit(1)) * dense_size).alias("dense_bytes"),
    )


def unit_histogram(postings: DataFrame) -> DataFrame:
    """``bucket``, ``postings``: bucket b holds unit counts from 2^(b-1) to 2^b - 1, the last one (15) all larger ones."""
    k = F.col("unit_count")
    bucket = F.when(k == 0, 0).otherwise(F.least(F.lit(15), F.length(F.bin(k)))).cast("long")
    return postings.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("postings"))


def hit_cumulative(postings: DataFrame, most: int = 2048) -> DataFrame:
    """``hits``, ``postings``, ``cumulative``; counts of ``most`` and more fall into one bin."""
    h = postings.groupBy(F.least(F.col("hit_count"), F.lit(most)).alias("hits")).agg(F.count(F.lit(1)).alias("postings"))
    run = Window.orderBy("hits").rowsBetween(Window.unboundedPreceding, 0)  # at most ``most`` + 1 rows
    return h.withColumn("cumulative", F.sum("postings").over(run))


def run_histogram(runs: DataFrame) -> DataFrame:
    """``length`` (9: longer than 8), ``runs``."""
    return runs.groupBy(F.least(F.col("run_length"), F.lit(9)).alias("length")).agg(F.count(F.lit(1)).alias("runs"))


def storage_estimate(tags: int, docs: int, segment_docs: int) -> int:
    """Bytes of an index of dense bitmaps only."""
    return tags * -(-docs // segment_docs) * segment_docs // 8


def threshold_curve(postings: DataFrame, segment_docs: int, unit_bytes: int = PACKED_UNIT, most: int = 2048) -> DataFrame:
    """For every hit count h that a threshold can lie above: the bytes saved by storing postings of up to h hits sparsely.

    ``hits``, ``threshold`` (h / segment), ``compressed``, ``saved``, ``bytes``.  A
    posting is charged one unit for each hit.
    """
    h = hit_cumulative(postings.filter(F.col("hit_count") < most), most)
    gain = F.col("postings") * (F.lit(segment_docs / 8.0) - (HEADER + unit_bytes * F.col("hits")))
    run = Window.orderBy("hits").rowsBetween(Window.unboundedPreceding, 0)
    base = postings.agg((F.count(F.lit(1)) * (segment_docs / 8.0)).alias("_base"))
    curve = h.withColumn("saved", F.sum(gain).over(run)).join(F.broadcast(base), F.lit(True))
    return curve.select("hits", (F.col("hits") / segment_docs).alias("threshold"), F.col("cumulative").alias("compressed"), "saved", (F.col("_base") - F.col("saved")).alias("bytes"))


def pick_threshold(curve: DataFrame, target: float, target_max: float) -> DataFrame:
    """The rows of the curve whose reduction lies between the targets (shares)."""
    reduction = F.col("saved") / (F.col("bytes") + F.col("saved"))
    return curve.withColumn("reduction", reduction).filter((F.col("reduction") >= target) & (F.col("reduction") <= target_max))


def interpolated_size(hist: DataFrame, cutoff: float, segment_docs: int, unit_bytes: int = PACKED_UNIT) -> DataFrame:
    """``sparse``, ``bytes``: the index size if postings below ``cutoff`` units were sparse, from the log2 histogram.

    Within the bucket of the cutoff counts are split in proportion; empty postings
    are dense.
    """
    lo, hi = F.pow(F.lit(2.0), F.col("bucket") - 1), F.pow(F.lit(2.0), F.col("bucket"))
    end = F.least(hi, F.lit(float(cutoff)))
    share = F.when((F.col("bucket") == 0) | (lo >= cutoff), 0.0).otherwise((end - lo) / (hi - lo))
    part = F.col("postings") * share
    cost = part * (HEADER + unit_bytes * (lo + end - 1) / 2)
    return hist.agg(F.sum(part).alias("sparse"), (F.sum(F.col("postings") - part) * (segment_docs / 8.0) + F.sum(cost)).alias("bytes"))


def break_even_units(place: float, fixed: float, avoided: float, units: float, pairs: float) -> float:
    """Units from which a dense posting is cheaper to filter with: (dense - fixed cost of a pair) / cost of a unit."""
    return (avoided / pairs - fixed / pairs) / (place / units)


def latency_summary(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """``n``, ``avg_ms``, ``p50``, ``p95``, ``p99``, ``max_ms``, ``qps`` (1000 / mean) by group."""
    by = by or []
    basic = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("avg_ms"), F.max(value).alias("max_ms"))
    p = order_percentiles(df, value, {"p50": 0.5, "p95": 0.95, "p99": 0.99}, by)
    joined = basic.join(p, by) if by else basic.join(p, F.lit(True))
    return joined.withColumn("qps", 1000.0 / F.col("avg_ms"))


def shard_decomposition(rows: DataFrame) -> DataFrame:
    """Where the time of fanned-out queries goes; ``rows``: ``idx``, ``shard_ms`` (array), ``merge_ms``, ``total_ms``."""
    mean = F.aggregate("shard_ms", F.lit(0.0), lambda a, x: a + x) / F.size("shard_ms")
    worst = F.array_max("shard_ms")
    r = rows.select("*", worst.alias("_max"), (worst - mean).alias("_tax"), (worst - F.array_min("shard_ms")).alias("_spread"))
    return r.agg(F.count(F.lit(1)).alias("n"), F.avg("_max").alias("max_shard"), F.avg("merge_ms").alias("merge"), F.avg(F.col("total_ms") - F.col("_max")).alias("overhead"), F.avg("_tax").alias("tax"), F.avg("_spread").alias("spread"))


def straggler_share(rows: DataFrame) -> DataFrame:
    """``shard``, ``share``: how often a shard (the first one of equals) was the slowest."""
    worst = (F.array_position("shard_ms", F.array_max("shard_ms")) - 1).alias("shard")
    n = rows.select(worst).groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.count(F.lit(1)).alias("_t"))
    return n.join(F.broadcast(total), F.lit(True)).select("shard", (F.col("n") / F.col("_t")).alias("share"))


def slow_tail(rows: DataFrame) -> DataFrame:
    """Of the slowest hundredth (by total, then index): whether one shard or several exceed the 90 % point of all totals."""
    bar = order_percentiles(rows, "total_ms", {"_bar": 0.90})
    n = rows.count()
    tail = rows.orderBy(F.col("total_ms").desc(), "idx").limit(max(1, n // 100)).join(F.broadcast(bar), F.lit(True))
    slow = F.aggregate("shard_ms", F.struct(F.lit(0).alias("n"), F.col("_bar").alias("bar")), lambda a, x: F.struct((a["n"] + (x >= a["bar"]).cast("int")).alias("n"), a["bar"].alias("bar")), lambda a: a["n"])
    return tail.select(slow.alias("_s"), "_bar").agg(F.count(F.lit(1)).alias("tail"), F.count(F.when(F.col("_s") >= 2, 1)).alias("several"), F.count(F.when(F.col("_s") < 2, 1)).alias("one"), F.max("_bar").alias("bar_ms"))


def ab_compare(rows: DataFrame, arm: str, value: str, baseline: str) -> DataFrame:
    """``arm``, ``median``, ``change`` (against the baseline's median), ``spread`` ((max - min) / median)."""
    med = order_percentiles(rows.withColumnRenamed(arm, "arm"), value, {"median": 0.5}, ["arm"])
    ends = rows.groupBy(F.col(arm).alias("arm")).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    base = med.filter(F.col("arm") == baseline).select(F.col("median").alias("_b"))
    return med.join(ends, "arm").join(F.broadcast(base), F.lit(True)).select("arm", "median", (F.col("median") / F.col("_b") - 1).alias("change"), ((F.col("_hi") - F.col("_lo")) / F.col("median")).alias("spread"))


def hash_sample(df: DataFrame, key: Column, share_of: int) -> DataFrame:
    """About one row in ``share_of``, the same ones on every engine (a linear hash of an integer key)."""
    return df.filter(F.pmod(key * 2654435761, F.lit(1 << 32)) % share_of == 0)


def shard_percentiles(rows: DataFrame) -> DataFrame:
    """``shard``, ``mean``, ``p50``, ``p99``, ``high`` of each shard's own time."""
    each = rows.select(F.posexplode("shard_ms").alias("shard", "ms"))
    basic = each.groupBy("shard").agg(F.avg("ms").alias("mean"), F.max("ms").alias("high"))
    return basic.join(order_percentiles(each, "ms", {"p50": 0.5, "p99": 0.99}, ["shard"]), "shard")


def profile_bands(freq: DataFrame, docs: int) -> DataFrame:
    """``band``, ``tags``, ``mean_share``: the populations that :func:`~quillon.operators.synthetic.banded_corpus` takes."""
    share = F.col("doc_freq") / docs
    band = F.lit(None).cast("string")
    for name, least in BANDS:
        band = F.coalesce(band, F.when(share >= least, F.lit(name)))
    return freq.filter("doc_freq > 0").select(band.alias("band"), share.alias("s")).groupBy("band").agg(F.count(F.lit(1)).alias("tags"), F.avg("s").alias("mean_share"))
