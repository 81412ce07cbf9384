"""Synthetic corpora and queries from hashes: the same rows however they are partitioned."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def uniform(*keys: Column) -> Column:
    """A number in [0, 1) from a hash of the keys."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 11) / F.lit(float(1 << 53))


def vectors(doc: Column, dim: int, seed: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (uniform(doc, i, F.lit(seed)) * 2 - 1).cast("float"))


def corpus(spark: SparkSession, docs: int, dim: int = 64, tag_num: int = 1000, tags_per_doc: int = 20, seed: int = 1, partitions: int | None = None) -> DataFrame:
    """Uniform vectors and ``tags_per_doc`` different random tags."""
    d = F.col("doc_id")
    drawn = F.transform(F.sequence(F.lit(0), F.lit(4 * tags_per_doc)), lambda i: F.floor(uniform(d, i, F.lit(seed + 1)) * tag_num).cast("long"))
    rows = spark.range(0, docs, 1, partitions).withColumnRenamed("id", "doc_id")
    return rows.select("doc_id", vectors(d, dim, seed).alias("vec"), F.slice(F.array_distinct(drawn), 1, min(tags_per_doc, tag_num)).alias("tags"))


def _held(doc: Column, low: float, high: float, seed: int):
    """Whether the document has a tag; a function of the tag alone, as those with two arguments would get its place too."""
    return lambda t: uniform(doc, t, F.lit(seed + 2)) < (low + uniform(t, F.lit(seed + 9)) * (high - low)) * F.col("_b")


def banded_corpus(spark: SparkSession, docs: int, dim: int = 64, bands: list[tuple[int, float, float]] | None = None, rich_share: float = 0.05, rich: tuple[float, float] = (2.5, 9.0), seed: int = 1) -> DataFrame:
    """Tags in populations of given frequency: ``bands`` lists (tags, lowest, highest probability); ids run on from band to band.

    Each tag has a probability of its own between its band's.  A share of rich documents
    has each tag more often, by a factor of the document's own within ``rich``; vectors are
    scaled by a log-normal length.
    """
    bands = bands or [(10, 0.9, 1.0), (40, 0.05, 0.4), (200, 0.01, 0.05), (750, 0.0001, 0.01)]
    d = F.col("doc_id")
    factor = rich[0] + uniform(d, F.lit(seed + 8)) * (rich[1] - rich[0])
    boost = F.when(uniform(d, F.lit(seed + 7)) < rich_share, factor).otherwise(1.0)
    parts, first = [], 0
    for n, low, high in bands:
        ids = F.sequence(F.lit(first).cast("long"), F.lit(first + n - 1).cast("long"))
        parts.append(F.filter(ids, _held(d, low, high, seed)))
        first += n
    # Box-Muller
    u, v = F.greatest(uniform(d, F.lit(seed + 3)), F.lit(1e-12)), uniform(d, F.lit(seed + 4))
    length = F.exp(0.25 * F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v))
    rows = spark.range(docs).withColumnRenamed("id", "doc_id").withColumn("_l", length).withColumn("_b", boost)
    return rows.select("doc_id", F.transform(vectors(d, dim, seed), lambda x: (x * F.col("_l")).cast("float")).alias("vec"), F.flatten(F.array(*parts)).alias("tags"))


def any_of(tags: Column) -> Column:
    """The text of an OR of tags."""
    return F.concat(F.lit("("), F.array_join(F.transform(tags, lambda t: t.cast("string")), " OR "), F.lit(")"))


def _draw(n: int, at, *keys: Column) -> Column:
    """``n`` draws of ``at``, a function of a number in [0, 1) and the draw's place; repetitions go."""
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: at(uniform(*keys, i), i)))


def queries(spark: SparkSession, n: int, dim: int, freq: DataFrame, docs: int, groups: int = 3, target: float = 0.05, k: int = 10, unresolved: float = 0.6, seed: int = 1) -> DataFrame:
    """``qid``, ``vec``, ``filter``, ``k``: an OR of rare tags that matches about ``target`` of the documents.

    ``freq`` has ``tag``, ``doc_freq``.  As many tags of at most the target's frequency
    are drawn as reach it on average; of all references a share of ``unresolved`` names
    tags that no document has.  Every fifth filter also excludes ``groups - 1`` tags
    together.  Without any such tag a filter is one tag, without any tag match-all.
    """
    q = spark.range(n).withColumnRenamed("id", "qid")
    share = F.col("doc_freq") / docs
    held = freq.filter("doc_freq > 0").select("tag", (share <= target).alias("_rare"), share.alias("_share"))
    sizes = {r["_rare"]: r for r in held.groupBy("_rare").agg(F.count(F.lit(1)).alias("n"), F.avg("_share").alias("mean"), F.max("tag").alias("top")).collect()}  # two rows at most
    done = lambda text: q.select("qid", vectors(F.col("qid"), dim, seed + 99).alias("vec"), text.alias("filter"), F.lit(k).alias("k"))
    if not sizes:
        return done(F.lit(""))
    some = True in sizes
    pool = sizes[some]
    m = min(pool["n"], max(1, math.ceil(target / pool["mean"]))) if some else 1
    # the dictionary's tags by number: a row for each tag, not for each document
    placed = held.filter(F.col("_rare") == some).select("tag", (F.row_number().over(Window.orderBy("tag")) - 1).cast("long").alias("_at"))
    top = 1 + max(r["top"] for r in sizes.values())
    missing = round(m * unresolved / (1 - unresolved)) if unresolved < 1 else m
    qid = F.col("qid")
    asked = q.select("qid", F.explode(_draw(m, lambda u, i: F.floor(u * pool["n"]).cast("long"), qid, F.lit(seed + 5))).alias("_at"))
    found = asked.join(placed, "_at").groupBy("qid").agg(F.array_sort(F.collect_list("tag")).alias("_tags"))  # m tags a query
    extra = _draw(missing, lambda u, i: F.lit(top) + F.floor(u * 1000).cast("long"), qid, F.lit(seed + 6)) if missing else F.array().cast("array<bigint>")
    text = any_of(F.concat(F.col("_tags").cast("array<bigint>"), extra))
    if groups > 1:
        out = _draw(groups - 1, lambda u, i: F.floor(u * top).cast("long"), qid, F.lit(seed + 10))
        never = F.array_join(F.transform(out, lambda t: t.cast("string")), " AND ")
        text = F.when(qid % 5 == 0, F.concat(text, F.lit(" AND NOT ("), never, F.lit(")"))).otherwise(text)
    return found.select("qid", vectors(qid, dim, seed + 99).alias("vec"), text.alias("filter"), F.lit(k).alias("k"))


def grouped_queries(spark: SparkSession, n: int, dim: int, tag_num: int, tags_per_group: int = 20, k: int = 10, seed: int = 1) -> DataFrame:
    """``qid``, ``vec``, ``filter``, ``k``: eight groups of tags, any of a group's; three are required, two pairs need one of each, one is excluded.

    Tags with small ids, which are the frequent ones of :func:`banded_corpus`, are drawn more often.
    """
    qid = F.col("qid")
    g = [any_of(_draw(tags_per_group, lambda u, i: F.floor(u * u * tag_num).cast("long"), qid, F.lit(seed + 20 + j))) for j in range(8)]
    text = F.concat_ws(" AND ", *g[:3], *[F.concat(F.lit("("), a, F.lit(" OR "), b, F.lit(")")) for a, b in (g[3:5], g[5:7])], F.concat(F.lit("NOT "), g[7]))
    return spark.range(n).select(F.col("id").alias("qid")).select("qid", vectors(qid, dim, seed + 99).alias("vec"), text.alias("filter"), F.lit(k).alias("k"))


def section_queries(spark: SparkSession, n: int, dim: int, sections: dict[str, tuple[int, int]], selective: list[str], anchors: list[str], mirrored: dict[str, str] | None = None, refs: int = 100, common: float = 0.148, resolved: float = 0.3988, clauses: int = 5, k: int = 10, seed: int = 1) -> DataFrame:
    """``qid``, ``vec``, ``filter``, ``k``: an OR over selective sections, permissive clauses over anchor sections, one NOT.

    ``sections``: first tag and number of tags by name.  A share of ``common`` of the
    references goes to the anchors.  Of the others a share of ``resolved`` names a tag of
    its section, small ones more often; the rest name tags behind all sections, which no
    document has.  A value of a section in ``mirrored`` is also asked of its mirror.
    """
    qid, absent = F.col("qid"), max(a + size for a, size in sections.values())
    spans = F.array(*[F.array(*[F.lit(x).cast("long") for x in (*sections[s], sections.get((mirrored or {}).get(s), (-1, 0))[0])]) for s in selective])

    def value(u: Column, i: Column) -> Column:
        span = F.element_at(spans, (F.floor(u * len(selective)) + 1).cast("int"))
        w = uniform(qid, i, F.lit(seed + 31))
        place = F.floor(w * w * span[1]).cast("long")
        here = F.array(span[0] + place, F.when(span[2] >= 0, span[2] + place))
        return F.when(uniform(qid, i, F.lit(seed + 32)) < resolved, here).otherwise(F.array(F.lit(absent) + F.floor(w * 1000000).cast("long")))

    some = lambda m, key: F.array_distinct(F.filter(F.flatten(_draw(m, value, qid, F.lit(key))), lambda t: t.isNotNull()))
    parts = [any_of(some(max(1, round(refs * (1 - common))), seed + 30))]
    each = max(1, round(refs * common / max(1, clauses)))
    chosen = F.slice(F.array_sort(F.array(*[F.struct(uniform(qid, F.lit(seed + 33 + j)).alias("u"), F.lit(sections[s][0]).cast("long").alias("first"), F.lit(sections[s][1]).alias("size")) for j, s in enumerate(anchors)])), 1, clauses)
    clause = lambda c: any_of(_draw(each, lambda u, i: c["first"] + F.floor(u * c["size"]).cast("long"), qid, c["first"]))
    if anchors:
        parts.append(F.array_join(F.transform(chosen, clause), " AND "))
    parts.append(F.concat(F.lit("NOT "), any_of(some(20, seed + 99))))
    return spark.range(n).select(F.col("id").alias("qid")).select("qid", vectors(qid, dim, seed + 99).alias("vec"), F.concat_ws(" AND ", *parts).alias("filter"), F.lit(k).alias("k"))
