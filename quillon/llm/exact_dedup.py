"""Exact deduplication by content sort (operator 2, DataFrame functions only).

Rows are range-partitioned by sampled splitters over their normalised text,
sorted externally inside each range so that equal texts become neighbours, and
cut into groups by comparing neighbouring keys in full.

The splitter key is ``(first code points, 64-bit hash, salt)`` of the normalised
text: the driver samples keys of bounded length, never whole documents, and a
prefix that many documents share still spreads over ranges.  A text that fills
more than a range by itself gets as many salts as it fills ranges.  Its size and
its row that stays are summed up before that, map-side, and given to its runs by
the SHA-256 of the normalised text; there is at most one such text for each range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
PREFIX = 16
#: A text counts as hot from this many rows at least.
LEAST_HOT = 256


def normalised(text: Column) -> Column:
    """The text without blanks; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, prefix: str = "") -> DataFrame:
    """One row per input row with its group of equal texts.

    Columns: the id, ``keep_id`` (id of the row that stays), ``group_size``,
    ``kept``, ``text_sha256`` (of the normalised text), each named with
    ``prefix``, and the columns in ``carry`` as they came (default none).

    Of equal texts the row with the most code points in the original text stays,
    then the one with the smallest id.  Null texts equal empty ones.  A null id
    sorts after all others.  Of rows that repeat with the same id and text exactly
    one is ``kept``.  An empty table gives an empty result.  Other columns are
    ignored, whatever their names.
    """
    spark = docs.sparkSession
    names = list(dict.fromkeys(carry or []))
    rows = docs.select(
        F.col(id_col).alias("_id"),
        F.col(text_col).alias("_text"),
        *([F.struct(*[F.col(c) for c in names if c not in (id_col, text_col)]).alias("_rest")] if set(names) - {id_col, text_col} else []),
    )
    norm = normalised(F.col("_text"))
    keyed = rows.withColumns({"_p": F.substring(norm, 1, PREFIX), "_h": F.xxhash64(norm)})

    ranges = scratch.partitions(spark)
    most = max(LEAST_HOT, -(-rows.count() // ranges))
    cp = F.length(F.coalesce("_text", F.lit("")))
    # texts that fill a range: at most one for each range, as each has more than rows / ranges rows
    counted = keyed.select("_h", F.sha2(norm, 256).alias("_sha"), F.struct(-cp, F.col("_id").isNull(), F.col("_id").alias("id")).alias("_key"))
    hot = counted.groupBy("_h", "_sha").agg(F.count(F.lit(1)).alias("_total"), F.min("_key").alias("_best")).filter(F.col("_total") > most)
    hot = scratch.stash(hot.select("_h", "_sha", "_total", F.col("_best.id").alias("_best"), F.ceil(F.col("_total") / most).cast("int").alias("_salts")), "hot")
    salts = hot.groupBy("_h").agg(F.max("_salts").alias("_salts"))
    salted = keyed.join(F.broadcast(salts), "_h", "left").withColumn("_salt", F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("_id"), F.col("_salts")).cast("int")))

    runs = salted.repartitionByRange("_p", "_h", "_salt").withColumn("_norm", norm)
    key = Window.partitionBy("_p", "_h", "_salt", "_norm")
    first = key.orderBy(cp.desc(), F.col("_id").asc_nulls_last())
    runs = runs.withColumns({"_rank": F.row_number().over(first), "_keep": F.first("_id").over(first), "_size": F.count(F.lit(1)).over(key), "_sha": F.sha2("_norm", 256)})

    whole = runs.join(F.broadcast(hot.select("_sha", "_best", "_total")), "_sha", "left")
    best = F.col("_total").isNotNull()
    out = {
        f"{prefix}keep_id": F.when(best, F.col("_best")).otherwise(F.col("_keep")),
        f"{prefix}group_size": F.coalesce("_total", "_size"),
        f"{prefix}kept": (F.col("_rank") == 1) & (~best | F.col("_keep").eqNullSafe(F.col("_best"))),
        f"{prefix}text_sha256": F.col("_sha"),
    }
    back = {id_col: F.col("_id"), text_col: F.col("_text")}
    carried = [back.get(c, F.col(f"_rest.`{c}`")).alias(c) for c in names]
    ids = [] if id_col in names else [F.col("_id").alias(id_col)]
    return whole.select(*ids, *carried, *[c.alias(n) for n, c in out.items()])


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts: see :func:`exact_dedup` for which.

    Null and empty texts and texts of blanks are one group; of rows that repeat, or tie in
    length and id, exactly one stays; a null id loses to any other.  Very long texts are
    compared whole.  An empty table stays empty.  Columns may have any names.
    """
    rows, names = scratch.positional(docs)
    found = exact_dedup(rows, names[id_col], names[text_col], carry=rows.columns, prefix="_")
    return found.filter("_kept").select(*[F.col(n).alias(c) for c, n in names.items()])


ORACLE = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS cp,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT *, row_number() OVER w AS rk, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size
      FROM t WINDOW w AS (PARTITION BY norm ORDER BY cp DESC, doc_id))
SELECT doc_id, keep_id, group_size, rk = 1 AS kept, sha256(norm) AS text_sha256 FROM g
"""
