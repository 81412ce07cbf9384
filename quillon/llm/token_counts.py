"""Token counts by an exact length histogram (operator 1).

Documents are encoded once and only their lengths go on.  The histogram of
lengths, with suffix sums, answers the number of documents and tokens, quantiles
and totals after truncation for every context limit.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import scratch, tokens

#: Lengths to a block of the two-level suffix sums.
BLOCK = 512


def token_lengths(docs: DataFrame, tokenizer: str = tokens.DEFAULT, id_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns ``id_cols`` and ``n_tokens`` (long) for every row; null and empty texts have no tokens."""
    schema = StructType([*docs.select(*id_cols).schema.fields, StructField("n_tokens", LongType(), False)])

    def count(batches):
        ids = tokens.encoder(tokenizer).ids
        for b in batches:
            n = [len(ids(t)) // 4 for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(n, pa.int64())], names=[*id_cols, "n_tokens"])

    return docs.select(F.col(text_col).alias("_text"), *[F.col(c) for c in id_cols]).mapInArrow(count, schema)


def length_histogram(docs: DataFrame, tokenizer: str = tokens.DEFAULT, text_col: str = "text") -> DataFrame:
    """One row for each length that occurs: ``n_tokens``, ``docs``."""
    lengths = token_lengths(docs, tokenizer, (), text_col)
    return lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("docs"))


def suffix_table(hist: DataFrame) -> DataFrame:
    """The histogram with its suffix sums.

    For each length L: ``docs``; ``docs_longer`` and ``tokens_longer`` (documents
    longer than L); ``truncated_total`` (tokens left after cutting at L);
    ``total_docs``, ``total_tokens``; ``quantile`` (the share of documents not
    longer than L).  Sums run within blocks of lengths and over the blocks'
    totals, so no task reads the whole histogram.
    """
    h = hist.withColumns({"_b": F.floor(F.col("n_tokens") / BLOCK), "_t": F.col("n_tokens") * F.col("docs")})
    blocks = h.groupBy("_b").agg(F.sum("docs").alias("_bd"), F.sum("_t").alias("_bt"))
    after = Window.orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    blocks = blocks.select(
        "_b", F.coalesce(F.sum("_bd").over(after), F.lit(0)).alias("_ad"), F.coalesce(F.sum("_bt").over(after), F.lit(0)).alias("_at"),
        F.sum("_bd").over(every).alias("total_docs"), F.sum("_bt").over(every).alias("total_tokens"),
    )
    inside = Window.partitionBy("_b").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    s = h.join(blocks, "_b").withColumns({
        "docs_longer": F.col("_ad") + F.coalesce(F.sum("docs").over(inside), F.lit(0)),
        "tokens_longer": F.col("_at") + F.coalesce(F.sum("_t").over(inside), F.lit(0)),
    })
    return s.select(
        "n_tokens", "docs", "docs_longer", "tokens_longer",
        (F.col("total_tokens") - F.col("tokens_longer") + F.col("n_tokens") * F.col("docs_longer")).alias("truncated_total"),
        "total_docs", "total_tokens", ((F.col("total_docs") - F.col("docs_longer")) / F.col("total_docs")).alias("quantile"),
    )


def token_counts(docs: DataFrame, tokenizer: str = tokens.DEFAULT, text_col: str = "text") -> DataFrame:
    """The suffix table of a table of documents.

    Every row counts, repeated ones as often as they occur; null texts have
    length 0.  An empty table gives an empty result.  Other columns are ignored.
    """
    # the sums read the histogram twice: without the table every text would be encoded twice
    return suffix_table(scratch.stash(length_histogram(docs, tokenizer, text_col), "histogram"))


def at_limits(table: DataFrame, limits: list[int]) -> DataFrame:
    """What ``table`` (a suffix table) answers for any limits, also lengths that don't occur.

    ``limit``, ``docs_longer``, ``tokens_longer``, ``truncated_total``: between two
    occurring lengths the sums of the smaller one hold.
    """
    asked = table.sparkSession.createDataFrame([(int(x),) for x in limits], "limit long")
    under = table.join(F.broadcast(asked), F.col("n_tokens") <= F.col("limit"), "right")
    row = F.max_by(F.struct("docs_longer", "tokens_longer", "total_docs", "total_tokens"), "n_tokens")
    got = under.groupBy("limit").agg(row.alias("r"))
    total = table.agg(F.max("total_docs").alias("d"), F.max("total_tokens").alias("t"))
    got = got.join(F.broadcast(total), F.lit(True))
    longer, rest = F.coalesce("r.docs_longer", "d", F.lit(0)), F.coalesce("r.tokens_longer", "t", F.lit(0))
    return got.select("limit", longer.alias("docs_longer"), rest.alias("tokens_longer"), (F.coalesce("t", F.lit(0)) - rest + F.col("limit") * longer).alias("truncated_total"))


def at_quantile(table: DataFrame, q: float) -> DataFrame:
    """The smallest length at which the share of documents not longer reaches ``q``."""
    return table.filter(F.col("quantile") >= q).agg(F.min("n_tokens").alias("n_tokens"))
