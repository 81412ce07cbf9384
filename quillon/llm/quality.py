"""Quality classifier: gradient-boosted trees over document statistics (operator 6).

A bounded sample of labelled rows (at most ``train_rows`` ids, those with the smallest
hash, and at most as many rows) is turned into statistics of the text and fitted on the driver:
features are cut into histogram bins, trees grow level by level on gradient
histograms.  The trees are flattened into arrays of complete binary trees, which
every task walks for a whole batch at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch

TRAIN_ROWS = 20_000
FOLDS, HELD_OUT = 3, 1
MARKS = b"!?.,;:|%$#&*<>{}()[]/\\=_-+@\"'~^"
FEATURES = ["bytes", "words", "word_bytes", "upper", "digit", "blank", "line_share", "beyond_ascii", *[f"mark_{chr(b)}" for b in MARKS], "distinct_words", "distinct_pairs", "distinct_lines", "line_bytes", "capital_words", "marked_words"]


def statistics(text: str | None) -> list[float]:
    """The features of one text, all finite; null counts as empty."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = len(raw)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    w, letters = max(1, len(words)), max(1, int(counts[65:91].sum() + counts[97:123].sum()))
    lines = [x for x in raw.split(b"\n") if x]
    marked = sum(x[-1] in MARKS for x in words)
    capital = sum(65 <= x[0] <= 90 for x in words)
    return [
        np.log1p(n), np.log1p(len(words)), n / w, counts[65:91].sum() / letters, counts[48:58].sum() / max(1, n), (counts[32] + counts[9]) / max(1, n), counts[10] / w,
        counts[128:].sum() / max(1, n), *[counts[b] / w for b in MARKS], len(set(words)) / w, len(set(zip(words, words[1:], strict=False))) / max(1, w - 1), len(set(lines)) / max(1, len(lines)), np.log1p(n / max(1, len(lines))), capital / w, marked / w,
    ]


@dataclass
class Trees:
    """``feature``, ``limit`` [trees, inner nodes] and ``leaf`` [trees, leaves] of complete trees."""

    base: float
    feature: np.ndarray
    limit: np.ndarray
    leaf: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        depth, rows = self.leaf.shape[1].bit_length() - 1, np.arange(len(x))
        total = np.full(len(x), self.base)
        for f, t, v in zip(self.feature, self.limit, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            total += v[at - len(f)]
        return 1 / (1 + np.exp(-np.clip(total, -60, 60)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.2, bins: int = 64, ridge: float = 1.0, least: float = 2.0) -> Trees:
    """Trees for the logistic loss; ``y`` in [0, 1].  Without rows the score is 0.5, with one class it is constant."""
    inner = 2**depth - 1
    none = Trees(0.0, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, 2**depth)))
    if not len(x):
        return none
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    none.base = float(np.log(mean / (1 - mean)))
    if y.min() == y.max():
        return none
    d = x.shape[1]
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    code = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    flat = code + bins * np.arange(d)
    score = np.full(len(x), none.base)
    out_f, out_t, out_v = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        feature, limit, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(x), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            key = ((node - first)[:, None] * (d * bins) + flat).ravel()
            hist = lambda w, key=key, width=width: np.bincount(key, np.repeat(w, d), width * d * bins).reshape(width, d, bins).cumsum(2)
            gl, hl = hist(g), hist(h)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain[(hl < least) | (ht - hl < least)] = 0
            for k in range(width):
                j, b = divmod(int(gain[k].argmax()), bins)
                if gain[k, j, b] > 1e-9 and b < len(cuts[j]):
                    feature[first + k], limit[first + k] = j, cuts[j][b]
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > limit[node])
        leaf = node - inner
        gs, hs = np.bincount(leaf, g, 2**depth), np.bincount(leaf, h, 2**depth)
        value = -rate * gs / (hs + ridge)
        score += value[leaf]
        out_f.append(feature)
        out_t.append(limit)
        out_v.append(value)
    return Trees(none.base, np.array(out_f), np.array(out_t), np.array(out_v))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Trees:
    """Fit on at most ``train_rows`` labelled rows outside the held-out fold.

    An id with several labels has their mean; null and not finite labels and null ids
    don't count, others are cut to [0, 1]; of an id's several texts each is a row, and
    repeated rows are one.
    """
    y = F.least(F.greatest(F.col(label_col).cast("double"), F.lit(0.0)), F.lit(1.0))
    finite = ~F.isnan("_raw") & (F.abs("_raw") < float("inf"))
    known = labels.select(F.col(id_col).alias("_id"), y.alias("_y"), F.col(label_col).cast("double").alias("_raw")).filter(F.col("_id").isNotNull() & finite).filter(~held_out(F.col("_id")))
    known = known.groupBy("_id").agg(F.avg("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(train_rows)

    def measure(frames):
        for f in frames:
            yield pd.DataFrame({"h": f["_h"], "y": f["_y"], "x": [statistics(t) for t in f["_text"]]})

    # at most train_rows rows of two numbers are broadcast
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(known), "_id").select(F.xxhash64("_id").alias("_h"), "_text", "_y")
    # an id may repeat in the table: equal rows are summed up before the shuffle, and the rows are bounded as the ids are
    got = rows.mapInPandas(measure, "h long, y double, x array<double>").dropDuplicates(["h", "x"]).orderBy("h", "x").limit(train_rows).toPandas()
    x = np.array(got["x"].tolist(), float).reshape(len(got), len(FEATURES))
    order = np.lexsort((*x.T, got["y"].to_numpy())) if len(got) else []
    return fit(x[order], got["y"].to_numpy(float)[order])


def score(docs: DataFrame, trees: Trees, text_col: str = "text") -> DataFrame:
    """``docs`` with the column ``_score``, which it must not have."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    schema = StructType([*docs.schema.fields, StructField("_score", DoubleType(), False)])
    at = docs.columns.index(text_col)

    def apply(batches):
        import pyarrow as pa

        for b in batches:
            x = np.array([statistics(t) for t in b.column(at).to_pylist()], float).reshape(b.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(trees.predict(x), pa.float64())], names=[*b.schema.names, "_score"])

    return docs.mapInArrow(apply, schema)


def classify(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per document: the id, ``held_out``, ``score`` (0 to 1), ``predicted`` (1 from 0.5 on).

    Null and empty texts get the score of the empty text's statistics.  Rows that
    repeat are scored each; a null id isn't held out.  Without usable labels every
    score is 0.5.  An empty table gives an empty result; other columns are ignored.
    """
    trees = train(docs, labels, train_rows, id_col, text_col, label_col)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    scored = score(rows, trees, "_text")
    return scored.select(F.col("_id").alias(id_col), held_out(F.col("_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, limit: float = 0.5, **options) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``limit``, with their own columns.

    Every row is judged by its text alone: null and empty texts by the empty text's
    statistics, repeated rows and rows without an id each, very long texts whole.  Without
    usable labels every score is 0.5.  An empty table stays empty.  Columns may have
    any names.
    """
    trees = train(docs, labels, **options)
    rows, names = scratch.positional(docs)
    kept = score(rows, trees, names[options.get("text_col", "text")]).filter(F.col("_score") >= limit)
    return kept.select(*[F.col(n).alias(c) for c, n in names.items()])
