"""The registered queries of the engine, each with DuckDB SQL for the same rows.

They run over a corpus made from the whole of ``embeddings``: tags from the id and
the label, segments of 128 documents, 4 shards.  The queries are all rows whose id
is divisible by 20; they take ten different filters in turn.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import bitmaps, vectors
from .operators import corpus, quality, search, stats, synthetic
from .plans import filters, json_filter, postings_algebra
from .streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TAG_NUM, SEGMENT, SHARDS, THRESHOLD, EVERY = 130, 128, 4, 0.2, 20
FILTERS = ["", "3", "3 AND 12", "3 OR 25 OR 41", "NOT 3", "(1 OR 2) AND NOT (13 OR 44)", "999", "3 AND NOT 3", "100 OR (25 AND 11)", "101 AND 100"]


def add(sql: str | None = None):
    def take(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return take


# --- the corpus and its SQL ---


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id``, ``vec``, ``tags``, ``segment_id``, ``local_id``."""
    i = F.col("vec_id")
    tags = F.concat(F.array(F.col("label").cast("long"), 10 + i % 7, 20 + i % 13, 40 + i % 31, F.lit(101).cast("long")), F.when(i % 50 == 0, F.array(F.lit(100).cast("long"))).otherwise(F.array().cast("array<long>")))
    rows = _read(spark, sf_dir, "embeddings").select(i.alias("doc_id"), F.col("embedding").cast("array<double>").alias("vec"), tags.alias("tags"))
    return corpus.with_segments(rows, SEGMENT)


def sharded(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    return d.withColumn("shard_id", corpus.shard_of(F.col("doc_id"), d.count(), SHARDS))


def queries(spark: SparkSession, sf_dir: str, k=None) -> DataFrame:
    place = F.floor(F.col("doc_id") / EVERY)
    text = F.element_at(F.array(*map(F.lit, FILTERS)), (place % len(FILTERS) + 1).cast("int"))
    d = docs(spark, sf_dir).filter(F.col("doc_id") % EVERY == 0)
    return d.select(F.col("doc_id").alias("qid"), "vec", text.alias("filter"), (5 + place % 6 if k is None else F.lit(k)).cast("int").alias("k"))


def fid(qid: str = "qid"):
    """The number of a query's filter."""
    return F.floor(F.col(qid) / EVERY) % len(FILTERS)


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.posting_docs(docs(spark, sf_dir))


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.with_layout(corpus.build_postings(entries(spark, sf_dir)), SEGMENT, THRESHOLD)


def frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.tag_frequencies(entries(spark, sf_dir), TAG_NUM)


def ids(*names: str) -> list:
    return [F.col(n).cast("long").alias(n) for n in names]


def _t(*tags: int) -> str:
    return " OR ".join(f"list_contains(tags, {t})" for t in tags)


#: The filters, written by hand.
WHERE = ["true", _t(3), f"{_t(3)} AND {_t(12)}", _t(3, 25, 41), f"NOT {_t(3)}", f"({_t(1, 2)}) AND NOT ({_t(13, 44)})", "false", "false", f"{_t(100)} OR ({_t(25)} AND {_t(11)})", f"{_t(101)} AND {_t(100)}"]
_CASE = "CASE fid " + " ".join(f"WHEN {k} THEN ({w})" for k, w in enumerate(WHERE)) + " END"
_HALF = "list_transform(CAST(embedding AS DOUBLE[]), lambda x: CASE WHEN abs(x) < 6.103515625E-5 THEN 0E0 ELSE x * 4398046511105E0 - (x * 4398046511105E0 - x) END)"
WITH = f"""WITH d AS (SELECT vec_id AS doc_id, CAST(embedding AS DOUBLE[]) AS vec, {_HALF} AS half,
  list_concat([CAST(label AS BIGINT), 10 + vec_id % 7, 20 + vec_id % 13, 40 + vec_id % 31, 101], CASE WHEN vec_id % 50 = 0 THEN [CAST(100 AS BIGINT)] ELSE CAST([] AS BIGINT[]) END) AS tags,
  vec_id // {SEGMENT} AS segment_id, vec_id % {SEGMENT} AS local_id,
  least(vec_id // ((SELECT count(*) FROM embeddings) // {SHARDS}), {SHARDS - 1}) AS shard_id FROM embeddings),
q AS (SELECT doc_id AS qid, vec AS qvec, half AS qhalf, 5 + doc_id // {EVERY} % 6 AS k, doc_id // {EVERY} % {len(FILTERS)} AS fid FROM d WHERE doc_id % {EVERY} = 0),
e AS (SELECT doc_id, segment_id, local_id, unnest(list_distinct(tags)) AS tag FROM d),
f AS (SELECT t.tag, count(e.doc_id) AS doc_freq FROM range({TAG_NUM}) t(tag) LEFT JOIN e ON e.tag = t.tag GROUP BY t.tag),
p0 AS (SELECT tag, segment_id, count(DISTINCT local_id) AS hit_count, count(DISTINCT local_id // 16) AS unit_count FROM e GROUP BY tag, segment_id),
p1 AS (SELECT *, CASE WHEN CAST(hit_count / {SEGMENT}E0 AS FLOAT) < CAST({THRESHOLD} AS FLOAT) THEN 'packed' ELSE 'dense_bitmap' END AS layout FROM p0),
p AS (SELECT *, CAST(CASE WHEN layout = 'packed' THEN 8 + 4 * unit_count ELSE 8 + 2 * {SEGMENT // 16} END AS BIGINT) AS bytes,
  CAST(CASE WHEN layout = 'packed' THEN least(unit_count, 65534) ELSE 65535 END AS BIGINT) AS weight FROM p1),
m AS (SELECT q.*, d.* FROM d, q WHERE {_CASE}),
s AS (SELECT *, list_inner_product(half, qhalf) AS s16, list_inner_product(vec, qvec) AS s32 FROM m),
r16 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s16 DESC, doc_id) AS rk FROM s),
r32 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s32 DESC, doc_id) AS rk FROM s)
"""
_TOP16 = WITH + "SELECT qid, rk AS rank, doc_id, round(s16, 6) AS score FROM r16 WHERE rk <= k"


def published(results: DataFrame) -> DataFrame:
    return results.select(*ids("qid", "rank", "doc_id"), F.round("score", 6).alias("score"))


# --- scans ---


@add(WITH + "SELECT doc_id, segment_id, local_id, len(tags) AS n_tags, round(list_inner_product(half, half), 6) AS square FROM d")
def scan_docs(spark, sf_dir):
    d = corpus.prepare(docs(spark, sf_dir))
    return d.select(*ids("doc_id", "segment_id", "local_id"), F.size("tags").cast("long").alias("n_tags"), F.round(vectors.dot(F.col("vec"), F.col("vec")), 6).alias("square"))


@add("SELECT vec_id AS doc_id, CAST(label AS BIGINT) AS label FROM embeddings WHERE vec_id >= 100 AND vec_id < 200")
def scan_doc_range(spark, sf_dir):
    i = F.col("vec_id")
    return _read(spark, sf_dir, "embeddings").filter((i >= 100) & (i < 200)).select(i.alias("doc_id"), F.col("label").cast("long").alias("label"))


_LINES = "(VALUES " + ", ".join(f"({k}, '{t}')" for k, t in enumerate(FILTERS)) + ") AS v(fid, expr)"


@add(WITH + f"SELECT qid // {EVERY} AS fid, expr, expr = '' AS match_all FROM q JOIN {_LINES} USING (fid)")
def filter_lines(spark, sf_dir):
    """The filter of every query, written as lines and read back."""
    from .sources import text

    path = _scratch(spark, "filters")
    text.write_lines(queries(spark, sf_dir).select("qid", F.concat("filter", F.lit(" \r")).alias("filter")), path)
    return text.read_filters(spark, path).select("fid", "expr", (F.trim("expr") == "").alias("match_all"))


@add(WITH + "SELECT row_number() OVER (ORDER BY qid) - 1 AS qid, k FROM q")
def topk_file(spark, sf_dir):
    """Every query's k as a line, with three lines more than there are queries, which are cut."""
    from .sources import text

    q, path = queries(spark, sf_dir), _scratch(spark, "topk")
    more = spark.range(3).select((F.col("id") + 2**40).alias("qid"), F.lit("77").alias("k"))
    text.write_lines(q.select("qid", F.concat(F.lit(" "), F.col("k").cast("string")).alias("k")).unionByName(more), path)
    return text.read_topk(spark, path, q.count()).select(*ids("qid", "k"))


@add(WITH + "SELECT qid, row_number() OVER (ORDER BY qid) - 1 AS fid FROM q")
def filter_assign(spark, sf_dir):
    from .sources import text

    q = queries(spark, sf_dir)
    return text.assign_filters(q, spark.range(q.count()).withColumnRenamed("id", "fid")).select(*ids("qid", "fid"))


@add(WITH + ", o AS (SELECT qid, k, row_number() OVER (ORDER BY qid) - 1 AS place, count(*) OVER () AS n FROM q) SELECT i AS qid, o.qid AS stored, o.k FROM range(250) t(i) JOIN o ON o.place = i % o.n")
def query_cycle(spark, sf_dir):
    q = queries(spark, sf_dir).withColumn("stored", F.col("qid"))
    return search.cycle(q, 250).select(*ids("qid", "stored", "k"))


def _scratch(spark, name: str) -> str:
    from .runtime import shared_dir

    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:8]}"


def _stored_records(spark, sf_dir) -> DataFrame:
    """A JSON record for every query, written as lines and read back; every seventh asks for no results."""
    from .sources import text

    i = F.col("vec_id")
    part = lambda s: F.to_json(s)
    tree = F.when(i % 40 == 0, F.format_string('{"term": {"label": %d}}', F.col("label").cast("long"))).otherwise(F.format_string('{"and": [{"term": {"label": %d}}, {"not": {"terms": {"week": [%d, %d], "join_type": "or"}}}]}', F.col("label").cast("long"), i % 7, (i + 1) % 7))
    inner = F.concat(F.lit('{"vector": {"relevance_learning2rank": '), part(F.slice("embedding", 1, 4)), F.lit(', "syntax_filter": '), tree, F.lit("}}"))
    record = part(F.struct((i / EVERY % 7).cast("long").alias("result_num"), F.struct(inner.alias("json_query")).alias("main_tier")))
    path = _scratch(spark, "records")
    text.write_lines(_read(spark, sf_dir, "embeddings").filter(i % EVERY == 0).select(i, record.alias("record")), path)
    return text.read_query_records(spark, path)


#: Labels up to 2 and the weeks are in the dictionary.
_STORED = "WITH r AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS line, vec_id AS i, label, vec_id // 20 % 7 AS k FROM embeddings WHERE vec_id % 20 = 0), x AS (SELECT *, CASE WHEN label > 2 THEN '0 AND (NOT 0)' WHEN i % 40 = 0 THEN CAST(label AS VARCHAR) ELSE '(' || label || ' AND NOT ((' || (10 + i % 7) || ' OR ' || (10 + (i + 1) % 7) || ')))' END AS filter FROM r) "


@add(_STORED + "SELECT line, k, CAST(4 AS BIGINT) AS dim, k > 0 AS ok FROM x")
def query_extract(spark, sf_dir):
    from .sources import text

    return text.checked_records(_stored_records(spark, sf_dir), 4).select(*ids("line", "k", "dim"), "ok")


@add(_STORED + "SELECT line FROM x WHERE k = 0")
def query_warnings(spark, sf_dir):
    """The lines that the file of skipped records names."""
    from .sources import text

    path = _scratch(spark, "warned")
    text.write_queries(_stored_queries(spark, sf_dir), path, {"source": "embeddings"})
    return spark.read.text(f"{path}/skipped_warnings").select(F.regexp_extract("value", "^line ([0-9]+): .", 1).cast("long").alias("line"))


def _stored_queries(spark, sf_dir) -> DataFrame:
    from .sources import text

    return text.extract_queries(_stored_records(spark, sf_dir), {f"label#{t}": t for t in range(3)} | {f"week#{w}": 10 + w for w in range(7)}, 4)


@add(_STORED + "SELECT line, CASE WHEN k > 0 THEN filter END AS filter, CASE WHEN k > 0 THEN k END AS k, k > 0 AS ok FROM x")
def query_records(spark, sf_dir):
    return _stored_queries(spark, sf_dir).select("line", "filter", "k", F.col("problem").isNull().alias("ok"))


@add(_STORED + ", y AS (SELECT row_number() OVER (ORDER BY line) - 1 AS qid, filter, k FROM x WHERE k > 0) SELECT * FROM y")
def query_files(spark, sf_dir):
    """The stored queries, converted, written as query files, and those read back."""
    from .sources import text

    path = _scratch(spark, "queries")
    text.write_queries(_stored_queries(spark, sf_dir), path, {"source": "embeddings"})
    lines = text.read_filters(spark, f"{path}/filters").select(F.col("fid").alias("qid"), F.col("expr").alias("filter"))
    return lines.join(text.read_topk(spark, f"{path}/topk", lines.count()), "qid").select("qid", "filter", F.col("k").cast("long").alias("k"))


@add(_STORED + ", n AS (SELECT count(*) AS n, count(*) FILTER (i % 40 <> 0) AS deep FROM r) SELECT counter, name, sum(n) AS n FROM (SELECT unnest([{'counter': 'depth', 'name': '', 'n': 2 * deep}, {'counter': 'refs', 'name': '', 'n': n + 2 * deep}, {'counter': 'kinds', 'name': 'term', 'n': n}, {'counter': 'kinds', 'name': 'and', 'n': deep}, {'counter': 'kinds', 'name': 'not', 'n': deep}, {'counter': 'kinds', 'name': 'terms', 'n': deep}, {'counter': 'joins', 'name': 'and', 'n': deep}, {'counter': 'joins', 'name': 'or', 'n': deep}, {'counter': 'sections', 'name': 'label', 'n': n}, {'counter': 'sections', 'name': 'week', 'n': 2 * deep}], recursive := true) FROM n) GROUP BY counter, name")
def tree_counters(spark, sf_dir):
    from .sources import text

    return text.tree_counters(_stored_records(spark, sf_dir)).groupBy("counter", "name").agg(F.sum("n").alias("n"))


def _dataset_folder(spark, sf_dir) -> str:
    from .sources import binary

    path = _scratch(spark, "datasets")
    binary.write_datasets(docs(spark, sf_dir).select("doc_id", "vec", "tags"), path, TAG_NUM, 2 * SEGMENT)
    return path


_DATASET = WITH + "SELECT doc_id, list_sort(list_distinct(tags)) AS tags, list_sum(CAST(CAST(vec AS FLOAT[]) AS DOUBLE[])) AS total FROM d"
_DATASET_SQL = "SELECT doc_id, array_to_string(tags, ',') AS tags, round(total, 6) AS total FROM (" + _DATASET + ")"


def _dataset_rows(rows: DataFrame) -> DataFrame:
    total = F.aggregate(F.col("vec").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    return rows.select("doc_id", F.array_join(F.col("tags").cast("array<string>"), ",").alias("tags"), F.round(total, 6).alias("total"))


@add(_DATASET_SQL)
def dataset_files(spark, sf_dir):
    """The corpus as dataset files and back."""
    from .sources import binary

    return _dataset_rows(binary.read_datasets(spark, _dataset_folder(spark, sf_dir), 100))


@add(f"SELECT doc_id - {2 * SEGMENT} AS doc_id, tags, total FROM ({_DATASET_SQL}) WHERE doc_id BETWEEN {2 * SEGMENT + 30} AND {2 * SEGMENT + 99}")
def dataset_slice(spark, sf_dir):
    """70 documents from the 30th on of the second dataset file, which numbers its own from 0 on."""
    from .sources import binary

    path = f"{_dataset_folder(spark, sf_dir)}/docs-{2 * SEGMENT:020d}.hyd"
    return _dataset_rows(binary.read_dataset(spark, path, 16, 30, 70))


@add(WITH + "SELECT row_number() OVER (ORDER BY qid) - 1 AS qid, CAST(len(qvec) AS BIGINT) AS dim, round(list_sum(CAST(CAST(qvec AS FLOAT[]) AS DOUBLE[])), 6) AS total FROM q")
def fvecs_file(spark, sf_dir):
    """The query vectors as a file and back."""
    from .sources import binary

    path = _scratch(spark, "queries") + ".fvecs"
    binary.write_fvecs(queries(spark, sf_dir), path)
    total = F.aggregate(F.col("vec").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    return binary.read_fvecs(spark, path).select("qid", F.size("vec").cast("long").alias("dim"), F.round(total, 6).alias("total"))


@add("SELECT doc_id AS id, octet_length(encode(coalesce(text, ''))) AS bytes, md5(coalesce(text, '')) AS digest FROM documents")
def record_files(spark, sf_dir):
    """Whole texts as builder records and back."""
    from .sources import binary

    path = _scratch(spark, "records")
    binary.write_records(_read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.encode("text", "utf-8").alias("payload")), path, 1 << 20)
    return binary.read_records(spark, path).select("id", F.length("payload").cast("long").alias("bytes"), F.md5("payload").alias("digest"))


_DICTIONARY = "SELECT DISTINCT 'label#' || label AS term, label AS tag_id FROM embeddings WHERE label % 2 = 0 UNION ALL SELECT DISTINCT 'week#' || vec_id % 7, 10 + vec_id % 7 FROM embeddings WHERE vec_id % 7 < 5"


def _dictionary(spark, sf_dir) -> DataFrame:
    """Labels that are even and five of the weeks, written as a dictionary file and read back."""
    from .sources import binary

    e, path = _read(spark, sf_dir, "embeddings"), _scratch(spark, "dictionary")
    label, week = F.col("label").cast("long"), F.col("vec_id") % 7
    terms = e.filter(label % 2 == 0).select(F.concat(F.lit("label#"), label.cast("string")).alias("term"), label.alias("tag_id")).distinct()
    weeks = e.filter(week < 5).select(F.concat(F.lit("week#"), week.cast("string")).alias("term"), (10 + week).alias("tag_id")).distinct()
    binary.write_tag_map(terms.unionByName(weeks), path)
    return binary.read_tag_map(spark, path)


@add(f"SELECT term, CAST(tag_id AS BIGINT) AS tag_id, split_part(term, '#', 1) AS section FROM ({_DICTIONARY})")
def tag_map_file(spark, sf_dir):
    return _dictionary(spark, sf_dir).select("term", F.col("tag_id").cast("long").alias("tag_id"), "section")


@add(WITH + "SELECT segment_id, count(*) AS docs, CAST(sum(len(list_distinct(tags))) AS BIGINT) AS entries, min(b.bytes) AS bytes FROM d JOIN (SELECT segment_id, CAST(sum(bytes) AS BIGINT) AS bytes FROM p GROUP BY segment_id) b USING (segment_id) GROUP BY segment_id")
def index_files(spark, sf_dir):
    """The index written by segments and loaded again."""
    path = _scratch(spark, "index")
    corpus.write_index(docs(spark, sf_dir).select("doc_id", "vec", "tags"), path, SEGMENT, THRESHOLD)
    index = corpus.load_index(spark, path)
    count = lambda name, c: index[name].groupBy(F.col("segment_id").cast("long").alias("segment_id")).agg(c)
    sizes = count("postings", F.sum("bytes").alias("bytes"))
    return count("documents", F.count(F.lit(1)).alias("docs")).join(count("posting_docs", F.count(F.lit(1)).alias("entries")), "segment_id").join(sizes, "segment_id")


@add("SELECT 'corpus' AS name, v AS version, (SELECT count(*) FROM embeddings WHERE v = 'v3' OR label < 5) AS rows FROM (VALUES ('v2'), ('v3')) AS t(v)")
def table_versions(spark, sf_dir):
    """Three versions are loaded, one of them twice and two of one name's are used on."""
    from .operators.tables import TableRepository

    e, known = _read(spark, sf_dir, "embeddings"), TableRepository(spark)
    some = e.filter("label < 5")
    for name, version, rows in (("corpus", "v1", e), ("corpus", "v2", some), ("corpus", "v3", e), ("corpus", "v2", e), ("other", "v1", e)):
        known.create(name, version, rows, cache=False)
    known.remove("corpus", "v9")
    known.remove_unused({"corpus": {"v2", "v3"}})
    parts = [rows.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("name"), F.lit(v).alias("version"), "rows") for (n, v), rows in known.loaded.items()]
    return reduce(DataFrame.unionByName, parts)


# --- filters ---

#: A filter for every vector: six forms over three tags that differ, one of them malformed.
_FORMS = ["{a}", "NOT {a} AND\t{b} OR {c}", "({a} OR {b}) AND {c}", "NOT ({a} AND {b}\n AND {c})", "{a} AND", "  "]
_FORM_AST = ["TAG({a})", "((NOT(TAG({a})) AND TAG({b})) OR TAG({c}))", "((TAG({a}) OR TAG({b})) AND TAG({c}))", "NOT((TAG({a}) AND TAG({b}) AND TAG({c})))", None, "MATCH_ALL"]
_FORM_STEPS = ["{{{a}}}", "{{{a}}} NOT(1,0) {{{b}}} AND(1,1) {{{c}}} OR(1,1)", "{{{a},{b}}} {{{c}}} AND(2,0)", "{{{a}}} {{{b}}} {{{c}}} AND(3,0) NOT(0,1)", None, "MATCH_ALL"]
_FORMED = "WITH w AS (SELECT vec_id AS id, vec_id % 6 AS form, vec_id % 10 AS a, 10 + vec_id % 7 AS b, 20 + vec_id % 13 AS c FROM embeddings) "


def _formed_sql(forms: list) -> str:
    """SQL for the form's text with the row's tags in place."""
    filled = ["NULL" if f is None else "'" + f.format(a="' || a || '", b="' || b || '", c="' || c || '") + "'" for f in forms]
    return "CASE form " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(filled)) + " END"


def _of_form(values: list) -> str:
    return "CASE form " + " ".join(f"WHEN {k} THEN {'NULL' if v is None else v}" for k, v in enumerate(values)) + " END"


def _compiled(spark, sf_dir) -> DataFrame:
    i = F.col("vec_id")
    text = F.element_at(F.array(*map(F.lit, _FORMS)), (i % 6 + 1).cast("int"))
    for name, tag in (("{a}", i % 10), ("{b}", 10 + i % 7), ("{c}", 20 + i % 13)):
        text = F.replace(text, F.lit(name), tag.cast("string"))
    return quality.compiled(_read(spark, sf_dir, "embeddings").select(i.alias("id"), text.alias("filter")))


@add(_FORMED + f"SELECT id, {_formed_sql(_FORM_AST)} AS ast, {_formed_sql(_FORM_STEPS)} AS postorder, form = 4 AS malformed FROM w")
def filter_parse(spark, sf_dir):
    """Every vector's filter read, printed and compiled."""
    return _compiled(spark, sf_dir).select("id", "ast", "postorder", F.col("problem").isNotNull().alias("malformed"))


@add(_FORMED + f"SELECT id, {_of_form([True, True, True, True, None, True])} AS sound, {_of_form([True, False, False, True, None, True])} AS cut_sound FROM w")
def postorder_check(spark, sf_dir):
    """Whether the steps are valid, and whether they are without the last one."""
    return _compiled(spark, sf_dir).select("id", "sound", "cut_sound")


_FIELDS = ["label", "week", "kind"]


@add("SELECT vec_id AS id, CASE vec_id % 8 WHEN 0 THEN NULL WHEN 1 THEN '(' || l || ')' WHEN 2 THEN '(' || w || ')' WHEN 3 THEN '(' || l || ' AND ' || w || ')' WHEN 4 THEN '((' || k || '))' WHEN 5 THEN '(' || l || ' AND (' || k || '))' WHEN 6 THEN '(' || w || ' AND (' || k || '))' ELSE '(' || l || ' AND ' || w || ' AND (' || k || '))' END AS ast FROM (SELECT vec_id, 'TAG(' || label || ')' AS l, 'NOT(TAG(' || (10 + vec_id % 7) || '))' AS w, 'TAG(100)' AS k FROM embeddings)")
def filter_prune(spark, sf_dir):
    """Trees of terms of three fields, of which the id's last bits say which are known."""
    from .runtime import ship

    @F.pandas_udf("string")
    def pruned(i: pd.Series, label: pd.Series) -> pd.Series:
        def one(i, label):
            tree = filters.And((filters.Term(label, "label"), filters.Not(filters.Term(10 + i % 7, "week")), filters.Or((filters.Term(100, "kind"), filters.Term(200, "none")))))
            left = filters.prune(tree, {f for k, f in enumerate(_FIELDS) if i >> k & 1})
            return None if left is None else filters.to_text(left)

        return pd.Series([one(int(a), int(b)) for a, b in zip(i, label, strict=True)])

    ship(spark)
    return _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), pruned("vec_id", F.col("label").cast("long")).alias("ast"))


@add("SELECT vec_id AS id, CASE vec_id % 5 WHEN 0 THEN CASE WHEN label % 2 = 0 THEN 'true' ELSE 'false' END WHEN 1 THEN CAST(vec_id AS VARCHAR) WHEN 2 THEN 'x' || vec_id WHEN 3 THEN printf('%.6g', vec_id / 7E0) ELSE '' END AS term FROM embeddings")
def json_scalars(spark, sf_dir):
    """JSON scalars of each kind as dictionary terms; others than scalars give none."""
    from .runtime import ship

    @F.pandas_udf("string")
    def texts(values: pd.Series) -> pd.Series:
        return values.map(json.loads).map(json_filter.scalar_text)

    ship(spark)
    i = F.col("vec_id")
    word = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    value = F.when(i % 5 == 0, (F.col("label") % 2 == 0).cast("string")).when(i % 5 == 1, word(i)).when(i % 5 == 2, word('"x', i, '"')).when(i % 5 == 3, F.to_json(F.array((i / F.lit(7.0)).cast("double")))).otherwise("null")
    return _read(spark, sf_dir, "embeddings").select(i.alias("id"), F.regexp_replace(value, r"^\[|\]$", "").alias("v")).select("id", texts("v").alias("term"))


def _filter_query(name: str, text: str, where: str) -> None:
    def run(spark, sf_dir):
        return docs(spark, sf_dir).filter(filters.to_column(filters.parse(text))).select("doc_id")

    run.__name__ = name
    add(WITH + f"SELECT doc_id FROM d WHERE {where}")(run)


_filter_query("filter_match_all", " ", "true")
_filter_query("filter_term", "3", _t(3))
_filter_query("filter_and", "3 AND 12 AND 101", f"{_t(3)} AND {_t(12)} AND {_t(101)}")
_filter_query("filter_or", "3 OR 25 OR 41", _t(3, 25, 41))
_filter_query("filter_not", "NOT 3", f"NOT {_t(3)}")
_filter_query("filter_nested", "(1 OR 2) AND NOT (13 OR 44) OR 100 AND NOT NOT 101", f"(({_t(1, 2)}) AND NOT ({_t(13, 44)})) OR ({_t(100)} AND {_t(101)})")
_filter_query("filter_flat", "(1 OR (2 OR (3 OR 2))) AND (101 AND (10 OR 11))", f"({_t(1, 2, 3)}) AND {_t(101)} AND ({_t(10, 11)})")


def with_words(spark, sf_dir) -> DataFrame:
    return docs(spark, sf_dir).withColumn("tag_words", bitmaps.to_words(F.col("tags"), TAG_NUM))


@add(WITH + f"SELECT fid, doc_id FROM (SELECT unnest(range({len(FILTERS)})) AS fid) x, d WHERE {_CASE}")
def filter_bitmap(spark, sf_dir):
    d = with_words(spark, sf_dir)
    parts = [d.filter(filters.to_bitmap_column(filters.parse(t))).select(F.lit(k).cast("long").alias("fid"), "doc_id") for k, t in enumerate(FILTERS)]
    return reduce(DataFrame.unionAll, parts)



@add("SELECT CAST(qid AS BIGINT) AS qid, CAST(position AS BIGINT) AS position, CAST(tag AS BIGINT) AS tag FROM (VALUES (1,0,3),(2,0,3),(2,1,12),(3,0,3),(3,1,25),(3,2,41),(4,0,3),(5,0,1),(5,1,2),(5,2,13),(5,3,44),(6,0,999),(7,0,3),(7,1,3),(8,0,100),(8,1,25),(8,2,11),(9,0,101),(9,1,100)) AS v(qid, position, tag)")
def filter_terms(spark, sf_dir):
    return quality.term_rows(spark, dict(enumerate(FILTERS)))


# the dictionary of languages and labels, and JSON filters over it
_TAG_MAP = {"label#0": 0, "label#1": 1, "label#2": 2, "label#3": 3, "week#0": 10, "week#1": 11, "week#2": 12, "kind#rare": 100, "kind#any": 101}


def _json_query(name: str, tree: dict, where: str) -> None:
    def run(spark, sf_dir):
        node = json_filter.as_node(json_filter.compile_tree(tree, _TAG_MAP))
        return docs(spark, sf_dir).filter(filters.to_column(node)).select("doc_id")

    run.__name__ = name
    add(WITH + f"SELECT doc_id FROM d WHERE {where}")(run)


_json_query("json_filter_term", {"term": {"label": 3, "week": 2}}, f"{_t(3)} AND {_t(12)}")
_json_query("json_filter_terms", {"terms": {"label": [1, 2], "week": [0, 1], "join_type": "and"}}, f"({_t(1, 2)}) AND ({_t(10, 11)})")
_json_query("json_filter_terms_inner_and", {"terms": {"kind": ["rare", "any"], "inner_section_join_type": "and"}}, f"{_t(100)} AND {_t(101)}")
_json_query("json_filter_nested", {"and": [{"or": [{"term": {"label": 1}}, {"term": {"kind": "rare"}}]}, {"not": {"term": {"week": 0}}}]}, f"({_t(1)} OR {_t(100)}) AND NOT {_t(10)}")
_json_query("filter_const_fold", {"or": [{"term": {"label": "none"}}, {"and": [{"not": {"term": {"no": 1}}}, {"term": {"label": 2}}]}]}, _t(2))
_json_query("filter_contradiction", {"and": [{"term": {"label": "none"}}, {"term": {"label": 2}}]}, "false")
_json_query("filter_tautology", {"not": {"terms": {"label": ["none", "nowhere"]}}}, "true")


@add("SELECT term, CAST(dense_rank() OVER (ORDER BY term) - 1 AS BIGINT) AS tag_id, n FROM (SELECT 'lang#' || lang AS term, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source#' || source, count(*) FROM documents GROUP BY source)")
def tag_dictionary(spark, sf_dir):
    from pyspark.sql import Window

    d = _read(spark, sf_dir, "documents")
    both = d.select(F.explode(F.array(F.concat(F.lit("lang#"), "lang"), F.concat(F.lit("source#"), "source"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return both.select("term", (F.dense_rank().over(Window.orderBy("term")) - 1).cast("long").alias("tag_id"), "n")


_RESOLVED = f"SELECT position, v.term, CAST(tag_id AS BIGINT) AS tag_id FROM (SELECT 2 * vec_id AS position, 'label#' || label AS term FROM embeddings UNION ALL SELECT 2 * vec_id + 1, 'week#' || vec_id % 7 FROM embeddings) v LEFT JOIN ({_DICTIONARY}) m ON m.term = v.term"


@add(_RESOLVED)
def tag_resolve(spark, sf_dir):
    """Two terms of every vector looked up in the dictionary read from its file."""
    i = F.col("vec_id")
    pair = F.array(F.concat(F.lit("label#"), F.col("label").cast("string")), F.concat(F.lit("week#"), (i % 7).cast("string")))
    asked = _read(spark, sf_dir, "embeddings").select(i, F.posexplode(pair).alias("at", "term")).select((2 * i + F.col("at")).alias("position"), "term")
    return asked.join(_dictionary(spark, sf_dir), "term", "left").select("position", "term", F.col("tag_id").cast("long").alias("tag_id"))


# --- postings ---


def _posting_query(name: str, node, where: str) -> None:
    def run(spark, sf_dir):
        return postings_algebra.match(node, entries(spark, sf_dir), docs(spark, sf_dir))

    run.__name__ = name
    add(WITH + f"SELECT doc_id FROM d WHERE {where}")(run)


_T = filters.Term
_posting_query("posting_term", _T(3), _t(3))
_posting_query("posting_terms", filters.Terms((3, 25, 999)), _t(3, 25, 999))
_posting_query("posting_or_terms", filters.OrTerms((_T(1), filters.Terms((2, 3)), filters.Not(_T(1)))), _t(1, 2, 3))
_posting_query("posting_and", filters.And((_T(3), _T(12), filters.Or((_T(20), _T(21))))), f"{_t(3)} AND {_t(12)} AND ({_t(20, 21)})")
_posting_query("posting_or", filters.Or((_T(3), filters.And((_T(25), _T(11))))), f"{_t(3)} OR ({_t(25)} AND {_t(11)})")
_posting_query("posting_not", filters.Not(filters.Or((_T(3), _T(101)))), f"NOT ({_t(3, 101)})")
_posting_query("posting_conjunction", filters.Conjunction((filters.Terms((1, 2, 3)), filters.OrTerms(()), _T(12))), f"({_t(1, 2, 3)}) AND {_t(12)}")


@add(WITH + "SELECT qid, doc_id FROM m")
def posting_batch(spark, sf_dir):
    return search.match_postings(docs(spark, sf_dir), entries(spark, sf_dir), queries(spark, sf_dir)).select(*ids("qid", "doc_id"))


@add(WITH + "SELECT tag, segment_id, hit_count, unit_count FROM p")
def inverted_build(spark, sf_dir):
    return corpus.build_postings(entries(spark, sf_dir)).select(*ids("tag", "segment_id", "hit_count", "unit_count"))


@add(WITH + "SELECT tag, segment_id, layout FROM p")
def posting_layout(spark, sf_dir):
    return postings(spark, sf_dir).select(*ids("tag", "segment_id"), "layout")


@add(WITH + f"SELECT tag, segment_id, bytes AS packed_bytes, CAST(8 + 6 * unit_count + (8 + 6 * unit_count) % 4 AS BIGINT) AS sparse_bytes, CAST(8 + 4 * hit_count AS BIGINT) AS id_bytes, CAST(8 + {SEGMENT} AS BIGINT) AS map_bytes FROM p")
def posting_bytes(spark, sf_dir):
    p = postings(spark, sf_dir)
    size = lambda kind: corpus.layout_bytes(F.lit(kind), F.col("hit_count"), F.col("unit_count"), SEGMENT)
    return p.select(*ids("tag", "segment_id"), F.col("bytes").alias("packed_bytes"), size("sparse_bitmap").alias("sparse_bytes"), size("id_list").alias("id_bytes"), size("byte_map").alias("map_bytes"))


_LAYOUTS = ["dense_bitmap", "sparse_bitmap", "byte_map", "id_list", "packed"]


def _encoded(spark, sf_dir) -> DataFrame:
    """Every posting once, in the five layouts by turns."""
    kind = F.element_at(F.array(*map(F.lit, _LAYOUTS)), ((F.col("tag") + F.col("segment_id")) % 5 + 1).cast("int"))
    return corpus.encoded_postings(entries(spark, sf_dir), SEGMENT, kind)


@add(WITH + f", k AS (SELECT *, ['dense_bitmap', 'sparse_bitmap', 'byte_map', 'id_list', 'packed'][(tag + segment_id) % 5 + 1] AS kind FROM p0) SELECT tag, segment_id, kind AS layout, CAST(CASE kind WHEN 'dense_bitmap' THEN {8 + 2 * SEGMENT // 16} WHEN 'byte_map' THEN {8 + SEGMENT} WHEN 'id_list' THEN 8 + 4 * hit_count WHEN 'packed' THEN 8 + 4 * unit_count ELSE 8 + 6 * unit_count + (8 + 6 * unit_count) % 4 END AS BIGINT) AS bytes FROM k")
def posting_encode(spark, sf_dir):
    return _encoded(spark, sf_dir).select("tag", "segment_id", "layout", F.length("posting").cast("long").alias("bytes"))


@add(WITH + "SELECT DISTINCT tag, segment_id, local_id FROM e")
def posting_decode(spark, sf_dir):
    return corpus.decoded_postings(_encoded(spark, sf_dir)).select("tag", "segment_id", "local_id")


@add(WITH + "SELECT tag, segment_id, weight FROM p")
def posting_weight(spark, sf_dir):
    return postings(spark, sf_dir).select(*ids("tag", "segment_id", "weight"))


@add(WITH + "SELECT v.tag, EXISTS (SELECT 1 FROM e WHERE e.tag = v.tag) AS present FROM (SELECT unnest([CAST(3 AS BIGINT), 77, 100, 129, 999]) AS tag) v")
def token_exists(spark, sf_dir):
    wanted = spark.createDataFrame([(t,) for t in (3, 77, 100, 129, 999)], "tag long")
    return corpus.token_exists(wanted, entries(spark, sf_dir))


def _bitmaps(spark, sf_dir) -> DataFrame:
    return corpus.segment_bitmaps(entries(spark, sf_dir), SEGMENT)


def _wide(spark, sf_dir, tags: list[int]) -> DataFrame:
    """One row for each segment with its number of documents and the words of each tag (zero where absent)."""
    size = docs(spark, sf_dir).groupBy("segment_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    zero = F.transform(F.sequence(F.lit(1), F.lit(bitmaps.words_for(SEGMENT))), lambda _: F.lit(0).cast("long"))
    held = _bitmaps(spark, sf_dir).filter(F.col("tag").isin(*tags))
    got = held.groupBy("segment_id").agg(*[F.first(F.when(F.col("tag") == t, F.col("words")), ignorenulls=True).alias(f"w{t}") for t in tags])
    return size.join(got, "segment_id", "left").select("segment_id", "n", *[F.coalesce(f"w{t}", zero).alias(f"w{t}") for t in tags])


def _bits(df: DataFrame, words) -> DataFrame:
    return df.select("segment_id", F.explode(bitmaps.to_positions(words)).alias("local_id")).select((F.col("segment_id") * SEGMENT + F.col("local_id")).alias("doc_id"))


@add(WITH + "SELECT tag, segment_id, count(DISTINCT local_id) AS bits FROM e GROUP BY tag, segment_id")
def posting_densify(spark, sf_dir):
    return _bitmaps(spark, sf_dir).select(*ids("tag", "segment_id"), bitmaps.popcount(F.col("words")).alias("bits"))


@add(WITH + f"SELECT doc_id FROM d WHERE {_t(3, 25)}")
def bitmap_or(spark, sf_dir):
    return _bits(_wide(spark, sf_dir, [3, 25]), bitmaps.either(F.col("w3"), F.col("w25")))


@add(WITH + f"SELECT doc_id FROM d WHERE {_t(3)} AND {_t(12)}")
def bitmap_and(spark, sf_dir):
    return _bits(_wide(spark, sf_dir, [3, 12]), bitmaps.both(F.col("w3"), F.col("w12")))


@add(WITH + f"SELECT doc_id FROM d WHERE NOT {_t(3)}")
def bitmap_not(spark, sf_dir):
    return _bits(_wide(spark, sf_dir, [3]), bitmaps.complement(F.col("w3"), F.col("n")))


@add(WITH + f"SELECT doc_id FROM d WHERE ({_t(1, 2)}) AND ({_t(12, 13)})")
def bitmap_conjunction(spark, sf_dir):
    c = F.col
    return _bits(_wide(spark, sf_dir, [1, 2, 12, 13]), bitmaps.both(bitmaps.either(c("w1"), c("w2")), bitmaps.either(c("w12"), c("w13"))))


@add(WITH + "SELECT DISTINCT doc_id, unnest(tags) AS tag FROM d")
def bitmap_to_tags(spark, sf_dir):
    return with_words(spark, sf_dir).select("doc_id", F.explode(bitmaps.to_positions(F.col("tag_words"))).alias("tag"))


@add(WITH + "SELECT doc_id, CAST(len(list_distinct(tags)) AS BIGINT) AS n FROM d")
def tag_popcount(spark, sf_dir):
    return with_words(spark, sf_dir).select("doc_id", bitmaps.popcount(F.col("tag_words")).alias("n"))


# --- vectors, pairs, top-k ---


@add(WITH + "SELECT doc_id, i - 1 AS component, half[i] AS value FROM d, range(1, 65) t(i)")
def vector_f16(spark, sf_dir):
    return corpus.prepare(docs(spark, sf_dir)).select("doc_id", F.posexplode("vec").alias("component", "value")).select(*ids("doc_id", "component"), "value")


@add(WITH + "SELECT qid, doc_id, round(list_inner_product(vec, qvec), 6) AS score FROM d, q")
def inner_product(spark, sf_dir):
    return search.scores(docs(spark, sf_dir), _unfiltered(spark, sf_dir), False, 6)


@add(WITH + "SELECT doc_id, round(sqrt(list_inner_product(vec, vec)), 6) AS norm, round(list_min(vec), 6) AS low, round(list_max(vec), 6) AS high FROM d")
def vector_norm(spark, sf_dir):
    v = F.col("vec")
    return docs(spark, sf_dir).select("doc_id", F.round(vectors.norm(v), 6).alias("norm"), F.round(F.array_min(v), 6).alias("low"), F.round(F.array_max(v), 6).alias("high"))


def _unfiltered(spark, sf_dir):
    return queries(spark, sf_dir).withColumn("filter", F.lit(""))


@add(WITH + "SELECT qid, doc_id, round(list_inner_product(half, qhalf), 6) AS score FROM d, q")
def score_f16(spark, sf_dir):
    return search.scores(docs(spark, sf_dir), _unfiltered(spark, sf_dir), True, 6)


@add(WITH + "SELECT qid, count(*) AS pairs, round(sum(list_inner_product(half, qhalf)), 4) AS total FROM d, q GROUP BY qid")
def score_all_pairs(spark, sf_dir):
    return search.totals(docs(spark, sf_dir), _unfiltered(spark, sf_dir)).select("qid", "pairs", F.round("total", 4).alias("total"))


@add(WITH + "SELECT qid, doc_id, round(list_inner_product(vec, qvec), 6) AS score FROM d, q")
def score_only(spark, sf_dir):
    return search.scores(docs(spark, sf_dir), _unfiltered(spark, sf_dir), False, 6)


@add(WITH + "SELECT qid, doc_id FROM m")
def filter_only(spark, sf_dir):
    return search.match(docs(spark, sf_dir), queries(spark, sf_dir)).select("qid", "doc_id")


@add(WITH + "SELECT qid, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM m GROUP BY qid")
def filtered_pairs(spark, sf_dir):
    return search.match(docs(spark, sf_dir), queries(spark, sf_dir)).groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


@add(WITH + "SELECT qid, doc_id, round(s16, 6) AS score FROM s")
def filtered_scores(spark, sf_dir):
    return search.scores(docs(spark, sf_dir), queries(spark, sf_dir), True, 6)


@add(WITH + "SELECT rk AS rank, doc_id, round(s16, 6) AS score FROM r16 WHERE qid = 0 AND rk <= 10")
def topk_single(spark, sf_dir):
    q = queries(spark, sf_dir, 10).filter("qid = 0")
    return published(search.topk(docs(spark, sf_dir), q)).drop("qid")


@add(_TOP16)
def topk_filtered(spark, sf_dir):
    return published(search.topk(docs(spark, sf_dir), queries(spark, sf_dir)))


@add(_TOP16)
def topk_blocks(spark, sf_dir):
    return published(search.topk_blocks(docs(spark, sf_dir), queries(spark, sf_dir)))


@add(WITH + "SELECT qid, rk AS rank, doc_id, round(s16, 6) AS score FROM r16 WHERE rk <= 1 + qid // 20 % 3 * 7")
def topk_per_query_k(spark, sf_dir):
    q = queries(spark, sf_dir).withColumn("k", (1 + F.floor(F.col("qid") / EVERY) % 3 * 7).cast("int"))
    return published(search.topk(docs(spark, sf_dir), q))


@add(WITH + "SELECT qid, rk AS rank, doc_id, round(s16, 6) AS score FROM r16")
def topk_k_exceeds(spark, sf_dir):
    found = search.topk(docs(spark, sf_dir), queries(spark, sf_dir, 1_000_000), digits=6)
    return found.select(*ids("qid", "rank", "doc_id"), "score")


@add(WITH + "SELECT qid, rk AS rank, doc_id, round(s16, 6) AS score FROM r16 WHERE fid IN (6, 7)")
def topk_empty(spark, sf_dir):
    q = queries(spark, sf_dir).filter(fid().isin(6, 7))
    return published(search.topk(docs(spark, sf_dir), q))


@add(_TOP16)
def topk_sharded(spark, sf_dir):
    return published(search.topk(sharded(spark, sf_dir), queries(spark, sf_dir), shard_col="shard_id"))


@add(_TOP16)
def topk_stream_merge(spark, sf_dir):
    return published(ingest.fold_shards(sharded(spark, sf_dir), queries(spark, sf_dir), "shard_id", list(range(SHARDS))))


@add(WITH + "SELECT qid, rank, doc_id, round(s16, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s16 DESC, doc_id) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid, shard_id ORDER BY s16 DESC, doc_id) AS in_shard FROM s) WHERE in_shard <= greatest(1, ceil(k * 0.5))) WHERE rank <= k")
def topk_shard_ratio(spark, sf_dir):
    return published(search.topk(sharded(spark, sf_dir), queries(spark, sf_dir), shard_col="shard_id", ratio=0.5))


@add(WITH + "SELECT qid, rank, doc_id, round(s16, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s16 DESC, doc_id) AS rank FROM s WHERE shard_id IN (0, 2)) WHERE rank <= k")
def topk_partial_shards(spark, sf_dir):
    return published(search.topk(sharded(spark, sf_dir), queries(spark, sf_dir), shard_col="shard_id", shards=[0, 2]))


@add(WITH + "SELECT qid, doc_id FROM r16 WHERE rk <= k")
def truth_f16(spark, sf_dir):
    return quality.truth(docs(spark, sf_dir), queries(spark, sf_dir)).select(*ids("qid", "doc_id"))


@add(WITH + "SELECT qid, doc_id FROM r32 WHERE rk <= k")
def truth_fp32(spark, sf_dir):
    return quality.truth(docs(spark, sf_dir), queries(spark, sf_dir), False).select(*ids("qid", "doc_id"))


@add(WITH + "SELECT qid, count(*) AS n, sum(doc_id)::BIGINT AS id_sum FROM r16 WHERE rk <= 40 GROUP BY qid")
def truth_batch(spark, sf_dir):
    t = quality.truth(docs(spark, sf_dir), queries(spark, sf_dir, 40))
    return t.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("id_sum"))


@add(WITH + "SELECT d.segment_id, d.local_id, d.doc_id FROM d JOIN (VALUES (0, 3), (1, 127), (2, 5), (99999, 1), (0, 500)) AS v(segment_id, local_id) ON d.segment_id = v.segment_id AND d.local_id = v.local_id")
def docid_lookup(spark, sf_dir):
    wanted = spark.createDataFrame([(0, 3), (1, 127), (2, 5), (99999, 1), (0, 500)], "segment_id long, local_id long")
    return corpus.to_global(wanted, corpus.id_map(docs(spark, sf_dir)))


@add(WITH + "SELECT doc_id, segment_id, local_id FROM d")
def docid_to_local(spark, sf_dir):
    d = docs(spark, sf_dir)
    return corpus.to_local(d.select("doc_id"), corpus.id_map(d))


@add(WITH + "SELECT 'doc-' || doc_id AS sdoc_id, doc_id, segment_id, local_id FROM d")
def sdocid_lookup(spark, sf_dir):
    d = docs(spark, sf_dir)
    held = corpus.id_map(d).withColumn("sdoc_id", F.concat(F.lit("doc-"), F.col("doc_id")))
    asked = d.select(F.concat(F.lit("doc-"), F.col("doc_id")).alias("sdoc_id")).unionAll(spark.createDataFrame([("doc-x",)], "sdoc_id string"))
    return corpus.from_strings(asked, held).select("sdoc_id", *ids("doc_id", "segment_id", "local_id"))


@add("SELECT count(*) AS rows, count(DISTINCT source || '#' || lang) AS tokens FROM documents")
def token_hash(spark, sf_dir):
    d = _read(spark, sf_dir, "documents")
    return d.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(corpus.token(F.col("source"), F.col("lang"))).alias("tokens"))


@add("SELECT vec_id, CAST(label AS BIGINT) AS label, CAST(len(embedding) AS BIGINT) AS dim FROM embeddings")
def stream_ingest(spark, sf_dir):
    from .runtime import shared_dir

    base = f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex[:8]}"
    schema = _read(spark, sf_dir, "embeddings").schema
    rows = ingest.ingest(spark, f"{sf_dir}/embeddings.parque[t]", schema, f"{base}/table", f"{base}/progress", ["vec_id"], "vec_id")
    return rows.select(*ids("vec_id", "label"), F.size("embedding").cast("long").alias("dim"))


# --- corpus statistics ---


@add(WITH + "SELECT tag, doc_freq FROM f")
def tag_doc_freq(spark, sf_dir):
    return frequencies(spark, sf_dir)


@add(WITH + f"SELECT count(*) FILTER (doc_freq > 0) AS distinct_tags, count(*) FILTER (doc_freq = 0) AS zero_tags, (SELECT string_agg(CAST(tag AS VARCHAR), ',' ORDER BY tag) FROM (SELECT tag FROM f WHERE doc_freq = 0 ORDER BY tag LIMIT 32)) AS first_zero_tags, CAST(sum(doc_freq) AS BIGINT) AS assignments, (SELECT CAST(ceil(count(*) / {SEGMENT}) AS BIGINT) FROM d) AS segments FROM f")
def conversion_summary(spark, sf_dir):
    return stats.conversion_summary(frequencies(spark, sf_dir), docs(spark, sf_dir).count(), SEGMENT)


_PERCENTILES = {"p50": 0.5, "p90": 0.9, "p99": 0.99}


def _percentile_sql(value: str, p: float, by: str = "") -> str:
    return f"max(CASE WHEN at_ = least(n_ - 1, CAST(floor({p}E0 * n_) AS BIGINT)) THEN {value} END)"


@add(WITH + ", t AS (SELECT CAST(len(tags) AS BIGINT) AS n FROM d), o AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS at_, count(*) OVER () AS n_ FROM t) SELECT min(n) AS low, round(avg(n), 6) AS mean, max(n) AS high, " + ", ".join(f"{_percentile_sql('n', p)} AS {k}" for k, p in _PERCENTILES.items()) + f", round(avg(n) / {TAG_NUM}, 6) AS density FROM o")
def tags_per_doc(spark, sf_dir):
    t = docs(spark, sf_dir).select(F.size("tags").cast("long").alias("n"))
    basic = t.agg(F.min("n").alias("low"), F.round(F.avg("n"), 6).alias("mean"), F.max("n").alias("high"), F.round(F.avg("n") / TAG_NUM, 6).alias("density"))
    return basic.join(stats.order_percentiles(t, "n", _PERCENTILES), F.lit(True))


@add(WITH + ", n AS (SELECT count(*) AS n FROM d) SELECT band, count(*) AS tags FROM (SELECT CASE WHEN doc_freq = 0 THEN 'never' WHEN doc_freq / n >= 0.999 THEN 'always' WHEN doc_freq / n >= 0.9 THEN 'universal' WHEN doc_freq / n >= 0.05 THEN 'common' WHEN doc_freq / n >= 0.01 THEN 'low' ELSE 'rare' END AS band FROM f, n) GROUP BY band")
def tag_freq_bands(spark, sf_dir):
    return stats.bands(frequencies(spark, sf_dir), docs(spark, sf_dir).count())


@add(WITH + ", r AS (SELECT doc_freq, row_number() OVER (ORDER BY doc_freq DESC, tag) AS rk FROM f) SELECT CAST(n AS BIGINT) AS top_n, CAST(sum(doc_freq) FILTER (rk <= n) AS BIGINT) AS assignments, round(sum(doc_freq) FILTER (rk <= n) / sum(doc_freq), 6) AS share FROM r, (SELECT unnest([5, 20, 100]) AS n) GROUP BY n")
def tag_concentration(spark, sf_dir):
    return stats.concentration(frequencies(spark, sf_dir), [5, 20, 100]).withColumn("share", F.round("share", 6))


@add(WITH + "SELECT tag, doc_freq FROM f WHERE doc_freq > 0 ORDER BY doc_freq DESC, tag LIMIT 10")
def tag_top_n(spark, sf_dir):
    return stats.most_common(frequencies(spark, sf_dir), 10)


@add(WITH + "SELECT tag, doc_freq FROM f WHERE doc_freq > 0 ORDER BY doc_freq, tag LIMIT 10")
def tag_rare_n(spark, sf_dir):
    return stats.most_common(frequencies(spark, sf_dir), 10, rarest=True)


@add("SELECT bucket, round(first_lo + bucket * first_w, 6) AS low, n FROM (SELECT CAST(least(11, floor((value - lo) / ((hi - lo) / 12))) AS BIGINT) AS bucket, min(lo) AS first_lo, min((hi - lo) / 12) AS first_w, count(*) AS n FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events) WHERE value IS NOT NULL GROUP BY 1)")
def norm_histogram(spark, sf_dir):
    return stats.fixed_histogram(_read(spark, sf_dir, "events"), "value", 12).withColumn("low", F.round("low", 6))


@add(WITH + ", c AS (SELECT list_sum(vec) AS s, list_inner_product(vec, vec) AS q, len(vec) AS d FROM d) SELECT count(*) AS vectors, round(sum(s) / sum(d), 6) AS component_mean, round(sqrt(sum(q) / sum(d) - (sum(s) / sum(d)) ** 2), 6) AS component_std, round(avg(sqrt(q)), 6) AS norm_mean, abs(avg(sqrt(q)) - 1) < 0.1 AS normalised, count(*) FILTER (q = 0) AS zero_vectors FROM c")
def vector_stats(spark, sf_dir):
    s = stats.vector_stats(docs(spark, sf_dir))
    return s.select("vectors", *[F.round(c, 6).alias(c) for c in ("component_mean", "component_std", "norm_mean")], "normalised", "zero_vectors")


@add(WITH + f"SELECT CAST({TAG_NUM} * ceil(count(*) / {SEGMENT}) * {SEGMENT} // 8 AS BIGINT) AS bytes FROM d")
def storage_estimate(spark, sf_dir):
    n = docs(spark, sf_dir).count()
    return spark.createDataFrame([(stats.storage_estimate(TAG_NUM, n, SEGMENT),)], "bytes long")


@add("SELECT source AS section, count(DISTINCT lang) AS n_values, count(*) AS n_terms FROM documents GROUP BY source")
def section_sizes(spark, sf_dir):
    return _read(spark, sf_dir, "documents").groupBy(F.col("source").alias("section")).agg(F.count_distinct("lang").alias("n_values"), F.count(F.lit(1)).alias("n_terms"))


@add("SELECT vec_id AS doc_id FROM embeddings WHERE (vec_id * 2654435761) % 4294967296 % 10 = 0")
def sample_docs(spark, sf_dir):
    return stats.hash_sample(docs(spark, sf_dir), F.col("doc_id"), 10).select("doc_id")


@add(WITH + "SELECT layout, count(*) AS postings FROM p GROUP BY layout")
def posting_layout_counts(spark, sf_dir):
    return postings(spark, sf_dir).groupBy("layout").agg(F.count(F.lit(1)).alias("postings"))


@add(WITH + f"SELECT count(*) FILTER (layout = 'dense_bitmap') AS dense, count(*) FILTER (layout <> 'dense_bitmap') AS sparse, CAST(sum(unit_count) FILTER (layout <> 'dense_bitmap') AS BIGINT) AS units, round(avg(unit_count) FILTER (layout <> 'dense_bitmap'), 6) AS mean_units, max(unit_count) FILTER (layout <> 'dense_bitmap') AS max_units, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) * {8 + 2 * SEGMENT // 16} AS dense_bytes FROM p")
def posting_summary(spark, sf_dir):
    return stats.posting_summary(postings(spark, sf_dir), SEGMENT).withColumn("mean_units", F.round("mean_units", 6))


@add(WITH + "SELECT CAST(least(15, length(bin(unit_count))) AS BIGINT) AS bucket, count(*) AS postings FROM p GROUP BY 1")
def posting_k_hist(spark, sf_dir):
    return stats.unit_histogram(postings(spark, sf_dir))


@add(WITH + "SELECT hits, postings, CAST(sum(postings) OVER (ORDER BY hits) AS BIGINT) AS cumulative FROM (SELECT least(hit_count, 2048) AS hits, count(*) AS postings FROM p GROUP BY 1)")
def posting_hit_cum(spark, sf_dir):
    return stats.hit_cumulative(postings(spark, sf_dir))


@add(WITH + ", u AS (SELECT DISTINCT tag, segment_id, local_id // 16 AS unit FROM e), g AS (SELECT *, unit - row_number() OVER (PARTITION BY tag, segment_id ORDER BY unit) AS island FROM u) SELECT tag, segment_id, min(unit) AS run_start, count(*) AS run_length FROM g GROUP BY tag, segment_id, island")
def posting_runs(spark, sf_dir):
    return corpus.unit_runs(entries(spark, sf_dir)).select(*ids("tag", "segment_id", "run_start", "run_length"))


@add(WITH + ", u AS (SELECT DISTINCT tag, segment_id, local_id // 16 AS unit FROM e), g AS (SELECT *, unit - row_number() OVER (PARTITION BY tag, segment_id ORDER BY unit) AS island FROM u), r AS (SELECT count(*) AS n FROM g GROUP BY tag, segment_id, island) SELECT least(n, 9) AS length, count(*) AS runs FROM r GROUP BY 1")
def posting_run_hist(spark, sf_dir):
    return stats.run_histogram(corpus.unit_runs(entries(spark, sf_dir)))


@add(WITH + ", k AS (SELECT 'posting' AS kind, CAST(sum(bytes) AS BIGINT) AS bytes FROM p UNION ALL SELECT 'vector', CAST(sum(2 * len(vec)) AS BIGINT) FROM d UNION ALL SELECT 'idm', count(*) * 8 FROM d) SELECT kind, bytes, round(bytes / sum(bytes) OVER (), 6) AS share FROM k")
def index_size(spark, sf_dir):
    from pyspark.sql import Window

    d = docs(spark, sf_dir)
    kinds = postings(spark, sf_dir).agg(F.sum("bytes").alias("bytes")).select(F.lit("posting").alias("kind"), "bytes")
    kinds = kinds.unionByName(d.agg(F.sum(2 * F.size("vec")).alias("bytes")).withColumn("kind", F.lit("vector"))).unionByName(d.agg((F.count(F.lit(1)) * 8).alias("bytes")).withColumn("kind", F.lit("idm")))
    return kinds.select("kind", F.col("bytes").cast("long").alias("bytes"), F.round(F.col("bytes") / F.sum("bytes").over(Window.partitionBy()), 6).alias("share"))


@add("SELECT * FROM (SELECT 'vector_dim' AS rule, count(*) FILTER (len(embedding) <> 64) AS rows FROM embeddings UNION ALL SELECT 'document_count', CAST(CASE WHEN count(*) <> -1 THEN 1 ELSE 0 END AS BIGINT) FROM embeddings UNION ALL SELECT 'segment_size', 1) WHERE rows > 0")
def corpus_violations(spark, sf_dir):
    return corpus.violations(docs(spark, sf_dir), 64, SEGMENT + 1, total=-1)


# --- recall, filters and latency ---

_RECALL = WITH + ", x AS (SELECT qid, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s16 DESC, doc_id) AS rank FROM s WHERE shard_id IN (0, 2)) WHERE rank <= k), t AS (SELECT qid, doc_id FROM r16 WHERE rk <= k), c AS (SELECT t.qid, count(x.doc_id) AS hits, count(*) AS expected, count(x.doc_id) / count(*) AS recall FROM t LEFT JOIN x ON x.qid = t.qid AND x.doc_id = t.doc_id GROUP BY t.qid) "


def _recalls(spark, sf_dir):
    d, q = sharded(spark, sf_dir), queries(spark, sf_dir)
    return quality.recall(search.topk(d, q, shard_col="shard_id", shards=[0, 2]), quality.truth(d, q))


@add(_RECALL + "SELECT qid, hits, expected, round(recall, 6) AS recall FROM c")
def recall_at_k(spark, sf_dir):
    return _recalls(spark, sf_dir).select(*ids("qid", "hits", "expected"), F.round("recall", 6).alias("recall"))


@add(_RECALL + "SELECT count(*) AS queries, round(avg(recall), 6) AS avg_recall, round(min(recall), 6) AS min_recall, count(*) FILTER (recall < 1) AS below_one FROM c")
def recall_summary(spark, sf_dir):
    s = quality.recall_summary(_recalls(spark, sf_dir))
    return s.select("queries", F.round("avg_recall", 6).alias("avg_recall"), F.round("min_recall", 6).alias("min_recall"), "below_one")


@add(_FORMED + f"SELECT id, CAST({_of_form([1, 4, 3, 3, None, 1])} AS BIGINT) AS depth, CAST({_of_form([1, 3, 3, 3, None, 0])} AS BIGINT) AS refs, CAST({_of_form([1, 3, 3, 3, None, 0])} AS BIGINT) AS tags FROM w")
def filter_shape(spark, sf_dir):
    return _compiled(spark, sf_dir).select("id", "depth", "refs", "tags")


def _shape_rows(spark, sf_dir) -> DataFrame:
    return _compiled(spark, sf_dir).select("id", F.explode("shape").alias("s")).select("id", "s.*")


#: The operators of each form: its number, the operator, posting and stacked operands, the most of the form.
_FORM_OPS = "(VALUES (1, 'NOT', 1, 0, 2), (1, 'AND', 1, 1, 2), (1, 'OR', 1, 1, 2), (2, 'AND', 2, 0, 2), (3, 'AND', 3, 0, 3), (3, 'NOT', 0, 1, 3)) AS v(form, op, postings, stacked, most)"


@add(_FORMED + f"SELECT op, count(*) AS nodes, CAST(sum(postings) AS BIGINT) AS postings, CAST(sum(stacked) AS BIGINT) AS stacked, CAST(max(most) AS BIGINT) AS most_operands FROM w JOIN {_FORM_OPS} USING (form) GROUP BY op")
def expr_stats(spark, sf_dir):
    s = _shape_rows(spark, sf_dir)
    return s.groupBy("op").agg(*[F.sum(c).alias(c) for c in ("nodes", "postings", "stacked")], F.max("most_operands").alias("most_operands"))


@add(_FORMED + f"SELECT CAST(postings + stacked AS VARCHAR) AS bucket, count(*) AS n FROM w JOIN {_FORM_OPS} USING (form) WHERE op <> 'NOT' GROUP BY 1")
def operand_histogram(spark, sf_dir):
    s = _shape_rows(spark, sf_dir).filter("op in ('AND', 'OR')")
    return s.groupBy(quality.operand_bucket(((F.col("postings") + F.col("stacked")) / F.col("nodes")).cast("long")).alias("bucket")).agg(F.sum("nodes").alias("n"))


@add(WITH + "SELECT qid, terms, present, terms - present AS missing, CASE WHEN present < terms THEN 'missing_postings_match_converter_absence_or_index_subset' ELSE 'no_missing_postings' END AS diagnosis FROM (SELECT qid, count(*) AS terms, count(*) FILTER (EXISTS (SELECT 1 FROM e WHERE e.tag = w.tag)) AS present FROM (SELECT DISTINCT CAST(qid AS BIGINT) AS qid, CAST(tag AS BIGINT) AS tag FROM (VALUES (1,3),(2,3),(2,12),(3,3),(3,25),(3,41),(4,3),(5,1),(5,2),(5,13),(5,44),(6,999),(7,3),(8,100),(8,25),(8,11),(9,101),(9,100)) AS v(qid, tag)) w GROUP BY qid)")
def filter_diagnosis(spark, sf_dir):
    out = quality.diagnose(quality.term_rows(spark, dict(enumerate(FILTERS))), entries(spark, sf_dir), frequencies(spark, sf_dir))
    return out.select(*ids("qid", "terms", "present", "missing"), "diagnosis")


@add(WITH + ", w AS (SELECT CAST(qid AS BIGINT) AS qid, CAST(tag AS BIGINT) AS tag FROM (VALUES (3,3),(3,25),(3,41),(5,1),(5,2),(5,13),(5,44),(6,999),(8,100),(8,25),(8,11)) AS v(qid, tag)) SELECT qid, g.segment_id, count(*) AS operands, count(*) - count(p.tag) AS empty FROM w CROSS JOIN (SELECT DISTINCT segment_id FROM d) g LEFT JOIN p ON p.tag = w.tag AND p.segment_id = g.segment_id GROUP BY qid, g.segment_id")
def empty_operands(spark, sf_dir):
    terms = quality.term_rows(spark, dict(enumerate(FILTERS))).filter(F.col("qid").isin(3, 5, 6, 8))
    segments = docs(spark, sf_dir).select("segment_id").distinct()
    held = postings(spark, sf_dir).select("tag", "segment_id", F.lit(1).alias("_here"))
    pairs = segments.join(F.broadcast(terms), F.lit(True)).join(held, ["tag", "segment_id"], "left")
    return pairs.groupBy("qid", "segment_id").agg(F.count(F.lit(1)).alias("operands"), (F.count(F.lit(1)) - F.count("_here")).alias("empty"))


@add(WITH + "SELECT w.qid, count(*) AS postings, count(*) FILTER (layout = 'packed') AS converted, CAST(coalesce(sum(unit_count) FILTER (layout = 'packed'), 0) AS BIGINT) AS units FROM (SELECT DISTINCT CAST(qid AS BIGINT) AS qid, CAST(tag AS BIGINT) AS tag FROM (VALUES (1,3),(2,3),(2,12),(3,3),(3,25),(3,41),(4,3),(5,1),(5,2),(5,13),(5,44),(6,999),(7,3),(8,100),(8,25),(8,11),(9,101),(9,100)) AS v(qid, tag)) w JOIN p ON p.tag = w.tag GROUP BY w.qid")
def bitlist_stats(spark, sf_dir):
    return quality.conversions(quality.term_rows(spark, dict(enumerate(FILTERS))), postings(spark, sf_dir))


@add(WITH + "SELECT qid, doc_id FROM r16 WHERE rk <= k")
def truth_cache(spark, sf_dir):
    """The truth written under its fingerprint, and read instead of computed the second time."""
    d, q, folder = docs(spark, sf_dir), queries(spark, sf_dir), _scratch(spark, "truth")
    key = quality.fingerprint(d.agg(F.count(F.lit(1)).alias("docs"), F.lit(True).alias("f16"))).collect()[0]["fingerprint"]
    quality.cached_truth(d, q, folder, key)
    return quality.cached_truth(d.limit(0), q, folder, key)


@add("SELECT doc_range, dim, sha256('{\"doc_range\":' || doc_range || ',\"dim\":' || dim || '}') AS fingerprint FROM (SELECT vec_id AS doc_range, CAST(len(embedding) AS BIGINT) AS dim FROM embeddings)")
def recall_fingerprint(spark, sf_dir):
    return quality.fingerprint(_read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_range"), F.size("embedding").cast("long").alias("dim")))


@add(WITH + ", n AS (SELECT count(*) AS n FROM d) SELECT qid, count(m.doc_id) AS matches, round(count(m.doc_id) / min(n), 6) AS share FROM q LEFT JOIN m USING (qid) CROSS JOIN n GROUP BY qid")
def filter_selectivity(spark, sf_dir):
    d, q = docs(spark, sf_dir), queries(spark, sf_dir)
    n = d.count()
    counts = search.match(d, q).groupBy("qid").agg(F.count(F.lit(1)).alias("matches"))
    got = q.select("qid").join(counts, "qid", "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
    return got.select("qid", "matches", F.round(F.col("matches") / n, 6).alias("share"))


@add(WITH + ", n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM d), g AS (SELECT max(doc_freq) FILTER (tag = 3) / n AS a3, max(doc_freq) FILTER (tag = 12) / n AS a12, max(doc_freq) FILTER (tag = 25) / n AS a25, max(doc_freq) FILTER (tag = 41) / n AS a41, max(doc_freq) FILTER (tag = 1) / n AS a1, max(doc_freq) FILTER (tag = 2) / n AS a2, max(doc_freq) FILTER (tag = 13) / n AS a13, max(doc_freq) FILTER (tag = 44) / n AS a44, max(doc_freq) FILTER (tag = 100) / n AS a100, max(doc_freq) FILTER (tag = 11) / n AS a11, max(doc_freq) FILTER (tag = 101) / n AS a101 FROM f, n GROUP BY n) SELECT CAST(fid AS BIGINT) AS fid, round(p, 6) AS estimate FROM g, LATERAL (VALUES (0, 1E0), (1, a3), (2, a3 * a12), (3, 1 - (1 - a3) * (1 - a25) * (1 - a41)), (4, 1 - a3), (5, (1 - (1 - a1) * (1 - a2)) * (1 - a13) * (1 - a44)), (6, 0E0), (7, a3 * (1 - a3)), (8, 1 - (1 - a100) * (1 - a25 * a11)), (9, a101 * a100)) AS v(fid, p)")
def filter_selectivity_est(spark, sf_dir):
    n = docs(spark, sf_dir).count()
    used = {t for text in FILTERS for t in filters.terms(filters.parse(text))}
    share = {r["tag"]: r["doc_freq"] / n for r in frequencies(spark, sf_dir).filter(F.col("tag").isin(*used)).collect()}  # the filters' tags only
    return spark.createDataFrame([(k, round(filters.selectivity(filters.parse(t), share), 6)) for k, t in enumerate(FILTERS)], "fid long, estimate double")


@add(f"SELECT count(*) AS refs, count(tag_id) AS resolved, round(count(tag_id) / count(*), 6) AS rate FROM ({_RESOLVED})")
def tag_resolution(spark, sf_dir):
    return tag_resolve(spark, sf_dir).agg(F.count(F.lit(1)).alias("refs"), F.count("tag_id").alias("resolved"), F.round(F.count("tag_id") / F.count(F.lit(1)), 6).alias("rate"))


_BY_FILTER = "(SELECT vec_id AS qid, vec_id // 20 % 10 AS fid FROM embeddings WHERE vec_id % 20 = 0)"


@add(f"WITH x AS (SELECT estimate FROM {_BY_FILTER} q JOIN ({ORACLES['filter_selectivity_est']}) USING (fid)), o AS (SELECT *, row_number() OVER (ORDER BY estimate) - 1 AS at_, count(*) OVER () AS n_ FROM x) SELECT count(*) AS queries, round(avg(estimate), 6) AS mean, max(estimate) AS high, count(*) FILTER (estimate >= 0.9) AS over_90, {_percentile_sql('estimate', 0.5)} AS p50, {_percentile_sql('estimate', 0.9)} AS p90 FROM o")
def filter_selectivity_dist(spark, sf_dir):
    est = filter_selectivity_est(spark, sf_dir)  # a row for each of the ten filters
    x = queries(spark, sf_dir).select(fid().alias("fid")).join(F.broadcast(est), "fid").select("estimate")
    basic = x.agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg("estimate"), 6).alias("mean"), F.max("estimate").alias("high"), F.count(F.when(F.col("estimate") >= 0.9, 1)).alias("over_90"))
    return basic.crossJoin(stats.order_percentiles(x, "estimate", {"p50": 0.5, "p90": 0.9}))


@add(WITH + f", t AS ({ORACLES['filter_terms']}), x AS (SELECT t.tag, coalesce(f.doc_freq, 0) AS n, (SELECT count(*) FROM d) AS docs FROM q JOIN t ON t.qid = q.fid LEFT JOIN f ON f.tag = t.tag) SELECT count(*) AS refs, count(*) FILTER (n > 0) AS resolved, round(count(*) FILTER (n > 0) / count(*), 6) AS rate, count(DISTINCT tag) AS tags, count(*) FILTER (n / docs >= 0.05) AS common, round(count(*) FILTER (n / docs >= 0.05) / count(*), 6) AS common_rate FROM x")
def tag_reference_freq(spark, sf_dir):
    terms = quality.term_rows(spark, dict(enumerate(FILTERS))).withColumnRenamed("qid", "fid")
    asked = queries(spark, sf_dir).select(fid().alias("fid")).join(F.broadcast(terms), "fid")  # the tags of the ten filters
    s = stats.reference_frequencies(asked, frequencies(spark, sf_dir), docs(spark, sf_dir).count())
    return s.select("refs", "resolved", F.round("rate", 6).alias("rate"), "tags", "common", F.round("common_rate", 6).alias("common_rate"))


_AST = ["MATCH_ALL", "TAG(3)", "(TAG(3) AND TAG(12))", "(TAG(3) OR TAG(25) OR TAG(41))", "NOT(TAG(3))", "((TAG(1) OR TAG(2)) AND NOT((TAG(13) OR TAG(44))))", "TAG(999)", "(TAG(3) AND NOT(TAG(3)))", "(TAG(100) OR (TAG(25) AND TAG(11)))", "(TAG(101) AND TAG(100))"]
_STEPS = ["MATCH_ALL", "{3}", "{3} {12} AND(2,0)", "{3,25,41}", "{3} NOT(1,0)", "{13,44} NOT(1,0) {1,2} AND(1,1)", "{999}", "{3} NOT(1,0) {3} AND(1,1)", "{25} {11} AND(2,0) {100} OR(1,1)", "{101} {100} AND(2,0)"]


@add(WITH + f", t AS (SELECT DISTINCT qid AS fid, tag FROM ({ORACLES['filter_terms']})), c AS (SELECT fid, count(*) AS terms, count(*) FILTER (EXISTS (SELECT 1 FROM e WHERE e.tag = t.tag)) AS present FROM t GROUP BY fid) SELECT q.qid, v.ast, v.postorder, coalesce(terms, 0) AS terms, coalesce(present, 0) AS present, coalesce(terms - present, 0) AS missing, CASE WHEN present < terms THEN 'missing_postings_match_converter_absence_or_index_subset' ELSE 'no_missing_postings' END AS diagnosis FROM q LEFT JOIN c USING (fid) JOIN (VALUES " + ", ".join(f"({k}, '{a}', '{p}')" for k, (a, p) in enumerate(zip(_AST, _STEPS, strict=True))) + ") AS v(fid, ast, postorder) USING (fid)")
def filter_report(spark, sf_dir):
    out = quality.report(queries(spark, sf_dir), entries(spark, sf_dir), frequencies(spark, sf_dir))
    return out.select(*ids("qid"), "ast", "postorder", *ids("terms", "present", "missing"), "diagnosis")


@add("WITH t AS (SELECT DISTINCT CASE doc_id % 3 WHEN 0 THEN source ELSE source || '#' || lang END AS term, doc_id % 40 AS tag_id FROM documents) SELECT 'malformed_term' AS problem, count(*) FILTER (NOT contains(term, '#')) AS n FROM t UNION ALL SELECT 'repeated_id', count(*) - count(DISTINCT tag_id) FROM t")
def dictionary_problems(spark, sf_dir):
    i = F.col("doc_id")
    term = F.when(i % 3 == 0, F.col("source")).otherwise(F.concat("source", F.lit("#"), "lang"))
    return stats.dictionary_problems(_read(spark, sf_dir, "documents").select(term.alias("term"), (i % 40).alias("tag_id")).distinct())


@add(_STORED + "SELECT section, refs FROM (SELECT 'label' AS section, count(*) AS refs FROM r UNION ALL SELECT 'week', 2 * count(*) FILTER (i % 40 <> 0) FROM r) WHERE refs > 0")
def top_sections(spark, sf_dir):
    """The ten sections that the stored records refer to most."""
    from .sources import text

    s = text.tree_counters(_stored_records(spark, sf_dir)).filter("counter = 'sections'")
    return s.groupBy(F.col("name").alias("section")).agg(F.sum("n").alias("refs")).orderBy(F.col("refs").desc(), "section").limit(10)


_EVENT_P = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


@add("WITH o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS at_, count(*) OVER (PARTITION BY event_type) AS n_ FROM events WHERE value IS NOT NULL) SELECT event_type, count(*) AS n, round(avg(value), 6) AS avg_ms, round(max(value), 6) AS max_ms, " + ", ".join(f"round({_percentile_sql('value', p)}, 6) AS {k}" for k, p in _EVENT_P.items()) + ", round(1000 / avg(value), 6) AS qps FROM o GROUP BY event_type")
def latency_summary(spark, sf_dir):
    s = stats.latency_summary(_read(spark, sf_dir, "events"), "value", ["event_type"])
    return s.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("avg_ms", "max_ms", "p50", "p95", "p99", "qps")])


def _shard_rows(spark, sf_dir) -> DataFrame:
    e = _read(spark, sf_dir, "events").filter("value is not null")
    i = F.col("event_id")
    shard = F.array(F.col("value"), F.col("value") * (0.5 + (i % 7) / 10.0), F.col("value") * (0.6 + (i % 5) / 10.0))
    merge = 0.1 + (i % 3) / 10.0
    return e.select(i.alias("idx"), shard.alias("shard_ms"), merge.alias("merge_ms"), (F.array_max(shard) + merge + 0.05).alias("total_ms"))


_SHARD = "WITH g AS (SELECT event_id AS idx, [value, value * (0.5E0 + (event_id % 7) / 10.0E0), value * (0.6E0 + (event_id % 5) / 10.0E0)] AS sh, 0.1E0 + (event_id % 3) / 10.0E0 AS merge FROM events WHERE value IS NOT NULL), w AS (SELECT *, list_max(sh) AS worst, list_max(sh) + merge + 0.05E0 AS total FROM g) "


@add(_SHARD + "SELECT count(*) AS n, round(avg(worst), 5) AS max_shard, round(avg(merge), 5) AS merge, round(avg(total - worst), 5) AS overhead, round(avg(worst - list_sum(sh) / 3), 5) AS tax, round(avg(worst - list_min(sh)), 5) AS spread FROM w")
def shard_latency_decomp(spark, sf_dir):
    s = stats.shard_decomposition(_shard_rows(spark, sf_dir))
    return s.select("n", *[F.round(c, 5).alias(c) for c in ("max_shard", "merge", "overhead", "tax", "spread")])


@add(_SHARD + ", x AS (SELECT i - 1 AS shard, sh[i] AS ms FROM g, range(1, 4) t(i)), o AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY ms) - 1 AS at_, count(*) OVER (PARTITION BY shard) AS n_ FROM x) SELECT shard, round(avg(ms), 5) AS mean, round(max(ms), 5) AS high, " + ", ".join(f"round({_percentile_sql('ms', p)}, 5) AS {k}" for k, p in {"p50": 0.5, "p99": 0.99}.items()) + " FROM o GROUP BY shard")
def shard_percentiles(spark, sf_dir):
    s = stats.shard_percentiles(_shard_rows(spark, sf_dir))
    return s.select(*ids("shard"), *[F.round(c, 5).alias(c) for c in ("mean", "high", "p50", "p99")])


@add(WITH + ", n AS (SELECT count(*) AS n FROM d) SELECT band, count(*) AS tags, round(avg(share), 6) AS mean_share FROM (SELECT doc_freq / n AS share, CASE WHEN doc_freq / n >= 0.999 THEN 'always' WHEN doc_freq / n >= 0.9 THEN 'universal' WHEN doc_freq / n >= 0.05 THEN 'common' WHEN doc_freq / n >= 0.01 THEN 'low' ELSE 'rare' END AS band FROM f, n WHERE doc_freq > 0) GROUP BY band")
def profile_constants(spark, sf_dir):
    return stats.profile_bands(frequencies(spark, sf_dir), docs(spark, sf_dir).count()).withColumn("mean_share", F.round("mean_share", 6))


@add(_SHARD + "SELECT CAST(list_position(sh, worst) - 1 AS BIGINT) AS shard, round(count(*) / (SELECT count(*) FROM w), 6) AS share FROM w GROUP BY 1")
def straggler_share(spark, sf_dir):
    return stats.straggler_share(_shard_rows(spark, sf_dir)).select(*ids("shard"), F.round("share", 6).alias("share"))


@add(_SHARD + ", o AS (SELECT *, row_number() OVER (ORDER BY total) - 1 AS at_, count(*) OVER () AS n_, row_number() OVER (ORDER BY total DESC, idx) AS rk FROM w), b AS (SELECT max(CASE WHEN at_ = least(n_ - 1, CAST(floor(0.9E0 * n_) AS BIGINT)) THEN total END) AS bar FROM o), s AS (SELECT len(list_filter(sh, lambda x: x >= bar)) AS slow, bar FROM o, b WHERE rk <= greatest(1, n_ // 100)) SELECT count(*) AS tail, count(*) FILTER (slow >= 2) AS several, count(*) FILTER (slow < 2) AS one, round(max(bar), 6) AS bar_ms FROM s")
def slow_tail(spark, sf_dir):
    return stats.slow_tail(_shard_rows(spark, sf_dir)).withColumn("bar_ms", F.round("bar_ms", 6))


@add("WITH o AS (SELECT event_type AS arm, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS at_, count(*) OVER (PARTITION BY event_type) AS n_ FROM events WHERE value IS NOT NULL), m AS (SELECT arm, max(CASE WHEN at_ = least(n_ - 1, CAST(floor(0.5E0 * n_) AS BIGINT)) THEN value END) AS median, max(value) - min(value) AS width FROM o GROUP BY arm) SELECT arm, round(median, 6) AS median, round(median / (SELECT median FROM m WHERE arm = 'click') - 1, 6) AS change, round(width / median, 6) AS spread FROM m")
def ab_compare(spark, sf_dir):
    s = stats.ab_compare(_read(spark, sf_dir, "events").filter("value is not null"), "event_type", "value", "click")
    return s.select("arm", *[F.round(c, 6).alias(c) for c in ("median", "change", "spread")])


@add(_SHARD + "SELECT idx, round(sh[1], 3) AS shard0_ms, round(sh[2], 3) AS shard1_ms, round(sh[3], 3) AS shard2_ms, round(worst, 3) AS max_shard_ms, round(merge, 3) AS merge_ms, round(total, 3) AS total_ms FROM w")
def shard_latency_file(spark, sf_dir):
    from .sources import text

    path = _scratch(spark, "shards")
    text.write_shard_latencies(_shard_rows(spark, sf_dir), path, 3)
    rows = spark.read.csv(path, sep="\t", header=True, schema="idx long, shard0_ms double, shard1_ms double, shard2_ms double, max_shard_ms double, merge_ms double, total_ms double")
    return rows.select("idx", *[F.round(c, 3).alias(c) for c in rows.columns[1:]])


# --- index tuning ---

_CURVE = WITH + f", h AS (SELECT hit_count AS hits, count(*) AS n FROM p GROUP BY 1), c AS (SELECT hits, CAST(sum(n) OVER (ORDER BY hits) AS BIGINT) AS compressed, sum(n * ({SEGMENT / 8}E0 - (8 + 4 * hits))) OVER (ORDER BY hits) AS saved FROM h), z AS (SELECT c.*, (SELECT count(*) FROM p) * {SEGMENT / 8}E0 - saved AS bytes FROM c) "


@add(_CURVE + f"SELECT hits, round(hits / {SEGMENT}, 6) AS threshold, compressed, round(saved, 6) AS saved, round(bytes, 6) AS bytes FROM z")
def threshold_size_curve(spark, sf_dir):
    c = stats.threshold_curve(postings(spark, sf_dir), SEGMENT)
    return c.select("hits", F.round("threshold", 6).alias("threshold"), "compressed", F.round("saved", 6).alias("saved"), F.round("bytes", 6).alias("bytes"))


@add(_CURVE + "SELECT hits, round(saved / (bytes + saved), 6) AS reduction FROM z WHERE saved / (bytes + saved) BETWEEN -0.5 AND 0.05")
def threshold_pick(spark, sf_dir):
    c = stats.pick_threshold(stats.threshold_curve(postings(spark, sf_dir), SEGMENT), -0.5, 0.05)
    return c.select("hits", F.round("reduction", 6).alias("reduction"))


@add(WITH + f", h9 AS (SELECT least(15, length(bin(unit_count))) AS bucket, count(*) AS n FROM p GROUP BY 1), b9 AS (SELECT *, 2E0 ** (bucket - 1) AS lo, 2E0 ** bucket AS hi, least(2E0 ** bucket, 5.5E0) AS stop FROM h9), s9 AS (SELECT *, n * CASE WHEN lo >= 5.5E0 THEN 0E0 ELSE (stop - lo) / (hi - lo) END AS part FROM b9) SELECT round(sum(part), 6) AS sparse, round(sum(n - part) * {SEGMENT / 8}E0 + sum(part * (8 + 4 * (lo + stop - 1) / 2)), 6) AS bytes FROM s9")
def threshold_interp(spark, sf_dir):
    s = stats.interpolated_size(stats.unit_histogram(postings(spark, sf_dir)), 5.5, SEGMENT)
    return s.select(F.round("sparse", 6).alias("sparse"), F.round("bytes", 6).alias("bytes"))


# --- batches and arrivals ---


@add(WITH + "SELECT batch, batch % 3 AS worker, count(*) AS queries FROM (SELECT qid // 160 AS batch FROM q) GROUP BY batch")
def batch_schedule(spark, sf_dir):
    b = ingest.static_assignment(ingest.query_batches(queries(spark, sf_dir), 8 * EVERY), 3)
    return b.groupBy("batch", "worker").agg(F.count(F.lit(1)).alias("queries"))


def _service(spark, sf_dir):
    e = _read(spark, sf_dir, "events").filter("value is not null")
    return corpus.numbered(e.select(F.col("event_type").alias("lane"), "event_id", F.col("value").alias("service_ms")), "event_id", ["lane"]).drop("event_id")


@add("WITH v AS (SELECT event_type AS lane, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i, value FROM events WHERE value IS NOT NULL), s AS (SELECT *, i * 1000.0E0 / 12 AS arrival, sum(value) OVER (PARTITION BY lane ORDER BY i) AS run FROM v), t AS (SELECT *, run + max(arrival - (run - value)) OVER (PARTITION BY lane ORDER BY i) AS done FROM s) SELECT lane, count(*) AS n, round(avg(done - arrival), 3) AS mean_latency, round(max(done - arrival), 3) AS max_latency FROM t GROUP BY lane")
def open_loop_latency(spark, sf_dir):
    r = ingest.open_loop_sql(_service(spark, sf_dir), 12.0, width=512)
    return r.groupBy("lane").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("latency_ms"), 3).alias("mean_latency"), F.round(F.max("latency_ms"), 3).alias("max_latency"))


@add()
def synthetic_corpus(spark, sf_dir):
    return synthetic.corpus(spark, 2000, 16, 200, 12).select("doc_id", F.size("tags").alias("n_tags"), vectors.norm(F.col("vec")).alias("norm"))


@add()
def synthetic_banded(spark, sf_dir):
    return stats.tag_frequencies(corpus.posting_docs(synthetic.banded_corpus(spark, 2000, 8)), 1000)


@add()
def synthetic_queries(spark, sf_dir):
    freq = stats.tag_frequencies(corpus.posting_docs(synthetic.banded_corpus(spark, 2000, 8)), 1000)
    return synthetic.queries(spark, 20, 8, freq, 2000).select("qid", "filter", "k")


@add()
def synthetic_grouped_queries(spark, sf_dir):
    return synthetic.grouped_queries(spark, 20, 8, 1000).select("qid", "filter", "k")


@add()
def synthetic_section_queries(spark, sf_dir):
    sections = {"a": (0, 200), "b": (200, 200), "c": (400, 50), "d": (450, 10), "e": (460, 1)}
    return synthetic.section_queries(spark, 20, 8, sections, ["a", "c"], ["d", "e"], {"a": "b"}).select("qid", "filter", "k")
