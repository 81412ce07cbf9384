"""MinHash near-duplicate detection with sequential Bayesian verification (operator 9).

1. One pass over the texts makes each document's MinHash signature, band keys,
   shingle count and a digest of its whole shingle set.  Documents with equal sets
   are one class, with the smallest id as representative.
2. Representatives that share a band meet in its bucket.  Their signatures are
   compared in batches; after each batch a pair is dropped if the posterior
   probability that its similarity reaches the threshold is too small.  A bucket
   hands on only a spanning forest of its surviving pairs.
3. The forests' components are the clusters in which links can lie.  Inside each
   cluster pairs of whole shingle sets are compared exactly.
4. The components of the exact links are the result.

A bucket or cluster of more than a block is first compared with its centre, the
member with the smallest id, in parts.  What is linked with the centre is settled
among itself, so only the others are then compared with all members, as pairs of
blocks.  No pair is left out, no task holds more than two blocks, and the work is
quadratic only in members that differ from the centre.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache, reduce
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .components import connected_components
from .skew import attach

WORDS = 5
#: Representatives to a block of a bucket; shingles and representatives to a block of a cluster.
BUCKET_BLOCK = 256
CLUSTER_BLOCK = 1_000_000
CLUSTER_DOCS = 256
#: Members to a part that is compared with the centre; they pass by one Arrow batch at a time.
STAR_PART = 2048
BATCH = 24
#: Words longer than this are hashed each time instead of being kept.
LONG_WORD = 64
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_BLANK = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_MIX = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F]


def plan(percent: int, miss: float) -> tuple[int, int]:
    """Rows to a band and bands: the longest bands of at most 8 rows for which ``bands * rows`` stays within 168 hashes and a pair at the threshold shares no band with probability ``miss`` at most."""
    s = percent / 100
    for rows in range(8, 0, -1):
        bands = int(np.ceil(np.log(miss) / np.log(1 - s**rows)))
        if bands * rows <= 168:
            return rows, bands
    return 1, 168


def words_of(text: str | None) -> list[str]:
    """A-Z lower-cased words between space, tab, LF, VT, FF and CR; none for null."""
    if not text:
        return []
    text = text.lower() if text.isascii() else text.translate(_UPPER)
    return _WORD.findall(text) if _BLANK.search(text) else text.split()


_HASHED: dict[str, int] = {}


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct 64-bit fingerprints of the text's shingles; with fewer words the whole sequence is one."""
    import xxhash

    found = words_of(text)
    if not found:
        return np.zeros(0, np.uint64)
    if len(_HASHED) > 200_000:
        _HASHED.clear()
    get, digest = _HASHED.get, xxhash.xxh3_64_intdigest
    h = []
    for w in found:
        x = get(w)
        if x is None:
            x = digest(w.encode("utf-8", "surrogatepass"))
            if len(w) <= LONG_WORD:
                _HASHED[w] = x
        h.append(x)
    h = np.array(h, np.uint64)
    size = min(words, len(h))
    out = np.full(len(h) - size + 1, len(h) if len(h) < words else words, np.uint64)
    for k in range(size):
        x = (h[k : len(h) - size + 1 + k] ^ out) * np.uint64(_MIX[k % len(_MIX)])
        out = x ^ (x >> np.uint64(29))
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(out ^ (out >> np.uint64(32)))


@lru_cache(4)
def _hashes(count: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240229)
    return (r.integers(0, 2**31, count, dtype=np.uint64) * 2 + 1).astype(np.uint32), r.integers(0, 2**32, count, dtype=np.uint64).astype(np.uint32)


def signature(sh: np.ndarray, count: int) -> np.ndarray:
    """The minima of ``count`` hash functions (permutations of 32 bits) over a set that isn't empty."""
    a, b = _hashes(count)
    x = (sh >> np.uint64(32)).astype(np.uint32)
    out = np.full(count, 2**32 - 1, np.uint32)
    for at in range(0, len(x), 512):  # blocks that stay in the processor's cache
        out = np.minimum(out, (x[at : at + 512, None] * a + b).min(axis=0))
    return out


@lru_cache(8)
def least_matches(percent: int, miss: float, count: int, batch: int = BATCH) -> tuple[tuple[int, int], ...]:
    """``(compared, least)`` after each batch: with fewer matches than ``least`` the pair is dropped.

    The posterior of the similarity given m of n matches is Beta(m + 1, n - m + 1)
    under a uniform prior; it reaches the threshold s with probability
    P(Binomial(n + 1, s) <= m).  Each of the batches has an equal part of ``miss``: the
    posterior must reach that, and dropping a pair whose similarity is s must be no
    likelier, so all batches together lose such a pair with probability ``miss`` at most.
    """
    s, out = percent / 100, []
    steps = [*range(batch, count, batch), count]
    most = miss / len(steps)
    for n in steps:
        posterior, lost, m = 0.0, 0.0, 0
        while m <= n:
            posterior += comb(n + 1, m) * s**m * (1 - s) ** (n + 1 - m)
            lost += comb(n, m) * s**m * (1 - s) ** (n - m)
            if posterior >= most or lost > most:
                break
            m += 1
        out.append((n, m))
    return tuple(out)


def survivors(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int, miss: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs ``(i, j)`` of rows of two signature matrices those that are never dropped."""
    hits, at = np.zeros(len(i), np.int32), 0
    for n, least in least_matches(percent, miss, left.shape[1]):
        hits += (left[i, at:n] == right[j, at:n]).sum(1, dtype=np.int32)
        keep = hits >= least
        i, j, hits, at = i[keep], j[keep], hits[keep], n
        if not len(i):
            break
    return i, j


def forest(size: int, rows) -> list[tuple[int, int]]:
    """A spanning forest of the edges from x to each of js, for ``(x, js)`` in ``rows``."""
    label, out, left = np.arange(size), [], size - 1
    for x, js in rows:
        labels, first = np.unique(label[js], return_index=True)
        new = labels != label[x]
        if new.any():
            out += [(x, int(y)) for y in js[first[new]]]
            label[np.isin(label, labels[new])] = label[x]
            left -= int(new.sum())
            if not left:
                break
    return out


def _grouped(frames, keys: list[str]):
    """The runs of equal keys of frames sorted by them, also across frames."""
    rest = None
    for f in frames:
        if rest is not None:
            f = pd.concat([rest, f], ignore_index=True)
        if not len(f):
            continue
        k = f[keys].to_numpy()
        cuts = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
        last = cuts[-1] if len(cuts) else 0
        yield f, np.r_[0, cuts].astype(int) if len(cuts) else np.zeros(0, int)
        rest = f.iloc[last:].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest, np.array([0, len(rest)])


def signatures(docs: DataFrame, percent: int, miss: float, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id``, ``_k`` (any number that spreads rows), ``n_shingles``, ``_set`` (digest of the shingle set), ``_sig``, ``_bands`` for every row; the last three are null for empty sets."""
    rows, bands = plan(percent, miss)
    count = rows * bands

    def make(frames):
        import xxhash

        for f in frames:
            out = []
            for k, (key, text) in enumerate(zip(f.column("_id").to_pylist(), f.column("_text").to_pylist(), strict=True)):
                sh = shingles(text, words)
                if not len(sh):
                    out.append((key, k, 0, None, None, None))
                    continue
                sig = signature(sh, count)
                keys = [xxhash.xxh3_64_intdigest(sig[b * rows : (b + 1) * rows].tobytes(), seed=b) - 2**63 for b in range(bands)]
                out.append((key, k, len(sh), hashlib.blake2b(sh.tobytes(), digest_size=16).digest(), sig.tobytes(), keys))
            if out:  # Arrow arrays: pandas would round ids beside nulls
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    names = ["_id", "_k", "n_shingles", "_set", "_sig", "_bands"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
    return docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).mapInArrow(make, "_id long, _k int, n_shingles long, _set binary, _sig binary, _bands array<long>")


def large_links(members: DataFrame, data: DataFrame, groups: int, star, cross) -> list[DataFrame]:
    """Links (``a``, ``b``) in groups of more than a block: with the centre, then of the others with all.

    ``members``: ``_key``, ``_id``, ``_centre`` (an id of the group), ``_n`` (members of
    the group), ``_blocks``; ``groups``: all members' number.  ``data``: ``_id``, ``_data``.
    ``star(centre, datas)`` tells which of ``datas`` are linked with the centre;
    ``cross(left ids, left datas, right ids, right datas)`` gives a spanning forest of
    the links of two blocks.  Texts and signatures only travel once the ids are dealt.
    """
    one = F.col("_id") == F.col("_centre")
    parts = F.ceil(F.col("_n") / STAR_PART).cast("int")
    leaves = members.filter(~one).withColumns({"_part": F.pmod(F.xxhash64("_id"), parts).cast("int"), "_side": F.lit(1)})
    centres = members.filter(one).withColumns({"_part": F.explode(F.sequence(F.lit(0), parts - 1)), "_side": F.lit(0)})
    dealt = leaves.unionByName(centres).join(data, "_id").repartition("_key", "_part").sortWithinPartitions("_key", "_part", "_side", "_id")

    def around(frames):
        held, centre = None, None
        for f in frames:
            keys, sides, ids = f["_key"].to_numpy(np.int64), f["_side"].to_numpy(), f["_id"].to_numpy(np.int64)
            for lo, hi in _runs(keys, f["_part"].to_numpy()):
                if sides[lo] == 0:
                    held, centre = (keys[lo], int(ids[lo])), f["_data"].iloc[lo]
                    lo += 1
                assert held[0] == keys[hi - 1]
                if lo < hi:
                    linked = star(centre, f["_data"].iloc[lo:hi])
                    yield pd.DataFrame({"_key": keys[lo:hi], "_id": ids[lo:hi], "_centre": held[1], "_n": f["_n"].to_numpy(np.int64)[lo:hi], "_blocks": f["_blocks"].to_numpy()[lo:hi], "linked": linked})

    seen = scratch.stash(dealt.mapInPandas(around, "_key long, _id long, _centre long, _n long, _blocks int, linked boolean"), "star")
    links = [seen.filter("linked").select(F.col("_centre").alias("a"), F.col("_id").alias("b"))]
    rest = seen.filter("not linked").select("_key", "_id", "_n", "_blocks")
    # as many rest blocks as the others fill, in blocks of the group's own size
    others = rest.groupBy("_key").agg(F.count(F.lit(1)).alias("_r"), F.max("_n").alias("_all"), F.max("_blocks").alias("_b"))
    others = scratch.stash(others.withColumn("_rb", F.ceil(F.col("_r") * F.col("_b") / F.col("_all")).cast("int")), "others")
    if others.isEmpty():
        return links
    every = attach(members.select("_key", "_id"), others, ["_key"], "_all", groups, F.col("_id")).filter("_r is not null")
    left = attach(rest.select("_key", "_id"), others, ["_key"], "_r", groups, F.col("_id"))
    left = left.select("_key", "_id", F.pmod(F.xxhash64("_id", F.lit(1)), F.col("_rb")).cast("int").alias("_x"), F.explode(F.sequence(F.lit(0), F.col("_b") - 1)).alias("_y"), F.lit(0).alias("_side"))
    right = every.select("_key", "_id", F.explode(F.sequence(F.lit(0), F.col("_rb") - 1)).alias("_x"), F.pmod(F.xxhash64("_id", F.lit(2)), F.col("_b")).cast("int").alias("_y"), F.lit(1).alias("_side"))
    met = left.unionByName(right).join(data, "_id").repartition("_key", "_x", "_y").sortWithinPartitions("_key", "_x", "_y", "_side", "_id")

    def blocks(frames):
        for f, cuts in _grouped(frames, ["_key", "_x", "_y"]):
            found, ids, side = [], f["_id"].to_numpy(np.int64), f["_side"].to_numpy()
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                mid = lo + int((side[lo:hi] == 0).sum())
                if lo < mid < hi:
                    found += cross(ids[lo:mid], f["_data"].iloc[lo:mid], ids[mid:hi], f["_data"].iloc[mid:hi])
            if found:
                yield pd.DataFrame(found, columns=["a", "b"])

    return [*links, met.mapInPandas(blocks, "a long, b long")]


def _runs(*keys: np.ndarray):
    """Bounds of the runs of equal keys."""
    cuts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
    return zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys[0])], strict=True) if len(keys[0]) else ()


def candidate_edges(reps: DataFrame, percent: int, miss: float, block: int = BUCKET_BLOCK) -> DataFrame:
    """Edges ``a``, ``b`` of spanning forests of the surviving pairs of every bucket."""
    rows, bands = plan(percent, miss)
    count = rows * bands
    banded = reps.select("_id", F.explode("_bands").alias("_key"))
    buckets = scratch.stash(banded.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_centre")).filter("_n > 1"), "buckets")
    banded_rows = reps.count() * bands
    members = attach(banded, buckets, ["_key"], "_n", banded_rows, F.col("_id")).filter("_n is not null")
    data = reps.select("_id", F.col("_sig").alias("_data"))

    def matrix(datas) -> np.ndarray:
        return np.frombuffer(b"".join(datas), np.uint32).reshape(len(datas), count)

    def verify(frames):
        for f, cuts in _grouped(frames, ["_key"]):
            if not len(cuts):
                continue
            ids, sig, sizes = f["_id"].to_numpy(np.int64), matrix(f["_data"]), np.diff(cuts)
            two = cuts[:-1][sizes == 2]  # most buckets: all at once
            x, y = survivors(sig, sig, two, two + 1, percent, miss)
            found = list(zip(ids[x].tolist(), ids[y].tolist(), strict=True))
            for lo, hi in zip(cuts[:-1][sizes > 2], cuts[1:][sizes > 2], strict=True):
                own = sig[lo:hi]
                found += [(int(ids[lo + x]), int(ids[lo + y])) for x, y in forest(hi - lo, _survivors_by_row(own, own, percent, miss, own=True))]
            if found:
                found = sorted({(min(p), max(p)) for p in found})
                yield pd.DataFrame(found, columns=["a", "b"])

    def star(centre, datas):
        own, linked = matrix([centre]), np.zeros(len(datas), bool)
        _, j = survivors(own, matrix(datas), np.zeros(len(datas), int), np.arange(len(datas)), percent, miss)
        linked[j] = True
        return linked

    def cross(left_ids, left, right_ids, right):
        n, a, b = len(left_ids), matrix(left), matrix(right)
        ids = np.r_[left_ids, right_ids]
        rows = ((x, n + js) for x, js in _survivors_by_row(a, b, percent, miss))
        return [(int(ids[x]), int(ids[y])) for x, y in forest(len(ids), rows) if ids[x] != ids[y]]

    small = members.filter(F.col("_n") <= block).select("_key", "_id").join(data, "_id").repartition("_key").sortWithinPartitions("_key", "_id")
    out = small.mapInPandas(verify, "a long, b long")
    if not buckets.filter(F.col("_n") > block).isEmpty():
        large = scratch.stash(members.filter(F.col("_n") > block).withColumn("_blocks", F.ceil(F.col("_n") / block).cast("int")), "large")
        out = reduce(DataFrame.unionByName, [out, *large_links(large, data, banded_rows, star, cross)])
    return out


def _survivors_by_row(left: np.ndarray, right: np.ndarray, percent: int, miss: float, own: bool = False):
    """``(x, js)`` for the rows of ``left``; with ``own`` (both are one matrix) only js above x."""
    for at in range(0, len(left), 64):
        i, j = np.divmod(np.arange(min(64, len(left) - at) * len(right)), len(right))
        i += at
        if own:
            i, j = i[j > i], j[j > i]
        i, j = survivors(left, right, i, j, percent, miss)
        for lo, hi in _runs(i):
            yield int(i[lo]), j[lo:hi]


def exact_links(ids: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs (one of each side) with 100 * common >= percent * union."""
    sizes = np.array([len(s) for s in sets], np.int64)
    values, code = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    often = np.bincount(code, minlength=len(values))
    # whatever shares most of its shingles comes first: it tends to link with all others
    centre = np.add.reduceat(often[code], starts) / sizes
    other, mark = np.zeros(len(sets), bool), np.zeros(len(values), bool)
    other[right] = True

    def rows():
        for i in left[np.argsort(-centre[left], kind="stable")].tolist():
            mine = code[starts[i] : ends[i]]
            mark[mine] = True
            common = np.add.reduceat(mark[code], starts, dtype=np.int64)
            mark[mine] = False
            linked = other & (100 * common >= percent * (sizes[i] + sizes - common))
            linked[i] = False
            yield i, np.flatnonzero(linked)

    return [(int(ids[i]), int(ids[j])) for i, j in forest(len(sets), rows()) if ids[i] != ids[j]]


def confirmed_links(docs: DataFrame, clusters: DataFrame, sizes: DataFrame, percent: int, words: int, id_col: str, text_col: str) -> DataFrame:
    """The exact links inside clusters (``node``, ``component``), up to those that connect nothing more."""
    sized = clusters.join(sizes, F.col("node") == F.col("_id")).groupBy("component").agg(F.sum("n_shingles").alias("_s"), F.count(F.lit(1)).alias("_n"))
    blocks = F.ceil(F.greatest(F.col("_s") / CLUSTER_BLOCK, F.col("_n") / CLUSTER_DOCS)).cast("int")
    sized = scratch.stash(sized.select(F.col("component").alias("_key"), "_n", blocks.alias("_blocks")), "sizes")
    total = clusters.count()
    nodes = clusters.select(F.col("component").alias("_key"), F.col("node").alias("_id"))
    members = attach(nodes, sized, ["_key"], "_n", total, F.col("_id")).withColumn("_centre", F.col("_key"))
    # the texts of clusters, few of all, travel once here and are read as often as needed
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_data"))
    data = scratch.stash(texts.join(clusters.select(F.col("node").alias("_id")), "_id", "left_semi"), "texts")

    def alone(frames):
        for f, cuts in _grouped(frames, ["_key"]):
            found, ids = [], f["_id"].to_numpy(np.int64)
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                sets = [shingles(t, words) for t in f["_data"].iloc[lo:hi]]
                full = np.array([k for k, s in enumerate(sets) if len(s)], int)
                if len(full) > 1:
                    every = np.arange(len(full))
                    found += exact_links(ids[lo:hi][full], [sets[k] for k in full], every, every, percent)
            if found:
                yield pd.DataFrame(found, columns=["a", "b"])

    def star(centre, datas):
        own, out = shingles(centre, words), np.zeros(len(datas), bool)
        for k, text in enumerate(datas):
            sh = shingles(text, words)
            common = np.intersect1d(own, sh, assume_unique=True).size
            out[k] = common > 0 and 100 * common >= percent * (len(own) + len(sh) - common)
        return out

    def cross(left_ids, left, right_ids, right):
        ids, sets = np.r_[left_ids, right_ids], [shingles(t, words) for t in [*left, *right]]
        full = np.array([k for k, s in enumerate(sets) if len(s)], int)
        a, b = np.flatnonzero(full < len(left_ids)), np.flatnonzero(full >= len(left_ids))
        return exact_links(ids[full], [sets[k] for k in full], a, b, percent) if len(a) and len(b) else []

    small = members.filter("_blocks = 1").select("_key", "_id").join(data, "_id").repartition("_key").sortWithinPartitions("_key", "_id")
    out = small.mapInPandas(alone, "a long, b long")
    if not sized.filter("_blocks > 1").isEmpty():
        large = scratch.stash(members.filter("_blocks > 1"), "large")
        out = reduce(DataFrame.unionByName, [out, *large_links(large, data, total, star, cross)])
    return out.filter("a <> b")


def near_dedup(docs: DataFrame, percent: int = 85, words: int = WORDS, miss: float = 2e-5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, ``n_shingles``, ``component_id``, ``kept``.

    Documents are linked if their sets of word shingles have a similarity of
    ``percent`` hundredths or more; ``component_id`` is the smallest id reachable over
    links.  Links are confirmed on whole sets; a pair at the threshold shares no band
    with probability ``miss`` at most, and is pruned with probability ``miss`` at most.

    Null and empty texts, and texts of blanks, have no shingles and are linked with
    nothing.  Rows without an id are linked with nothing and have a null component;
    rows that share an id count as linked.  ``kept`` is true where the id is its
    component's, and for rows without an id.  Very long texts are compared whole.  An
    empty table gives an empty result.  Other columns are ignored, whatever their names.
    """
    made = scratch.stash(signatures(docs, percent, miss, words, id_col, text_col), "signatures")
    full = made.filter(F.col("_set").isNotNull() & F.col("_id").isNotNull())
    classes = scratch.stash(made.filter(F.col("_set").isNotNull()).groupBy("_set").agg(F.min("_id").alias("_rep"), F.count(F.lit(1)).alias("_n")), "classes")
    # one row for each class, also where an id repeats with different texts
    reps = full.join(classes, (full["_set"] == classes["_set"]) & (full["_id"] == classes["_rep"])).select("_id", "n_shingles", "_sig", "_bands", full["_set"].alias("_set")).dropDuplicates(["_id", "_set"])
    reps = scratch.stash(reps, "representatives")
    edges = scratch.stash(candidate_edges(reps, percent, miss).distinct(), "candidates")
    clusters = scratch.stash(connected_components(edges), "clusters")
    links = confirmed_links(docs, clusters, reps.select("_id", "n_shingles"), percent, words, id_col, text_col)

    rows = attach(made.select("_id", "_k", "n_shingles", "_set"), classes, ["_set"], "_n", made.count(), F.struct("_id", "_k"))
    rows = scratch.stash(rows.drop("_set", "_n"), "rows")
    # an id with several texts is a node of several classes
    pairs = rows.filter("_id is not null and _rep is not null").select("_id", "_rep").distinct()
    several = pairs.groupBy("_id").agg(F.min("_rep").alias("a"), F.max("_rep").alias("b")).filter("a <> b").select("_id", "a")
    again = pairs.join(several, "_id").select("a", F.col("_rep").alias("b")).filter("a <> b")
    links = scratch.stash(links.union(again).distinct(), "links")
    found = scratch.stash(connected_components(links), "components")

    # how many rows a representative stands for, so that hot classes are split here too
    stood = classes.groupBy("_rep").agg(F.sum("_n").alias("_m")).filter("_rep is not null")
    labelled = stood.join(found, F.col("_rep") == F.col("node")).select("_rep", "component", "_m")
    rows = attach(rows, labelled, ["_rep"], "_m", made.count(), F.struct("_id", "_k"))
    component = F.when(F.col("_id").isNotNull(), F.coalesce("component", "_rep", "_id"))
    return rows.select(F.col("_id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with, of each group of near duplicates, the rows of its smallest id: see :func:`near_dedup`.

    Rows without words and rows without an id are in no group and stay; rows that share
    an id are in one group, and those of its smallest id all stay.  An empty table stays
    empty.  Columns may have any names.
    """
    rows, names = scratch.positional(docs)
    found = near_dedup(rows, id_col=names[id_col], text_col=names[text_col], **options)
    kept = found.filter(F.col("kept") & F.col(names[id_col]).isNotNull()).select(F.col(names[id_col]).alias("_id"))
    # rows without an id would all meet in one task of the join
    both = rows.join(kept, F.col(names[id_col]) == F.col("_id"), "left_semi").unionByName(rows.filter(F.col(names[id_col]).isNull()))
    return both.select(*[F.col(n).alias(c) for c, n in names.items()])


ORACLE = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS shingle
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM t UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reached),
c AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n ON n.doc_id = c.doc_id
"""
