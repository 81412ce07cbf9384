"""Packing documents into sequences (operator 7).

Pieces are dealt into groups of bounded size.  In a group pieces start in bins by next
fit, the longest first, and local search does the packing: documents of the least filled bin
are moved to other underfull bins, or exchanged one for one or two for one, as long as
the squared fill grows, until bins are empty or no step is left.  What the groups leave
underfull is packed again together.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import scratch, tokens

CAPACITY = 4096
END_ID = 1
#: Pieces to a group at most, about; a group is packed by one task.
GROUP = 16_384
#: Of a group's bins the least filled so many are packed again with those of other groups.
LOOSE = 4
#: Levels of groups at most; each has about ``LOOSE`` bins of a group of the one before.
LEVELS = 16


def _with(schema: StructType, **more: str) -> StructType:
    out = StructType(list(schema.fields))
    for name, kind in more.items():
        out.add(name, kind)
    return out


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = tokens.DEFAULT, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of every row: the id, ``piece``, ``start``, ``length``, ``ids_crc32``.

    A document is its ids followed by ``end_id``; only longer ones than the
    capacity are cut.  Null and empty texts are the end id alone.
    """
    schema = _with(docs.select(id_col).schema, piece="integer", start="long", length="long", ids_crc32="long")
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches):
        encode = tokens.encoder(tokenizer).ids
        for b in batches:
            at, rows = [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                ids = encode(text) + end
                for k, start in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[start : start + 4 * capacity]
                    at.append(i)
                    rows.append((k, start // 4, len(part) // 4, zlib.crc32(part)))
            of = zip(*rows, strict=True) if rows else [[]] * 4
            made = [pa.array(x, kind) for x, kind in zip(of, (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *made], names=schema.names)

    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(cut, schema)


def next_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The start: pieces in their order, each into the last bin or a new one; full pieces get bins of their own."""
    bins, at, room, count = [], -1, 0, 0
    for n in lengths.tolist():
        if n == capacity:
            bins.append(count)
            count += 1
            continue
        if n > room:
            at, room, count = count, capacity, count + 1
        bins.append(at)
        room -= n
    return np.array(bins, np.int64)


def _reach(own: list[int], capacity: int, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """For every size the largest that one document, and that one or two documents, of a bin (their lengths) have up to it (0: none)."""
    lengths = sorted(set(own))
    # a bin has few different lengths (n of them sum up to n * (n + 1) / 2 at least), so all pairs are tried
    sums = {a + b for k, a in enumerate(lengths) for b in lengths[k + 1 :]}
    if len(lengths) < len(own):
        sums.update(2 * a for a, times in Counter(own).items() if times > 1)

    def steps(sizes: list[int]) -> np.ndarray:
        at = np.array([0, *sizes, capacity + 1], kind)
        return np.repeat(at[:-1], np.diff(at))

    return steps(lengths), steps(sorted({x for x in sums if x <= capacity}.union(lengths)))


def _taken(own: list[int], lengths: list[int], total: int) -> list[int]:
    """One piece, else two pieces, of ``own`` with that total length."""
    at: dict[int, int] = {}
    for i in own:
        n = lengths[i]
        if n == total:
            return [i]
        at.setdefault(n, i)
    for i in own:
        j = at.get(total - lengths[i])
        if j is not None and j != i:
            return [j, i]
    raise AssertionError("no such pieces")


def local_search(lengths: np.ndarray, bins: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Empty underfull bins; the new bin of each piece, and the number of steps.

    The least filled bin is emptied first.  A step moves one of its documents to
    another underfull bin, or exchanges one or two of them for a shorter one there;
    of all such steps that fit, over all documents of all underfull bins, the one that
    raises the sum of squared fills most is made.  Each step raises that sum, so the
    search ends; it ends early once as few bins are left as the total needs.
    """
    lengths, where = lengths.astype(np.int64), bins.astype(np.int64).copy()
    if not len(where):
        return where, 0
    size_of = lengths.tolist()
    fill = np.bincount(where, lengths).astype(np.int64)
    room = capacity - fill
    least, used, steps = -(-int(lengths.sum()) // capacity), int((fill > 0).sum()), 0
    own: dict[int, list[int]] = {}
    for i in np.flatnonzero(room[where] > 0).tolist():
        own.setdefault(int(where[i]), []).append(i)
    kind = np.int32 if capacity < 1 << 15 else np.int64  # a gain is below 2 * capacity ** 2
    # of full bins nothing can change: they leave these two lists when those are made anew
    items, targets = np.array([i for b in own.values() for i in b], np.int64), np.array(list(own), np.int64)
    slot = np.empty(len(where), np.int64)

    def listed() -> tuple[np.ndarray, np.ndarray]:
        """Of every item its length, and the room that its bin would have without it."""
        slot[items] = np.arange(len(items))
        back = lengths[items]
        return back.astype(kind), (room[where[items]] + back).astype(kind)

    back, without = listed()
    todo = [(int(fill[b]), b) for b in own]
    heapq.heapify(todo)
    stale = changed = 0
    while used > least:
        if not todo:  # a step may have opened others: go on until a whole pass finds none
            if not changed:
                break
            todo, changed = [(int(fill[b]), b) for b in own if 0 < fill[b] < capacity], 0
            heapq.heapify(todo)
            continue
        size, src = heapq.heappop(todo)
        if not 0 < fill[src] < capacity:
            continue
        if size != fill[src]:
            heapq.heappush(todo, (int(fill[src]), src))
            continue
        mine = own[src]
        without[slot[mine]] = lengths[mine]  # the bin itself is no target
        while mine:
            if stale > 256:
                items, targets, stale = items[room[where[items]] > 0], targets[(room[targets] > 0) & (fill[targets] > 0)], 0
                back, without = listed()
                without[slot[mine]] = lengths[mine]
            one, two = _reach([size_of[i] for i in mine], capacity, kind)
            left, room[src] = room[src], 0
            free = room[targets].astype(kind)
            room[src] = left
            spare = kind(room[src])  # what a bin of this fill has left
            moved = one[free]
            gain = moved * (moved - free + spare)
            best, b = -1, -1
            if len(gain) and gain.max() > 0:
                b = int(gain.argmax())
                best = int(gain[b])
            out = two[without]
            gain = np.maximum(out - back, 0)
            gain *= out - without + spare
            j = int(gain.argmax()) if len(gain) else -1
            if j >= 0 and gain[j] > max(best, 0):
                piece, total = int(items[j]), int(out[j])
                dst, gone, come = int(where[piece]), _taken(mine, size_of, total), [piece]
            elif best > 0:
                dst, total = int(targets[b]), int(moved[b])
                gone, come = _taken(mine, size_of, total), []
            else:
                break
            theirs = own[dst]
            for i in gone:
                mine.remove(i)
                theirs.append(i)
                where[i] = dst
            for i in come:
                theirs.remove(i)
                mine.append(i)
                where[i] = src
            d = total - sum(size_of[i] for i in come)
            fill[src] -= d
            fill[dst] += d
            room[src] += d
            room[dst] -= d
            without[slot[come]] = lengths[come]
            without[slot[theirs]] = lengths[theirs] + room[dst]
            stale += room[dst] == 0
            steps += 1
            changed = 1
        without[slot[mine]] = lengths[mine] + room[src]
        if not mine:
            used -= 1
            room[src] = 0
            stale += 1
    return where, steps


def pack_table(t: pa.Table, capacity: int) -> pa.Table:
    """Columns ``_bin`` (from 0), ``offset`` and ``_loose`` (whether the bin is one of the least filled) added to rows with ``length``."""
    t = t.sort_by([("length", "descending"), *[(c, "ascending") for c in t.column_names if c != "length"]])
    n = t.column("length").to_numpy().astype(np.int64)
    bins, _ = local_search(n, next_fit(n, capacity), capacity)
    bins = np.unique(bins, return_inverse=True)[1].astype(np.int64) if len(bins) else bins
    order = np.argsort(bins, kind="stable")
    ends = np.cumsum(n[order])
    starts = ends - n[order]
    first = np.r_[True, np.diff(bins[order]) > 0] if len(bins) else np.zeros(0, bool)
    base = np.maximum.accumulate(np.where(first, starts, 0)) if len(bins) else starts
    offset = np.empty(len(n), np.int64)
    offset[order] = starts - base
    room = capacity - np.bincount(bins, n).astype(np.int64) if len(bins) else bins
    loosest = np.argsort(-room, kind="stable")[: min(LOOSE, len(room) // 2)]  # so that every level has fewer pieces
    loosest = loosest[room[loosest] > 0]
    for name, x in (("_bin", bins), ("offset", offset), ("_loose", np.isin(bins, loosest))):
        t = t.append_column(name, pa.array(x))
    return t


def pack(parts: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """The rows of ``parts`` (with ``length`` from 1 up to the capacity) with ``sequence_id`` and ``offset``.

    Rows keep their other columns; equal rows are packed as often as they occur, and
    are dealt by their place in the table, not by value.  The pieces of each group's
    ``LOOSE`` least filled bins (half of its bins at most) are packed again together, in
    groups as before, until one group holds what is left.  An empty table gives an empty result.
    """
    names = parts.columns
    schema = _with(parts.schema, _bin="long", offset="long", _loose="boolean", _g="integer")

    def pack_groups(batches):  # sorted by group
        held = []

        def packed_group():
            t = pa.Table.from_batches(held)
            g = t.column("_g")
            return pack_table(t.drop_columns("_g"), capacity).append_column("_g", g).to_batches()  # one value

        for b in batches:
            g = b.column(b.num_columns - 1).to_numpy(zero_copy_only=False)
            ends = [*(np.flatnonzero(np.diff(g)) + 1).tolist(), b.num_rows]
            for lo, hi in zip([0, *ends], ends):
                if lo == hi:
                    continue
                if held and held[-1].column(b.num_columns - 1)[0].as_py() != g[lo]:
                    yield from packed_group()
                    held = []
                held.append(b.slice(lo, hi - lo))
        if held:
            yield from packed_group()

    done, rest, level = [], scratch.stash(parts, "parts"), 0
    while True:
        groups = max(1, -(-rest.count() // group))
        # the table is written, so a row's place stays the same if a task runs again
        dealt = rest.withColumn("_g", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("int"))
        # the rows are slim but the search isn't: as many groups to each task, which neither sizes nor hashes would give
        tasks = min(groups, 4 * scratch.partitions(parts.sparkSession))
        packed = dealt.repartitionById(tasks, F.col("_g") % tasks).sortWithinPartitions("_g").mapInArrow(pack_groups, schema)
        # unique over bins, groups and levels
        number = ((F.col("_bin") * groups + F.col("_g")) * LEVELS + level).alias("sequence_id")
        if groups == 1 or level == LEVELS - 1:
            return reduce(DataFrame.unionByName, [*done, packed.select(*names, number, "offset")])
        packed = scratch.stash(packed, "packed")
        done.append(packed.filter("not _loose").select(*names, number, "offset"))
        rest, level = scratch.stash(packed.filter("_loose").select(*names), "loose"), level + 1


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = tokens.DEFAULT, end_id: int = END_ID, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's pieces with their places in sequences.

    Columns: the id, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``,
    ``offset``.  Null and empty texts are one piece, the end id alone; very long texts
    are cut; rows that repeat are packed each; an empty table gives an empty result;
    ids may be null; other columns are ignored, whatever their names.
    """
    return pack(pieces(docs, capacity, tokenizer, end_id, id_col, text_col), capacity, group)
