"""Binary formats: vector datasets, query vectors, builder records, tag dictionaries.

Files are found and read by Spark (``binaryFile`` for the small ones), so any store
that Spark reads will do; a dataset is read in ranges of documents, each range by
one task through the Hadoop or local file system.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship

# Fixed values of the dataset format: magic, header layout and size.
MAGIC = b"HYDSET2\0"
HEADER = "<8sIIQIIII"
HEADER_BYTES = 40
#: Headered query files have at most this many components.
MOST_DIM = 4096
MOST_TERMS = 10_000_000
DATASET_SCHEMA = "doc_id long, vec array<float>, tag_words array<long>, tags array<long>"


class FormatError(ValueError):
    """A file that doesn't have its format."""


def read_header(raw: bytes) -> tuple[int, int, int]:
    """``(documents, dim, tag_num)``."""
    if len(raw) < HEADER_BYTES:
        raise FormatError("file too small for its header")
    magic, _, _, docs, dim, tags, _, _ = struct.unpack_from(HEADER, raw)
    if magic != MAGIC:
        raise FormatError("bad magic")
    return docs, dim, tags


def encode_dataset(vectors: np.ndarray, tags: Iterable[Iterable[int]], tag_num: int) -> bytes:
    vectors = np.ascontiguousarray(vectors, "<f4")
    stride = -(-tag_num // 64)
    words = np.zeros((len(vectors), stride), "<u8")
    for d, some in enumerate(tags):
        for t in some:
            words[d, t >> 6] |= np.uint64(1) << np.uint64(t & 63)
    head = struct.pack(HEADER, MAGIC, 1, 0, len(vectors), vectors.shape[1] if vectors.ndim == 2 else 0, tag_num, 0, 0)
    return head + vectors.tobytes() + words.tobytes()


def _tags_of(words: np.ndarray) -> list[list[int]]:
    bits = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little")
    return [np.flatnonzero(r).tolist() for r in bits]


def _part(uri: str, at: int, n: int) -> bytes:
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(uri)
    with store.open_input_file(place) as f:
        f.seek(at)
        return f.read(n)


def _slice(uri: str, header: tuple[int, int, int], lo: int, hi: int, first: int = 0) -> pd.DataFrame:
    """The documents from ``lo`` up to ``hi`` of a dataset file, whose first document has the id ``first``."""
    docs, dim, tag_num = header
    n, stride = hi - lo, -(-tag_num // 64)
    raw = _part(uri, HEADER_BYTES + lo * dim * 4, n * dim * 4)
    bits = _part(uri, HEADER_BYTES + docs * dim * 4 + lo * stride * 8, n * stride * 8)
    if len(raw) < n * dim * 4 or len(bits) < n * stride * 8:
        raise FormatError("file ends within its documents")
    words = np.frombuffer(bits, "<u8").reshape(n, stride)
    return pd.DataFrame({"doc_id": np.arange(first + lo, first + hi), "vec": list(np.frombuffer(raw, "<f4").reshape(n, dim)), "tag_words": list(words.view("<i8")), "tags": _tags_of(words)})


def read_dataset(spark: SparkSession, path: str, chunk: int = 65536, offset: int = 0, count: int = 0) -> DataFrame:
    """The documents of a dataset file from ``offset`` on (``count`` of them; 0: all that follow).

    Each task reads ``chunk`` documents' slices of the vector and the bitmap region.
    An offset behind the end raises an error; a larger count is cut.
    """
    uri = path if "://" in path else f"file://{path}"
    try:
        docs, dim, tag_num = read_header(_part(uri, 0, HEADER_BYTES))
    except (FileNotFoundError, OSError) as e:
        raise FormatError(f"cannot open {path}") from e
    if offset and offset >= docs:
        raise FormatError(f"offset {offset} is not below {docs} documents")
    end = docs if not count else min(docs, offset + count)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for k in f["id"]:
                lo = offset + int(k) * chunk
                yield _slice(uri, (docs, dim, tag_num), lo, min(end, lo + chunk))

    ship(spark)
    parts = max(0, -(-(end - offset) // chunk))
    return spark.range(0, parts, 1, max(1, parts)).mapInPandas(read, DATASET_SCHEMA)


def write_datasets(docs: DataFrame, folder: str, tag_num: int, docs_per_file: int = 65536) -> int:
    """Dataset files of consecutive documents below ``folder``, each named by its first id; the number of files.

    ``docs``: ``doc_id`` (from 0 on without gaps), ``vec``, ``tags``.  A file is one
    task's work, which ``docs_per_file`` bounds; a repeated task writes the same file.
    Documents that aren't consecutive raise an error.
    """

    def write(frame: pd.DataFrame) -> pd.DataFrame:
        ids = frame["doc_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        first = int(ids[0]) // docs_per_file * docs_per_file
        if not np.array_equal(ids[order], np.arange(first, first + len(ids))):
            raise FormatError(f"the documents from {first} on aren't consecutive")
        raw = encode_dataset(np.stack(frame["vec"].to_numpy()[order]), frame["tags"].to_numpy()[order], tag_num)
        _write(f"{folder}/docs-{first:020d}.hyd", [raw])
        return pd.DataFrame({"docs": [len(ids)]})

    ship(docs.sparkSession)
    rows = docs.select("doc_id", F.col("vec").cast("array<float>").alias("vec"), F.coalesce(F.col("tags").cast("array<long>"), F.array().cast("array<long>")).alias("tags"))
    return rows.groupBy(F.floor(F.col("doc_id") / docs_per_file)).applyInPandas(write, "docs long").count()


def read_datasets(spark: SparkSession, folder: str, chunk: int = 65536) -> DataFrame:
    """The documents of all dataset files that :func:`write_datasets` left below ``folder``; a task reads whole files, ``chunk`` documents at a time."""

    def read(frames):
        for f in frames:
            for path in f["path"]:
                uri = _uri(path)
                header, first = read_header(_part(uri, 0, HEADER_BYTES)), int(path.rsplit("-", 1)[1].removesuffix(".hyd"))
                for lo in range(0, header[0], chunk):
                    yield _slice(uri, header, lo, min(header[0], lo + chunk), first)

    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "docs-*.hyd").load(folder).select("path")
    return files.mapInPandas(read, DATASET_SCHEMA)


def _uri(path: str) -> str:
    """Spark writes local paths with one slash."""
    return path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path


def _write(uri: str, pieces: Iterable[bytes]) -> None:
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(uri)
    store.create_dir(place.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(place) as out:
        for piece in pieces:
            out.write(piece)


def _write_file(rows: DataFrame, uri: str, encode: Callable[[Iterator[tuple]], Iterable[bytes]]) -> None:
    """One file by one task, which streams the rows in their partition's order: query and dictionary files, not a corpus."""

    def run(frames):
        _write(uri, encode(r for f in frames for r in f.itertuples(index=False, name=None)))
        yield pd.DataFrame({"done": [1]})

    ship(rows.sparkSession)
    rows.mapInPandas(run, "done int").collect()


def write_fvecs(queries: DataFrame, uri: str) -> None:
    """``vec`` by ``qid`` as one query file, with the dimension before every vector."""
    rows = queries.select("qid", F.col("vec").cast("array<float>").alias("vec")).repartition(1).sortWithinPartitions("qid")
    _write_file(rows, uri, lambda pairs: (encode_fvecs([v], False) for _, v in pairs))


def write_tag_map(terms: DataFrame, uri: str) -> None:
    """``term``, ``tag_id`` as one dictionary file, by term; ValueError beyond its most terms."""
    n = terms.count()
    if not 0 < n <= MOST_TERMS:
        raise ValueError(f"{n} terms")
    rows = terms.select("term", F.col("tag_id").cast("int").alias("tag_id")).repartition(1).sortWithinPartitions("term")

    def encode(pairs):
        yield struct.pack("<Q", n)
        for term, tag in pairs:
            yield encode_tag_map({term: tag})[8:]

    _write_file(rows, uri, encode)


def write_records(rows: DataFrame, folder: str, most: int = 1 << 26) -> None:
    """``id``, ``payload`` (binary) as record files below ``folder``, of about ``most`` bytes at most or one record.

    A null payload is an empty one.  Rows are dealt by id and payload and sorted, so a
    repeated task writes the same files.
    """

    def run(frames):
        from pyspark import TaskContext

        part, held, size, files = TaskContext.get().partitionId(), [], 0, 0
        for f in frames:
            for key, payload in zip(f["id"], f["payload"], strict=True):
                payload = payload or b""
                if held and size + len(payload) > most:
                    _write(f"{folder}/part-{part:06d}-{files:06d}.rec", [encode_records(held)])
                    held, size, files = [], 0, files + 1
                held.append((int(key), bytes(payload)))
                size += 12 + len(payload)
        if held:
            _write(f"{folder}/part-{part:06d}-{files:06d}.rec", [encode_records(held)])
        yield pd.DataFrame({"files": [files + bool(held)]})

    ship(rows.sparkSession)
    dealt = rows.select(F.col("id").cast("long").alias("id"), "payload").withColumn("_d", F.xxhash64("payload")).repartition("id", "_d").sortWithinPartitions("id", "_d").drop("_d")
    dealt.mapInPandas(run, "files int").collect()


def decode_fvecs(raw: bytes) -> list[np.ndarray]:
    """Headered (``rows, dim``, then all numbers) if the size fits exactly, else ``dim`` before every vector.

    A short or senseless tail ends the second form without an error.
    """
    if len(raw) < 8:
        raise FormatError("file too small")
    rows, dim = struct.unpack_from("<ii", raw)
    if rows > 0 and 0 < dim <= MOST_DIM and len(raw) == 8 + rows * dim * 4:
        return list(np.frombuffer(raw, "<f4", offset=8).reshape(rows, dim))
    out, at = [], 0
    while at + 4 <= len(raw):
        (dim,) = struct.unpack_from("<i", raw, at)
        if not 0 < dim <= MOST_DIM or at + 4 + 4 * dim > len(raw):
            break
        out.append(np.frombuffer(raw, "<f4", dim, at + 4))
        at += 4 + 4 * dim
    return out


def encode_fvecs(vectors: list[list[float]], headered: bool = True) -> bytes:
    data = [np.asarray(v, "<f4") for v in vectors]
    if headered:
        return struct.pack("<ii", len(data), len(data[0]) if data else 0) + b"".join(v.tobytes() for v in data)
    return b"".join(struct.pack("<i", len(v)) + v.tobytes() for v in data)


def decode_records(raw: bytes) -> list[tuple[int, bytes]]:
    """``[u32 n]`` and n records ``[u32 length][u64 id][payload]``; the length counts id and payload."""
    if len(raw) < 4:
        raise FormatError("file too small")
    (n,), at, out = struct.unpack_from("<I", raw), 4, []
    for _ in range(n):
        if at + 12 > len(raw):
            raise FormatError("truncated record")
        length, key = struct.unpack_from("<IQ", raw, at)
        if length < 8 or at + 4 + length > len(raw):
            raise FormatError("truncated record")
        out.append((key, raw[at + 12 : at + 4 + length]))
        at += 4 + length
    return out


def encode_records(records: list[tuple[int, bytes]]) -> bytes:
    return struct.pack("<I", len(records)) + b"".join(struct.pack("<IQ", 8 + len(p), key) + p for key, p in records)


def decode_tag_map(raw: bytes) -> dict[str, int]:
    """``[count]`` and entries ``[u32 length][utf-8][i32 id]``; the count has 8 or else 4 bytes."""
    for size, kind in ((8, "<Q"), (4, "<I")):
        try:
            (n,), at, out = struct.unpack_from(kind, raw), size, {}
            if not 0 < n <= MOST_TERMS:
                continue
            for _ in range(n):
                (length,) = struct.unpack_from("<I", raw, at)
                if not length or at + 8 + length > len(raw):
                    raise FormatError("invalid entry")
                out[raw[at + 4 : at + 4 + length].decode()] = struct.unpack_from("<i", raw, at + 4 + length)[0]
                at += 8 + length
            if at == len(raw):
                return out
        except (struct.error, UnicodeDecodeError, FormatError):
            continue
    raise FormatError("not a tag dictionary")


def encode_tag_map(tags: dict[str, int]) -> bytes:
    return struct.pack("<Q", len(tags)) + b"".join(struct.pack("<I", len(t.encode())) + t.encode() + struct.pack("<i", i) for t, i in tags.items())


def _files(spark: SparkSession, path: str, decode, schema: str) -> DataFrame:
    def read(frames):
        for f in frames:
            for raw in f["content"]:
                rows = list(decode(raw))
                if rows:
                    yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    ship(spark)
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(read, schema)


def read_fvecs(spark: SparkSession, path: str) -> DataFrame:
    """``qid`` (place in the file), ``vec``."""
    return _files(spark, path, lambda raw: enumerate(v.tolist() for v in decode_fvecs(raw)), "qid long, vec array<float>")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return _files(spark, path, decode_records, "id long, payload binary")


def read_tag_map(spark: SparkSession, path: str) -> DataFrame:
    """``term``, ``tag_id``, ``section`` (the term up to its first #)."""
    return _files(spark, path, lambda raw: decode_tag_map(raw).items(), "term string, tag_id int").withColumn("section", F.split_part("term", F.lit("#"), F.lit(1)))
