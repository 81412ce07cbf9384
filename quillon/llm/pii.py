"""Information-theoretic sanitisation of personal data (operator 5).

Patterns find the protected entities (e-mail and IP addresses, card and phone
numbers).  Then the corpus tells which other terms disclose them: a term that
occurs with an entity, and in hardly any other text, lets a reader infer the
entity although it is masked.  Its disclosure is the pointwise mutual information
with the entity, smoothed where they meet in few different texts; terms that give
away at least ``share`` of the entity's information content are generalised, those
that give away at least ``remove`` of it are removed.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch
from .skew import attach

KINDS = ["email", "ip", "card", "phone", "generalise", "remove"]
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# runs of digits are taken whole: a match can't begin within one, and this keeps long runs linear
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: A term is this many letters or more.
TERM = r"\p{L}{3,}"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` of the patterns' matches, by kind, then start, in code points."""
    out: list[tuple[int, int, int]] = []
    if not text:
        return out
    at, free = text.find("@"), 0
    while at >= 0:
        # a match's local part is the whole run before the @, back to the match before
        s = at
        while s > free and text[s - 1] in _LOCAL:
            s -= 1
        m = _DOMAIN.match(text, at + 1) if s < at else None
        if m:
            out.append((0, s, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    if _DIGIT.search(text):
        out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def entity(kind: int, value: str) -> str:
    """One spelling of an entity's value: numbers by their digits, e-mail addresses in lower case."""
    return f"{KINDS[kind]}:" + (value.lower() if kind == 0 else value if kind == 1 else re.sub("[^0-9]", "", value))


def terms_of(text: Column) -> Column:
    """The different terms of a text, in lower case: what :func:`masked_terms` yields for a text without spans."""
    # put into lower case together, with blanks between them, on which no letter's case depends
    found = F.lower(F.array_join(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), " "))
    return F.array_remove(F.array_distinct(F.split(found, " ")), "")


def masked_terms(text: str, spans: list[tuple[int, int, int]]):
    """``(term, start, end)`` of the terms outside the spans."""
    import regex

    cover, last = [], -1
    for s, e in sorted((s, e) for _, s, e in spans):
        if e > last:
            cover.append((max(s, last), e))
            last = e
    k = 0
    for m in regex.finditer(TERM, text):
        while k < len(cover) and cover[k][1] <= m.start():
            k += 1
        if k == len(cover) or cover[k][0] >= m.end():
            yield m[0].lower(), m.start(), m.end()


def sanitised(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with entities replaced by their kind, disclosing terms generalised or removed."""
    out, at = [], 0
    for s, e, k in sorted((s, e, k) for k, s, e in spans):
        if s < at:  # overlaps one that was replaced already
            at = max(at, e)
            continue
        out += [text[at:s], "" if KINDS[k] == "remove" else "[TERM]" if KINDS[k] == "generalise" else f"[{KINDS[k].upper()}]"]
        at = e
    return "".join([*out, text[at:]])


def disclosing_terms(holders: DataFrame, docs: DataFrame, rows: int, share: float, remove: float, support: int, text_col: str) -> DataFrame:
    """``_h``, ``_flags`` (array of term, action) for the texts in which terms exceed the thresholds.

    ``holders``: one row for each different text with entities, with ``_m`` (rows with
    that text), ``_entities`` and ``_terms``.
    """
    own = holders.select("_h", "_m", F.explode("_entities").alias("e"))
    # two 64-bit sums of 128-bit digests tell the texts of an entity
    texts = F.struct(F.bit_xor(F.xxhash64("_h")).alias("x"), F.bit_xor(F.xxhash64("_h", F.lit(1))).alias("y"))
    entities = scratch.stash(own.groupBy("e").agg(texts.alias("c"), F.sum("_m").alias("ne"), F.count(F.lit(1)).alias("_n")), "entities")
    # entities of the same texts rate every term alike, so one stands for all: a list of addresses isn't paired with all its terms for each
    classes = entities.groupBy("c").agg(F.min("e").alias("e"), F.first("ne").alias("ne"), F.first("_n").alias("_n"))
    mentions = entities.agg(F.sum("_n")).collect()[0][0] or 0
    own = attach(own, classes, ["e"], "_n", mentions, F.col("_h")).filter("_n is not null").select("_h", "_m", "c", "ne")
    # a text's classes with its terms: as many rows as the statistic has, summed before they are shuffled
    pairs = own.join(holders.select("_h", F.explode("_terms").alias("t")), "_h")
    joint = pairs.groupBy("c", "t").agg(F.count(F.lit(1)).alias("texts"), F.sum("_m").alias("nj"), F.first("ne").alias("ne"))
    joint = scratch.stash(joint, "joint")
    # in how many rows a term occurs: counted over the whole corpus, summed before the shuffle
    words = docs.select(F.explode(terms_of(F.col(text_col))).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("nt"))
    # an inner join stays above the count, with the few rated terms on its other side; a semi join would be pushed below it and shuffle every word
    words = joint.select("t").distinct().join(words, "t")
    # a term that only one of the two character tables takes for letters counts as often as it meets the entity
    known = joint.join(words, "t", "left")
    nt = F.greatest(F.coalesce("nt", "nj"), "nj")
    content = F.log2(F.lit(float(rows)) / F.col("ne"))
    # each text short of the support counts as one with the term in which the entity is as likely as anywhere
    short = F.greatest(F.lit(support) - F.col("texts"), F.lit(0)) * F.col("nj") / F.col("texts")
    information = F.log2((F.col("nj") * F.lit(float(rows)) + short * F.col("ne")) / ((nt + short) * F.col("ne")))
    rated = known.withColumn("r", F.when(content > 0, information / content)).filter(F.col("r") >= share)
    flags = rated.select("c", "t", "texts", F.when(F.col("r") >= remove, KINDS.index("remove")).otherwise(KINDS.index("generalise")).alias("k"))
    flags = scratch.stash(flags, "rated")
    total = joint.agg(F.sum("texts")).collect()[0][0] or 0
    flagged = attach(pairs.select("_h", "_m", "c", "t"), flags, ["c", "t"], "texts", total, F.col("_h")).filter("k is not null")
    return flagged.groupBy("_h", "t").agg(F.max("k").alias("k"), F.first("_m").alias("_m")).groupBy("_h").agg(F.collect_list(F.struct("t", "k")).alias("_flags"), F.first("_m").alias("_m"))


def sanitise(docs: DataFrame, share: float = 0.8, remove: float = 0.97, support: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its spans and sanitised text.

    Columns: the id, ``n_email``, ``n_ip``, ``n_card``, ``n_phone``, ``base_sha256``
    (of the patterns' spans), ``spans`` (all spans), ``n_terms`` and ``sanitised``
    (null where the document has no span and so stays as it is).

    Every term is rated against every entity it occurs with.  Where both occur in
    fewer than ``support`` different texts, the texts that lack are added as texts with
    the term in which the entity is as likely as anywhere; copies of a text are one
    text there, but count in all frequencies.  Terms are compared in lower case, as
    the JVM and Python agree on it.  Null and empty texts have no spans; very long ones
    are read whole.  Rows that repeat are rows of their own; ids may be null.  An
    empty table gives an empty result; other columns are ignored, whatever their names.
    """

    long, string = pa.int64(), pa.string()
    kinds = {"n_email": long, "n_ip": long, "n_card": long, "n_phone": long, "base_sha256": string, "_base": string, "_h": pa.binary(), "_k": long, "_text": string, "_entities": pa.list_(string), "_terms": pa.list_(string)}

    def find(frames):
        for f in frames:
            out = []
            for row, text in enumerate(f.column("_text").to_pylist()):
                spans = base_spans(text)
                n = [sum(k == i for k, _, _ in spans) for i in range(4)]
                digest = hashlib.blake2b((text or "").encode("utf-8", "surrogatepass"), digest_size=16).digest() if spans else None
                entities = sorted({entity(k, text[s:e]) for k, s, e in spans}) if spans else None
                terms = sorted({t for t, _, _ in masked_terms(text, spans)}) if spans else None
                line = joined(spans)
                out.append((*n, hashlib.sha256(line.encode()).hexdigest(), line, digest, row, text if spans else None, entities, terms))
            # Arrow arrays: pandas would round ids and hashes beside nulls
            columns = zip(*out, strict=True) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([f.column("_id"), *[pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)]], names=["_id", *kinds])

    schema = "_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, _base string, _h binary, _k long, _text string, _entities array<string>, _terms array<string>"
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    found = scratch.stash(rows.mapInArrow(find, schema), "personal")
    total = found.count()
    texts = found.filter("_h is not null")
    holders = texts.groupBy("_h").agg(F.count(F.lit(1)).alias("_m"), F.first("_entities").alias("_entities"), F.first("_terms").alias("_terms"))
    holders = scratch.stash(holders, "holders")
    flags = scratch.stash(disclosing_terms(holders, docs, total, share, remove, support, text_col), "flags")

    def locate(frames):
        for f in frames:
            out = []
            for text, flagged in zip(f.column("_text").to_pylist(), f.column("_flags").to_pylist(), strict=True):
                if text is None:
                    out.append(("", 0, None))
                    continue
                spans = base_spans(text)
                actions = {x["t"]: x["k"] for x in flagged} if flagged is not None else {}
                more = sorted((actions[t], s, e) for t, s, e in masked_terms(text, spans) if t in actions) if actions else []
                out.append((joined(spans + more), len(more), sanitised(text, spans + more)))
            new = zip(*out, strict=True) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([*[f.column(c) for c in plain], *[pa.array(c, t) for c, t in zip(new, (string, long, string), strict=True)]], names=[*plain, "spans", "n_terms", "sanitised"])

    plain = ["_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"]
    kept = "_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_terms long, sanitised string"
    with_flags = attach(texts, flags, ["_h"], "_m", total, F.struct("_id", "_k")).select(*plain, "_text", "_flags").mapInArrow(locate, kept)
    clean = found.filter("_h is null").select(*plain, F.col("_base").alias("spans"), F.lit(0).cast("long").alias("n_terms"), F.lit(None).cast("string").alias("sanitised"))
    both = with_flags.unionByName(clean)
    return both.select(F.col("_id").alias(id_col), *both.columns[1:])
