"""Postings as bytes: the documents of one tag in one segment, in any of five layouts.

A posting starts with two 32-bit words, the layout's code above a 28-bit hit count and
the payload's length, and is padded with zeros to a multiple of four bytes.
"""

from __future__ import annotations

import numpy as np

#: Fixed values of the format.
CODES = {"dense_bitmap": 0, "sparse_bitmap": 1, "byte_map": 2, "id_list": 3, "packed": 4}
UNIT_DOCS, HIT_BITS, MOST_PACKED_UNIT = 16, 28, 0xFFFF


def encode(local_ids, segment_docs: int, layout: str) -> bytes:
    """The posting of documents ``local_ids`` (in any order, repeated ones count once) of a segment."""
    at = np.unique(np.asarray(local_ids, np.int64))
    if len(at) and not 0 <= at[0] <= at[-1] < segment_docs:
        raise ValueError("a document lies outside the segment")
    if len(at) >> HIT_BITS:
        raise ValueError(f"more than {HIT_BITS} bits of hits")
    masks = np.bincount(at // UNIT_DOCS, 2.0 ** (at % UNIT_DOCS), -(-segment_docs // UNIT_DOCS)).astype("<u2")
    units = np.flatnonzero(masks)
    match layout:
        case "dense_bitmap":
            payload = masks.tobytes()
        case "byte_map":
            payload = np.isin(np.arange(segment_docs), at).astype(np.uint8).tobytes()
        case "id_list":
            payload = at.astype("<u4").tobytes()
        case "sparse_bitmap":  # places in the dense bitmap, in bytes, then the masks
            payload = (2 * units).astype("<u4").tobytes() + masks[units].tobytes()
        case "packed":
            if len(units) and units[-1] > MOST_PACKED_UNIT:
                raise ValueError("the segment has too many units for packed postings")
            payload = (units.astype("<u4") << 16 | masks[units]).astype("<u4").tobytes()
        case _:
            raise ValueError(f"unknown layout {layout!r}")
    head = np.array([CODES[layout] << HIT_BITS | len(at), len(payload)], "<u4").tobytes()
    return head + payload + bytes(-len(payload) % 4)


def decode(posting: bytes) -> tuple[str, np.ndarray]:
    """The layout and the sorted local ids; ValueError for bytes that are no posting."""
    if len(posting) < 8:
        raise ValueError("a posting has a header of eight bytes")
    word, length = np.frombuffer(posting, "<u4", 2).tolist()
    layout = {c: n for n, c in CODES.items()}.get(word >> HIT_BITS)
    if layout is None or len(posting) != 8 + length + -length % 4:
        raise ValueError("no posting: unknown layout or wrong length")
    payload = posting[8 : 8 + length]
    if layout == "byte_map":
        at = np.flatnonzero(np.frombuffer(payload, np.uint8))
    elif layout == "id_list":
        at = np.frombuffer(payload, "<u4").astype(np.int64)
    else:
        if layout == "dense_bitmap":
            masks = np.frombuffer(payload, "<u2")
            units = np.arange(len(masks))
        elif layout == "sparse_bitmap":
            n = length // 6
            units, masks = np.frombuffer(payload, "<u4", n) // 2, np.frombuffer(payload, "<u2", n, 4 * n)
        else:
            words = np.frombuffer(payload, "<u4")
            units, masks = words >> 16, words & 0xFFFF
        row, bit = np.nonzero(masks[:, None].astype(np.int64) >> np.arange(UNIT_DOCS) & 1)
        at = units.astype(np.int64)[row] * UNIT_DOCS + bit
    if len(at) != word & (1 << HIT_BITS) - 1:
        raise ValueError("the hit count differs from the payload")
    return layout, at
