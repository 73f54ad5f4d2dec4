"""Counting quotient filters of 64-bit fingerprints.

A filter covers one slab: the fingerprints that share their top ``slab_bits`` bits.  Of the
other bits the upper ``q`` are the quotient, which is stored by position in a bitmap of
occupied quotients, and the lower ones the remainder, stored in order with one bit that ends
each quotient's run.  Counts above one stand apart.  Nothing is lost: a filter decodes to
its sorted fingerprints and their counts, so filters merge exactly.
"""

from __future__ import annotations

import struct

import numpy as np

HEAD = "<BBQQQ"


def encode(prints: np.ndarray, counts: np.ndarray, slab: int, slab_bits: int) -> bytes:
    """``prints``: sorted distinct uint64 of the slab."""
    n = len(prints)
    q = min(max(n - 1, 1).bit_length(), 63 - slab_bits)
    low = 64 - slab_bits - q
    quotient = ((prints << np.uint64(slab_bits)) if slab_bits else prints) >> np.uint64(64 - q)
    occupied = np.zeros(1 << q, bool)
    occupied[quotient.astype(np.int64)] = True
    ends = np.r_[quotient[1:] != quotient[:-1], True]
    width = -(-low // 8)
    remainder = (prints & np.uint64((1 << low) - 1)).astype(">u8").view(np.uint8).reshape(n, 8)[:, 8 - width:]
    many = np.flatnonzero(counts > 1)
    return b"".join((struct.pack(HEAD, q, slab_bits, slab, n, len(many)), np.packbits(occupied).tobytes(), np.packbits(ends).tobytes(),
                     remainder.tobytes(), many.astype("<i8").tobytes(), counts[many].astype("<i8").tobytes()))


def decode(data: bytes) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Sorted fingerprints, counts, slab and slab bits."""
    q, slab_bits, slab, n, extra = struct.unpack_from(HEAD, data)
    low, at = 64 - slab_bits - q, struct.calcsize(HEAD)

    def take(count: int, kind) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, count, at)
        at += out.nbytes
        return out

    occupied = np.flatnonzero(np.unpackbits(take(-(-(1 << q) // 8), np.uint8), count=1 << q))
    ends = np.unpackbits(take(-(-n // 8), np.uint8), count=n)
    width = -(-low // 8)
    wide = np.zeros((n, 8), np.uint8)
    wide[:, 8 - width:] = take(n * width, np.uint8).reshape(n, width)
    run = np.cumsum(ends) - ends
    prints = wide.view(">u8").ravel().astype(np.uint64) | (occupied[run].astype(np.uint64) << np.uint64(low))
    if slab_bits:
        prints |= np.uint64(slab << (64 - slab_bits))
    counts = np.ones(n, np.int64)
    where = take(extra, "<i8")
    counts[where] = take(extra, "<i8")
    return prints, counts, slab, slab_bits


def merge(filters: list[bytes]) -> bytes:
    """One filter of a slab from several: runs of sorted remainders are merged and equal ones summed."""
    if len(filters) == 1:
        return filters[0]
    parts = [decode(f) for f in filters]
    prints, counts = summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
    return encode(prints, counts, parts[0][2], parts[0][3])


def summed(prints: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(prints, kind="stable")
    prints, counts = prints[order], counts[order]
    first = np.flatnonzero(np.r_[True, prints[1:] != prints[:-1]])
    return prints[first], np.add.reduceat(counts, first)


def filters_of(prints: np.ndarray, slab_bits: int):
    """(slab, filter) of any fingerprints, repeats counted."""
    if not len(prints):
        return
    prints, counts = summed(prints, np.ones(len(prints), np.int64))
    slab = (prints >> np.uint64(64 - slab_bits)) if slab_bits else np.zeros(len(prints), np.uint64)
    first = np.flatnonzero(np.r_[True, slab[1:] != slab[:-1]])
    for a, b in zip(first, np.r_[first[1:], len(prints)], strict=True):
        yield int(slab[a]), encode(prints[a:b], counts[a:b], int(slab[a]), slab_bits)
