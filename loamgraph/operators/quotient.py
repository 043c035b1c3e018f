"""Quotient filters as NumPy arrays: build, read back, look up, merge.

A fingerprint of ``bits`` bits is split into a quotient of ``q`` bits, which is the slot
it belongs to, and a remainder of ``bits - q`` bits, which is what the slot stores.
Remainders of one quotient form a run, kept sorted; runs that do not fit move to the
right.  Three bits a slot (quotient occurs, slot continues a run, slot is moved) are
enough to read all fingerprints back in order, so filters merge like sorted lists
and can be rebuilt with another ``q`` without the keys.
"""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<BBxxII")  # bits, q, entries, slots
LOAD = 0.75


def _pack(values: np.ndarray, width: int) -> bytes:
    """Whole numbers of ``width`` bits, one after the other, as words of 64 bits with one word to spare."""
    n = len(values)
    out = np.zeros((n * width + 63) // 64 + 1, np.uint64)
    if width and n:
        bit = np.arange(n, dtype=np.uint64) * np.uint64(width)
        word, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        out[word[first]] = np.bitwise_or.reduceat(values << shift, first)
        over = np.flatnonzero(shift + np.uint64(width) > np.uint64(64))  # at most one value of a word goes on in the next
        out[word[over] + 1] |= values[over] >> (np.uint64(64) - shift[over])
    return out.astype("<u8").tobytes()


def _values(words: np.ndarray, width: int, at: np.ndarray) -> np.ndarray:
    """The packed numbers at some places."""
    if not width:
        return np.zeros(len(at), np.uint64)
    bit = at.astype(np.uint64) * np.uint64(width)
    word, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
    high = np.where(shift > 0, words[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
    return ((words[word] >> shift) | high) & np.uint64((1 << width) - 1)


def build(fingerprints: np.ndarray, bits: int) -> bytes:
    """Filter of sorted, distinct fingerprints below ``2**bits``."""
    n = len(fingerprints)
    q = min(bits, max(1, int(np.ceil(np.log2(max(n, 1) / LOAD)))))
    r = bits - q
    quotient = (fingerprints >> np.uint64(r)).astype(np.int64)
    i = np.arange(n)
    slot = i + np.maximum.accumulate(quotient - i) if n else i
    slots = max(1 << q, int(slot[-1]) + 1 if n else 0)  # room at the end in place of a wrap-around
    flags = np.zeros((3, slots), np.uint8)
    flags[0, quotient] = 1
    if n:
        flags[1, slot[1:][quotient[1:] == quotient[:-1]]] = 1
        flags[2, slot] = slot != quotient
    # Empty slots store no remainder: the flags tell which slots are used.
    body = _pack(fingerprints & np.uint64((1 << r) - 1), r)
    return _HEAD.pack(bits, q, n, slots) + np.packbits(flags, axis=1, bitorder="little").tobytes() + body


def _flags(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bits that mark the quotients that occur, place of the first entry of each run and one past the last, words of the remainders)."""
    _, _, n, slots = _HEAD.unpack_from(blob)
    row = (slots + 7) // 8
    rows = np.frombuffer(blob, np.uint8, 3 * row, _HEAD.size).reshape(3, row)
    used = np.unpackbits(rows[0] | rows[1] | rows[2], count=slots, bitorder="little").view(bool)
    goes_on = np.unpackbits(rows[1], count=slots, bitorder="little").view(bool)[used]
    return rows[0], np.append(np.flatnonzero(~goes_on), n), np.frombuffer(blob, "<u8", -1, _HEAD.size + 3 * row)


def fingerprints(blob: bytes) -> np.ndarray:
    """All fingerprints, in order."""
    bits, q, n, slots = _HEAD.unpack_from(blob)
    occurs, first, words = _flags(blob)
    quotient = np.repeat(np.flatnonzero(np.unpackbits(occurs, count=slots, bitorder="little")), np.diff(first))  # the k-th run belongs to the k-th quotient that occurs
    return (quotient.astype(np.uint64) << np.uint64(bits - q)) | _values(words, bits - q, np.arange(n))


def contains(blob: bytes, wanted: np.ndarray) -> np.ndarray:
    """Whether each wanted fingerprint is in the filter: its quotient's run is looked at, entry by entry, and nothing else is decoded."""
    bits, q, _, _ = _HEAD.unpack_from(blob)
    r = bits - q
    occurs, first, words = _flags(blob)
    quotient, rest = (wanted >> np.uint64(r)).astype(np.int64), wanted & np.uint64((1 << r) - 1)
    byte, bit = quotient >> 3, (quotient & 7).astype(np.uint8)
    found = np.zeros(len(wanted), bool)
    at = np.flatnonzero(occurs[byte] >> bit & 1)
    before = np.concatenate([[0], np.cumsum(np.bitwise_count(occurs), dtype=np.int64)])
    run = before[byte[at]] + np.bitwise_count(occurs[byte[at]] & ((np.uint8(1) << bit[at]) - np.uint8(1)))
    entry, last = first[run], first[run + 1]
    while len(at):
        here = _values(words, r, entry)
        found[at[here == rest[at]]] = True
        entry = entry + 1
        go = (here < rest[at]) & (entry < last)
        at, entry, last = at[go], entry[go], last[go]
    return found


def merge(a: bytes, b: bytes) -> bytes:
    """Filter of the fingerprints of both, by a merge of the two sorted lists."""
    if a[0] != b[0]:
        raise ValueError("filters of different fingerprint lengths")
    x, y = fingerprints(a), fingerprints(b)
    both = np.concatenate([x, y])
    both.sort(kind="stable")  # two sorted runs: a linear merge
    return build(both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both, a[0])


def entries(blob: bytes) -> int:
    """How many fingerprints a filter holds."""
    return _HEAD.unpack_from(blob)[2]
