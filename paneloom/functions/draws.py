"""Reproducible pseudo-random numbers from coordinates, the same on any partitioning."""

from __future__ import annotations

import math
from hashlib import md5

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

SHIFTS = [*[7, 12, 17, 22] * 4, *[5, 9, 14, 20] * 4, *[4, 11, 16, 23] * 4, *[6, 10, 15, 21] * 4]
SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
PLACES = [*range(16), *[(5 * i + 1) % 16 for i in range(16)], *[(3 * i + 5) % 16 for i in range(16)], *[7 * i % 16 for i in range(16)]]
START = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
#: Hashes that are made at a time.
HASHES = 65_536


def hash_number(*parts: Column | str | int) -> Column:
    """Uniform non-negative 60-bit integer from the md5 of the joined coordinates."""
    texts = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *texts).cast("binary")), 1, 15), 16, 10).cast("bigint")


def hash_numbers(head: str, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """(first, second): ``hash_number`` of the head and every pair of two whole numbers, not below zero."""
    found = np.empty((len(first), len(second)), np.int64)
    for a, mine in by_digits(first):
        for b, others in by_digits(second):
            size = max(1, HASHES // len(others))
            for at in range(0, len(mine), size):
                some = mine[at : at + size]
                found[np.ix_(some, others)] = block_hashes(f"{head}:".encode(), first[some], a, second[others], b)
    return found


def by_digits(numbers: np.ndarray) -> list[tuple[int, np.ndarray]]:
    digits = np.array([len(str(n)) for n in numbers.tolist()], int)
    return [(int(d), np.flatnonzero(digits == d)) for d in np.unique(digits)]


def block_hashes(front: bytes, first: np.ndarray, a: int, second: np.ndarray, b: int) -> np.ndarray:
    """First 15 hexadecimal digits of the MD5 of front, number of ``a`` digits, colon, number of ``b`` digits; one MD5 block
    is computed for all pairs at once, longer texts go through the library."""
    size = len(front) + a + 1 + b
    if size > 55:
        digests = b"".join([md5(b"%b%d:%d" % (front, x, y), usedforsecurity=False).digest() for x in first.tolist() for y in second.tolist()])
        return (np.frombuffer(digests, ">u8")[::2] >> 4).astype(np.int64).reshape(len(first), len(second))
    text = front + bytes(a) + b":" + bytes(b) + b"\x80"
    words = [np.full((1, 1), w, np.uint32) for w in np.frombuffer(text.ljust(56, b"\0") + (8 * size).to_bytes(8, "little"), "<u4")]
    for numbers, digits, start in ((first[:, None], a, len(front)), (second[None, :], b, len(front) + a + 1)):
        for i in range(digits):
            at, digit = start + i, (numbers // 10 ** (digits - 1 - i) % 10 + 48).astype(np.uint32)
            words[at // 4] = words[at // 4] + (digit << np.uint32(8 * (at % 4)))
    p, q, r, s = (np.full((len(first), len(second)), x, np.uint32) for x in START)
    for i in range(64):
        if i < 16:
            mixed = s ^ (q & (r ^ s))
        elif i < 32:
            mixed = r ^ (s & (q ^ r))
        elif i < 48:
            mixed = q ^ r ^ s
        else:
            mixed = r ^ (q | ~s)
        mixed += p
        mixed += words[PLACES[i]]
        mixed += SINES[i]
        turned = mixed << np.uint32(SHIFTS[i])
        turned |= mixed >> np.uint32(32 - SHIFTS[i])
        turned += q
        p, q, r, s = s, turned, q, r
    high, low = ((x + y).byteswap().astype(np.int64) for x, y in ((p, START[0]), (q, START[1])))
    return high << 28 | low >> 4
