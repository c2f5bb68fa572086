"""Hash space helpers, and vectorised MurmurHash3 (x64, 128 bits) and MD5 after their public descriptions."""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

TOP = 1 << 64
SIGN = -(1 << 63)
C1, C2 = np.uint64(0x87C37B91114253D5), np.uint64(0x4CF5AD432745937F)


def max_hash(scaled: int, bits: int = 64) -> int:
    """Largest hash that a sketch of ``scaled`` keeps, unsigned."""
    if scaled <= 1:
        return (1 << bits) - 1
    return int(float((1 << bits) - 1) / scaled) if bits == 64 else (1 << bits) // scaled


def at_most(hash_: Column, scaled: int, bits: int = 64) -> Column:
    """``hash <= max_hash(scaled)`` in unsigned order; a plain range where it can be, which Parquet can skip by."""
    top = max_hash(scaled, bits)
    if scaled <= 1:
        return F.lit(True)
    if top < 1 << 63:
        return hash_.between(0, top)
    return hash_.bitwiseXOR(F.lit(SIGN)) <= F.lit((top ^ (1 << 63)) - TOP if (top ^ (1 << 63)) >= 1 << 63 else top ^ (1 << 63))


def unsigned(hash_: Column) -> Column:
    """The hash as a non-negative decimal."""
    wide = hash_.cast("decimal(20,0)")
    return F.when(hash_ < 0, (wide + F.lit(str(TOP)).cast("decimal(20,0)")).cast("decimal(20,0)")).otherwise(wide)


def unsigned_order(hash_: Column) -> Column:
    """A signed value that sorts as the unsigned hash does."""
    return hash_.bitwiseXOR(F.lit(SIGN))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _mix(k: np.ndarray) -> np.ndarray:
    k = k ^ (k >> np.uint64(33))
    k = k * np.uint64(0xFF51AFD7ED558CCD)
    k = k ^ (k >> np.uint64(33))
    k = k * np.uint64(0xC4CEB9FE1A85EC53)
    return k ^ (k >> np.uint64(33))


def murmur64(keys: np.ndarray, seed: int = 42) -> np.ndarray:
    """First 64 bits of the 128-bit hash of each row of an (n, length) byte matrix, as uint64."""
    n, length = keys.shape
    padded = np.zeros((n, -(-max(length, 1) // 16) * 16), np.uint8)
    padded[:, :length] = keys
    words = padded.view("<u8")
    h1 = np.full(n, seed, np.uint64)
    h2 = h1.copy()
    whole = length // 16
    for b in range(whole):
        k1, k2 = words[:, 2 * b], words[:, 2 * b + 1]
        h1 = h1 ^ (_rotl(k1 * C1, 31) * C2)
        h1 = (_rotl(h1, 27) + h2) * np.uint64(5) + np.uint64(0x52DCE729)
        h2 = h2 ^ (_rotl(k2 * C2, 33) * C1)
        h2 = (_rotl(h2, 31) + h1) * np.uint64(5) + np.uint64(0x38495AB5)
    rest = length - 16 * whole
    if rest > 8:
        h2 = h2 ^ (_rotl(words[:, 2 * whole + 1] * C2, 33) * C1)
    if rest:
        h1 = h1 ^ (_rotl(words[:, 2 * whole] * C1, 31) * C2)
    h1, h2 = h1 ^ np.uint64(length), h2 ^ np.uint64(length)
    h1 = h1 + h2
    h2 = h2 + h1
    h1, h2 = _mix(h1), _mix(h2)
    return h1 + h2


# MD5 after RFC 1321: the additive constants, and each round's rotations.
_MD5_K = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_MD5_R = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]


def _md5_blocks(words: np.ndarray) -> np.ndarray:
    """First 64 bits, big-endian, of the digests of one-block messages: a padded message in each column of a (16, n) matrix of words."""
    n = words.shape[1]
    start = [np.full(n, x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = start
    for i in range(64):
        turn = i // 16
        if turn == 0:
            f, g = d ^ (b & (c ^ d)), i
        elif turn == 1:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif turn == 2:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f = f + a
        f += words[g]
        f += _MD5_K[i]
        r = _MD5_R[turn][i % 4]
        high = f << np.uint32(r)
        f >>= np.uint32(32 - r)
        f |= high
        f += b
        a, b, c, d = d, f, b, c
    high, low = ((x + y).byteswap().astype(np.uint64) for x, y in zip(start[:2], (a, b), strict=True))
    return (high << np.uint64(32)) | low


def md5_64(text: np.ndarray, starts: np.ndarray, lengths: np.ndarray, rows: int = 32768) -> np.ndarray:
    """First 64 bits of the MD5 of the byte stretches of ``text`` at ``starts``, as uint64; those of more than 55 bytes one by one."""
    out = np.empty(len(starts), np.uint64)
    windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([text, np.zeros(64, np.uint8)]), 64)
    column = np.arange(64)
    for at in range(0, len(starts), rows):
        length = np.minimum(lengths[at : at + rows], 55)
        block = windows[starts[at : at + rows]]
        block *= column < length[:, None]
        block[np.arange(len(block)), length] = 0x80
        words = np.ascontiguousarray(block.view("<u4").T)
        words[14] = length * 8
        out[at : at + rows] = _md5_blocks(words)
    for k in np.flatnonzero(lengths > 55):
        out[k] = int.from_bytes(hashlib.md5(text[starts[k] : starts[k] + lengths[k]].tobytes(), usedforsecurity=False).digest()[:8], "big")
    return out
