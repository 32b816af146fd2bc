"""CRC-32 of joined byte strings from the parts' own checksums, on arrays.

Appending ``n`` zero bytes to a string is a linear map of its checksum, so the checksum of two strings joined is that map
of the first one's, exclusive-or the second one's. The maps for 0 to 63 bytes and for powers of two are small tables.
"""

from __future__ import annotations

import zlib
from functools import cache

import numpy as np

SHORT = 64


@cache
def _maps() -> tuple[np.ndarray, list[np.ndarray]]:
    """By number of zero bytes below ``SHORT``, and for ``SHORT * 2**k`` of them: one table for each byte of a checksum."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, one >> 1 ^ np.uint32(0xEDB88320), one >> 1)
    here = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    short = []
    for _ in range(SHORT + 1):
        short.append(here)
        here = here >> 8 ^ one[here & 255]
    powers = [short.pop()]
    for _ in range(32):
        powers.append(_mapped(powers[-1], powers[-1]))
    return np.array(short), powers


def _mapped(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return tables[0][crc & 255] ^ tables[1][crc >> 8 & 255] ^ tables[2][crc >> 16 & 255] ^ tables[3][crc >> 24]


def checksums(values: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, values), np.uint32, len(values))


def joined(left: np.ndarray, right: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The checksums of strings joined: ``left`` and ``right`` are those of the parts, ``size`` the right ones' bytes."""
    short, powers = _maps()
    low = size & (SHORT - 1)
    out = short[low, 0, left & 255]
    for k in range(1, 4):
        out ^= short[low, k, left >> np.uint32(8 * k) & 255]
    high = size >> 6
    for k, tables in enumerate(powers):
        if not (high >> k).any():
            break
        far = (high >> k & 1).astype(bool)
        out[far] = _mapped(tables, out[far])
    return out ^ right
