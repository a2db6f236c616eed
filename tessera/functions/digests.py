"""MD5 of many short texts at once, as arrays: for rules that draw by the digest of every concept pair of a paper."""

from __future__ import annotations

import math

import numpy as np

_SHIFTS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_STEPS = [(i // 16, (i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16, np.uint32(_SHIFTS[i // 16][i % 4]), np.uint32(int(abs(math.sin(i + 1)) * 2**32))) for i in range(64)]
_START = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
#: Most bytes of a text, which with its length make one block, and texts that are digested at once.
MOST, CHUNK = 55, 1 << 13


def first_digits(texts: np.ndarray) -> np.ndarray:
    """The first hexadecimal digit, as a number, of the MD5 of each text: rows of bytes, all of one length of at most ``MOST``."""
    n, size = texts.shape
    if size > MOST:
        raise ValueError(f"texts of {size} bytes don't fit one block")
    out = np.empty(n, np.uint8)
    for at in range(0, n, CHUNK):
        part = texts[at : at + CHUNK]
        block = np.zeros((len(part), 64), np.uint8)
        block[:, :size], block[:, size] = part, 0x80
        block[:, 56:58] = np.array([8 * size], "<u2").view(np.uint8)
        words = np.ascontiguousarray(block.view("<u4").T)
        a, b, c, d = (np.full(len(part), x) for x in _START)
        t = np.empty(len(part), np.uint32)
        for kind, word, shift, constant in _STEPS:
            if kind == 0:
                f = (c ^ d) & b ^ d
            elif kind == 1:
                f = (b ^ c) & d ^ c
            elif kind == 2:
                f = b ^ c ^ d
            else:
                f = (~d | b) ^ c
            f += a
            f += constant
            f += words[word]
            np.right_shift(f, np.uint32(32) - shift, out=t)
            f <<= shift
            f |= t
            f += b
            a, b, c, d = d, f, b, c
        out[at : at + CHUNK] = (a + _START[0]).view(np.uint8)[::4] >> 4
    return out


_HEX = np.array([list(f"{i:02X}".encode()) for i in range(256)], np.uint8)


def hex_of(numbers: np.ndarray) -> np.ndarray:
    """Six upper-case hexadecimal digits of each number of 24 bits, a row of bytes each."""
    return np.concatenate([_HEX[(numbers >> shift) & 255] for shift in (16, 8, 0)], axis=1)
