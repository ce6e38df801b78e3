"""Number codecs of model files: packed signed integers, zig-zag symbols, half floats, base 85."""

from __future__ import annotations

import numpy as np


def pack_signed(codes: np.ndarray, bits: int) -> bytes:
    """Two's-complement codes of ``bits`` bits each, lowest bit first, without gaps."""
    low = np.asarray(codes, dtype=np.int64) & ((1 << bits) - 1)
    flat = (low[:, None] >> np.arange(bits) & 1).astype(np.uint8).ravel()
    return np.packbits(flat, bitorder="little").tobytes()


def unpack_signed(data: bytes, bits: int, count: int) -> np.ndarray:
    flat = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: bits * count].reshape(count, bits).astype(np.int64)
    value = (flat << np.arange(bits)).sum(axis=1)
    return value - (flat[:, -1] << bits)


def zigzag(codes: np.ndarray) -> np.ndarray:
    codes = np.asarray(codes, dtype=np.int64)
    return np.where(codes < 0, -2 * codes - 1, 2 * codes)


def unzigzag(symbols: np.ndarray) -> np.ndarray:
    symbols = np.asarray(symbols, dtype=np.int64)
    return np.where(symbols & 1, -(symbols + 1) // 2, symbols // 2)


def half_to_float(words: np.ndarray) -> np.ndarray:
    return np.asarray(words, dtype=np.uint16).view(np.float16).astype(np.float32)


def decode_base85(text: str, alphabet: str) -> bytes:
    """Five symbols to four bytes, most significant first; a short last group gives fewer bytes."""
    place = {c: k for k, c in enumerate(alphabet)}
    out = bytearray()
    for at in range(0, len(text), 5):
        group = text[at : at + 5]
        value = 0
        for c in group.ljust(5, alphabet[84]):
            value = value * 85 + place[c]
        out += (value & 0xFFFFFFFF).to_bytes(4, "big")[: len(group) - 1]
    return bytes(out)


def pack_bit_planes(codes: np.ndarray, bits: int) -> bytes:
    """Codes as bit planes, lowest plane first; in a plane, eight codes to a byte, the first one lowest."""
    codes = np.asarray(codes, dtype=np.int64)
    return b"".join(np.packbits((codes >> k & 1).astype(np.uint8), bitorder="little").tobytes() for k in range(bits))


def unpack_bit_planes(data: bytes, bits: int, count: int) -> np.ndarray:
    size = -(-count // 8)
    planes = [np.unpackbits(np.frombuffer(data[k * size : (k + 1) * size], np.uint8), bitorder="little")[:count].astype(np.int64) for k in range(bits)]
    return sum((p << k for k, p in enumerate(planes)), np.zeros(count, dtype=np.int64))


def xorshift(seed: int, n: int) -> np.ndarray:
    """n numbers in [0, 1) of the 32-bit xorshift generator with shifts 13, 17 and 5."""
    x, out = seed & 0xFFFFFFFF or 1, np.empty(n)
    for k in range(n):
        x ^= x << 13 & 0xFFFFFFFF
        x ^= x >> 17
        x ^= x << 5 & 0xFFFFFFFF
        out[k] = x / 2.0**32
    return out


#: Embedding rows that no part can reach, left out of the runtime layout.
UNREACHABLE = (659, 674, 675, 690, 691, 723)


def runtime_rows(size: int = 755) -> np.ndarray:
    """The rows of the full embedding that the runtime layout keeps, in order."""
    return np.setdiff1d(np.arange(size), UNREACHABLE)


def runtime_ids(ids: np.ndarray, size: int = 755) -> np.ndarray:
    """Feature ids in the runtime layout; -1 stays none."""
    place = np.full(size + 1, -1, dtype=np.int64)
    place[runtime_rows(size)] = np.arange(size - len(UNREACHABLE))
    return place[ids]


def widened_rows(table: np.ndarray, first: int, old: int, new: int) -> np.ndarray:
    """An embedding whose ``old`` hash rows from ``first`` on become ``new``: each row again for the hashes that it folded."""
    part = table[first : first + old]
    return np.concatenate([table[:first], np.tile(part, (new // old, 1)), table[first + old :]])
