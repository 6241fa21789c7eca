"""Hashed character n-grams of whole texts, summed against weight tables without being stored."""

from __future__ import annotations

import numpy as np

from nodeloom.llm.common import chunks, codepoints

#: Code points below this have their own lower case and letter test; above it every one stands for itself.
_KNOWN = 0x3000
_FOLD = np.arange(_KNOWN, dtype=np.uint32)
for _i in range(_KNOWN):
    _c = chr(_i)
    _FOLD[_i] = ord(_c.lower()) if _c.isalpha() and len(_c.lower()) == 1 else _i if _c.isalpha() else 32


def folded(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased letters, everything else a space, one space ahead of each row; and where each row begins."""
    cp, rows = codepoints(data, at)
    out = cp.copy()
    low = cp < _KNOWN
    if low.all():
        out = _FOLD[cp]
    else:
        out[low] = _FOLD[cp[low]]
        seen, which = np.unique(cp[~low], return_inverse=True)
        out[~low] = np.array([c if chr(c).isalpha() else 32 for c in seen.tolist()], np.uint32)[which]
    return np.insert(out, rows[:-1], 32), rows + np.arange(len(rows))


def positions(text: np.ndarray, rows: np.ndarray, size: int, bits: int) -> np.ndarray:
    """Slot of the n-gram that begins at each position; 2**bits where it would run past its row."""
    h = np.full(len(text), size * 0x2545F491 & 0xFFFFFFFF, np.uint32)
    for k in range(size):
        part = text[k:]
        h[: len(part)] = (h[: len(part)] ^ part) * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    slot = ((h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - bits)).astype(np.int32)
    if size > 1:
        late = (rows[1:, None] - np.arange(1, size)[None, :]).ravel()
        begin = np.repeat(rows[:-1], size - 1)
        slot[late[late >= begin]] = 1 << bits
    return slot


def slots_of(data: np.ndarray, at: np.ndarray, sizes: tuple[int, ...], bits: int):
    """Per row: the slots of all its n-grams (with repeats) and its length."""
    for _, _, part, begin in chunks(data, at):
        text, rows = folded(part, begin)
        found = [positions(text, rows, n, bits) for n in sizes]
        for a, b in zip(rows[:-1], rows[1:], strict=True):
            got = np.concatenate([f[a:b] for f in found])
            yield got[got < 1 << bits], int(b - a)


def sums(data: np.ndarray, at: np.ndarray, sizes: tuple[int, ...], bits: int, tables: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row: the sums of ``tables`` (k x 2**bits + 1, the last slot zero) over its n-grams, its length and its number of letters."""
    total, length, letters = [], [], []
    for _, _, part, begin in chunks(data, at):
        text, rows = folded(part, begin)
        found = [positions(text, rows, n, bits) for n in sizes]
        each = np.zeros((len(tables), len(rows) - 1))
        for k, t in enumerate(tables):
            value = t[found[0]]
            for f in found[1:]:
                value += t[f]
            each[k] = np.add.reduceat(value, rows[:-1], dtype=np.float64)
        total.append(each)
        length.append(np.diff(rows))
        letters.append(np.add.reduceat(text != 32, rows[:-1], dtype=np.int64))
    if not total:
        return np.zeros((len(tables), 0)), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(total, axis=1), np.concatenate(length), np.concatenate(letters)


#: A sparse vector is packed as the numbers of its features (32 bits each), then their values in single precision.


def pack(features: np.ndarray, values: np.ndarray) -> bytes:
    return features.astype(np.int32).tobytes() + values.astype(np.float32).tobytes()


def unpack(rows: list[bytes], width: int) -> np.ndarray:
    """Rows x ``width``, dense."""
    out = np.zeros((len(rows), width), np.float32)
    for k, data in enumerate(rows):
        n = len(data) // 8
        out[k, np.frombuffer(data, np.int32, n)] = np.frombuffer(data, np.float32, n, 4 * n)
    return out
