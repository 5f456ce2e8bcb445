"""BLAKE3-256 from its published specification, vectorised over rows with numpy."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence

import numpy as np

# Fixed values of the specification: initial words, order of message words, flags.
IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
PERMUTATION = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8
BLOCK, CHUNK = 64, 1024
_LANES = ((0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14))


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def _compress(cv: np.ndarray, words: np.ndarray, counter: int, length: int, flags: int) -> np.ndarray:
    """The first eight output words; ``cv`` is (8, rows), ``words`` (16, rows)."""
    rows = words.shape[1]
    const = lambda v: np.full(rows, v & 0xFFFFFFFF, np.uint32)
    v = [*cv, *(const(i) for i in IV[:4]), const(counter), const(counter >> 32), const(length), const(flags)]
    m = list(words)
    for _ in range(7):
        for k, (a, b, c, d) in enumerate(_LANES):
            for x, turn_d, turn_b in ((m[2 * k], 16, 12), (m[2 * k + 1], 8, 7)):
                v[a] = v[a] + v[b] + x
                v[d] = _turn(v[d] ^ v[a], turn_d)
                v[c] = v[c] + v[d]
                v[b] = _turn(v[b] ^ v[c], turn_b)
        m = [m[i] for i in PERMUTATION]
    return np.stack([v[i] ^ v[i + 8] for i in range(8)])


def _chunk(parts: Sequence[bytes], counter: int, root: bool) -> np.ndarray:
    """Chaining values of chunks of one length, one column per chunk."""
    size = len(parts[0])
    blocks = max(1, -(-size // BLOCK))
    data = np.frombuffer(b"".join(p.ljust(blocks * BLOCK, b"\0") for p in parts), "<u4").reshape(len(parts), blocks, 16)
    cv = np.repeat(np.array(IV, np.uint32)[:, None], len(parts), axis=1)
    for k in range(blocks):
        last = k == blocks - 1
        flags = (CHUNK_START if k == 0 else 0) | (CHUNK_END if last else 0) | (ROOT if last and root else 0)
        cv = _compress(cv, np.ascontiguousarray(data[:, k].T), counter, size - k * BLOCK if last else BLOCK, flags)
    return cv


def _tree(data: bytes, counter: int, root: bool) -> np.ndarray:
    if len(data) <= CHUNK:
        return _chunk([data], counter, root)
    left = CHUNK << ((len(data) - 1) // CHUNK).bit_length() - 1
    words = np.concatenate([_tree(data[:left], counter, False), _tree(data[left:], counter + left // CHUNK, False)])
    return _compress(np.array(IV, np.uint32)[:, None], words, 0, BLOCK, PARENT | (ROOT if root else 0))


def blake3_hex(values: Sequence[str | None]) -> list[str | None]:
    """Lower-case hex digests; null for null. Short values of one length are hashed together."""
    out: list[str | None] = [None] * len(values)
    by_length: dict[int, list[tuple[int, bytes]]] = defaultdict(list)
    for k, value in enumerate(values):
        if value is not None:
            data = value.encode("utf-8")
            by_length[len(data)].append((k, data))
    with np.errstate(over="ignore"):
        for size, some in by_length.items():
            if size <= CHUNK:
                cv = _chunk([d for _, d in some], 0, True)
                for column, (k, _) in zip(cv.T, some):
                    out[k] = column.astype("<u4").tobytes().hex()
            else:
                for k, data in some:
                    out[k] = _tree(data, 0, True)[:, 0].astype("<u4").tobytes().hex()
    return out
