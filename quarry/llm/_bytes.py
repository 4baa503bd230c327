"""Byte-aligned variable-length integers with separate control bytes, coded and decoded by table lookup.

A control byte holds two bits for each of four values: which of four widths the value takes. A
table of 256 masks, one for each control byte, says which of the bytes of four full-width values
are stored; encoding and decoding are one masked copy.
"""

from __future__ import annotations

import numpy as np

WIDTHS_32 = (1, 2, 3, 4)
WIDTHS_64 = (1, 2, 4, 8)


def _masks(widths: tuple[int, ...]) -> np.ndarray:
    full = widths[-1]
    control = np.arange(256)
    codes = np.stack([(control >> (2 * k)) & 3 for k in range(4)], 1)
    length = np.array(widths)[codes]
    return (np.arange(full)[None, None, :] < length[:, :, None]).reshape(256, 4 * full)


_TABLES = {w: _masks(w) for w in (WIDTHS_32, WIDTHS_64)}
_SIZES = {w: m.sum(1) for w, m in _TABLES.items()}


def encode(values: np.ndarray, widths: tuple[int, ...] = WIDTHS_32) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of non-negative integers that fit the largest width."""
    full = widths[-1]
    padded = np.zeros(-(-len(values) // 4) * 4, f"<u{full}")
    padded[: len(values)] = values
    codes = np.zeros(len(padded), np.uint8)
    for w in widths[:-1]:
        codes += padded >= (1 << (8 * w))
    quads = codes.reshape(-1, 4)
    control = quads[:, 0] | (quads[:, 1] << 2) | (quads[:, 2] << 4) | (quads[:, 3] << 6)
    data = padded.view(np.uint8).reshape(-1, 4 * full)[_TABLES[widths][control]]
    return control.tobytes(), data.tobytes()


def data_size(control: np.ndarray, widths: tuple[int, ...] = WIDTHS_32) -> int:
    return int(_SIZES[widths][control].sum())


def decode(control: bytes | np.ndarray, data: bytes | np.ndarray, n: int, widths: tuple[int, ...] = WIDTHS_32) -> np.ndarray:
    """The n values; the padding of the last four is dropped."""
    control = np.frombuffer(control, np.uint8) if isinstance(control, bytes) else control
    data = np.frombuffer(data, np.uint8) if isinstance(data, bytes) else data
    full = widths[-1]
    out = np.zeros((len(control), 4 * full), np.uint8)
    out[_TABLES[widths][control]] = data
    return out.view(f"<u{full}").ravel()[:n]


def planes(values: np.ndarray) -> bytes:
    """All first bytes, then all second bytes and so on: equal high bytes lie together and compress away."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def from_planes(body: memoryview, n: int, dtype: str) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(body, np.uint8, n * width).reshape(width, n).T).view(dtype).ravel()
