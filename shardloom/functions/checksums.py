"""CRC-32C of many byte ranges at once."""

from __future__ import annotations

import numpy as np

# The reflected Castagnoli polynomial, and the mask of record files.
POLYNOMIAL = 0x82F63B78
MASK_ADD = 0xA282EAD8
BLOCK = 128
U32 = np.uint32


def _tables() -> tuple[np.ndarray, np.ndarray]:
    byte = np.arange(256, dtype=U32)
    for _ in range(8):
        byte = (byte >> U32(1)) ^ np.where(byte & U32(1), U32(POLYNOMIAL), U32(0))
    at = np.stack([np.arange(256, dtype=U32) << U32(8 * k) for k in range(4)])
    zeros = np.empty((BLOCK + 1, 4, 256), U32)
    for n in range(BLOCK + 1):
        zeros[n] = at
        at = (at >> U32(8)) ^ byte[at & U32(255)]
    return byte, zeros


# What one byte, and what so many zero bytes, make of a register.
_BYTE, _ZEROS = _tables()


def _after_zeros(register: np.ndarray, count: np.ndarray) -> np.ndarray:
    low = U32(255)
    out = _ZEROS[count, 0, register & low] ^ _ZEROS[count, 1, (register >> U32(8)) & low]
    return out ^ _ZEROS[count, 2, (register >> U32(16)) & low] ^ _ZEROS[count, 3, register >> U32(24)]


def crc32c(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The checksum of each range of ``data``.

    Ranges are cut into blocks that advance side by side; registers of blocks are
    then joined along each range.
    """
    start, end = np.asarray(start, np.int64), np.asarray(end, np.int64)
    many = -(-(end - start) // BLOCK)
    first = np.concatenate([[0], np.cumsum(many)])
    owner = np.repeat(np.arange(len(start)), many)
    begin = start[owner] + (np.arange(first[-1]) - first[owner]) * BLOCK
    size = np.minimum(end[owner] - begin, BLOCK)
    # Long blocks first: those still running are then a prefix.
    order = np.argsort(-size, kind="stable")
    place, live = begin[order], np.searchsorted(-size[order], -np.arange(BLOCK), "left")
    register = np.zeros(len(order), U32)
    for k in range(BLOCK):
        n = live[k]
        if not n:
            break
        register[:n] = (register[:n] >> U32(8)) ^ _BYTE[(register[:n] ^ data[place[:n] + k]) & U32(255)]
    own = np.empty_like(register)
    own[order] = register
    state = np.full(len(start), 0xFFFFFFFF, U32)
    order = np.argsort(-many, kind="stable")
    for k in range(int(many.max(initial=0))):
        rows = order[: np.searchsorted(-many[order], -k, "left")]
        block = first[rows] + k
        state[rows] = _after_zeros(state[rows], size[block]) ^ own[block]
    return ~state


def masked_crc32c(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The checksum as record files store it: rotated, a constant added."""
    crc = crc32c(data, start, end)
    return ((crc >> U32(15)) | (crc << U32(17))) + U32(MASK_ADD)
