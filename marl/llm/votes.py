"""SimHash votes over many documents at once, and Hamming arithmetic on fingerprints."""

from __future__ import annotations

import numpy as np

#: Every eighth bit of a word: eight byte-wide counters side by side.
_LANES = np.uint64(0x0101010101010101)
#: A byte counter overflows beyond this many votes.
_RUN = 255


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each document (its number of consecutive hashes in `sizes`): the bits set in over half of its hashes; 0 for none.

    Each hash is spread over eight words of byte counters, summed in runs of 255 and then by document.
    """
    sizes = np.asarray(sizes, np.int64)
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    own = sizes[full]
    begins = np.cumsum(own) - own
    runs = -(-own // _RUN)
    first = np.cumsum(runs) - runs
    starts = np.repeat(begins, runs) + (np.arange(runs.sum()) - np.repeat(first, runs)) * _RUN
    counts = np.empty((len(starts), 8, 8), np.int64)  # [run, byte, bit of the byte]
    for bit in range(8):
        lane = hashes >> np.uint64(bit)
        lane &= _LANES
        counts[:, :, bit] = np.add.reduceat(lane, starts).view(np.uint8).reshape(-1, 8)
    votes = np.add.reduceat(counts.reshape(len(starts), 64), first, axis=0)
    bits = (2 * votes > own[:, None]).astype(np.uint8)
    out[full] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def hex16(fingerprints: np.ndarray) -> list[str]:
    return [format(x, "016x") for x in fingerprints.tolist()]
