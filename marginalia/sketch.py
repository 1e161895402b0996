"""A set of hashes of bounded size that every task can hold."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bound on a bitmap of rows to read again; 8 MB.
MAX_FILTER_BITS = 1 << 26


#: What a hash is multiplied with for each of its bits in a bitmap; the first is the hash itself.
_TURNS = np.array([1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], dtype=np.uint64)


class HashBitmap:
    """A set of 64-bit hashes by the upper bits of ``probes`` products; it may hold more than was put in, never less."""

    def __init__(self, bits: np.ndarray, shift: int, probes: int = 1):
        self.bits, self.shift, self.probes = bits, shift, probes

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        hashes = hashes.view(np.uint64)
        out = self._marked(hashes)
        for turn in _TURNS[1 : self.probes]:
            left = np.flatnonzero(out)
            out[left] = self._marked(hashes[left] * turn)
        return out

    def _marked(self, hashes: np.ndarray) -> np.ndarray:
        slots = hashes >> np.uint64(self.shift)
        return ((self.bits[(slots >> np.uint64(3)).astype(np.int64)] >> (slots & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


def hash_bitmap(hashes: DataFrame, n: int, most: int = MAX_FILTER_BITS, probes: int = 1) -> HashBitmap:
    """A bitmap of the 64-bit hashes in the only column of ``hashes`` (``n`` at most).

    16 bits a hash, ``most`` at most: what it lets through beyond them (a sixteenth with
    one probe, one in 400 with four, more once the bound is met) only costs a shuffle.
    """
    log = 16
    while (1 << log) < min(16 * n, most):
        log += 1
    chunk = 16  # bits of a chunk of the map, as a logarithm

    def mark(batches):
        import pyarrow as pa

        own: dict[int, np.ndarray] = {}
        for batch in batches:
            slots = batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - log)
            for c in np.unique(slots >> np.uint64(chunk)).tolist():
                bits = own.setdefault(c, np.zeros(1 << chunk, dtype=bool))
                bits[(slots[slots >> np.uint64(chunk) == c] & np.uint64((1 << chunk) - 1)).astype(np.int64)] = True
        d = {"chunk": list(own), "bits": [np.packbits(b, bitorder="little").tobytes() for b in own.values()]}
        yield pa.RecordBatch.from_arrays([pa.array(d["chunk"], pa.int64()), pa.array(d["bits"], pa.binary())], names=list(d))

    def turned(batches):
        import pyarrow as pa

        for batch in batches:
            own = batch.column(0).to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array((own[:, None] * _TURNS[None, :probes]).ravel().view(np.int64))], names=["h"])

    hashes = hashes.toDF("h")
    rows = (
        (hashes if probes == 1 else hashes.mapInArrow(turned, "h long")).repartition(1 << max(0, log - 22), F.shiftrightunsigned("h", 64 - log + chunk))
        .mapInArrow(mark, "chunk long, bits binary").collect()
    )
    bits = np.zeros(1 << (log - 3), dtype=np.uint8)
    size = 1 << (chunk - 3)
    for r in rows:
        bits[r["chunk"] * size : (r["chunk"] + 1) * size] |= np.frombuffer(r["bits"], dtype=np.uint8)
    return HashBitmap(bits, 64 - log, probes)
