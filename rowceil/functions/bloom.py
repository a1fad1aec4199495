"""A Bloom filter over integers and strings, with the usual operations."""

from __future__ import annotations

import base64
import math
import struct
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash


class BloomFilter:
    """capacity items at most error_rate false positives; filters with the same seeds and size can be combined."""

    def __init__(self, capacity: int, error_rate: float = 0.01, hash_seeds: Iterable[int] | None = None) -> None:
        if not 0 < error_rate < 1 or capacity < 1:
            raise ValueError("capacity must be positive and error_rate between 0 and 1")
        self.capacity, self.error_rate = capacity, error_rate
        k = max(1, int(math.log2(1 / error_rate)))
        self.hash_seeds = tuple(hash_seeds) if hash_seeds is not None else tuple(range(1, k + 1))
        k = len(self.hash_seeds)
        per_hash = math.ceil(capacity * abs(math.log(error_rate)) / (k * math.log(2) ** 2))
        self.num_bits = max(k * per_hash, 128)
        self._bits = np.zeros(-(-self.num_bits // 8), dtype=np.uint8)
        self._n = 0

    @property
    def num_hashes(self) -> int:
        return len(self.hash_seeds)

    def _places(self, item) -> list[int]:
        raw = item if isinstance(item, bytes) else struct.pack("<q", item) if isinstance(item, int) and -(2**63) <= item < 2**63 else repr(item).encode() if not isinstance(item, str) else item.encode()
        return [xxhash.xxh64_intdigest(raw, s) % self.num_bits for s in self.hash_seeds]

    def add(self, item) -> bool:
        """Whether the item seemed to be there already."""
        there = True
        for p in self._places(item):
            if not self._bits[p >> 3] >> (p & 7) & 1:
                there = False
                self._bits[p >> 3] |= 1 << (p & 7)
        self._n += not there
        return there

    def update(self, items: Iterable) -> None:
        for x in items:
            self.add(x)

    def __contains__(self, item) -> bool:
        return all(self._bits[p >> 3] >> (p & 7) & 1 for p in self._places(item))

    def __len__(self) -> int:
        """Items that were new when they were added; after combining, an estimate."""
        return self._n

    def bit_count(self) -> int:
        return int(np.bitwise_count(self._bits).sum())

    def approx_len(self) -> int:
        used = self.bit_count()
        return self.num_bits if used >= self.num_bits else round(-self.num_bits / self.num_hashes * math.log(1 - used / self.num_bits))

    @property
    def bit_array(self) -> int:
        return int.from_bytes(self._bits.tobytes(), "little")

    def _same(self, other: BloomFilter) -> None:
        if (self.hash_seeds, self.num_bits) != (other.hash_seeds, other.num_bits):
            raise ValueError("filters of different size or seeds can't be combined")

    def union(self, other: BloomFilter) -> BloomFilter:
        self._same(other)
        self._bits |= other._bits
        self._n = self.approx_len()
        return self

    def intersection(self, other: BloomFilter) -> BloomFilter:
        self._same(other)
        self._bits &= other._bits
        self._n = self.approx_len()
        return self

    __ior__ = union
    __iand__ = intersection

    def __or__(self, other: BloomFilter) -> BloomFilter:
        return self.copy().union(other)

    def __and__(self, other: BloomFilter) -> BloomFilter:
        return self.copy().intersection(other)

    def copy_template(self) -> BloomFilter:
        return BloomFilter(self.capacity, self.error_rate, self.hash_seeds)

    def copy(self) -> BloomFilter:
        out = self.copy_template()
        out._bits, out._n = self._bits.copy(), self._n
        return out

    def clear_all(self) -> None:
        self._bits[:] = 0
        self._n = 0

    def to_bytes(self) -> bytes:
        return struct.pack(f"<QdQI{self.num_hashes}Q", self.capacity, self.error_rate, self._n, self.num_hashes, *self.hash_seeds) + self._bits.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> BloomFilter:
        capacity, error, n, k = struct.unpack_from("<QdQI", raw)
        head = struct.calcsize("<QdQI")
        out = cls(capacity, error, struct.unpack_from(f"<{k}Q", raw, head))
        out._bits, out._n = np.frombuffer(raw, dtype=np.uint8, offset=head + 8 * k).copy(), n
        return out

    def to_base64(self) -> str:
        return base64.b64encode(self.to_bytes()).decode()

    @classmethod
    def from_base64(cls, text: str) -> BloomFilter:
        return cls.from_bytes(base64.b64decode(text))

    def __reduce__(self):
        return BloomFilter.from_bytes, (self.to_bytes(),)


def build(df, column: str, capacity: int, error_rate: float = 0.01) -> BloomFilter:
    """A filter of a column's values (nulls left out): each task fills one of the same size, and the driver unites them."""

    def fill(batches):
        own = BloomFilter(capacity, error_rate)
        for b in batches:
            own.update(x for x in b.column(0).to_pylist() if x is not None)
        yield pa.RecordBatch.from_arrays([pa.array([own.to_bytes()], pa.binary())], ["filter"])

    out = BloomFilter(capacity, error_rate)
    for (raw,) in df.select(column).mapInArrow(fill, "filter binary").collect():
        out.union(BloomFilter.from_bytes(bytes(raw)))
    return out


def members(df, column: str, known: BloomFilter):
    """The rows of df whose value the filter seems to hold; nulls never."""

    def test(batches):
        for b in batches:
            yield b.filter(pa.array([x is not None and x in known for x in b.column(column).to_pylist()], pa.bool_()))

    return df.mapInArrow(test, df.schema)
