"""Token ids in sorted-string-table shards: prefix-compressed blocks, sparse index, Bloom filter, footer.

A shard, all integers little-endian unless said otherwise:

    block*      entries in ascending key order, then the CRC-32 of the block (4 bytes).
                entry: varint bytes shared with the key before, varint further key bytes, varint number of ids,
                those key bytes, the ids (2 or 4 bytes each, as the footer says). The first entry shares nothing.
    index       for each block: 9 bytes last key, 8 bytes offset, 8 bytes length, 8 bytes ids before it in the shard
    filter      bits of a Bloom filter over the keys
    footer      8 x 8 bytes: index offset, blocks, filter offset, filter bits, hashes, keys, ids, bytes per id;
                8 bytes MAGIC

A key is 9 bytes: 0 for a null doc_id, else 1 and the doc_id with its sign bit flipped, big-endian, so that bytes
sort as the integers do. Rows with the same doc_id keep all their entries, beside each other.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path
from .tokens import END_ID, encoder

MAGIC = b"RCSSTAB1"
BLOCK_BYTES = 64 * 1024
BITS_PER_KEY, HASHES = 10, 7
#: A shard ends after the document with which it reaches so many bytes or keys, and the task begins another.
SHARD_BYTES, SHARD_KEYS = 512 << 20, 2_000_000
_INDEX = struct.Struct("<9sQQQ")
_FOOTER = struct.Struct("<8Q8s")


def open_folder(uri: str):
    """File system and path of a folder that driver and executors share. The names that Spark has for S3 are pyarrow's s3."""
    from pyarrow import fs

    uri = re.sub("^s3[an]://", "s3://", uri)
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def sweep(folder: str, keep: set[str]) -> None:
    """Deletes what tasks that failed or ran twice left in a folder: all files but those named."""
    from pyarrow import fs as kinds

    fs, at = open_folder(folder)
    for x in fs.get_file_info(kinds.FileSelector(at, allow_not_found=True)):
        if x.is_file and x.base_name not in keep:
            fs.delete_file(x.path)


def key_of(doc_id) -> bytes:
    return b"\x00" + b"\x00" * 8 if doc_id is None else b"\x01" + struct.pack(">Q", (int(doc_id) + (1 << 63)) & (2**64 - 1))


def id_of(key: bytes):
    return None if key[0] == 0 else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = b[at]
        n |= (x & 127) << shift
        at += 1
        if x < 128:
            return n, at
        shift += 7


def _probes(keys: list[bytes], bits: int) -> np.ndarray:
    """Rows of bit positions, by double hashing."""
    import xxhash

    one = np.array([xxhash.xxh64_intdigest(k, 1) for k in keys], dtype=np.uint64)
    two = np.array([xxhash.xxh64_intdigest(k, 2) | 1 for k in keys], dtype=np.uint64)
    return (one[:, None] + np.arange(HASHES, dtype=np.uint64)[None, :] * two[:, None]) % np.uint64(bits)


class Writer:
    def __init__(self, out, width: int) -> None:
        self.out, self.width = out, width
        self.block, self.last, self.at = bytearray(), b"", 0
        self.index: list[tuple] = []
        self.keys: list[bytes] = []
        self.ids = self.ids_before = 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >> (8 * self.width):
            raise ValueError(f"an id does not fit {self.width} bytes")
        shared = 0
        if self.block:
            while shared < len(key) and key[shared] == self.last[shared]:
                shared += 1
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(ids)) + key[shared:] + ids.astype(f"<u{self.width}").tobytes()
        self.last = key
        self.ids += len(ids)
        self.keys.append(key)
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            self.block += struct.pack("<I", zlib.crc32(self.block))
            self.out.write(bytes(self.block))
            self.index.append((self.last, self.at, len(self.block), self.ids_before))
            self.at += len(self.block)
            self.block, self.ids_before = bytearray(), self.ids

    def close(self) -> None:
        self._flush()
        bits = max(64, -(-BITS_PER_KEY * len(self.keys) // 8) * 8)
        held = np.zeros(bits, dtype=np.uint8)
        for i in range(0, len(self.keys), 10_000):
            held[_probes(self.keys[i : i + 10_000], bits).ravel()] = 1
        self.out.write(b"".join(_INDEX.pack(*x) for x in self.index))
        at = self.at + _INDEX.size * len(self.index)
        self.out.write(np.packbits(held).tobytes())
        self.out.write(_FOOTER.pack(self.at, len(self.index), at, bits, HASHES, len(self.keys), self.ids, self.width, MAGIC))


class Reader:
    """file: a seekable binary file of a shard; only footer, index and filter are read at the start."""

    def __init__(self, file) -> None:
        self.file = file
        end = file.seek(0, 2)
        file.seek(end - _FOOTER.size)
        at, blocks, filter_at, self.bits, _, self.n_keys, self.n_ids, self.width, magic = _FOOTER.unpack(file.read(_FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        file.seek(at)
        raw = file.read(_INDEX.size * blocks)
        self.index = list(_INDEX.iter_unpack(raw))
        self.last_keys = [x[0] for x in self.index]
        file.seek(filter_at)
        self.filter = np.frombuffer(file.read(self.bits // 8), dtype=np.uint8)

    def _entries(self, i: int) -> Iterator[tuple[bytes, np.ndarray, int]]:
        _, at, size, before = self.index[i]
        self.file.seek(at)
        b = self.file.read(size)
        if zlib.crc32(b[:-4]) != struct.unpack("<I", b[-4:])[0]:
            raise ValueError("a block is damaged")
        at, key = 0, b""
        while at < size - 4:
            shared, at = _read_varint(b, at)
            more, at = _read_varint(b, at)
            n, at = _read_varint(b, at)
            key = key[:shared] + b[at : at + more]
            at += more
            yield key, np.frombuffer(b, dtype=f"<u{self.width}", count=n, offset=at), before
            at += n * self.width
            before += n

    def may_hold(self, key: bytes) -> bool:
        p = _probes([key], self.bits)[0].astype(np.int64)
        return bool(((self.filter[p >> 3] >> (7 - (p & 7))) & 1).all())

    def get(self, doc_id) -> list[np.ndarray]:
        """The id arrays under one doc_id; usually none or one."""
        key = key_of(doc_id)
        found = []
        if self.n_keys and self.may_hold(key):
            for i in range(bisect_left(self.last_keys, key), len(self.index)):
                for k, ids, _ in self._entries(i):
                    if k > key:
                        return found
                    if k == key:
                        found.append(ids)
        return found

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray, int]]:
        """Key, ids, ids before it in the shard."""
        for i in range(len(self.index)):
            yield from self._entries(i)


def write_shards(docs: DataFrame, folder: str, tokenizer: str = "byte_bpe_50k.json", width: int = 2) -> list[dict]:
    """Encodes doc_id and text of docs into shards under folder, in ascending doc_id order over all shards.

    Returns a record for each shard (path, docs, ids, first), in order; a partition has one, or more by SHARD_BYTES and
    SHARD_KEYS. Null text is empty, every document ends with id 0, other columns are ignored, no rows give no shards. A
    task writes under names of its own, and what tasks that failed or ran twice wrote is deleted. Quantiles of doc_id
    alone tell the parts, so that documents are encoded once, on their way there, and stored nowhere between. width is the number of bytes of an id, 2 or 4; 2 holds vocabularies up
    to 65,536, and an id that does not fit is an error.
    """

    def encode(batches):
        enc, end = encoder(tokenizer), np.array([END_ID], dtype="<u4").tobytes()
        for b in batches:
            ids = [np.frombuffer(x + end, dtype="<u4") for x in enc.encode(b.column("text").to_pylist())]
            if any(int(x.max()) >> (8 * width) for x in ids):
                raise ValueError(f"an id does not fit {width} bytes")
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x.astype(f"<u{width}").tobytes() for x in ids], pa.binary())], ["doc_id", "ids"])

    def write(batches):
        fs, at = open_folder(folder)
        fs.create_dir(at, recursive=True)
        w = None
        for b in batches:
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), b.column("ids").to_pylist(), strict=True):
                if w is None:
                    name = f"{uuid.uuid4().hex}.sst"
                    out = fs.open_output_stream(f"{at}/{name}")
                    w, first = Writer(out, width), doc_id
                w.add(key_of(doc_id), np.frombuffer(ids, dtype=f"<u{width}"))
                if w.at >= SHARD_BYTES or len(w.keys) >= SHARD_KEYS:
                    yield closed(w, out, name, first)
                    w = None
        if w is not None:
            yield closed(w, out, name, first)

    def closed(w, out, name, first):
        w.close()
        out.close()
        last = id_of(w.keys[-1])
        return pa.RecordBatch.from_pydict({"name": [name], "docs": [len(w.keys)], "ids": [w.ids], "first": pa.array([first], pa.int64()), "last": pa.array([last], pa.int64())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = rows.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)] or [0.5], 10 * n)).first()[0]
    edges = pa.array(sorted(set(edges or [])), pa.int64()).to_numpy()

    def place(batches):
        for b in encode(batches):
            ids = b.column("doc_id")
            at = np.where(ids.is_null(), 0, np.searchsorted(edges, ids.fill_null(0).to_numpy(), "left"))
            yield b.append_column("part", pa.array(at.astype(np.int32)))

    rows = rows.mapInArrow(place, "doc_id long, ids binary, part int")
    rows = rows.repartitionById(len(edges) + 1, "part").drop("part").sortWithinPartitions(F.asc_nulls_first("doc_id"))
    made = rows.mapInArrow(write, "name string, docs long, ids long, first long, last long").collect()
    sweep(folder, {r["name"] for r in made})
    made.sort(key=lambda r: (r["first"] is not None, r["first"] or 0, r["last"] is not None, r["last"] or 0))
    return [{"path": f"{folder}/{r['name']}", "docs": r["docs"], "ids": r["ids"], "first": r["first"]} for r in made]


def read_shards(spark: SparkSession, shards: list[dict]) -> DataFrame:
    """For each document of the shards: doc_id, start (ids before it in all shards), n_tokens, ids_crc32, shard."""
    rows, before = [], 0
    for i, s in enumerate(shards):
        rows.append((i, s["path"], before))
        before += s["ids"]

    def read(batches):
        for b in batches:
            for number, path, base in zip(*(c.to_pylist() for c in b.columns), strict=True):
                fs, at = open_folder(path)
                with fs.open_input_file(at) as f:
                    got: list[tuple] = []
                    for key, ids, start in Reader(f):
                        got.append((id_of(key), base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), number))
                        if len(got) == 20_000:
                            yield _frame(got)
                            got = []
                    yield _frame(got)

    def _frame(got):
        cols = list(zip(*got, strict=True)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "n_tokens", "ids_crc32", "shard"])

    listed = spark.sparkContext.parallelize(rows, max(1, len(rows))).toDF("number long, path string, base long")
    return listed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard long")


def tokens_on_disk(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """Writes docs as shards in the shared folder and returns what the shards hold."""
    spark = docs.sparkSession
    return read_shards(spark, write_shards(docs, fresh_path(spark, "shards"), tokenizer))
