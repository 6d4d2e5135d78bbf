"""Sorted-string-table shards of token ids, keyed by document identifier.

A shard file is::

    data blocks | index | Bloom filter | footer

Keys are a byte (0: null, 1: a value) and the identifier as an order-preserving
big-endian number. A data block holds the entries of about BLOCK_BYTES of ids:
a table of entries (bytes shared with the key before, rest of the key, number
of ids), then all ids, compressed together with zstandard. The index has each
block's last key, place and entry count; the Bloom filter has BITS_PER_KEY
bits a key; the fixed-size footer locates both. A lookup asks the filter,
binary-searches the index and reads one block (more if the key is repeated).

Documents are dealt to shards by ranges of the key, equal keys further by the
text's hash, so no shard depends on the size of a key's group. A task writes
its shard under a name of its own attempt and renames it when complete, so a
lost or repeated task leaves whole files only.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .hashing import mix
from .storage import shared_dir, written
from .tokens import word_encoder

BLOCK_BYTES, BITS_PER_KEY, PROBES = 1 << 18, 10, 7
MAGIC = b"CMSSTBL1"
FOOTER = struct.Struct("<QQQQQQI8s")
META = "shard int, path string, first_id long, last_id long, n_docs long, n_tokens long, n_bytes long"


def key_bytes(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))


def key_value(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        n |= (data[at] & 127) << shift
        shift += 7
        at += 1
        if data[at - 1] < 128:
            return n, at


def _probes(keys: np.ndarray, bits: int) -> np.ndarray:
    h = mix(keys)
    step = mix(h) | np.uint64(1)
    return (h[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]) % np.uint64(bits)


def _hash_key(key: bytes) -> np.uint64:
    return np.uint64(int.from_bytes(key, "big") & (2**64 - 1))


class ShardWriter:
    def __init__(self, out, width: int):
        self._out, self._width, self._dtype = out, width, {2: "<u2", 4: "<u4"}[width]
        self._zip = zstandard.ZstdCompressor(level=1)
        self._index: list[tuple[bytes, int, int, int]] = []
        self._hashes: list[np.uint64] = []
        self.n_docs = self.n_tokens = self.at = 0
        self._begin()

    def _begin(self) -> None:
        self._entries, self._ids, self._size, self._last, self._count = bytearray(), [], 0, b"", 0

    def add(self, key: bytes, ids: bytes) -> None:
        """ids: little-endian unsigned 32-bit."""
        shared = 0
        while shared < min(len(key), len(self._last)) and key[shared] == self._last[shared]:
            shared += 1
        n = len(ids) // 4
        self._entries += _varint(shared) + _varint(len(key) - shared) + key[shared:] + _varint(n)
        self._ids.append(ids)
        self._last, self._count, self._size = key, self._count + 1, self._size + n * self._width
        self._hashes.append(_hash_key(key))
        self.n_docs, self.n_tokens = self.n_docs + 1, self.n_tokens + n
        if self._size >= BLOCK_BYTES:
            self._flush()

    def _write(self, data: bytes) -> tuple[int, int]:
        self._out.write(data)
        self.at += len(data)
        return self.at - len(data), len(data)

    def _flush(self) -> None:
        if self._count:
            ids = np.frombuffer(b"".join(self._ids), "<u4")
            if len(ids) and int(ids.max()) >= 1 << 8 * self._width:
                raise ValueError(f"id {int(ids.max())} does not fit in {self._width} bytes")
            body = self._zip.compress(struct.pack("<I", len(self._entries)) + bytes(self._entries) + ids.astype(self._dtype).tobytes())
            self._index.append((self._last, *self._write(body), self._count))
            self._begin()

    def close(self) -> None:
        self._flush()
        index = b"".join(_varint(len(k)) + k + _varint(at) + _varint(n) + _varint(count) for k, at, n, count in self._index)
        index_at = self._write(zstandard.compress(index))
        bits = max(64, BITS_PER_KEY * len(self._hashes))
        on = np.zeros(bits, bool)
        if self._hashes:
            on[_probes(np.array(self._hashes, np.uint64), bits).ravel().astype(np.int64)] = True
        bloom_at = self._write(struct.pack("<Q", bits) + np.packbits(on).tobytes())
        self._write(FOOTER.pack(*index_at, *bloom_at, self.n_docs, self.n_tokens, self._width, MAGIC))


class ShardReader:
    def __init__(self, path: str):
        filesystem, name = pafs.FileSystem.from_uri(path)
        self._file = filesystem.open_input_file(name)
        size = self._file.size()
        index_at, index_n, bloom_at, bloom_n, self.n_docs, self.n_tokens, self._width, magic = FOOTER.unpack(self._file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is no shard")
        self._bloom_at = bloom_at, bloom_n
        self._bloom: tuple[int, np.ndarray] | None = None
        data, at, self._index = zstandard.decompress(self._file.read_at(index_n, index_at)), 0, []
        while at < len(data):
            n, at = _read_varint(data, at)
            key, at = data[at : at + n], at + n
            place, at = _read_varint(data, at)
            length, at = _read_varint(data, at)
            count, at = _read_varint(data, at)
            self._index.append((key, place, length, count))

    def _block(self, i: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, place, length, count = self._index[i]
        data = zstandard.decompress(self._file.read_at(length, place))
        (entries,) = struct.unpack_from("<I", data)
        ids = np.frombuffer(data, {2: "<u2", 4: "<u4"}[self._width], offset=4 + entries).astype("<u4")
        at, key, start = 4, b"", 0
        for _ in range(count):
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            key, at = key[:shared] + data[at : at + rest], at + rest
            n, at = _read_varint(data, at)
            yield key, ids[start : start + n]
            start += n

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for i in range(len(self._index)):
            for key, ids in self._block(i):
                yield key_value(key), ids

    def may_have(self, doc_id: int | None) -> bool:
        if self._bloom is None:
            data = self._file.read_at(self._bloom_at[1], self._bloom_at[0])
            self._bloom = struct.unpack_from("<Q", data)[0], np.unpackbits(np.frombuffer(data, np.uint8, offset=8))
        bits, on = self._bloom
        return bool(on[_probes(np.array([_hash_key(key_bytes(doc_id))], np.uint64), bits).astype(np.int64)].all())

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every document of that identifier in this shard."""
        key, found = key_bytes(doc_id), []
        if self.may_have(doc_id):
            for i in range(bisect_left([x[0] for x in self._index], key), len(self._index)):
                entries = list(self._block(i))
                found += [ids for k, ids in entries if k == key]
                if entries[-1][0] > key:
                    break
        return found


def write_shards(docs: DataFrame, tokenizer: str, end_id: int = 2, width: int = 2, out: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Writes shard files below out (default: a new folder in the shared one) and returns META, one row per shard in key order.

    width: bytes of an id, 2 for vocabularies of at most 65,536 ids. A null
    text is empty: its only id is end_id. A null key sorts first. Repeated
    keys each keep their entry. An empty table gives no shard. Other columns
    are not read.
    """
    folder = out or shared_dir(docs.sparkSession)

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        filesystem, root = pafs.FileSystem.from_uri(folder)
        filesystem.create_dir(root, recursive=True)
        name = f"shard-{context.partitionId():06d}.sst"
        draft = f"{root}/.{name}.{context.taskAttemptId()}"
        encoder, end, ends = word_encoder(tokenizer), np.uint32(end_id).tobytes(), []
        writer = None
        with filesystem.open_output_stream(draft) as stream:
            writer = ShardWriter(stream, width)
            for batch in batches:
                for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    writer.add(key_bytes(doc), encoder.encode(body or "") + end)
                    ends = [ends[0] if ends else doc, doc]
            writer.close()
        if not writer.n_docs:
            filesystem.delete_file(draft)
            return
        filesystem.move(draft, f"{root}/{name}")
        row = {"shard": context.partitionId(), "path": f"{folder}/{name}", "first_id": ends[0], "last_id": ends[1], "n_docs": writer.n_docs, "n_tokens": writer.n_tokens, "n_bytes": writer.at}
        types = [pa.int32(), pa.string(), *[pa.int64()] * 5]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), types, strict=True)], list(row))

    body = F.coalesce(F.col(text), F.lit(""))
    dealt = docs.select(F.col(key).cast("long").alias("doc_id"), body.alias("body"), F.xxhash64(body).alias("h")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "body")
    return written(dealt.mapInArrow(write, META))


def read_shards(shards: DataFrame) -> DataFrame:
    """What the files hold, per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, shard, slot.

    A null key and repeated keys come back as they were written, an empty
    text as its end alone; of no shards nothing.
    """

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, path in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                rows, at = [], 0
                for slot, (doc, ids) in enumerate(ShardReader(path)):
                    rows.append((doc, at, len(ids), zlib.crc32(ids.tobytes()), shard, slot))
                    at += len(ids)
                types = [*[pa.int64()] * 4, pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["doc_id", "at", "n_tokens", "ids_crc32", "shard", "slot"])

    rows = shards.select("shard", "path").repartition("shard").mapInArrow(read, "doc_id long, at long, n_tokens long, ids_crc32 long, shard int, slot long")
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(shards.select("shard", before.alias("before")))  # a row per file
    return rows.join(starts, "shard").select("doc_id", (F.col("at") + F.col("before")).cast("long").alias("start"), "n_tokens", "ids_crc32", "shard", "slot")


def lookup(shards: DataFrame, keys: DataFrame) -> DataFrame:
    """doc_id and ids of the documents in keys (doc_id), read by binary search in the shards whose range has them.

    Repeated keys are looked up once; a key without documents gives no row, a
    null one those with a null key. Of no shards or no keys nothing is found.
    Other columns are not read. The shards' ranges (two numbers a file) are
    known to all tasks, and each key finds its shards by binary search.
    """
    ranges = shards.select("path", "first_id", "last_id").orderBy("shard").collect()
    least = -(2**63)  # a null key comes first
    bound = lambda c: np.array([least if r[c] is None else r[c] for r in ranges], np.int64)
    shared = shards.sparkSession.sparkContext.broadcast((bound("first_id"), bound("last_id"), [r["path"] for r in ranges]))

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, last, paths = shared.value
        for batch in batches:
            at = np.asarray(batch.column(0).fill_null(least))
            lo, hi = np.searchsorted(last, at), np.searchsorted(first, at, "right")
            key, place = np.repeat(np.arange(len(at)), np.maximum(hi - lo, 0)), [i for x, y in zip(lo, hi, strict=True) for i in range(x, y)]
            yield pa.RecordBatch.from_arrays([pa.array([paths[i] for i in place], pa.string()), batch.column(0).take(pa.array(key))], ["path", "doc_id"])

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, reader = None, None
        for batch in batches:
            found = []
            for at, doc in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                path, reader = at, reader if at == path else ShardReader(at)
                found += [(doc, ids.tolist()) for ids in reader.get(doc)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.list_(pa.int64()))], ["doc_id", "ids"])

    asked = keys.select(F.col("doc_id").cast("long")).distinct().mapInArrow(find, "path string, doc_id long")
    return asked.repartition("path").sortWithinPartitions("path", "doc_id").mapInArrow(read, "doc_id long, ids array<long>")
