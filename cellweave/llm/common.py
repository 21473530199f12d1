"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import pickle
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Bytes of text that one Python call works on at a time.
SLICE_BYTES = 4 << 20

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: ASCII characters other than letters and digits.
SIGNS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_P = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where that is unset, a temporary one on a single machine and an error on a cluster."""
    sc = spark.sparkContext
    if named := sc.getConf().get("spark.checkpoint.dir"):
        return named
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="cellweave-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def settle(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and return it without its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def text_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts, plus one for each row."""
    total = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1)).first()[0]
    return int(total or 0)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit numbers (two multiply and shift rounds)."""
    h = h ^ (h >> np.uint64(30))
    h = h * _M1
    h = h ^ (h >> np.uint64(27))
    h = h * _M2
    return h ^ (h >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[at[0] : at[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def slices(batch, column: int = 1, most: int = SLICE_BYTES):
    """Yield pieces of a record batch that hold about `most` bytes of the column, one row at least."""
    if not batch.num_rows:
        return
    _, at = buffers(batch.column(column))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        yield batch.slice(first, last - first)
        first = last


def words(data: np.ndarray, at: np.ndarray, gaps: np.ndarray = _WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes that aren't in gaps (ASCII white space): (starts, ends, first word of each text).

    The last result has one more entry than there are texts.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    solid = ~gaps[data]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    begin = solid.copy()
    begin[1:] &= ~solid[:-1] | edge[1:n]
    end = solid.copy()
    end[:-1] &= ~solid[1:] | edge[1:n]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, at)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes at each position as one number, zeros after the end; one more entry than bytes."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run data[start:end].

    The sum, over a run's pieces of eight bytes, of a mix of piece and place that is linear in neither.
    Equal hashes don't prove equal runs; `distinct` compares the bytes.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    count = np.maximum(1, (lengths + 7) >> 3)
    first = np.cumsum(count) - count
    within = np.arange(int(count.sum())) - np.repeat(first, count)
    begin = np.repeat(starts, count) + 8 * within
    x = eights(data)[begin] & _LOW[np.minimum(8, np.repeat(ends, count) - begin)]
    x ^= np.cumprod(np.full(int(count.max()), _P, np.uint64))[within]
    return mix(np.add.reduceat(mix(x), first) + lengths.astype(np.uint64))


def differ(data: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether data[a : a + length] and data[b : b + length] differ, for each entry."""
    out, word = np.zeros(len(a), bool), eights(data)
    left, k = np.arange(len(a)), 0
    while len(left):
        own = _LOW[np.minimum(8, lengths[left] - 8 * k)]
        out[left] |= (word[a[left] + 8 * k] & own) != (word[b[left] + 8 * k] & own)
        k += 1
        left = left[(lengths[left] > 8 * k) & ~out[left]]
    return out


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each run among the distinct ones, index of the first run of each number), by bytes, whatever the hashes are."""
    _, at, which = np.unique(hashes, return_index=True, return_inverse=True)
    same, lengths = at[which], ends - starts
    wrong = lengths != lengths[same]
    check = np.flatnonzero(~wrong & (same != np.arange(len(same))))
    if not wrong.any() and not differ(data, starts[check], starts[same[check]], lengths[check]).any():
        return which, at
    raw, seen, first = data.tobytes(), {}, []
    for k, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
        if seen.setdefault(raw[a:b], len(seen)) == len(first):
            first.append(k)
        which[k] = seen[raw[a:b]]
    return which, np.array(first, np.int64)


def grams(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word windows that stay inside a text: (hashes, index of each one's first word)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    g = hashes[:m].copy()
    for k in range(1, n):
        g = mix(g * _M1 + hashes[k : k + m])
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    inside = np.flatnonzero(text[:m] == text[n - 1 : n - 1 + m])
    return g[inside], inside


def packed(batch: pa.RecordBatch) -> bytes:
    """A record batch as compressed Arrow bytes."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(raw) -> list[pa.RecordBatch]:
    return list(pa.ipc.open_stream(raw))


def packed_numbers(*columns) -> bytes:
    """Columns of numbers from 0 to 2**64 - 1, compressed by planes of bytes."""
    out = []
    for x in columns:
        x = np.asarray(x).astype(np.uint64)
        out.append((len(x), np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes()))
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(out))


def unpacked_numbers(blob: bytes) -> list[np.ndarray]:
    return [np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(8, n).T).view(np.uint64).ravel() for n, x in pickle.loads(zstandard.ZstdDecompressor().decompress(blob))]


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, as many as its length."""
    total = int(lengths.sum())
    return np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(total) if total else np.zeros(0, np.int64)
