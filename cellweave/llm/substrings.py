"""Suffix-array dedup: bytes in repeated 50-byte strings, by distributed prefix doubling.

Ranks of text positions grow in length by joining the rank at a position with the rank at an
offset: 1, 2, 3, 6, 12, 24, 25 bytes within a text, and from 25 to 50 with the offset 25. Ranks
are 64-bit fingerprints; what a doubling needs of them is which are equal, so equal ranks are
brought together by sorting fingerprints in buckets, and positions whose rank is unique leave.

Positions are thinned without loss: a 50-byte window is stood for by the leftmost smallest
25-byte rank within it, by its first 16 bits (its anchor), which equal windows share. Blocks of
documents and buckets of ranks exchange packed, sorted lists in three rounds:

1. Rank at 25 bytes of each anchor. A bucket answers which occur in more than one block.
2. Rank of an anchor's whole run of windows (joined from ranks at 50) and its smallest
   doc_id. A bucket answers the smallest doc_id of equal runs, and which runs share their
   anchor's rank with different ones.
3. Only of those: the bytes of the run, from which the bucket joins the ranks at 50 of every
   window. It answers which windows occur in a smaller doc_id.

A list holds a rank once for each block, so a passage that a third of all documents share
costs an entry a block, and no group of copies is gathered anywhere.

What is equal in round 3 is decided on bytes. In round 2 two runs count as equal if both their
anchors' ranks, of log2(bytes) + 14 bits, and the ranks of their bytes, of 64 bits, agree. Over
n bytes of text that joins two different runs with a probability under 2**-80 * n: 1e-10 for
100 TB. The mix is linear in no byte, and no texts are known that collide by construction.

Cases: a null or empty text, or one under 50 bytes, loses nothing; rows without a doc_id
neither lose bytes nor count as smaller; rows that repeat a doc_id don't remove from each
other; repeated rows give a row each; an empty table gives an empty result; other columns are
ignored. Whole texts are read.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import buffers, differ, ranges, slices, text_bytes

LENGTH = 50
HALF = LENGTH // 2
#: UTF-8 bytes of text for each block, about, and that are dealt to blocks at a time; window starts that are worked on at
#: a time (their ranks fit a core's cache, their places 16 bits).
BLOCK_BYTES, DEAL_BYTES, PIECE = 8 << 20, 32 << 20, 1 << 14
#: Each block has a list for each bucket: there are as many buckets as blocks up to FEW, later one for BUCKET_BLOCKS blocks.
FEW, BUCKET_BLOCKS = 128, 4

_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A, _M, _S = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x94D049BB133111EB), np.uint64(29)


def _join(a: np.ndarray, offset: int, b: np.ndarray) -> np.ndarray:
    """Ranks of a at each position joined with ranks of b at an offset."""
    n = min(len(a), len(b) - offset)
    if n <= 0:
        return np.zeros(0, np.uint64)
    x = a[:n] * _A
    x += b[offset : offset + n]
    x ^= x >> _S
    return x


def ranks(data: np.ndarray) -> np.ndarray:
    """Fingerprints of the HALF bytes at each position."""
    one = _BYTE[data]
    two = _join(one, 1, one)
    three = _join(two, 2, one)
    six = _join(three, 3, three)
    twelve = _join(six, 6, six)
    full = _join(_join(twelve, 12, twelve), 24, one)
    full *= _M
    full ^= full >> np.uint64(32)
    return full


def _lowest(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum over each window of `width` entries."""
    k = 1
    while 2 * k <= width and len(x) > k:
        x, k = np.minimum(x[:-k], x[k:]), 2 * k
    rest = width - k
    return np.minimum(x[:-rest], x[rest:]) if rest and len(x) > rest else x


def anchors(data: np.ndarray, at: np.ndarray):
    """Yield (rank at the anchor, text, first window, last window, rank of the run) by pieces of data."""
    walls = np.unique(np.concatenate([at[:-1], at[1:] - LENGTH + 1]))  # where the windows inside a text begin, and end
    for base in range(0, max(0, len(data) - LENGTH + 1), PIECE):
        piece = data[base : base + PIECE + LENGTH - 1]
        half = ranks(piece)
        whole = _join(half, HALF, half)
        key = (half >> np.uint64(48)).astype(np.uint32) << np.uint32(16)
        key |= np.arange(len(half), dtype=np.uint32)
        low = _lowest(key, LENGTH - HALF + 1) & np.uint32(0xFFFF)
        new = np.ones(len(low), bool)
        np.not_equal(low[1:], low[:-1], out=new[1:])
        new[walls[np.searchsorted(walls, base) : np.searchsorted(walls, base + len(low))] - base] = True
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(low)) - 1
        text = np.searchsorted(at, first + base, "right") - 1
        ok = first + base + LENGTH <= at[text + 1]
        first, last, text = first[ok], last[ok], text[ok]
        ends = whole[np.stack([first, last])] * _M
        ends ^= ends >> np.uint64(31)
        run = ends[0] * _A
        run += ends[1] ^ (last - first).astype(np.uint64) * _M
        run ^= run >> _S
        # Smallest ranks begin with zeros; the product, which is one to one, deals them evenly.
        yield half[low[first]] * _A, text, first + base, last + base, run * _M


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of 64-bit numbers, compressed by planes of bytes; the first one ascends and is kept as steps."""
    out = []
    for k, x in enumerate(columns):
        x = x.astype(np.uint64)
        if not k and len(x):
            x = np.concatenate([x[:1], np.diff(x)])
        out.append(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps((len(columns[0]), out)))


def _unpack(blob: bytes) -> list[np.ndarray]:
    n, columns = pickle.loads(zstandard.ZstdDecompressor().decompress(blob))
    out = [np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(8, n).T).view(np.uint64).ravel() for x in columns]
    out[0] = np.cumsum(out[0], dtype=np.uint64)
    return out


def _dealt(docs: DataFrame, n: int) -> DataFrame:
    """(block, docs): rows of packed texts. Rows that share a doc_id, or have none, are spread by their texts."""

    def dealt(batches):
        for batch in batches:
            for part in slices(batch, 1, DEAL_BYTES):
                home, ids, (data, at) = np.array(part.column(2)), part.column(0), buffers(part.column(1))
                order = np.argsort(home, kind="stable")
                names, cut = np.unique(home[order], return_index=True)
                unknown, ids, lengths = np.array(ids.is_null()), np.array(ids.fill_null(0)), np.diff(at)
                raw, begin, end = memoryview(data), at[:-1].tolist(), at[1:].tolist()
                pieces = [_squeeze((ids[x], unknown[x], lengths[x], b"".join([raw[begin[i] : end[i]] for i in x.tolist()]))) for x in np.split(order, cut[1:])]
                yield pa.record_batch([pa.array(names, pa.int32()), pa.array(pieces, pa.binary())], ["block", "docs"])

    home = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias("block")
    return docs.select("doc_id", "text", home).mapInArrow(dealt, "block int, docs binary")


def _texts(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, whether known, bytes, offsets) of a block, in the order of doc_id and text, which is the same in every round."""
    rows = []
    for blob in group.column("docs"):
        ids, unknown, lengths, raw = _unsqueeze(blob.as_buffer())
        ends = np.cumsum(lengths).tolist()
        rows += zip(unknown.tolist(), ids.tolist(), [raw[a:b] for a, b in zip([0, *ends[:-1]], ends)])
    rows.sort()
    at = np.concatenate([[0], np.cumsum([len(r[2]) for r in rows], dtype=np.int64)])
    return np.array([r[1] for r in rows], np.int64), ~np.array([r[0] for r in rows], bool), np.frombuffer(b"".join([r[2] for r in rows]), np.uint8), at


def _all(group: pa.Table):
    """All anchors of a block: (rank, doc_id, rank of the run)."""
    ids, known, data, at = _texts(group)
    found = [(g[known[t]], ids[t[known[t]]], r[known[t]]) for g, t, _, _, r in anchors(data, at)]
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found))


LIST = "bucket int, block int, list binary"


def _rows(bucket, block, lists) -> pa.Table:
    return pa.table({"bucket": pa.array(bucket, pa.int32()), "block": pa.array(block, pa.int32()), "list": pa.array(lists, pa.binary())})


class _Rounds:
    """What blocks and buckets do in each round; n_buckets and the bits of ranks that a list keeps are fixed."""

    def __init__(self, n_buckets: int, bits: int):
        self.n, self.cut = n_buckets, np.uint64(64 - bits)

    def bucket(self, g: np.ndarray) -> np.ndarray:
        return ((g >> np.uint64(32)) * np.uint64(self.n) >> np.uint64(32)).astype(np.int64)

    def split(self, g: np.ndarray) -> list[tuple[int, int, int]]:
        """(bucket, start, end) in ascending g."""
        cut = np.searchsorted(self.bucket(g), np.arange(self.n + 1))
        return [(k, a, b) for k, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if a < b]

    def short(self, g: np.ndarray) -> np.ndarray:
        return g >> self.cut << self.cut

    def list_ranks(self, group: pa.Table) -> pa.Table:
        g = np.unique(self.short(_all(group)[0]))
        parts = self.split(g)
        return _rows([k for k, _, _ in parts], [group.column("block")[0].as_py()] * len(parts), [_pack(g[a:b] >> self.cut) for _, a, b in parts])

    def answer_ranks(self, group: pa.Table) -> pa.Table:
        lists = [_unpack(x)[0] for x in group.column("list").to_pylist()]
        every = np.concatenate(lists)
        order = np.argsort(every, kind="stable")
        every = every[order]
        twin = every[1:] == every[:-1]
        again = np.zeros(len(every), bool)
        again[order[1:]] = twin
        again[order[:-1]] |= twin
        ends = np.cumsum([len(x) for x in lists]).tolist()
        bits = [np.packbits(again[a:b]).tobytes() for a, b in zip([0, *ends[:-1]], ends)]
        return _rows(group.column("bucket"), group.column("block"), bits)

    def list_runs(self, group: pa.Table, answers: pa.Table) -> pa.Table:
        g, doc, run = _all(group)
        short = self.short(g)
        names, inverse = np.unique(short, return_inverse=True)
        bits = {k: np.unpackbits(np.frombuffer(x, np.uint8)) for k, x in zip(answers.column("bucket").to_pylist(), answers.column("list").to_pylist())}
        far = np.zeros(len(names), bool)
        for k, a, b in self.split(names):
            far[a:b] = bits[k][: b - a]
        low, high = np.full(len(names), 2**63 - 1), np.full(len(names), -(2**63))
        np.minimum.at(low, inverse, doc)
        np.maximum.at(high, inverse, doc)
        keep = (far | (low < high))[inverse]
        short, doc, run = short[keep], doc[keep], run[keep]
        order = np.lexsort((doc, run, short))
        short, doc, run = short[order], doc[order], run[order]
        new = np.ones(len(order), bool)
        new[1:] = (short[1:] != short[:-1]) | (run[1:] != run[:-1])
        short, doc, run = short[new], doc[new], run[new]
        parts = self.split(short)
        return _rows([k for k, _, _ in parts], [group.column("block")[0].as_py()] * len(parts), [_pack(short[a:b] >> self.cut, run[a:b], doc[a:b]) for _, a, b in parts])

    def answer_runs(self, group: pa.Table) -> pa.Table:
        lists = [_unpack(x) for x in group.column("list").to_pylist()]
        g, run, doc = (np.concatenate(x) for x in zip(*lists))
        doc, source = doc.astype(np.int64), np.repeat(np.arange(len(lists)), [len(x[0]) for x in lists])
        order = np.lexsort((doc, run, g))
        g, run, doc, source = g[order], run[order], doc[order], source[order]
        of_g = np.ones(len(g), bool)
        of_g[1:] = g[1:] != g[:-1]
        of_run = of_g.copy()
        of_run[1:] |= run[1:] != run[:-1]
        runs = np.cumsum(of_run) - 1
        least = doc[of_run][runs]
        ranks_of = np.cumsum(of_g) - 1
        mixed = (np.bincount(ranks_of[of_run]) > 1)[ranks_of]
        ask = mixed & (doc == least)
        told = np.flatnonzero(ask | (least < doc))
        told = told[np.lexsort((run[told], source[told]))]
        ends = np.searchsorted(source[told], np.arange(len(lists)), "right").tolist()
        run, least, ask = run[told], least[told].view(np.uint64), ask[told]
        out = [_pack(run[a:b], least[a:b], ask[a:b]) for a, b in zip([0, *ends[:-1]], ends)]
        return _rows(group.column("bucket"), group.column("block"), out)

    def list_windows(self, group: pa.Table, answers: pa.Table) -> pa.Table:
        """Besides the lists, a row for the block itself: runs of bytes known to be repeated, and the windows that lists ask about."""
        block = group.column("block")[0].as_py()
        told = [_unpack(x) for x in answers.column("list").to_pylist()]
        name, least, ask = (np.concatenate(x) for x in zip(*told)) if told else (np.zeros(0, np.uint64),) * 3
        order = np.argsort(name, kind="stable")
        name, least, ask = name[order], least[order].view(np.int64), ask[order].astype(bool)
        ids, known, data, at = _texts(group)
        found = [[x[known[t]] for x in (g, t, first, last, r)] for g, t, first, last, r in anchors(data, at)]
        g, t, first, last, r = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3, np.zeros(0, np.uint64))
        doc = ids[t]
        own, inverse = np.unique(r, return_inverse=True)
        low = np.full(len(own), 2**63 - 1)
        np.minimum.at(low, inverse, doc)
        asked = np.zeros(len(own), bool)
        if len(name) and len(own):
            k = np.minimum(np.searchsorted(own, name), len(own) - 1)
            ok = own[k] == name
            np.minimum.at(low, k[ok], least[ok])
            np.logical_or.at(asked, k[ok], ask[ok])
        gone = doc > low[inverse]
        covered = np.stack([t[gone], first[gone] - at[t[gone]], last[gone] + LENGTH - at[t[gone]]])
        some = np.flatnonzero((doc == low[inverse]) & asked[inverse])
        some = some[np.argsort(g[some], kind="stable")]
        n = last[some] - first[some] + 1
        out, waiting = [], {}
        for k, a, b in self.split(g[some]):
            x = some[a:b]
            region = data[ranges(first[x], n[a:b] + LENGTH - 1)].tobytes()
            out.append((k, _squeeze((n[a:b].astype(np.uint8), doc[x], region))))
            waiting[k] = (t[x].astype(np.int32), first[x] - at[t[x]], n[a:b].astype(np.uint8))
        out.append((-1 - block, _squeeze((_merged(covered), waiting))))
        return _rows([k for k, _ in out], [block] * len(out), [x for _, x in out])

    def answer_windows(self, group: pa.Table) -> pa.Table:
        if group.column("bucket")[0].as_py() < 0:
            return group.select(["bucket", "block", "list"])
        lists = [_unsqueeze(x) for x in group.column("list").to_pylist()]
        doc = np.concatenate([np.repeat(x[1], x[0]) for x in lists])
        n, raw = [x[0].astype(np.int64) for x in lists], b"".join([x[2] for x in lists])
        inverse = _by_bytes(np.concatenate(list(_window_ranks(np.concatenate(n), raw))), n, raw)
        names = np.arange(inverse.max(initial=-1) + 1)
        least = np.full(len(names), 2**63 - 1)
        np.minimum.at(least, inverse, doc)
        bits = np.split(least[inverse] < doc, np.cumsum([x[0].sum(dtype=np.int64) for x in lists])[:-1])
        return _rows(group.column("bucket"), group.column("block"), [np.packbits(x).tobytes() for x in bits])


def _window_ranks(n: np.ndarray, raw: bytes):
    """Yield the ranks at 50 of the n windows of each of the regions that lie end to end in raw, by pieces."""
    ends = np.cumsum(n + LENGTH - 1)
    data, done = np.frombuffer(raw, np.uint8), 0
    while done < len(n):
        begin = ends[done - 1] if done else 0
        stop = max(done + 1, int(np.searchsorted(ends, begin + PIECE, "right")))
        half = ranks(data[begin : ends[stop - 1]])
        starts = np.concatenate([[0], ends[done : stop - 1] - begin]) if stop - done > 1 else np.zeros(1, np.int64)
        yield _join(half, HALF, half)[ranges(starts, n[done:stop])]
        done = stop


def _by_bytes(rank: np.ndarray, n: list[np.ndarray], raw: bytes) -> np.ndarray:
    """A number for each window, equal where the bytes are; ranks are only a first guess of what is equal."""
    n, data = np.concatenate(n), np.frombuffer(raw, np.uint8)
    at = ranges(np.cumsum(n + LENGTH - 1) - (n + LENGTH - 1), n)
    _, one, inverse = np.unique(rank, return_index=True, return_inverse=True)
    check = np.flatnonzero(one[inverse] != np.arange(len(inverse)))
    if differ(data, at[check], at[one[inverse[check]]], np.full(len(check), LENGTH)).any():
        seen: dict[bytes, int] = {}
        inverse = np.array([seen.setdefault(raw[a : a + LENGTH], len(seen)) for a in at.tolist()], np.int64)
    return inverse


def _squeeze(x) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(x))


def _unsqueeze(x):
    return pickle.loads(zstandard.ZstdDecompressor().decompress(x))


def _merged(spans: np.ndarray) -> np.ndarray:
    """(text, start, end) columns as maximal runs, ascending."""
    if not spans.shape[1]:
        return spans
    spans = spans[:, np.lexsort((spans[1], spans[0]))]
    text, start, end = spans
    far = text * (int(end.max()) + 2)
    reach = np.maximum.accumulate(far + end)
    new = np.ones(len(text), bool)
    new[1:] = (far + start)[1:] > reach[:-1]
    begin = np.flatnonzero(new)
    return np.stack([text[begin], start[begin], reach[np.append(begin[1:], len(text)) - 1] - far[begin]])


def repeats(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs(doc_id, text)."""
    return _spans(docs, block_bytes, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", _digest)


def strip_repeats(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, kept (the bytes that are left), spans (the removed runs as start and end) for every row of docs."""
    return _spans(docs, block_bytes, "doc_id long, kept binary, spans array<struct<start:long,end:long>>", _kept)


def _left(raw: bytes, spans: list) -> bytes:
    out, done = [], 0
    for a, b in spans:
        out.append(raw[done:a])
        done = b
    return b"".join([*out, raw[done:]])


def _digest(raw: bytes, spans: list) -> tuple:
    return len(raw), sum(b - a for a, b in spans), len(spans), hashlib.sha256(_left(raw, spans)).hexdigest()


def _kept(raw: bytes, spans: list) -> tuple:
    return _left(raw, spans), [{"start": a, "end": b} for a, b in spans]


def _spans(docs: DataFrame, block_bytes: int, schema: str, told) -> DataFrame:
    total = text_bytes(docs)
    n = max(1, -(-total // block_bytes))
    rounds = _Rounds(max(min(n, FEW), -(-n // BUCKET_BLOCKS)), min(64, total.bit_length() + 14))
    dealt = _dealt(docs, n)
    types = pa.schema([])
    arrow = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<struct<start:long,end:long>>": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))}
    for field in schema.split(", "):
        types = types.append(pa.field(field.split(" ")[0], arrow[field.split(" ")[1]]))

    def ended(group: pa.Table, answers: pa.Table) -> pa.Table:
        ids, known, data, at = _texts(group)
        covered, waiting, bits = np.zeros((3, 0), np.int64), {}, {}
        for k, blob in zip(answers.column("bucket").to_pylist(), answers.column("list").to_pylist()):
            if k < 0:
                covered, waiting = _unsqueeze(blob)
            else:
                bits[k] = np.unpackbits(np.frombuffer(blob, np.uint8)).astype(bool)
        more = []
        for k, (t, p, n) in waiting.items():
            n = n.astype(np.int64)
            hit = bits[k][: n.sum()]
            t, p = np.repeat(t.astype(np.int64), n)[hit], ranges(p, n)[hit]
            more.append(np.stack([t, p, p + LENGTH]))
        spans = _merged(np.concatenate([covered, *more], 1))
        cut = np.searchsorted(spans[0], np.arange(len(ids) + 1))
        raw = data.tobytes()
        rows = [told(raw[at[i] : at[i + 1]], list(zip(spans[1, a:b].tolist(), spans[2, a:b].tolist()))) for i, (a, b) in enumerate(zip(cut[:-1], cut[1:]))]
        columns = [pa.array(ids, mask=~known), *[pa.array([r[k] for r in rows], types.field(k + 1).type) for k in range(len(types) - 1)]]
        return pa.Table.from_arrays(columns, schema=types)

    # Spark counts a function's arguments, and would count those of a bound method wrongly: hence the lambdas.
    one = dealt.groupBy("block").applyInArrow(lambda t: rounds.list_ranks(t), LIST).groupBy("bucket").applyInArrow(lambda t: rounds.answer_ranks(t), LIST)
    two = dealt.groupBy("block").cogroup(one.groupBy("block")).applyInArrow(lambda t, a: rounds.list_runs(t, a), LIST).groupBy("bucket").applyInArrow(lambda t: rounds.answer_runs(t), LIST)
    three = dealt.groupBy("block").cogroup(two.groupBy("block")).applyInArrow(lambda t, a: rounds.list_windows(t, a), LIST).groupBy("bucket").applyInArrow(lambda t: rounds.answer_windows(t), LIST)
    return dealt.groupBy("block").cogroup(three.groupBy("block")).applyInArrow(ended, schema)
