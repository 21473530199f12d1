"""Byte-level BPE by a global shuffle of distinct words.

Texts are dealt to blocks of bounded size. Each block lists its distinct pre-tokens,
dealt to buckets by the word (positions stay in the block, where the text is, so that a word
costs one entry for each block and not one for each occurrence); a bucket meets each of its
words from all blocks, encodes every distinct one once and sends the ids back; each block
joins them to its pre-tokens by word and puts its texts together by position. Decoding joins
the token-byte table to the ids. Blocks and lists travel packed and compressed.

Words are told apart by their bytes everywhere. Their hashes only order the lists and choose
the buckets.

Cases: a null text counts as empty, an empty text has no ids and the hashes of the empty
string; repeated rows give a row each; an empty table gives an empty result; other columns of
the input are ignored. Long texts are split and joined as a whole, with no limit of length.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import buffers, distinct, packed, packed_numbers, ranges, run_hashes, slices, text_bytes, unpacked, unpacked_numbers

#: UTF-8 bytes of text for each block, and for each bucket of words, about.
BLOCK_BYTES, BUCKET_BYTES = 12 << 20, 24 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


#: The pattern that `pretokens` follows without a regular expression.
CLASSIC = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of text that are split at a time.
PIECE = 1 << 20


@lru_cache
def _kinds() -> np.ndarray:
    """Of each code point: 1 letter, 2 number, 3 white space, 0 any other."""
    import regex

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    out = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((1, r"\p{L}"), (2, r"\p{N}"), (3, r"\s")):
        out[np.frombuffer("".join(regex.findall(pattern, every)).encode("utf-32-le"), np.uint32)] = kind
    return out


def _classic(data: np.ndarray, at: np.ndarray, text: str) -> np.ndarray:
    """Byte positions where the matches of CLASSIC begin, texts one after the other.

    A match begins where the kind of character changes, but a space goes with what follows it,
    a run of white space before other text leaves its last character to itself, and a
    contraction at the beginning of a match ends after its letters.
    """
    cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    n, lead = len(cp), np.flatnonzero((data & 0xC0) != 0x80)
    kind = _kinds()[cp]
    edge = np.zeros(n + 1, bool)
    edge[np.searchsorted(lead, at)] = True
    change = edge[:n].copy()
    change[1:] |= kind[1:] != kind[:-1]
    white = kind == 3
    glued = np.zeros(n, bool)  # after a space of the same text
    glued[1:] = (cp[:-1] == 32) & ~edge[1:n]
    ending = np.zeros(n, bool)  # white space before other text
    ending[:-1] = ~white[1:] & ~edge[1:n]
    start = np.where(white, change | ending, change & ~(glued & ~white))
    quote = np.flatnonzero((cp == 39) & start)
    padded, walls = np.append(cp, [0, 0, 0]), np.append(edge, [True, True])
    one, two = padded[quote + 1], padded[quote + 2]
    inside = ~walls[quote + 1]
    short = quote[inside & np.isin(one, np.array([ord(c) for c in "stmd"], np.uint32))]
    pair = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    long = quote[inside & ~walls[quote + 2] & pair]
    start = np.append(start, [False] * 3)
    start[short + 1] = False
    start[long + 1] = False
    start[long + 2] = False
    start[short + 2] = True
    start[long + 3] = True
    return lead[np.flatnonzero(start[:n])]


def pretokens(data: np.ndarray, at: np.ndarray, pattern: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The matches of the pattern in each text, which cover it: (starts, ends, first match of each text) in bytes."""
    raw = data.tobytes()
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        text = None
    if pattern == CLASSIC and text is not None:
        starts = _classic(data, at, text) if len(data) else np.zeros(0, np.int64)
    else:
        import regex

        find, found = regex.compile(pattern).findall, []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            for w in find(raw[a:b].decode("utf-8", "replace")):
                found.append(a)
                a += len(w.encode())
        starts = np.array(found, np.int64)
    return starts, np.append(starts[1:], len(data)), np.searchsorted(starts, at)


def _word_list(raw: list[bytes]) -> bytes:
    lengths = np.array([len(w) for w in raw], np.uint32)
    return zstandard.ZstdCompressor(level=3).compress(np.uint32(len(raw)).tobytes() + lengths.tobytes() + b"".join(raw))


def _listed_words(blob: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    ends = 4 + 4 * n + np.cumsum(np.frombuffer(raw, np.uint32, n, 4), dtype=np.int64)
    return [raw[a:b] for a, b in zip([4 + 4 * n, *ends[:-1].tolist()], ends.tolist())]


def blocks(docs: DataFrame, n: int) -> DataFrame:
    """(block, docs): rows of packed (doc_id, text). Rows that share a doc_id, or have none, are spread by their texts."""

    def dealt(batches):
        for batch in batches:
            for part in slices(batch):
                home = np.array(part.column(2))
                order = np.argsort(home, kind="stable")
                names, cut = np.unique(home[order], return_index=True)
                pieces = np.split(order, cut[1:])
                yield pa.record_batch([pa.array(names, pa.int32()), pa.array([packed(part.take(pa.array(i)).select(["doc_id", "text"])) for i in pieces], pa.binary())], ["block", "docs"])

    home = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias("block")
    return docs.select("doc_id", "text", home).mapInArrow(dealt, "block int, docs binary")


def _pieces(group: pa.Table, pattern: str, seen: dict[bytes, int], hashes: list[int]):
    """Yield (doc_ids, number of each match's word, first match of each text) of a block's texts, by pieces.

    Words are numbered in seen as they come; hashes takes the hash of each new one.
    """
    table = pa.Table.from_batches([b for blob in group.column("docs") for b in unpacked(blob.as_buffer())])
    for batch in table.combine_chunks().to_batches():
        for part in slices(batch, 1, PIECE):
            data, at = buffers(part.column(1))
            starts, ends, first = pretokens(data, at, pattern)
            own = run_hashes(data, starts, ends)
            which, one = distinct(data, starts, ends, own)
            raw, numbers = data.tobytes(), []
            for h, a, b in zip(own[one].tolist(), starts[one].tolist(), ends[one].tolist()):
                k = seen.setdefault(raw[a:b], len(seen))
                if k == len(hashes):
                    hashes.append(h)
                numbers.append(k)
            yield part.column(0), np.array(numbers, np.int32)[which], first


def _ordered(words: list[bytes], hashes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(order of words by hash and bytes, their hashes in that order): the same however the words were come by."""
    every = np.array(hashes, np.uint64)
    order = np.argsort(every, kind="stable")
    every = every[order]
    tied = np.flatnonzero(every[1:] == every[:-1])
    if len(tied):
        order = np.array(sorted(order.tolist(), key=lambda k: (hashes[k], words[k])), np.int64)
    return order, every


class _Ragged:
    """Byte strings end to end, from which many can be picked at once."""

    def __init__(self, rows: list[bytes]):
        self.data, self.lengths = np.frombuffer(b"".join(rows), np.uint8), np.array([len(r) for r in rows], np.int64)
        self.at = np.cumsum(self.lengths) - self.lengths

    def texts(self, index: np.ndarray, first: np.ndarray) -> list[bytes]:
        """For each text the strings of its matches, joined; index has a row for each match."""
        n = self.lengths[index]
        ends = np.concatenate([[0], np.cumsum(n)])[first]
        raw = self.data[ranges(self.at[index], n)].tobytes()
        return [raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def encode(docs: DataFrame, vocabulary: str, pattern: str, digests: bool = False, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Encode and decode every text: doc_id, ids array<int>, decoded binary, or, with digests, doc_id, n_tokens, ids_sha256, decoded_sha256."""
    total = text_bytes(docs)
    n_blocks, n_buckets = max(1, -(-total // block_bytes)), max(1, -(-total // bucket_bytes))
    dealt = blocks(docs, n_blocks)

    def buckets(hashes: np.ndarray) -> list[tuple[int, int, int]]:
        """(bucket, start, end) in ascending hashes: the order in which a block asks and is answered."""
        cut = np.searchsorted((hashes >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32), np.arange(n_buckets + 1))
        return [(k, a, b) for k, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())) if a < b]

    def listed(group: pa.Table) -> pa.Table:
        seen: dict[bytes, int] = {}
        hashes: list[int] = []
        for _ in _pieces(group, pattern, seen, hashes):
            pass
        words = list(seen)
        order, every = _ordered(words, hashes)
        order, parts = order.tolist(), buckets(every)
        home = group.column("block")[0].as_py()
        lists = [_word_list([words[k] for k in order[a:b]]) for _, a, b in parts]
        return pa.table({"bucket": pa.array([k for k, _, _ in parts], pa.int32()), "block": pa.array([home] * len(parts), pa.int32()), "words": pa.array(lists, pa.binary())})

    def answered(group: pa.Table) -> pa.Table:
        import tiktoken

        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=load_ranks(vocabulary), special_tokens={})
        known: dict[bytes, list[int]] = {}
        replies = []
        for blob in group.column("words"):
            ids = []
            for w in _listed_words(blob.as_py()):
                if w not in known:
                    known[w] = encoding._encode_single_piece(w)
                ids.append(known[w])
            replies.append(packed_numbers([len(x) for x in ids], [i for x in ids for i in x]))
        return pa.table({"bucket": group.column("bucket"), "block": group.column("block"), "ids": pa.array(replies, pa.binary())})

    words = dealt.groupBy("block").applyInArrow(listed, "bucket int, block int, words binary")
    replies = words.groupBy("bucket").applyInArrow(answered, "bucket int, block int, ids binary")
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "doc_id long, ids array<int>, decoded binary"

    def reassembled(group: pa.Table, replies: pa.Table) -> pa.Table:
        token = {rank: raw for raw, rank in load_ranks(vocabulary).items()}
        seen: dict[bytes, int] = {}
        hashes: list[int] = []
        pieces = list(_pieces(group, pattern, seen, hashes))
        order, every = _ordered(list(seen), hashes)
        place = np.zeros(len(order), np.int64)
        place[order] = np.arange(len(order))
        del seen, hashes
        replied = dict(zip(replies.column("bucket").to_pylist(), replies.column("ids").to_pylist()))
        ids: list[list[int]] = []
        for k, _, _ in buckets(every):
            lengths, flat = unpacked_numbers(replied.pop(k))
            flat, ends = flat.tolist(), np.cumsum(lengths, dtype=np.int64).tolist()
            ids += [flat[a:b] for a, b in zip([0, *ends[:-1]], ends)]
        count = np.array([len(x) for x in ids], np.int64)
        raw = _Ragged([b"".join([token[i] for i in x]) for x in ids])
        shown = _Ragged([b"".join([b"%d," % i for i in x]) if digests else np.array(x, np.int32).tobytes() for x in ids])
        out: list[list] = [[], [], [], []]
        for doc_ids, numbers, first in pieces:
            at = place[numbers]
            out[0].append(doc_ids)
            out[1].append(np.diff(np.concatenate([[0], np.cumsum(count[at])])[first]))
            coded, decoded = shown.texts(at, first), raw.texts(at, first)
            out[2] += [hashlib.sha256(x[:-1]).hexdigest() for x in coded] if digests else coded
            out[3] += [hashlib.sha256(x).hexdigest() for x in decoded] if digests else decoded
        doc_ids = pa.chunked_array(out[0], pa.int64())
        if digests:
            return pa.table({"doc_id": doc_ids, "n_tokens": pa.array(np.concatenate(out[1]), pa.int64()), "ids_sha256": pa.array(out[2], pa.string()), "decoded_sha256": pa.array(out[3], pa.string())})
        ends = pa.array(np.concatenate([[0], np.cumsum(np.concatenate(out[1]))]), pa.int32())
        lists = pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(out[2]), np.int32)))
        return pa.table({"doc_id": doc_ids, "ids": lists, "decoded": pa.array(out[3], pa.binary())})

    return dealt.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(reassembled, schema)
