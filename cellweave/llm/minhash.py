"""MinHash near-duplicate detection by an inverted join on signature coordinates.

A signature has COORDINATES coordinates, each the smallest of one mix of the text's shingle
hashes. Texts of the same words in the same order form one class (by SHA-256 of the words), and
one document of each class is posted under every pair of coordinate and value. Two texts of the
least similarity agree in `least_matches` coordinates or more, but for one pair in a million;
pairs above that threshold are confirmed on their full shingle sets, word by word.

1. Postings are counted. Values that one class holds alone make no pairs, and a class with fewer
   other values than the threshold has no partner.
2. Prefix: two classes that agree in t of k coordinates share one of the k - t + 1 rarest values
   of each. Only those are merged; the frequent rest are skipped and counted by comparing the
   signatures of the pairs that the prefixes give.
3. Each merged list links its members to its first one. Confirmed links make components.
4. Lists that still hold members of different components are merged member by member: short ones
   by a join, long ones in blocks, in which collisions are counted in place. Only pairs above the
   threshold leave a block, and of these only such as their parity sketches allow (a bound).

Words are runs of bytes other than ASCII white space, lower-cased in A-Z. A text's set is
that of its distinct shingles of three words; with fewer words, the whole sequence as one.

Cases: a null, empty or white text has an empty set, links to nothing and is its own
component; rows without a doc_id link to nothing, have no component and are kept; repeated rows
share a component; of rows that repeat a doc_id with different texts each may link, and the
links count for all of them; an empty table gives an empty result; other columns are ignored (and
preserved by `drop_copies`). Whole texts are read.
"""

from __future__ import annotations

import hashlib
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import buffers, distinct, grams, lower_ascii, mix, ranges, run_hashes, settle, slices, words

COORDINATES = 64
SHINGLE_WORDS, PERCENT = 3, 85
#: Probability that a pair of the least similarity stays below the match threshold.
MISS = 1e-6
#: 64-bit words of a text's parity sketch.
SKETCH = 16
#: A merged list of more members is long; members in a block of a long list, about.
LONG_LIST, BLOCK_ROWS = 64, 1024
#: Documents to confirm are picked by a broadcast of their ids up to so many (8 bytes each), by a join beyond.
PICKED = 250_000

_A = np.random.default_rng(11).integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = np.random.default_rng(12).integers(0, 1 << 63, COORDINATES, dtype=np.uint64)


def least_matches(percent: int, miss: float = MISS) -> int:
    """The most coordinates that two sets of that similarity agree in but for a share `miss` of pairs."""
    p, below = percent / 100, 0.0
    for t in range(COORDINATES + 1):
        below += comb(COORDINATES, t) * p**t * (1 - p) ** (COORDINATES - t)
        if below > miss:
            return max(1, t)
    return COORDINATES


def shingles(data: np.ndarray, at: np.ndarray, n: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, hash, text) of the distinct shingles of each text, ordered by text and code.

    Codes are made of the numbers of the words, which are told apart by their bytes: within one
    call, equal codes are equal shingles. Hashes are the same in every call.
    """
    data = lower_ascii(data)
    starts, ends, first = words(data, at)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashes = run_hashes(data, starts, ends)
    which, _ = distinct(data, starts, ends, hashes)
    found, i = grams(hashes, first, n)
    owner = np.searchsorted(first, i, "right") - 1
    parts = [which[i + k] for k in range(n)]
    none = int(which.max()) + 1  # stands for the words that a short text lacks
    for k in range(1, n):  # texts of k words
        short = np.flatnonzero(np.diff(first) == k)
        if len(short):
            h = np.full(len(short), k, np.uint64)
            for j in range(k):
                h = mix(h * np.uint64(0xD6E8FEB86659FD93) + hashes[first[short] + j])
            found, owner = np.append(found, h), np.append(owner, short)
            parts = [np.append(x, which[first[short] + j] if j < k else np.full(len(short), none)) for j, x in enumerate(parts)]
    code, used, bits = parts[0].astype(np.uint64), none.bit_length(), none.bit_length()
    for x in parts[1:]:
        if used + bits > 64:
            code = np.unique(code, return_inverse=True)[1].astype(np.uint64)
            used = len(code).bit_length()
        code, used = code << np.uint64(bits) | x.astype(np.uint64), used + bits
    if used + len(at).bit_length() <= 64:
        order = np.argsort(owner.astype(np.uint64) << np.uint64(used) | code)
    else:
        order = np.lexsort((code, owner))
    code, owner = code[order], owner[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])
    return code[new], found[order][new], owner[new]


def sequences(data: np.ndarray, at: np.ndarray) -> list[bytes]:
    """SHA-256 of the words of each text, lower-cased, one space after each."""
    data = np.append(lower_ascii(data), np.uint8(32))
    starts, ends, first = words(data[:-1], at)
    lengths = ends - starts + 1
    stops = np.concatenate([[0], np.cumsum(lengths)])
    flat = data[ranges(starts, lengths)]
    flat[stops[1:] - 1] = 32
    raw, cut = flat.tobytes(), stops[first].tolist()
    return [hashlib.sha256(raw[a:b]).digest() for a, b in zip(cut[:-1], cut[1:])]


def signatures(docs: DataFrame, n: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, n_shingles, class (null if the set is empty), keys (a token of each coordinate and its value), odd.

    Bit k of odd says whether an odd number of the set's hashes fall on k. The sketches of two
    sets differ in at most as many bits as the sets differ in members.
    """

    def made(batches):
        for batch in batches:
            for part in slices(batch):
                data, at = buffers(part.column(1))
                _, found, owner = shingles(data, at, n)
                size = np.bincount(owner, minlength=part.num_rows)
                full = np.flatnonzero(size)
                keys = np.zeros((part.num_rows, COORDINATES), np.int64)
                if len(full):
                    cut = np.concatenate([[0], np.cumsum(size[full])[:-1]])
                    for c in range(COORDINATES):
                        keys[full, c] = mix(np.minimum.reduceat(found * _A[c] + _B[c], cut) + np.uint64(c) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)
                bits = np.bincount(owner * (64 * SKETCH) + (found % np.uint64(64 * SKETCH)).astype(np.int64), minlength=part.num_rows * 64 * SKETCH) & 1
                odd = np.packbits(bits.astype(bool)).view(np.int64)
                sketches = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * SKETCH, pa.int32()), pa.array(odd, pa.int64()))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * COORDINATES, pa.int32()), pa.array(keys.ravel(), pa.int64()))
                names = pa.array([x if k else None for x, k in zip(sequences(data, at), size.tolist())], pa.binary())
                yield pa.record_batch([part.column(0), pa.array(size.astype(np.int64)), names, lists, sketches], ["doc_id", "n_shingles", "class", "keys", "odd"])

    return docs.select("doc_id", "text").mapInArrow(made, "doc_id long, n_shingles long, class binary, keys array<long>, odd array<long>")


def confirm(pairs: DataFrame, docs: DataFrame, n: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """Those of pairs(a, b) whose texts have 100 * intersection >= percent * union."""
    ids = settle(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    texts = docs.select("doc_id", "text")
    if ids.count() <= PICKED:
        texts = texts.join(F.broadcast(ids), "doc_id", "left_semi")
    texts = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    joined = pairs.join(texts, "a").select("a", "b", "ta").join(texts.select(F.col("a").alias("b"), F.col("ta").alias("tb")), "b").select("a", "b", "ta", "tb")

    def confirmed(batches):
        for batch in batches:
            for part in slices(batch, 2):
                rows = part.num_rows
                (da, ta), (db, tb) = buffers(part.column(2)), buffers(part.column(3))
                code, _, owner = shingles(np.concatenate([da, db]), np.concatenate([ta, tb[1:] + len(da)]), n)
                own = owner % rows
                size = np.bincount(own, minlength=rows)  # of both sets
                order = np.lexsort((code, own))
                code, own = code[order], own[order]
                both = np.bincount(own[1:][(code[1:] == code[:-1]) & (own[1:] == own[:-1])], minlength=rows)
                ok = pa.array((100 * both >= percent * (size - both)) & (both > 0))
                yield pa.record_batch([part.column(0).filter(ok), part.column(1).filter(ok)], ["a", "b"])

    return joined.mapInArrow(confirmed, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of links(a, b): the smallest node that can be reached, for every node with a link.

    Alternates large and small stars (every node's neighbours are linked to its smallest one)
    until nothing changes; a round halves the depth at least, and no node's links are gathered.
    """
    edges = settle(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct()
        edges = settle(small)
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _alike(a: str, b: str, percent: int):
    """Whether the sizes allow a similarity of percent."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def counted(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Those of pairs(a, b) of classes whose signatures agree in enough coordinates and whose sketches allow the similarity."""
    own = classes.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("keys").alias("ka"), F.col("odd").alias("oa"))
    other = classes.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("keys").alias("kb"), F.col("odd").alias("ob"))
    differ = sum((F.bit_count(F.get("oa", F.lit(k)).bitwiseXOR(F.get("ob", F.lit(k)))) for k in range(SKETCH)), F.lit(0))
    near = differ * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent)
    joined = pairs.join(own, "a").join(other, "b").where(_alike("na", "nb", percent) & near)
    return joined.where(F.size(F.array_intersect("ka", "kb")) >= least_matches(percent)).select("a", "b")


def in_blocks(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different roots above the match threshold, of lists of members(token, rep, n, root, length, keys, odd).

    A list's members are dealt to blocks, and every two blocks meet in one group, so that memory is
    bounded however long a list is.
    """
    least = least_matches(percent)
    blocks = F.ceil(F.col("length") / BLOCK_ROWS).cast("int")
    own = members.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})

    def compared(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        keys = np.array(group.column("keys").combine_chunks().flatten()).reshape(-1, COORDINATES)
        odd = np.array(group.column("odd").combine_chunks().flatten()).reshape(-1, SKETCH)
        rep, n, root, own = (np.array(group.column(c)) for c in ("rep", "n", "root", "own"))
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        x, y = np.flatnonzero(own == i), np.flatnonzero(own == j)
        count = np.zeros((len(x), len(y)), np.uint8)
        for c in range(COORDINATES):
            count += keys[x, c][:, None] == keys[y, c]
        p, q = np.nonzero((count >= least) & (root[x][:, None] != root[y]))
        p, q = x[p], y[q]
        ok = (rep[p] < rep[q]) | (i != j)
        ok &= np.minimum(n[p], n[q]) * 100 >= np.maximum(n[p], n[q]) * percent
        p, q = p[ok], q[ok]
        bits = np.bitwise_count(odd[p] ^ odd[q]).sum(1, dtype=np.int64)
        ok = bits * (100 + percent) <= (n[p] + n[q]) * (100 - percent)
        a, b = rep[p[ok]], rep[q[ok]]
        return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

    return met.select("token", "i", "j", "own", "rep", "n", "root", "keys", "odd").groupBy("token", "i", "j").applyInArrow(compared, "a long, b long")


def link(docs: DataFrame, n: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs."""
    signed = settle(signatures(docs, n))
    classes = settle(signed.where("class is not null and doc_id is not null").groupBy("class").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"), F.first("odd").alias("odd")))
    least = least_matches(percent)
    prefix = COORDINATES - least + 1
    posts = classes.select("rep", F.explode("keys").alias("token"))
    often = settle(posts.groupBy("token").agg(F.count("*").alias("times")).where("times > 1"))
    # Values that are held alone come first in a prefix and make no pairs, so that the shared ones fill what they leave.
    shared = posts.join(often, "token").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("times", "token"))).alias("t")).where(F.size("t") >= least)
    merged = shared.select("rep", F.explode(F.slice("t", 1, F.greatest(F.size("t") - (least - 1), F.lit(1)))).alias("p")).select("rep", F.col("p.token").alias("token"))
    merged = settle(merged.join(classes.select("rep", "n"), "rep"))
    lists = settle(merged.groupBy("token").agg(F.min(F.struct("rep", "n")).alias("hub"), F.count("*").alias("length")).where("length > 1"))
    # Written tables on both sides let Spark split a long list's join among tasks.
    merged = settle(merged.join(lists, "token").select("token", "rep", "n", "length", "hub"))
    stars = merged.where(F.col("rep") != F.col("hub.rep")).where(_alike("n", "hub.n", percent)).select(F.col("hub.rep").alias("a"), F.col("rep").alias("b")).distinct()
    stars = settle(counted(stars, classes, percent))
    links = settle(confirm(stars, docs, n, percent))
    roots = components(links)

    tagged = merged.select("token", "rep", "n", "length").join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    mixed = settle(tagged.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("token"))
    left = settle(tagged.join(mixed, "token"))
    short = left.where(F.col("length") <= LONG_LIST).select("token", "rep", "n", "root")
    other = short.select("token", F.col("rep").alias("b"), F.col("n").alias("m"), F.col("root").alias("other"))
    pairs = short.withColumnRenamed("rep", "a").join(other, "token").where((F.col("a") < F.col("b")) & (F.col("root") != F.col("other"))).where(_alike("n", "m", percent))
    pairs = counted(pairs.select("a", "b").distinct(), classes, percent)
    long = left.where(F.col("length") > LONG_LIST)
    if not long.isEmpty():
        pairs = pairs.union(in_blocks(long.join(classes.select("rep", "keys", "odd"), "rep"), percent)).distinct()
    pairs = settle(pairs.join(stars, ["a", "b"], "left_anti"))
    more = settle(confirm(pairs, docs, n, percent))
    if not more.isEmpty():
        roots = components(links.union(more))
    roots = classes.select("class", "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("class", F.coalesce("root", "rep").alias("root"))
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("root", "doc_id"))
    return (
        signed.select("doc_id", "n_shingles", "class").join(roots, "class", "left")
        .select("doc_id", "n_shingles", component.alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def drop_copies(docs: DataFrame, n: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that `link` keeps, with all their columns; rows that repeat a doc_id stay or go together."""
    gone = link(docs, n, percent).where(~F.col("kept")).select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti")
    return left.select(*docs.columns)
