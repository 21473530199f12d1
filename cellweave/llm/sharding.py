"""Sharding by sampled splitters, with DataFrame functions only.

Keys are (md5 of the text, doc_id, ordinal of the row), so equal texts lie side by side and no two
rows are the same. A size-weighted sample of keys gives quantile boundaries; records are dealt to
the ranges between them, and ranges that come out with too many rows are divided again by
splitters drawn inside them, so that the number of ranges grows with the rows. Within each range
a running sum gives every record its place in the order of all bytes; the place decides the shard.
A group of equal texts that holds a third of all rows is cut at as many splitters as its weight
asks for, by doc_id and ordinal.

Cases: a null text has size 1 and the crc32 of no bytes; a null doc_id sorts first; repeated
rows are told apart by no column and may take any order among themselves (each gets its own
slot); an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import settle

#: Boundaries of the first round and samples for each; rows of a range that isn't divided, and parts of one that is at most.
RANGES, OVERSAMPLE = 64, 16
RANGE_ROWS, PARTS = 500_000, 256


def _before(parts, key):
    """How many splitters of a sorted array are at or below the row's key."""
    return F.size(F.filter(parts, lambda s: s <= key))


def _splitters(sample: DataFrame, n: Column) -> DataFrame:
    """(g, splits): for each group g of sample(g, n, key) about n - 1 quantiles of its keys."""
    keys = F.sort_array(F.collect_list("key"))
    step = F.greatest(F.lit(1), F.floor(F.size("keys") / F.col("n")).cast("int"))
    picked = F.filter("keys", lambda x, i: (i > 0) & (i % step == 0))
    return sample.groupBy("g").agg(keys.alias("keys"), F.max(n).alias("n")).select("g", picked.alias("splits"))


def shard(docs: DataFrame, shards: int = 8, ranges: int = RANGES, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Deal all rows of docs(doc_id, text, ...) to shards 0 to shards-1 of near equal bytes.

    The law is ``bytes``: a row goes to the shard in which its first byte falls when all rows
    are laid end to end in key order, so that shards differ by the size of one record at most.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.struct(F.md5(text.cast("binary")).alias("k"), F.col("doc_id").alias("d"), F.monotonically_increasing_id().alias("o"))
    # The texts are read once; what follows reads keys and sizes, in which ordinals are fixed.
    keys = settle(docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), key.alias("key")))
    n, total = keys.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    chance = F.xxhash64(F.lit(7), "key").bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)
    # Half of the draws by size and half by count, so that neither rows nor bytes pile up; ranges * OVERSAMPLE are drawn on average.
    draws = ranges * OVERSAMPLE / 2
    drawn = keys.where(chance < F.col("size") * (draws / max(total, 1)) + draws / max(n, 1))
    first = F.broadcast(_splitters(drawn.select(F.lit(0).alias("g"), F.lit(ranges).alias("n"), "key"), F.col("n")))
    dealt = settle(keys.join(first, F.col("g") == 0, "left").withColumn("r", F.coalesce(_before("splits", F.col("key")), F.lit(0))).select(*keys.columns, "r"))
    counted = dealt.groupBy("r").agg(F.count("*").alias("n"), F.sum("size").alias("b"))
    parts = F.least(F.lit(PARTS), F.ceil(F.greatest(F.col("n") / range_rows, F.col("b") * F.lit(ranges / max(total, 1)) / 2)).cast("int"))
    over = F.broadcast(counted.select("r", F.col("n").alias("rows"), "b", parts.alias("parts")).where("parts > 1"))  # a row for each of the ranges
    inside = F.col("parts") * (OVERSAMPLE / 2)
    drawn = dealt.join(over, "r").where(chance < inside * F.col("size") / F.col("b") + inside / F.col("rows"))
    second = _splitters(drawn.select(F.col("r").alias("g"), F.col("parts").alias("n"), "key"), F.col("n"))  # at most ranges rows of PARTS splitters
    dealt = dealt.join(F.broadcast(second.withColumnRenamed("g", "r")), "r", "left").withColumn("s", F.coalesce(_before("splits", F.col("key")), F.lit(0))).drop("splits")
    sums = dealt.groupBy("r", "s").agg(F.count("*").alias("n"), F.sum("size").alias("b"))
    upto = W.orderBy("r", "s").rowsBetween(W.unboundedPreceding, -1)  # a row for each range: few
    bases = sums.select("r", "s", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("n0"), F.coalesce(F.sum("b").over(upto), F.lit(0)).alias("b0"))
    order = W.partitionBy("r", "s").orderBy("key")
    placed = (
        dealt.withColumn("i", F.row_number().over(order) - 1)
        .withColumn("before", F.coalesce(F.sum("size").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .join(F.broadcast(bases), ["r", "s"])  # at most ranges * PARTS rows
        .select("doc_id", "size", "text_crc32", (F.col("n0") + F.col("i")).alias("rank"), F.least(F.floor((F.col("b0") + F.col("before")) * shards / F.lit(max(total, 1))), F.lit(shards - 1)).cast("int").alias("shard"))
    )
    firsts = placed.groupBy("shard").agg(F.min("rank").alias("first"))
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") - F.col("first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
