"""Rendezvous hashing of stable record keys over weighted shards.

Every shard draws a number from the record's key and the shard's own number alone; the least
-ln(u) / weight wins. A new shard can only win records for itself, a lost one only gives its own away,
and shares follow the weights. Positions inside a shard are counted in hash order over buckets of
bounded size, so neither a hot key nor a large shard ends in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwright.llm.common import running_total
from barwright.session import materialize


def _draw(key: Column, shard: int) -> Column:
    """A number in (0, 1) from the first 52 bits of the MD5 of key and shard."""
    digits = F.substring(F.md5(F.concat(key, F.lit(f"/{shard}")).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(2**52)


def shard_of(key: Column, weights: list[float]) -> Column:
    """The winning shard, 0 to len(weights) - 1; a null key counts as the empty text."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    bids = [F.struct((-F.log(_draw(text, s)) / F.lit(float(w))).alias("bid"), F.lit(s).alias("shard")) for s, w in enumerate(weights) if w > 0]
    if not bids:
        raise ValueError("no shard has a weight above zero")
    return F.array_min(F.array(*bids))["shard"]


def place(docs: DataFrame, weights: list[float], grown: list[float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot, grown_shard) for every row.

    size is UTF-8 bytes of the text plus one, a null text counts as empty. slot counts from zero without
    gaps in each shard, in order of the key's MD5, then id, size and checksum. Equal rows are counted first
    and get neighbouring slots, so that a row repeated very often is no hot key.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    counted = rows.groupBy("id", "size", "text_crc32").agg(F.count("*").alias("n"))
    key = F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary"))
    high = F.conv(F.substring(key, 1, 15), 16, 10).cast("long")
    placed = counted.select(
        "*",
        shard_of(F.col("id"), weights).alias("shard"),
        shard_of(F.col("id"), grown).alias("grown_shard"),
        F.shiftleft(high, 4).bitwiseXOR(F.lit(-(2**63))).alias("order"),
    )
    slots = running_total(materialize(placed, "shards"), "shard", "order", ["id", "size", "text_crc32"], "n", "first")
    blocks = slots.withColumn("block", F.explode(F.expr("sequence(0L, (n - 1) div 1000)")))
    out = blocks.withColumn("step", F.explode(F.expr("sequence(block * 1000, least(n, block * 1000 + 1000) - 1)")))
    return out.select("id", "size", "text_crc32", "shard", (F.col("first") + F.col("step")).alias("slot"), "grown_shard")
