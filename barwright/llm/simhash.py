"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most two bits have a common neighbour within one bit of each. So
every distinct fingerprint emits itself and its 64 one-bit variants, the variants are shuffled, and
whatever meets on a variant is a pair. A variant can meet at most 65 different fingerprints, whatever
the data; the flipped bits of all of them fit in one long, so the bucket is a hash aggregate of fixed
size and no bucket is ever collected. Copies are folded into one fingerprint first.

``representatives`` keeps one document of each group.

Nulls and texts without words have fingerprint zero; a null id takes part and never becomes the least id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwright.llm.common import lower_words
from barwright.llm.components import connected_components
from barwright.session import materialize

def shingle_digests(text: str | None, shingle: int) -> bytes:
    """XXH64 (seed 42, big-endian) of each shingle in turn; fewer words make one shingle, none make none."""
    words = lower_words(text)
    if not words:
        return b""
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_digest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_digest
    spans = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())
    return b"".join([digest(joined[i:j], 42) for i, j in spans])


def bit_margins(hashes: np.ndarray, step: int = 1 << 15) -> np.ndarray:
    """Per bit, most significant first: hashes that have it less those that don't."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), step):
        part = hashes[i : i + step].astype(">u8").view(np.uint8).reshape(-1, 8)
        bits = np.unpackbits(part, axis=1)
        full = len(bits) // 255 * 255  # sums of 255 bits fit in a byte, which numpy adds many at a time
        ones += bits[full:].sum(0, dtype=np.uint8)
        if full:
            ones += bits[:full].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
    return 2 * ones - len(hashes)


def _pack(margins: np.ndarray) -> int:
    return int.from_bytes(np.packbits(margins > 0).tobytes(), "big", signed=True)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit SimHash as a signed long: a bit is set if over half the shingles set it."""
    return _pack(bit_margins(np.frombuffer(shingle_digests(text, shingle), ">u8")))


def fingerprint_column(text: Column, shingle: int = 3) -> Column:
    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([fingerprint(t, shingle) for t in batch], dtype="int64")

    return run(text)


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def linked_pairs(fps: DataFrame) -> DataFrame:
    """(a, b) edges that connect all distinct fingerprints ``fp`` at two or fewer differing bits.

    All that meet on a variant are within two bits of each other, so linking each to the least of its
    bucket loses no connection; every pair is checked all the same.
    """
    masks = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    variants = fps.select("fp", F.explode(masks).alias("flip")).select(F.col("fp").bitwiseXOR(F.col("flip")).alias("variant"), "flip")
    buckets = variants.groupBy("variant").agg(F.bit_or("flip").alias("flips"), F.max((F.col("flip") == 0).cast("int")).alias("itself"))
    met = buckets.where(F.bit_count("flips") + F.col("itself") > 1)
    flips = F.filter(masks, lambda m: F.when(m == 0, F.col("itself") == 1).otherwise(F.col("flips").bitwiseAND(m) != 0))
    members = met.select(F.transform(flips, lambda m: F.col("variant").bitwiseXOR(m)).alias("m"))
    pairs = members.select(F.array_min("m").alias("a"), F.explode("m").alias("b")).where("a <> b").distinct()
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp, component_id) for every row: fingerprints at two or fewer differing bits are linked.

    component_id is the least id reachable over links, the row's own id included.
    """
    fps = materialize(docs.select(F.col(id_col).alias("id"), fingerprint_column(F.col(text_col), shingle).alias("fp")), "fingerprints")
    first = materialize(fps.groupBy("fp").agg(F.min("id").alias("first")), "distinct")
    roots = connected_components(linked_pairs(first)).withColumnsRenamed({"node": "fp", "component": "root"})
    linked = materialize(roots.join(first, "fp"), "linked")
    least = materialize(linked.groupBy("root").agg(F.min("first").alias("least")), "least")
    known = linked.join(least, "root").select("fp", "least")
    known = materialize(first.join(known, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id")), "known")
    return fps.join(known, "fp").select("id", "fp", "component_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """The rows of ``docs`` less all but one document of each group of linked fingerprints.

    The one that stays is the one of least id, then least text hash; rows without an id come last and count as
    one id a text. Rows of one id are told apart by their texts; equal ones of them are one
    document. Columns may have any names: rows travel as one struct. An empty table stays empty.
    """
    body = F.coalesce(F.col(text_col), F.lit(""))
    key = F.coalesce(F.col(id_col).cast("long"), -F.shiftrightunsigned(F.xxhash64(body), 1) - 1)
    names = F.struct(F.col(id_col).isNull().alias("unnamed"), key.alias("key"), F.xxhash64(body, F.lit(1)).alias("hash"))
    rows = materialize(docs.select(names.alias("name"), fingerprint_column(F.col(text_col), shingle).alias("fp")), "named")
    linked = connected_components(linked_pairs(rows.select("fp").distinct())).withColumnsRenamed({"node": "fp", "component": "root"})
    least = rows.groupBy("fp").agg(F.min("name").alias("name"), F.count("*").alias("n"))
    first = least.join(linked, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("name").alias("name"))
    kept = rows.join(first.select("name"), "name").groupBy("name").agg((F.count("*") > 1).alias("repeated"))
    kept = materialize(kept, "kept")
    packed = docs.select(names.alias("name"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    once = packed.join(kept.where("NOT repeated"), "name", "left_semi")
    often = packed.join(kept.where("repeated"), "name", "left_semi").dropDuplicates(["name"])
    return once.union(often).select("row.*")
