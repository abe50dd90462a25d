"""Near copies by Jaccard similarity of word n-grams: a grouped prefix join.

A set's shingles are put in one order of the whole corpus, rare ones first; two sets at the similarity share one
of their first ``n - ceil(similarity * n) + 1`` shingles, their prefixes. Sets of one size with identical prefixes
make up one group. Groups meet on the shingles of their prefixes, pairs of groups are filtered by size and by the
places of the shared shingle, and only what is left is expanded to members and verified on the whole sets.

The order comes from counts of all shingles of all documents in a table of ``slots`` bytes (by the size of the
input, up to a bound): any order that all sets share gives the same links, a fine one gives fewer candidates. These
counts and a filter of fixed size are all that is broadcast. A shingle that is alone in its slot is in one text only;
it stays in its prefix's place, but meets nobody and is not sent.

Links unite; what counts is which sets hang together. So a bucket (all groups with one shingle in their prefix) of
more than ``hubs`` members is not paired out: first every member meets one hub, then, where the bucket still holds
sets of different components, ever more hubs (``hubs`` times as many each round) until all are hubs. Each round
skips pairs that are united by then. Every pair at the similarity is thus linked, directly or by others that are
verified. Buckets of more than 4,096 members are dealt over several tasks. Pairs are first compared by sketches of
their sets; whole sets travel only for those whose sketches allow the similarity.

Nulls and texts without words have the empty set and are linked with nothing; equal sets are one set. A null id
takes part and never becomes the least id. Rows repeated with one id are told apart by their texts. Sets are held
as 64-bit hashes of their shingles. An empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barwright.llm.components import connected_components
from barwright.session import materialize

_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
BLOCK = 1 << 16
DEALT = 4096
FILTER_BITS = 1 << 23
SKETCH = 4096  # classes of a sketch, a bit each
ALONE = 6  # the count, on the scale of shingle_counts, of a slot with one shingle in one set
#: Most slots of the table of counts, a byte each: what is broadcast, whatever the input.
MOST_SLOTS = 1 << 25
PIECE = 1 << 19  # bytes of text that are hashed at once; a longer text is a piece of its own

_BASE = 0x5851F42D4C957F2B  # 3 modulo 8, so its powers have long periods modulo 2**64
_BACK = pow(_BASE, -1, 1 << 64)
_CODES = np.random.default_rng(42).integers(1, 1 << 64, 256, dtype=np.uint64)
_CODES[65:91] = _CODES[97:123]  # A-Z as a-z
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True


class _Powers:
    """Powers of the base and of its inverse, as many as the longest piece asked for."""

    up = down = np.ones(0, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up = np.cumprod(np.append(np.uint64(1), np.full(n - 1, _BASE, np.uint64)), dtype=np.uint64)
            cls.down = np.cumprod(np.append(np.uint64(1), np.full(n - 1, _BACK, np.uint64)), dtype=np.uint64)
        return cls.up[:n], cls.down[:n]


def _mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
    return z ^ (z >> np.uint64(29))


def _piece_sets(data: np.ndarray, offsets: np.ndarray, shingle: int) -> list[np.ndarray]:
    """The sets of texts that lie one after the other in ``data`` (UTF-8), by array operations over all of them.

    A word's hash is a polynomial over random numbers for its bytes, taken from running sums; a shingle's is made
    of its words' hashes with a factor for each place.
    """
    n = len(data)
    if not n:
        return [np.zeros(0, np.uint64) for _ in offsets[1:]]
    up, down = _Powers.of(n + 1)
    solid = ~_BLANK[data]
    begins = np.zeros(n + 1, bool)
    begins[offsets[:-1]] = True
    starts = np.flatnonzero(solid & (begins[:-1] | np.append(True, ~solid[:-1])))
    ends = np.flatnonzero(solid & (np.append(begins[1:-1], True) | np.append(~solid[1:], True))) + 1
    sums = np.append(np.uint64(0), np.cumsum(_CODES[data] * up[:n], dtype=np.uint64))
    words = _mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    firsts = np.searchsorted(starts, offsets)
    counts = np.diff(firsts)
    text = np.repeat(np.arange(len(counts)), counts)
    z = np.zeros(len(words), np.uint64)
    for j in range(min(shingle, len(words))):
        factor = np.uint64(_FACTORS[j % len(_FACTORS)] ^ (2 * (j // len(_FACTORS))))
        same = text[j:] == text[: len(text) - j]  # words beyond a short text add nothing
        z[: len(words) - j][same] += words[j:][same] * factor
    z = _mixed(z)
    many = np.where(counts > 0, np.maximum(counts - shingle + 1, 1), 0)
    return [np.unique(z[a : a + k]) for a, k in zip(firsts[:-1].tolist(), many.tolist())]


def shingle_sets(texts: pa.Array, shingle: int = 5) -> list[np.ndarray]:
    """Hashes of the distinct shingles of each text, ascending; fewer words make one shingle, none make none."""
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, side="right")) - 1)
        out += _piece_sets(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], shingle)
        at = to
    return out


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    return shingle_sets(pa.array([text], pa.string()), shingle)[0]


def _digest(data: bytes) -> bytes:
    return xxhash.xxh128_digest(data)


def _batches(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    for batch in batches:
        yield batch.column(0), shingle_sets(batch.column(1), shingle)


def slots_for(docs: DataFrame, text_col: str) -> int:
    """A quarter as many slots as there are words, about, within fixed bounds."""
    size = docs.agg(F.sum(F.octet_length(F.col(text_col)).cast("long"))).first()[0] or 0
    return min(MOST_SLOTS, max(1 << 16, 1 << (int(size) // 28).bit_length()))


def shingle_counts(docs: DataFrame, text_col: str, shingle: int, slots: int) -> np.ndarray:
    """How often the shingles of each slot occur in sets, on a scale of logarithms: one byte a slot.

    Tasks count in bytes (255 at most). Most slots of a task are empty, so it sends a block as one bit a slot and the
    counts of the used ones, both compressed; a block is added up from one task's at a time.
    """
    shift, block = np.uint64(64 - (slots - 1).bit_length()), min(BLOCK, slots)

    def count(batches):
        total = np.zeros(slots, np.uint8)
        for _, sets in _batches(batches, shingle):
            for i in range(0, len(sets), 500):
                at, n = np.unique(np.concatenate(sets[i : i + 500]) >> shift, return_counts=True)
                at = at.astype(np.int64)
                total[at] = np.minimum(total[at] + n, 255)
        low = total.reshape(-1, block)
        used = np.flatnonzero(low.any(axis=1))
        pack = lambda x: pa.Codec("zstd").compress(x.tobytes(), asbytes=True)
        for part in np.array_split(used, max(1, len(used) // 16)):
            bits, counts = [pack(np.packbits(low[i] > 0)) for i in part], [low[i][low[i] > 0] for i in part]
            arrays = [pa.array(part, pa.int32()), pa.array(bits, pa.binary()), pa.array(list(map(pack, counts)), pa.binary()), pa.array(list(map(len, counts)), pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, ["block", "bits", "counts", "used"])

    def add(pdf):
        total = np.zeros(block, np.int64)
        unpack = lambda x, n: np.frombuffer(pa.Codec("zstd").decompress(x, n, asbytes=True), np.uint8)
        for bits, counts, used in zip(pdf["bits"], pdf["counts"], pdf["used"]):
            total[np.unpackbits(unpack(bits, -(-block // 8)), count=block).view(bool)] += unpack(counts, used)
        out = pdf[["block", "counts"]].iloc[:1].copy()
        out["counts"] = [np.minimum(np.log2(total + 1.0) * 6, 255).astype(np.uint8).tobytes()]
        return out

    plain = docs.select(F.lit(0).alias("none"), F.col(text_col).alias("text"))
    out = np.zeros((slots // block, block), np.uint8)
    for r in plain.mapInArrow(count, "block int, bits binary, counts binary, used int").groupBy("block").applyInPandas(add, "block int, counts binary").toLocalIterator():  # a byte a slot
        out[r.block] = np.frombuffer(r.counts, np.uint8)
    return out.ravel()


def _signature(hashes: np.ndarray, classes: int = 256) -> list[int]:
    """Parities of the members in a number of classes: two sets differ in at least as many members as bits."""
    odd = (np.bincount((hashes & np.uint64(classes - 1)).astype(np.int64), minlength=classes) & 1).astype(np.uint8)
    return np.frombuffer(np.packbits(odd).tobytes(), ">i8").tolist()


def _described(docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int, slots: int | None) -> DataFrame:
    """(id, n, content, sig, g, alone, prefix): ``g`` is one for sets of one size and prefix; a task gives each prefix
    once, without its first ``alone`` shingles, which are in no other set.

    Should two groups ever have one number, they are taken as one: that adds candidates and loses none.
    """
    slots = slots or slots_for(docs, text_col)
    ranks = docs.sparkSession.sparkContext.broadcast(shingle_counts(docs, text_col, shingle, slots))
    shift = np.uint64(64 - (slots - 1).bit_length())

    def describe(batches):
        given: set[int] = set()
        for ids, sets in _batches(batches, shingle):
            contents, sigs, numbers, alone, prefixes = [], [], [], [], []
            for s in sets:
                n = len(s)
                rank = ranks.value[(s >> shift).astype(np.int64)]
                order = np.argsort(rank, kind="stable")[: n - (percent * n + 99) // 100 + 1 if n else 0]
                first = s[order].astype(np.int64)
                contents.append(_digest(s.tobytes()))
                sigs.append(_signature(s))
                number = int.from_bytes(_digest(n.to_bytes(8, "big") + first.tobytes())[:8], "big", signed=True)
                numbers.append(number)
                alone.append(int(np.searchsorted(rank[order], ALONE, side="right")) if len(order) and rank[order[0]] == ALONE else 0)
                prefixes.append(first[:0] if number in given else first[alone[-1] :])
                given.add(number)
            if len(given) > 1_000_000:
                given.clear()
            offsets = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
            values = np.concatenate([np.zeros(0, np.int64), *prefixes])
            arrays = [ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(contents, pa.binary()), pa.array(sigs, pa.list_(pa.int64())), pa.array(numbers, pa.int64()), pa.array(alone, pa.int32()), pa.ListArray.from_arrays(offsets, values)]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "n", "content", "sig", "g", "alone", "prefix"])

    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return plain.mapInArrow(describe, "id long, n long, content binary, sig array<long>, g long, alone int, prefix array<long>")


def _asked_bits(contents: DataFrame) -> np.ndarray:
    """A bit for the start of each ``content``: of fixed size, and leaves out most sets that are not asked for."""
    at = F.conv(F.hex(F.substring("content", 1, 4)), 16, 10).cast("long") % FILTER_BITS
    rows = contents.select(at.alias("at")).selectExpr("at div 64 AS word", "shiftleft(1L, cast(at % 64 AS int)) AS bit")
    out = np.zeros(FILTER_BITS // 64, np.int64)
    for r in rows.groupBy("word").agg(F.bit_or("bit").alias("bits")).collect():  # FILTER_BITS / 64 rows at most
        out[r.word] = r.bits
    return out


def _sets(docs: DataFrame, text_col: str, nodes: DataFrame, shingle: int) -> DataFrame:
    """(node, sketch, n, members): whole sets of ``nodes`` (node, content). Texts stay where they are; sets asked for travel
    once, as their copies are taken out where they meet their nodes."""
    bits = docs.sparkSession.sparkContext.broadcast(_asked_bits(nodes))

    def asked(digest: bytes) -> bool:
        at = int.from_bytes(digest[:4], "big") % FILTER_BITS
        return bool(int(bits.value[at >> 6]) >> (at & 63) & 1)

    def members(batches):
        given: set[bytes] = set()
        for _, sets in _batches(batches, shingle):
            found = {}
            for s in sets:
                digest = _digest(s.tobytes())
                if asked(digest) and digest not in given:
                    found[digest] = s
            given.update(found)
            if len(given) > 1_000_000:
                given.clear()
            offsets = np.cumsum([0, *map(len, found.values())]).astype(np.int32)
            values = np.concatenate([np.zeros(0, np.uint64), *found.values()]).astype(np.int64)
            sketches = pa.array([_signature(s, SKETCH) for s in found.values()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), sketches, pa.ListArray.from_arrays(offsets, values)], ["content", "sketch", "members"])

    plain = docs.select(F.lit(0).alias("none"), F.col(text_col).alias("text"))
    found = plain.mapInArrow(members, "content binary, sketch array<long>, members array<long>").join(nodes.select("node", "content"), "content")
    return materialize(found.dropDuplicates(["content", "node"]).select("node", "sketch", F.size("members").alias("n"), "members"), "sets")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, slots: int | None = None, hubs: int = 8) -> DataFrame:
    """(id, n_shingles, component_id) for every row; sets at ``percent`` or more of Jaccard similarity are linked."""
    rows = materialize(_described(docs, id_col, text_col, shingle, percent, slots), "described")
    shown = rows.where("n > 0")
    nodes = shown.groupBy("content", "g", "n").agg(F.min("id").alias("first"), F.first("sig").alias("sig"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    links = _linked(docs, text_col, shown, nodes, shingle, percent, hubs)
    named = nodes.join(links, "node", "left").select("content", "first", F.coalesce("label", "node").alias("label"))
    least = named.groupBy("label").agg(F.min("first").alias("component_id"))
    known = materialize(named.join(least, "label").select("content", "component_id"), "known")
    found = shown.select("id", "n", "content").join(known, "content").select("id", F.col("n").alias("n_shingles"), "component_id")
    return found.union(rows.where("n = 0").select("id", "n", F.col("id").alias("component_id")))


def _linked(docs: DataFrame, text_col: str, shown: DataFrame, nodes: DataFrame, shingle: int, percent: int, hubs: int) -> DataFrame:
    """(node, label) of all nodes that meet another; label is that of their component."""
    firsts = shown.select("g", "alone", F.posexplode("prefix").alias("at", "token")).select("token", "g", (F.col("at") + F.col("alone")).alias("at"))
    # Most shingles are in one group only: they are sent once, to where all of one shingle meet, and end there. A group
    # has a shingle once, but may come from several tasks.
    here = Window.partitionBy("token")
    met = firsts.withColumn("low", F.min("g").over(here)).withColumn("high", F.max("g").over(here)).where("low < high")
    met = met.select("token", "g", "at").distinct()
    # Members of one group share a prefix, so they meet in a bucket of their own too.
    own = nodes.groupBy("g").agg(F.count("*").alias("k")).where("k > 1").select(F.xxhash64("g").alias("token"), "g", F.lit(0).alias("at"))
    met = materialize(met.union(own), "met")
    nodes = materialize(nodes.join(met.select("g").distinct(), "g", "left_semi"), "met_nodes")
    labels = nodes.select("node", F.col("node").alias("label"))
    sets, limit, turn = None, 1, 0
    while True:
        labelled = materialize(nodes.select("node", "g", "n", "sig").join(labels, "node"), "labelled")
        spread = labelled.groupBy("g", "n").agg(F.count("*").alias("k"), F.min("label").alias("low"), F.max("label").alias("high"))
        order = F.xxhash64(F.lit(turn), "g")
        entries = met.join(spread, "g")
        buckets = entries.groupBy("token").agg(F.min("low").alias("least"), F.max("high").alias("most"), F.sum("k").alias("c"), F.min(order).alias("hub"))
        buckets = materialize(buckets.where("least < most").select("token", "c", "hub"), "buckets")
        if not buckets.take(1):
            return labels
        entries = materialize(entries.drop("k").join(buckets, "token").withColumn("order", order), "entries")
        pairs = materialize(_candidates(entries, percent, limit, hubs), "group_pairs")
        alike = materialize(_verifiable(pairs, labelled, percent, limit, hubs, turn), "pairs")
        asked = alike.select(F.col("a").alias("node")).union(alike.select("b"))
        if sets is None:  # what large buckets may ask for later comes along, so that texts are not read once a turn
            later = entries.where(F.col("c") > max(limit, hubs)).select("g").distinct()
            asked = asked.union(nodes.join(later, "g", "left_semi").select("node"))
        asked = asked.distinct()
        asked = asked if sets is None else asked.join(sets, "node", "left_anti")
        asked = materialize(nodes.join(asked, "node", "left_semi").select("node", "content"), "asked")
        if asked.take(1):
            more = _sets(docs, text_col, asked, shingle)
            sets = more if sets is None else sets.union(more)
        if sets is not None:
            links = _verified(alike, sets, percent)
            if links.take(1):
                edges = links.union(labels.where("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b")))
                united = connected_components(edges).withColumnRenamed("component", "label")
                labels = nodes.select("node").join(united, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
                labels = materialize(labels, "labels")
        met = materialize(entries.where(F.col("c") > max(limit, hubs)).select("token", "g", "at"), "open")
        limit, turn = limit * hubs, turn + 1


def _is_hub(order, count, chosen, limit: int, hubs: int):
    """All members of small buckets, else the chosen one and about ``limit`` - 1 more by their hash."""
    share = F.shiftrightunsigned(order, 11).cast("double") / float(2**53)
    return (count <= max(limit, hubs)) | (order == chosen) | (share * count < limit - 1)


def _candidates(entries: DataFrame, percent: int, limit: int, hubs: int) -> DataFrame:
    """(g, hub): pairs of groups that meet in a bucket, can be similar and are not of one component yet."""
    parts = F.expr(f"c div {DEALT}")
    dealt = entries.withColumn("part", F.pmod(F.xxhash64(F.lit(-1), "g"), parts + 1))
    chosen = entries.where(_is_hub(F.col("order"), F.col("c"), F.col("hub"), limit, hubs))
    chosen = chosen.select("token", F.col("g").alias("hub_g"), F.col("n").alias("m"), F.col("at").alias("hub_at"), F.col("low").alias("hub_low"), F.col("high").alias("hub_high"), F.explode(F.sequence(F.lit(0).cast("long"), parts)).alias("part"))
    n, m = F.col("n"), F.col("m")
    can = (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * F.least(n - F.col("at"), m - F.col("hub_at")) >= percent * (n + m))
    apart = (F.col("low") != F.col("hub_low")) | (F.col("high") != F.col("hub_high")) | (F.col("low") != F.col("high"))
    return dealt.join(chosen, ["token", "part"]).where(can & apart).select("g", "hub_g").distinct()


def _verifiable(pairs: DataFrame, labelled: DataFrame, percent: int, limit: int, hubs: int, turn: int) -> DataFrame:
    """(a, b): members of paired groups that are of different components and whose signatures allow the similarity."""
    x = labelled.select("g", F.col("node").alias("x"), "n", "sig", "label")
    order = F.xxhash64(F.lit(turn), "node")
    ranked = labelled.withColumn("order", order)
    of = ranked.groupBy("g").agg(F.count("*").alias("k"), F.min("order").alias("hub"))
    y = ranked.join(of, "g").where(_is_hub(F.col("order"), F.col("k"), F.col("hub"), limit, hubs))
    y = y.select(F.col("g").alias("hub_g"), F.col("node").alias("y"), F.col("n").alias("m"), F.col("sig").alias("hub_sig"), F.col("label").alias("hub_label"))
    differ = sum((F.bit_count(F.get("sig", F.lit(i)).bitwiseXOR(F.get("hub_sig", F.lit(i)))) for i in range(1, 4)), F.bit_count(F.get("sig", F.lit(0)).bitwiseXOR(F.get("hub_sig", F.lit(0)))))
    can = (100 + percent) * differ <= (100 - percent) * (F.col("n") + F.col("m"))
    both = pairs.join(y, "hub_g").join(x, "g").where((F.col("label") != F.col("hub_label")) & can)
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets are similar, by their whole intersection.

    Sketches sort out most pairs that are not; the sets of the others are picked out before they are moved.
    """
    asked = materialize(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "compared")
    short = sets.select("node", "sketch", "n").join(asked, "node", "left_semi")
    both = pairs.join(short.toDF("b", "q", "m"), "b").join(short.toDF("a", "p", "n"), "a")
    differ = F.aggregate(F.zip_with("p", "q", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x)
    near = materialize(both.where((100 + percent) * differ <= (100 - percent) * (F.col("n") + F.col("m"))).select("a", "b"), "near")
    for side, members in (("b", "y"), ("a", "x")):
        wanted = materialize(near.select(F.col(side).alias("node")).distinct(), "wanted")
        held = sets.select("node", "members").join(wanted, "node", "left_semi")
        near = near.join(held.toDF(side, members), side)
    common = F.size(F.array_intersect("x", "y"))
    return materialize(near.where(100 * common >= percent * (F.size("x") + F.size("y") - common)).select("a", "b"), "links")
