"""SpotSigs and sharding."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from barwright.llm import sharding, spotsigs
from tests.llm.conftest import prose


def plain_signatures(text: str | None, chain=2, reach=8) -> set:
    """The signatures as words instead of hashes."""
    plain = re.sub(r"[\W_]+", " ", (text or "").lower()).strip()
    pieces, sigs = [["."]], set()
    for w in plain.split(" ") if plain else []:
        if w in spotsigs.ANCHORS:
            pieces.append([w])
        else:
            pieces[-1].append(w)
    content = [p for p in pieces[1:] if len(p) > 1]
    for i, p in enumerate(content):
        rest = [w for q in content[i + 1 : i + chain] for w in q[1:]]
        sigs.add(" ".join((p + rest)[: chain + 1]))
    for p in pieces:
        sigs |= set(p[reach + 1 :])
    return sigs or set(plain.split(" ") if plain else [text] if text else [])


def test_signatures_match_definition(make_docs, odd_docs, spark):
    texts = [" ".join(prose(i, 60)) for i in range(20)] + ["the", "the of", "the cat", "the cat of dog sat", "a " * 5000 + "x", "| x | y " * 30, "$$$", "x" * 100_000]
    texts += [r.text for r in odd_docs.collect()]
    got = make_docs(list(enumerate(texts))).select("doc_id", spotsigs.signatures(F.col("text")).alias("s")).collect()
    hashes = lambda words: {r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(F.xxhash64("w")).collect()}
    for r in got:
        assert set(r.s) == hashes(plain_signatures(texts[r.doc_id])) and len(set(r.s)) == len(r.s), texts[r.doc_id]


def plain_edits(rows):
    """(id, edited text) with the next row in descending id, null last, round to the first."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for i, (doc_id, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        k = len(text) // 3
        out.append((doc_id, len(text), hashlib.sha256((text[: len(text) - k] + after[:k]).encode()).hexdigest()))
    return out


def test_edits_match_definition(make_docs, odd_docs):
    rows = [(i * i * 1000 if i % 3 else -i, " ".join(prose(i, i % 50))) for i in range(1, 400)] + [(2**60, "far away"), (None, "none")]
    for some in (rows, rows[:1], rows[:2]):
        got = spotsigs.fingerprint_edits(make_docs(some))
        assert sorted(map(str, plain_edits(some))) == sorted(str((r.id, r.n_chars, r.edited_sha256)) for r in got.collect())
    import barwright.llm.spotsigs as module

    docs = make_docs(rows).select(F.col("doc_id").alias("id"), "text")
    small = {(r.id, r.text): r.next_text for r in module.with_next(docs, ["text"], bucket_rows=1).collect()}
    large = {(r.id, r.text): r.next_text for r in module.with_next(docs, ["text"]).collect()}
    assert small == large and len(small) == len(rows)


def test_likeness_of_edits(make_docs, odd_docs, no_docs):
    rows = [(i, " ".join(prose(i, 200))) for i in range(30)]
    for r in spotsigs.fingerprint_edits(make_docs(rows)).collect():
        assert 0.3 < r.near_edited < 0.8 and r.near_next < 0.3
    assert spotsigs.fingerprint_edits(odd_docs).count() == odd_docs.count()
    assert spotsigs.fingerprint_edits(no_docs).count() == 0


def test_similar_pairs_match_brute_force(make_docs, no_docs):
    rows = []
    for i in range(30):
        words = prose(i % 10, 200)
        for k in range(i // 10 * 2):
            words[k * 40 + i] = "swapped"
        rows.append((i, " ".join(words)))
    rows.append((99, rows[0][1]))
    pairs, members = spotsigs.similar_pairs(make_docs(rows))
    sigs = {i: plain_signatures(t) for i, t in rows if i != 99}
    first = {i: min(k for k in sigs if sigs[k] == sigs[i]) for i in sigs}
    want = {}
    for a, b in itertools.combinations(sorted(set(first.values())), 2):
        j = len(sigs[a] & sigs[b]) / len(sigs[a] | sigs[b])
        if j >= 0.8:
            want[frozenset((a, b))] = round(j, 9)
    assert {frozenset((r.a, r.b)): round(r.similarity, 9) for r in pairs.collect()} == want and want
    assert {r.id: r.set_id for r in members.collect()} == {**first, 99: 0}
    assert spotsigs.similar_pairs(no_docs)[0].count() == 0


def test_shards(make_docs, odd_docs, no_docs):
    rows = [(i, f"text {i}") for i in range(3000)] + [(r.doc_id, r.text) for r in odd_docs.collect()] + [(77, "often")] * 2500
    got = sharding.place(make_docs(rows), [1.0] * 16, [1.0] * 17).collect()
    assert len(got) == len(rows)
    assert sorted((str(r.id), r.size, r.text_crc32) for r in got) == sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    slots = Counter()
    for r in got:
        slots[r.shard] = max(slots[r.shard], r.slot + 1)
        assert r.grown_shard in (r.shard, 16)
    assert slots == Counter(r.shard for r in got) and len({(r.shard, r.slot) for r in got}) == len(got)
    by_id = {}
    for r in got:
        assert by_id.setdefault(r.id, r.shard) == r.shard
    counts = Counter(by_id.values())
    assert max(counts.values()) < 1.5 * 3000 / 16 and min(counts.values()) > 0.6 * 3000 / 16
    assert sharding.place(no_docs, [1.0] * 4, [1.0] * 5).count() == 0


def test_shards_follow_weights_and_definition(make_docs):
    weights = [1.0, 3.0, 0.0, 4.0]
    got = {r.id: r.shard for r in sharding.place(make_docs([(i, None) for i in range(4000)]), weights, weights).collect()}

    def shard(i):
        draws = [(-math.log((int(hashlib.md5(f"{i}/{s}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52) / w, s) for s, w in enumerate(weights) if w]
        return min(draws)[1]

    assert got == {i: shard(i) for i in range(4000)}
    share = Counter(got.values())
    assert share[2] == 0 and abs(share[3] / 4000 - 0.5) < 0.04 and abs(share[0] / 4000 - 0.125) < 0.03
