from __future__ import annotations

import random

import xxhash

from pyspark.sql import functions as F

from barwright.llm import simhash
from barwright.llm.components import connected_components
from tests.llm.conftest import prose


def plain_fingerprint(text: str | None, k: int = 3) -> int:
    """Straight from the definition."""
    import re

    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, linked):
    """Least id reachable over links, by flooding."""
    out = {}
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            a = todo.pop()
            for b in range(len(rows)):
                if b not in seen and linked(rows[a], rows[b]):
                    seen.add(b)
                    todo.append(b)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.setdefault(rows[i], min(ids) if ids else None)
    return out


def test_fingerprint_matches_definition():
    for text in [None, "", "a", "a b", "a b c", "The THE the the", " ".join(prose(3, 400)), "café 日本  x y\nz", "w " * 700]:
        assert simhash.fingerprint(text) % 2**64 == plain_fingerprint(text), text


def test_components_match_brute_force(make_docs, odd_docs):
    pick = random.Random(5)
    rows = []
    for i in range(60):
        words = prose(i % 12, 60)
        for _ in range(pick.randint(0, 2)):
            words[pick.randrange(60)] = "edited"
        rows.append((i + 10, " ".join(words)))
    rows += [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = {(r.id, r.fp): r.component_id for r in simhash.components(make_docs(rows)).collect()}
    items = sorted({(i, simhash.fingerprint(t)) for i, t in rows}, key=str)
    want = plain_components(items, lambda a, b: bin((a[1] ^ b[1]) % 2**64).count("1") <= 2)
    assert got == want
    assert len(set(want.values())) < len(items)


def test_two_bits_link_and_three_do_not(spark):
    fps = [0, 0b11, 0b11111, -(2**63), -(2**63) | 1 << 40, 0b1110000]
    pairs = {frozenset((r.a, r.b)) for r in simhash.linked_pairs(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()}
    near = {frozenset((a, b)) for a in fps for b in fps if a != b and bin((a ^ b) % 2**64).count("1") <= 2}
    assert pairs <= near
    labels = {r.node: r.component for r in connected_components(simhash.linked_pairs(spark.createDataFrame([(f,) for f in fps], "fp long"))).collect()}
    assert labels == {0: -(2**63), 0b11: -(2**63), -(2**63): -(2**63), -(2**63) | 1 << 40: -(2**63)}


def test_empty_table(no_docs):
    assert simhash.components(no_docs).count() == 0


def test_long_chain_of_edges(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(201)}, 1000: 1000, 1001: 1000}


def test_one_row_of_each_group_stays(make_docs, odd_docs, no_docs):
    rows = []
    for i in range(40):
        words = prose(i % 10, 60)
        if i >= 20:
            words[i] = "edited"
        rows.append((i + 100, " ".join(words)))
    rows += [(r.doc_id, r.text) for r in odd_docs.collect()] + [(100, "another text under one id")] * 3 + [(7, "Same text here")] * 50
    docs = make_docs(rows).select("*", *[F.lit(k).alias(n) for k, n in enumerate(["NAME", "Key", "hash", "fp", "row", "root", "repeated", "_ID"])])
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    want = {}
    for i, t in rows:
        fp = simhash.fingerprint(t) % 2**64
        near = next((r for r in want if any(bin(fp ^ x).count("1") <= 2 for x in want[r][1])), None)
        ids, fps = want.pop(near) if near is not None else ([], set())
        for r in [r for r in want if any(bin(fp ^ x).count("1") <= 2 for x in want[r][1])]:
            more = want.pop(r)
            ids, fps = ids + more[0], fps | more[1]
        want[min([fp, *fps])] = (ids + [i], fps | {fp})
    found = {next(r for r in want if simhash.fingerprint(t) % 2**64 in want[r][1]): i for i, t in got}
    assert len(found) == len(got)
    assert found == {r: min((i for i in ids if i is not None), default=None) for r, (ids, _) in want.items()}
    assert simhash.representatives(no_docs).count() == 0
