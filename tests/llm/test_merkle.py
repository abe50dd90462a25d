"""The Merkle manifest against the definition."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from barwright.llm import merkle


def H(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row) -> str:
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def grow(digests: list[str], fan_out: int):
    """(root, for each node the list of (before, after))."""
    paths, spots, level = [[] for _ in digests], list(range(len(digests))), digests
    while len(level) > 1:
        for i, at in enumerate(spots):
            low = at // fan_out * fan_out
            paths[i].append(("".join(level[low:at]), "".join(level[at + 1 : low + fan_out])))
        level = [H(*level[i : i + fan_out]) for i in range(0, len(level), fan_out)]
        spots = [s // fan_out for s in spots]
    return level[0], paths


def plain_manifest(rows, fan_out, changed):
    by_source = {}
    for r in rows:
        by_source.setdefault(r[1], []).append(r)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        ordered = sorted(by_source[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[s] = (ordered, *grow([leaf_of(r) for r in ordered], fan_out))
    root, upper = grow([trees[s][1] for s in names], fan_out)
    out = []
    for s, above in zip(names, upper):
        ordered, subroot, paths = trees[s]
        for r, path in zip(ordered, paths):
            digest = leaf_of(changed(r))
            for before, after in path + above:
                digest = H(before, digest, after)
            out.append((r[0], leaf_of(r), subroot, root, H(*[b + a for b, a in path + above]), digest))
    return out


def changed(r):
    touched = zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 5 == 0
    text = None if r[4] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])
    return (*r[:4], text) if touched else r


def manifest_of(docs, fan_out):
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    touched = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    out = merkle.manifest(docs, {"text": F.when(touched, lowered).otherwise(F.col("text"))}, fan_out=fan_out)
    return out.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")), merkle.fold(F.col("path"), F.col("presented"))).collect()


@pytest.mark.parametrize("fan_out, n", [(16, 600), (2, 40), (16, 16), (16, 1), (3, 28)])
def test_manifest_matches_definition(make_docs, odd_docs, many_partitions, fan_out, n):
    sources = ["big"] * 6 + ["", None, "é", "z", "Z"] + [f"s{i}" for i in range(30)]
    rows = [(i * 7 % 1000, f"Text {i} É" if i % 3 else f"text {i}", sources[i % len(sources)]) for i in range(n)]
    if n > 500:
        rows += [(5, "same", "big")] * 40 + [(None, "x", "big"), (None, "X", None)] + [(r.doc_id, r.text, r.source) for r in odd_docs.collect()]
    docs = make_docs(rows).drop("n").withColumn("tree", F.lit("t")).withColumn("POS", F.lit(1)).withColumn("Path", F.lit(1))
    full = [(i, s, "en", None if t is None else len(t), t) for i, t, s in rows]
    assert sorted(map(str, plain_manifest(full, fan_out, changed))) == sorted(str(tuple(r)) for r in manifest_of(docs, fan_out))


def test_tampering_is_found(make_docs, no_docs):
    rows = [(i, f"Text {i}", "a") for i in range(100)]
    got = manifest_of(make_docs(rows), 16)
    assert {r.doc_id for r in got if r[5] != r.root} == {i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert manifest_of(no_docs, 16) == []
