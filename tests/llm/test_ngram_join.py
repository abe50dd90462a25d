"""The grouped prefix join against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barwright.llm import ngram_join
from tests.llm.conftest import prose


def plain_set(text, k=5):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return frozenset(" ".join(words[i : i + k]) for i in range(max(len(words) - k + 1, 1))) if words else frozenset()


def plain_components(rows, percent=80, k=5):
    """(id, set size, least id reachable), by flooding over all pairs."""
    sets = [plain_set(t, k) for _, t in rows]
    distinct = sorted(set(sets) - {frozenset()}, key=sorted)
    near = {s: [t for t in distinct if 100 * len(s & t) >= percent * len(s | t)] for s in distinct}
    ids = {s: [i for (i, _), x in zip(rows, sets) if x == s and i is not None] for s in distinct}
    label = {}
    for s in distinct:
        if s in label:
            continue
        seen, todo = {s}, [s]
        while todo:
            for t in near[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        known = [i for t in seen for i in ids[t]]
        label |= dict.fromkeys(seen, min(known) if known else None)
    return sorted(str((i, len(s), label[s] if s else i)) for (i, _), s in zip(rows, sets))


def result(docs, **options):
    return sorted(str((r.id, r.n_shingles, r.component_id)) for r in ngram_join.components(docs, **options).collect())


def edited(words, times, pick):
    words = list(words)
    for _ in range(times):
        words[pick.randrange(len(words))] = f"new{pick.random()}"
    return " ".join(words)


@pytest.fixture(scope="module")
def mixed(odd_docs):
    pick = random.Random(11)
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    rows += [(i + 100, edited(prose(i % 25, 60 + i % 25), i // 25, pick)) for i in range(100)]
    rows += [(i + 300, edited(prose(77, 150), pick.randint(1, 4), pick)) for i in range(60)]  # one large family
    passage = prose(88, 60)
    rows += [(i + 400, " ".join(passage + prose(1000 + i, pick.choice([3, 8, 20, 60])))) for i in range(60)]  # one shared passage
    rows += [(i + 500, " ".join(prose(i % 7, 3 + i % 3))) for i in range(20)] + [(600, rows[20][1].upper()), (None, rows[30][1])]
    return rows


def test_components_match_brute_force(make_docs, mixed):
    want = plain_components(mixed)
    docs = make_docs(mixed).withColumn("TOKEN", F.lit(1)).withColumn("g", F.lit("g")).withColumn("Label", F.lit(0))
    assert result(docs) == want
    assert len({x.split(", ")[2] for x in want}) < len(want) - 50


def test_few_hubs_and_small_tables_change_nothing(make_docs, mixed):
    """One hub a bucket at first, dealt buckets, and an order that is hardly better than hashes."""
    want = plain_components(mixed)
    assert result(make_docs(mixed), hubs=2, slots=2) == want


def test_one_pool_of_sentences(make_docs):
    """Texts from one pool share much without being alike; some are."""
    pick = random.Random(5)
    pool = [" ".join(prose(i, 12)) for i in range(40)]
    rows = [(i, " ".join(pick.sample(pool, 9))) for i in range(150)]
    rows += [(200 + i, rows[i][1] + " and a few more words") for i in range(0, 60, 3)]
    assert result(make_docs(rows), hubs=2) == plain_components(rows)


def test_one_prefix_many_members(make_docs, monkeypatch):
    """Sets of one size whose shared half comes first: one group whose members are to be told apart."""
    monkeypatch.setattr(ngram_join, "DEALT", 4)
    monkeypatch.setattr(ngram_join, "shingle_counts", lambda docs, text, shingle, slots: np.zeros(slots, np.uint8))
    pick = random.Random(2)
    rows = [(i, " ".join(f"w{k}" for k in [*range(60), *(pick.sample(range(100, 140), 12))])) for i in range(60)]
    assert result(make_docs(rows), shingle=1, hubs=2) == plain_components(rows, k=1)


@pytest.mark.parametrize("percent, shingle", [(50, 2), (100, 3)])
def test_other_thresholds(make_docs, mixed, percent, shingle):
    assert result(make_docs(mixed), percent=percent, shingle=shingle) == plain_components(mixed, percent, shingle)


def test_no_rows_and_no_words(make_docs, no_docs):
    assert result(no_docs) == []
    assert result(make_docs([(1, None), (2, ""), (None, " ")])) == plain_components([(1, None), (2, ""), (None, " ")])


def jaccard_groups(rows, similarity=0.8, k=5):
    """Least id of each group of linked texts, straight from the definition."""
    sets = {}
    for i, text in rows:
        words = text.lower().split()
        sets[i] = {" ".join(words[j : j + k]) for j in range(max(1, len(words) - k + 1))}
    out = {i: i for i in sets}
    for i in sorted(sets):
        todo = [i] if out[i] == i else []
        while todo:
            a = todo.pop()
            for b in sets:
                if out[b] == b > i and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                    out[b] = i
                    todo.append(b)
    return out


def test_isolated_pairs_just_above_the_threshold(make_docs):
    """Every pair at 0.80 to 0.83, each alone, at several lengths."""
    rows = []
    for i in range(240):
        n = (54, 154, 604)[i % 3]
        words = prose(2000 + i, n)
        shared = -(-(n - 4) * 89 // 100)  # the share of shingles kept on each side: 0.89 / 1.11 is just above 0.8
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[: shared + 4] + prose(5000 + i, n - shared - 4)))]
    want = jaccard_groups(rows)
    assert all(want[2 * i + 1] == 2 * i for i in range(240))
    assert {r.id: r.component_id for r in ngram_join.components(make_docs(rows)).collect()} == want


def test_families_in_one_bucket(make_docs):
    """Families on one shared passage: whatever meets a busier text first is still compared with its own kind."""
    rows = []
    passage = prose(1, 200)
    for f in range(12):
        own = passage + prose(50 + f, 90)
        for v in range(5):
            words = list(own)
            words[200 + 15 * v : 210 + 15 * v] = prose(700 + 10 * f + v, 10)
            rows.append((10 * f + v, " ".join(words)))
    want = jaccard_groups(rows)
    assert len(set(want.values())) == 12
    # With two slots the order is hardly better than hashes, so the passage is in most prefixes.
    for options in ({}, {"slots": 2, "hubs": 2}):
        assert {r.id: r.component_id for r in ngram_join.components(make_docs(rows), **options).collect()} == want


def test_sets_by_arrays(odd_docs, monkeypatch):
    """Sizes and overlaps of hashed sets against sets of strings, with texts cut into pieces anyhow."""
    monkeypatch.setattr(ngram_join, "PIECE", 40)
    texts = [r.text for r in odd_docs.collect()] + ["a b c d e f", "A B C D E F", "a b c d e g", "a b", "ab", "b a", " a  b\n", "\u00a0x\u2003y", "a b c d e f a b c d e f", "x" * 5000, "\r\n\x0b\x0c\t "]
    for k in (1, 2, 5, 7):
        found = ngram_join.shingle_sets(pa.array(texts, pa.string()), k)
        plain = [plain_set(t, k) for t in texts]
        assert [len(f) for f in found] == [len(p) for p in plain]
        for i in range(len(texts)):
            for j in range(i):
                assert len(np.intersect1d(found[i], found[j])) == len(plain[i] & plain[j])
    part = pa.array(texts, pa.string()).slice(3, 4)
    assert [f.tolist() for f in ngram_join.shingle_sets(part)] == [ngram_join.shingle_set(t).tolist() for t in texts[3:7]]


def test_counts_match_brute_force(make_docs, mixed):
    """Tables of several tasks, added up block by block, against all sets at once."""
    slots = 1 << 18
    at = np.concatenate([ngram_join.shingle_set(t) for _, t in mixed]) >> np.uint64(64 - 18)
    want = np.minimum(np.log2(np.bincount(at.astype(np.int64), minlength=slots) + 1.0) * 6, 255).astype(np.uint8)
    docs = make_docs(mixed).repartition(7)
    assert (ngram_join.shingle_counts(docs, "text", 5, slots) == want).all()
    assert ngram_join.shingle_counts(make_docs([]), "text", 5, slots).max() == 0


def test_lone_shingles_do_not_travel(make_docs):
    """What is in one text only is left out of the prefixes that are joined, and the others keep their places."""
    shared = prose(1, 40)
    rows = [(i, " ".join(prose(100 + i, 200))) for i in range(4)] + [(10 + i, " ".join(shared + prose(200 + i, 3))) for i in range(2)]
    found = ngram_join._described(make_docs(rows), "doc_id", "text", 5, 80, 1 << 22)
    for r in found.collect():
        assert r.alone + len(r.prefix) == r.n - -(-80 * r.n // 100) + 1
        assert r.alone == (r.n - -(-80 * r.n // 100) + 1 if r.id < 10 else 3)
    assert result(make_docs(rows)) == plain_components(rows)


def test_sets_move_for_few_pairs_only(make_docs, monkeypatch):
    """Pairs that share a passage without being alike are told apart before whole sets are moved."""
    shown = []
    kept = ngram_join.materialize
    monkeypatch.setattr(ngram_join, "materialize", lambda df, name="table": (shown.append((name, out := kept(df, name))), out)[1])
    passage = prose(3, 150)
    rows = [(i, " ".join(passage + prose(300 + i, 500))) for i in range(8)] + [(20 + i, " ".join(prose(9, 700 + i))) for i in range(2)]
    assert result(make_docs(rows), slots=2) == plain_components(rows)
    assert [r.node for name, df in shown if name == "wanted" for r in df.collect()].__len__() == 2


def test_prefixes_travel_once(make_docs, monkeypatch):
    """Shingles of prefixes are shuffled once to find where groups meet, and no row goes to one task alone."""
    plans = {}
    keep = ngram_join.materialize
    monkeypatch.setattr(ngram_join, "materialize", lambda df, name="table": (plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()), keep(df, name))[1])
    rows = [(i, " ".join(prose(i % 9, 40 + i))) for i in range(30)]
    assert result(make_docs(rows)) == plain_components(rows)
    assert len(re.findall(r"Exchange hashpartitioning\(token", plans["met"])) == 1
    assert "SinglePartition" not in plans["met"] and "met_groups" not in plans
