from __future__ import annotations

import random
import re

import numpy as np

from barwright.llm import quality_model as m
from barwright.llm import quality_rules as q
from tests.llm.conftest import prose


def junk(seed: int) -> str:
    words = prose(seed, 120)
    return [" ".join(w + "$$$" for w in words), " ".join(w.upper() + "!!" for w in words), " ".join(words[:12] * 10)][seed % 3]


def plain_counts(text: str | None) -> tuple:
    """Straight from the definitions."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    covered = {j for i, w in enumerate(windows) if seen[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_counts_match_definition(make_docs, odd_docs):
    pick = random.Random(4)
    rows = [(100 + i, " ".join(pick.choices("a b c d".split(), k=pick.randint(0, 40)))) for i in range(60)]
    rows += [(200 + i, "\n".join(pick.choices(["x y", "x  y", "", " ", "z#"], k=pick.randint(0, 9)))) for i in range(30)]
    rows += [(300, "a b c " * 3000), (301, "\x1ca\x85b\xa0c d"), (302, "a\x0bb\x0cc\r\nd")]
    rows += [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = q.with_counts(make_docs(rows)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((i, *plain_counts(t))) for i, t in rows)


def test_rules_find_junk_without_labels(make_docs):
    rows = [(i, " ".join(prose(i, 150)) + ".") for i in range(170)] + [(1000 + i, junk(i)) for i in range(30)] + [(2000, "too short")]
    got = {r.id: r for r in q.judge(make_docs(rows)).collect()}
    assert all(got[i].kept for i in range(170))
    assert not any(got[1000 + i].kept for i in range(30))
    assert got[2000].base_failed and not got[2000].kept


def test_estimates_on_planted_accuracies():
    """Votes drawn from known accuracies give them back, and the classes."""
    rng = np.random.default_rng(0)
    good = rng.random(20_000) < 0.8
    votes = np.where(good[:, None], np.where(rng.random((20_000, 5)) < 0.95, 1, -1), np.where(rng.random((20_000, 5)) < 0.7, -1, 1))
    votes[rng.random(votes.shape) < 0.2] = 0
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    share, on_good, on_bad = q.estimate([(tuple(map(int, p)), int(c)) for p, c in zip(patterns, counts)], 5)
    assert abs(share - 0.8) < 0.03 and max(abs(a - 0.95) for a in on_good) < 0.03 and max(abs(a - 0.7) for a in on_bad) < 0.08


def test_rules_on_odd_and_no_rows(odd_docs, no_docs):
    assert q.judge(odd_docs).count() == odd_docs.count()
    assert q.judge(no_docs).count() == 0


def test_classifier_on_held_out_rows(spark, make_docs, odd_docs):
    rows = [(i, " ".join(prose(i, 80)) + ".") for i in range(300)] + [(1000 + i, junk(i)) for i in range(120)]
    rows += [(r.doc_id, r.text) for r in odd_docs.collect() if r.doc_id is None or r.doc_id > 5]
    labels = spark.createDataFrame([(i, int(i < 1000), "z") for i, _ in rows if i is not None and (i >= 20)] + [(None, 1, "z"), (50, None, "z")], "doc_id long, quality int, text string")
    described = m.describe(make_docs(rows), "doc_id", "text", m.held_out_fold().alias("held_out"))
    model = m.fit(described.where("NOT held_out"), labels)
    got = described.select("id", "held_out", m.score_column(model, m.F.col("x")).alias("s")).collect()
    assert len(got) == len(rows) and all(0 <= r.s <= 1 for r in got)
    out = [(r.id < 1000, r.s >= 0.3) for r in got if r.held_out and r.id is not None and r.id >= 20]
    assert len(out) > 40 and sum(a == b for a, b in out) / len(out) > 0.95


def test_classifier_without_labels_or_rows(spark, make_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert m.fit(m.describe(make_docs([(1, "a b")])), none) is None
    assert m.fit(m.describe(no_docs), none) is None
    assert make_docs([(1, "a b")]).select(m.score_column(None, m.F.col("x")).alias("s")).collect()[0].s == 0.5


def test_one_class_of_labels(spark, make_docs):
    docs = make_docs([(i, " ".join(prose(i, 30))) for i in range(40)])
    model = m.fit(m.describe(docs), spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int"))
    assert all(r.s > 0.5 for r in m.describe(docs).select(m.score_column(model, m.F.col("x")).alias("s")).collect())


def test_isotonic_pools_neighbours():
    x, y = m.isotonic([1.0, 2.0, 3.0, 4.0], [0.0, 3.0, 1.0, 4.0], [4.0, 4.0, 4.0, 4.0])
    assert np.interp([1, 2, 3, 4], x, y).tolist() == [0.0, 0.5, 0.5, 1.0]


def test_bounded_training_rows(spark, make_docs):
    docs = make_docs([(i, " ".join(prose(i, 30)) if i % 3 else junk(i)) for i in range(200)])
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(200)], "doc_id long, quality int")
    assert m.fit(m.describe(docs), labels, max_rows=100) is not None
