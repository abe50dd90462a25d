from __future__ import annotations

import hashlib
import itertools
import math
import random
from array import array
from functools import cache

import pyarrow as pa
import pytest

from barwright.llm import lm_score, pieces, segment
from tests.llm.conftest import prose


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load()


@pytest.fixture(scope="module")
def tiny():
    """A small vocabulary, so that all segmentations can be listed."""
    words = ["▁", "▁a", "a", "b", "ab", "▁ab", "aba", "ba", "▁▁"]
    entries = {w[:k]: None for w in words for k in range(1, len(w))}
    scores = [-9.0] * 256
    for i, w in enumerate(words):
        scores.append(-1.0 - 0.37 * i)
        entries[w] = (256 + i, scores[-1])
    spelled = [bytes([i]) for i in range(256)] + [w.replace("▁", " ").encode() for w in words]
    return pieces.Vocabulary(entries, list(range(256)), spelled, scores)


def all_cuts(text: str, vocabulary) -> list[tuple[float, tuple[int, ...]]]:
    """Every segmentation, by recursion over the first piece; bytes only where no single character is a piece."""
    marked = text.replace(" ", "▁")

    @cache
    def rest(i):
        if i == len(text):
            return [(0.0, ())]
        out = []
        firsts = [(j, vocabulary.entries.get(marked[i:j])) for j in range(i + 1, len(text) + 1)]
        firsts = [(j, (f[0],), f[1]) for j, f in firsts if f]
        if not any(j == i + 1 for j, *_ in firsts):
            firsts.append((i + 1, *vocabulary.spell(text[i])))
        for j, ids, cost in firsts:
            out += [(cost + c, ids + more) for c, more in rest(j)]
        return out

    return sorted(rest(0), reverse=True)


@pytest.mark.parametrize("text", [" a", " abab", "  ab", " abaab", " caba", " ba ab"])
def test_n_best_is_exact(tiny, text):
    want = all_cuts(text, tiny)
    got = segment.n_best(text, tiny, 6)
    assert [round(s, 9) for s, _ in got] == [round(s, 9) for s, _ in want[:6]]
    assert len({ids for _, ids in got}) == len(got)
    assert set(got) <= set(map(tuple, want)) or all(any(abs(s - w) < 1e-9 and i == x for w, x in want) for s, i in got)


def test_n_best_of_whole_texts(tiny):
    text = "abab ba aab"
    _, best, scores = segment.Encoder(tiny, 5).encode(text)
    parts = [all_cuts(u, tiny) for u in (" abab", " ba", " aab")]
    sums = sorted((sum(s for s, _ in c) for c in itertools.product(*parts)), reverse=True)[:5]
    assert [round(s, 9) for s in scores] == [round(s, 9) for s in sums] and best == scores[0]


@pytest.mark.parametrize("text", ["", "a", " ", "\n", "▁x ▁", "日本語 テスト", "a  b\t\tc\r\n", "x" * 5000, "\x00", "é̂", "\U0001f600 _ _a", " ".join(prose(1, 20_000))])
def test_round_trip(vocabulary, text):
    packed, _, _ = segment.Encoder(vocabulary, 3, remembered=100).encode(text)
    assert segment.decode(memoryview(packed).cast("i"), vocabulary) == text


def test_best_against_whole_lattice(vocabulary):
    """Cutting at units loses nothing: the whole text as one lattice has the same best score."""
    for seed in range(5):
        text = " ".join(prose(seed, 30)) + ". Next(line)\n_x $y 12"
        whole = segment.n_best(" " + text, vocabulary, 3)
        assert [round(s, 6) for s, _ in whole] == [round(s, 6) for s in segment.Encoder(vocabulary, 3).encode(text)[2]]


@pytest.mark.parametrize("text", ["f(x);\r\n}\r\n", "a line.\r\n\r\nThe next, \r\"x\"\r\n", "5 m².\r", "\r\r\r\r\r", "/**\r\n * x;\r\n */\r\n});\r\n"])
def test_pieces_across_units(vocabulary, text):
    """Pieces such as ';\\r' join punctuation with line ends."""
    whole = segment.n_best(" " + text, vocabulary, 3)
    packed, best, scores = segment.Encoder(vocabulary, 3).encode(text)
    assert [round(s, 6) for s, _ in whole] == [round(s, 6) for s in scores] and round(best, 6) == round(whole[0][0], 6)
    assert segment.decode(memoryview(packed).cast("i"), vocabulary) == text


def test_units_follow_the_vocabulary(tiny):
    """A piece may join words or letters and signs in any vocabulary."""
    entries = {**tiny.entries, "b▁": None, "b▁a": (265, -0.5), "b.": (266, -0.7)}
    own = pieces.Vocabulary(entries, tiny.byte_ids, [*tiny.spelled, b"b a", b"b."], [*tiny.scores, -0.5, -0.7])
    for text in ("ab ab. ab", "ab. b", "b a b.a"):
        want = all_cuts(" " + text, own)[:4]
        assert [round(s, 9) for s in segment.Encoder(own, 4).encode(text)[2]] == [round(s, 9) for s, _ in want]


@pytest.mark.parametrize("n", [2, 3, 5])
def test_segmentations_of_whole_texts(tiny, n):
    """The n best are given with their ids, not only with their scores."""
    for text in ("abab ba aab", "ab ab ab", "a", "c", ""):
        want = all_cuts(" " + text, tiny) if text else [(0.0, ())]
        got = [(s, tuple(memoryview(p).cast("i"))) for s, p, same in segment.Encoder(tiny, n).segmentations(text) if same]
        assert [round(s, 9) for s, _ in got] == [round(s, 9) for s, _ in want[:n]]
        assert len({ids for _, ids in got}) == len(got)
        assert all(any(abs(s - w) < 1e-9 and ids == x for w, x in want) for s, ids in got)


def test_documents_give_all_segmentations(vocabulary, make_docs):
    texts = [" ".join(prose(3, 40)), "f(x);\r\n}\r\n", "日本語 テスト", "", None, "a"]
    rows = {r.id: r for r in segment.encode_documents(make_docs(list(enumerate(texts)))).collect()}
    digest = lambda ids: hashlib.sha256(array("i", ids).tobytes()).hexdigest()
    for i, text in enumerate(texts):
        r = rows[i]
        if text is None:
            assert r.others is None and r.n_best_sha256 is None
            continue
        every = [r.ids, *r.others]
        assert len(every) == len(r.scores) and len({tuple(ids) for ids in every}) == len(every)
        assert r.n_best_sha256 == [digest(ids) for ids in every] and r.n_best_sha256[0] == r.ids_sha256
        assert all(segment.decode(ids, vocabulary) == text for ids in every) and r.round_trip
        # Each list of ids has the score that stands at its place.
        assert all(abs(sum(vocabulary.scores[k] for k in ids) - s) < 1e-6 for ids, s in zip(every, r.scores))
    assert len(rows[0].others) == 2


def test_documents(odd_docs, no_docs):
    rows = segment.encode_documents(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        assert (r.ids is None) == (r.n_pieces is None) == (r.round_trip is None)
        assert r.ids is None or (r.round_trip and len(r.ids) == r.n_pieces and r.scores == sorted(r.scores, reverse=True))
    assert segment.encode_documents(no_docs).count() == 0


def test_marginal_sums_all_segmentations(tiny):
    for word in ("a", "abab", "abaab", "cab"):
        want = math.log(sum(math.exp(s) for s, _ in all_cuts(" " + word, tiny)))
        assert abs(lm_score.marginal(word, tiny) - want) < 1e-9
        total = {}
        for s, ids in all_cuts(" " + word, tiny):
            for i in ids:
                total[i] = total.get(i, 0) + math.exp(s - want)
        got = {}
        for ids, p in lm_score.expected_pieces(word, tiny):
            for i in ids:
                got[i] = got.get(i, 0) + p
        assert got.keys() == total.keys() and all(abs(got[i] - total[i]) < 1e-9 for i in total)


def test_scores_of_documents(spark, make_docs, odd_docs, no_docs):
    from collections import Counter
    from zlib import crc32

    rows = [(i, " ".join(prose(i % 7, 50 + i)).upper() if i % 2 else " ".join(prose(i, 80))) for i in range(40, 90)]
    rows += [(r.doc_id, r.text) for r in odd_docs.collect()]
    split = lambda t: (t or "").encode().lower().split()
    held = lambda i: crc32(("" if i is None else str(i)).encode()) % 10 == 0
    counts = Counter()
    for i, t in rows:
        if not held(i):
            counts.update([*split(t), None])
    n, v = sum(counts.values()), len(counts)
    for share in (1 / 500_000, 1 / 20):  # all words travel, or nearly all are joined
        got = lm_score.score_documents(make_docs(rows), head_share=share).collect()
        assert len(got) == len(rows)
        want = sorted((held(i), len(split(t)) + 1, sum(counts[w] > 0 for w in [*split(t), None]), n, round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*split(t), None]), 6)) for i, t in rows)
        assert sorted((r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
        assert all(r.score < 0 for r in got)
    assert lm_score.score_documents(no_docs).count() == 0


def test_model_is_a_distribution(vocabulary, spark):
    words = spark.createDataFrame([(bytearray(b"the"), 5), (bytearray(b"cat"), 2)], "word binary, trained long")
    model, end = lm_score.fit_pieces(words, 3, vocabulary)
    assert abs(sum(math.exp(s) for s in model.scores) + math.exp(end) - 1) < 1e-9
    assert lm_score.marginal("the", model) > lm_score.marginal("the", vocabulary)


def test_forward_pass_gives_the_two_best(tiny, vocabulary, monkeypatch):
    """The forward pass gives what the search gives for two, to the bit, in any order; units are solved without the search."""
    pick = random.Random(4)
    units = ["".join(pick.choices(" abc", k=pick.randint(1, 9))) for _ in range(300)]
    for words, own in ((units, tiny), ([" " + w for w in prose(5, 400)] + ["    ", ";\r\n\r\n", "日本語", " aaaaaaaa", "é̂", "▁x"], vocabulary)):
        forward = segment.Forward(own)
        for unit in words + sorted(words):
            (score, ids), *second = segment.n_best(unit, own, 2)
            assert forward.solve(unit) == (ids, score, max(score - second[0][0], 0.0) if second else segment._NONE)
    monkeypatch.setattr(segment, "n_best", None)
    encoder = segment.Encoder(vocabulary, 3)
    assert encoder.learn(["some words", None, "", "more words"]) == [[" some", " words"], [], [], [" more", " words"]]
    assert list(encoder.solved) == [" more", " some", " words"]
    assert [list(r) for r in segment._runs(["ab", None, "c", "", "defg", "h"], 3)] == [["ab", None, "c"], ["", "defg"], ["h"]]


def test_workers_keep_no_units(spark, vocabulary, make_docs):
    """A worker process outlives its tasks: what it holds then counts against the stages that follow."""
    docs = make_docs([(i, " ".join(prose(i, 300))) for i in range(20)])
    encoded = segment.encode_documents(docs).collect()
    assert len(encoded) == 20

    def held(batches):
        for _ in batches:
            kept = [x for x in segment._encoder.__defaults__[0] if isinstance(x, segment.Encoder)]
            yield pa.RecordBatch.from_arrays([pa.array([sum(len(e.solved) + len(e.others) for e in kept)], pa.int64())], ["n"])

    assert sum(r.n for r in spark.range(8, numPartitions=8).mapInArrow(held, "n long").collect()) == 0


def test_units_are_forgotten_between_runs(vocabulary):
    """Small bounds change no result, and no more is held than twice the bound and a run."""
    texts = [" ".join(prose(seed, 400)) for seed in range(12)]
    wide, narrow = segment.Encoder(vocabulary), segment.Encoder(vocabulary, remembered=50)
    for text in texts:
        units = narrow.learn([text])[0]
        assert narrow.segmentations(text, units) == wide.segmentations(text)
        assert len(narrow.solved) + len(narrow.older) <= 2 * (50 + len(set(units)))
    assert len(wide.solved) > 2 * (50 + 300)
