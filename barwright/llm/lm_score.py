"""Language-model scores: the probability of a text over all its segmentations into subword pieces.

Each word is a lattice of vocabulary pieces. The vocabulary's own scores weigh all segmentations of every
training word; the pieces' expected counts under these weights, on top of the same scores as a prior, make
the model's piece probabilities. A text's score is the log of the sum over all its segmentations, by a
forward recursion in log space; pieces never cross words, so the document is a sum over words and one end.

Beside it stands the word unigram score with additive smoothing. Words that make up at least one in
``1 / head_share`` tokens are at most that many and travel to every task; all other words are joined, so
neither a frequent word nor a large vocabulary ends in one task. Every count covers all training rows.

Null and empty texts have one token, the end. Null ids count as the empty text in the split.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwright.llm.common import id_remainder, lower_words
from barwright.llm.pieces import DEFAULT_MODEL, MARK, Vocabulary, load
from barwright.session import materialize


class WordLattices:
    """Lattices of mark + word for words given in turn.

    What leads to an end position depends on the characters before it alone. So a word keeps what it has in common
    with the one before, which is much where words come in order, and arcs are found by walking back from each end
    through a tree of reversed pieces.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.tree: dict = {}
        for piece, found in vocabulary.entries.items():
            if found:
                node = self.tree
                for c in reversed(piece):
                    node = node.setdefault(c, {})
                node[""] = ((found[0],), found[1])
        self.text = ""
        self.forward = [0.0]  # per end the natural log of the sum over all ways there
        self.arcs: list[list] = [[]]  # per end (start, ids, share of the ways there)

    def read(self, word: str) -> None:
        text, kept = MARK + word, 0
        for a, b in zip(text, self.text):
            if a != b:
                break
            kept += 1
        forward, arcs = self.forward, self.arcs
        del forward[kept + 1 :], arcs[kept + 1 :]
        self.text = text
        for end in range(kept + 1, len(text) + 1):
            node, single, found, terms = self.tree, False, [], []
            for start in range(end - 1, -1, -1):
                c = text[start]
                if start and c == MARK:  # a literal mark is in no piece
                    break
                node = node.get(c)
                if node is None:
                    break
                piece = node.get("")
                if piece:
                    found.append((start, piece[0]))
                    terms.append(forward[start] + piece[1])
                    single = single or start == end - 1
            if not single:
                ids, cost = self.vocabulary.spell(text[end - 1])
                found.append((end - 1, ids))
                terms.append(forward[end - 1] + cost)
            if len(terms) == 1:
                forward.append(terms[0])
                arcs.append([(*found[0], 1.0)])
                continue
            top = max(terms)
            shares = [math.exp(t - top) for t in terms]
            total = sum(shares)
            forward.append(top + math.log(total))
            arcs.append([(start, ids, p / total) for (start, ids), p in zip(found, shares)])

    def marginal(self, word: str) -> float:
        """Natural log of the sum over all segmentations."""
        self.read(word)
        return self.forward[-1]

    def expected(self, word: str) -> list[tuple[tuple[int, ...], float]]:
        """(ids, expected number of uses) of every arc, over all segmentations by their probability."""
        self.read(word)
        share = [0.0] * len(self.arcs)
        share[-1] = 1.0  # probability that a segmentation has a cut here
        out = []
        for end in range(len(share) - 1, 0, -1):
            here = share[end]
            if here > 1e-12:
                for start, ids, p in self.arcs[end]:
                    p *= here
                    share[start] += p
                    out.append((ids, p))
        return out


def marginal(word: str, vocabulary: Vocabulary) -> float:
    return WordLattices(vocabulary).marginal(word)


def expected_pieces(word: str, vocabulary: Vocabulary) -> list[tuple[tuple[int, ...], float]]:
    return WordLattices(vocabulary).expected(word)


def count_words(docs: DataFrame, held_out: Column, text_col: str = "text") -> DataFrame:
    """(word, trained, held): occurrences of every word in training and held-out rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {False: Counter(), True: Counter()}

        def flush():
            words = list(seen[False].keys() | seen[True].keys())
            columns = [pa.array(words, pa.binary()), *(pa.array([seen[h][w] for w in words], pa.int64()) for h in (False, True))]
            seen[False].clear()
            seen[True].clear()
            return pa.RecordBatch.from_arrays(columns, names=["word", "trained", "held"])

        for batch in batches:
            for text, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[held].update(lower_words(text))
                if len(seen[False]) + len(seen[True]) > 300_000:
                    yield flush()
        yield flush()

    counted = docs.select(F.col(text_col).alias("text"), held_out.alias("held")).mapInArrow(run, "word binary, trained long, held long")
    return counted.groupBy("word").agg(F.sum("trained").alias("trained"), F.sum("held").alias("held"))


def fit_pieces(words: DataFrame, ends: int, vocabulary: Vocabulary, prior_weight: float = 1000.0) -> tuple[Vocabulary, float]:
    """(vocabulary with the model's log probabilities, log probability of the end) from counted training words."""
    shared = words.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = WordLattices(shared.value)
        sums = [0.0] * len(shared.value.scores)
        for batch in batches:
            for word, count in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for ids, p in lattices.expected(word.decode()):
                    for i in ids:
                        sums[i] += p * count
        total = np.array(sums)
        used = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], names=["piece", "n"])

    counts = words.where("trained > 0").select("word", "trained").mapInArrow(run, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n"))
    expected = np.zeros(len(vocabulary.scores))
    for row in counts.collect():
        expected[row.piece] = row.n
    weights = expected + prior_weight * np.exp(np.array(vocabulary.scores))
    total = weights.sum() + ends + 1.0
    with np.errstate(divide="ignore"):
        scores = np.log(weights) - math.log(total)
    return vocabulary.with_scores(scores.tolist()), math.log(ends + 1.0) - math.log(total)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, model_file: str = DEFAULT_MODEL, head_share: float = 1 / 500_000) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row, scores in log10.

    Rows whose id has remainder zero are held out and only scored.
    """
    spark = docs.sparkSession
    held_out = id_remainder(F.col(id_col), folds) == 0
    words = materialize(count_words(docs, held_out, text_col).sortWithinPartitions("word"), "words")
    known = words.agg(F.sum("trained"), F.count(F.when(F.col("trained") > 0, 1)), F.sum(F.col("trained") + F.col("held"))).first()
    ends = docs.where(~held_out).count()
    tokens = (known[0] or 0) + ends
    distinct = known[1] + (ends > 0)
    everything = (known[2] or 0) + 1
    whole = tokens + 0.1 * (distinct + 1)
    model, end_score = fit_pieces(words, ends, load(model_file))
    shared = spark.sparkContext.broadcast(model)

    def score_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices, ten = WordLattices(shared.value), math.log(10)
        for batch in batches:
            scores = [lattices.marginal(w.decode()) / ten for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=["word", "trained", "held", "score"])

    scored = words.select("word", "trained", "held").mapInArrow(score_words, "word binary, trained long, held long, score double")
    base = F.log10((F.col("trained") + 0.1) / F.lit(whole))
    scored = materialize(scored.select("word", (F.col("trained") + F.col("held")).alias("n"), (F.col("trained") > 0).cast("long").alias("known"), base.alias("base"), "score"), "word_scores")
    head = {bytes(r.word): (r.known, r.base, r.score) for r in scored.where(F.col("n") >= everything * head_share).collect()}
    head = spark.sparkContext.broadcast(head)
    end = (int(ends > 0), math.log10((ends + 0.1) / whole), end_score / math.log(10))
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = head.value
        for batch in batches:
            out, tails, times, offsets = [], [], [], [0]
            for text in batch.column(1).to_pylist():
                words_here = lower_words(text)
                n_known, base_sum, score_sum = end
                for word, n in Counter(words_here).items():
                    found = frequent.get(word)
                    if found:
                        n_known += found[0] * n
                        base_sum += found[1] * n
                        score_sum += found[2] * n
                    else:
                        tails.append(word)
                        times.append(n)
                offsets.append(len(tails))
                out.append((len(words_here) + 1, n_known, base_sum, score_sum))
            numbers = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64(), pa.float64()))] if out else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64())]
            lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), v) for v in (pa.array(tails, pa.binary()), pa.array(times, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *numbers, *lists], names=["id", "held_out", "n_tokens", "n_known", "base_score", "score", "tail", "times"])

    schema = f"id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, tail array<binary>, times array<long>"
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), held_out.alias("held_out")).mapInArrow(split, schema)
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "head_scores")
    tail = rows.select("row", F.explode(F.arrays_zip("tail", "times")).alias("t")).select("row", F.col("t.tail").alias("word"), F.col("t.times").alias("times"))
    tail = tail.join(scored, "word").select("row", *[(F.col(c) * F.col("times")).alias(c) for c in ("known", "base", "score")])
    tail = tail.groupBy("row").agg(F.sum("known").alias("known"), F.sum("base").alias("base"), F.sum("score").alias("more"))
    total = rows.drop("tail", "times").join(tail, "row", "left")
    plus = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0))).alias(a)
    return total.select("id", "held_out", "n_tokens", plus("n_known", "known"), F.lit(tokens).cast("long").alias("train_tokens"), plus("base_score", "base"), plus("score", "more"))
