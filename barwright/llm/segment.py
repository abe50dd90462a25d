"""SentencePiece encoding and decoding with exact N-best segmentations.

The forward Viterbi pass gives, for every position, the best score of all that lies before it. Searching
backwards from the end, that score is exactly what remains, so A-star pops whole segmentations in falling
order of score and expands nothing else. A text is cut into words and runs of other characters, but nowhere
between two characters that some piece of the vocabulary holds side by side. No piece crosses such a cut, so
the text is a chain of small lattices: each is solved once per task, and the N best of the chain come from
the N - 1 smallest losses: each is the best chain with the units behind its losses replaced.

A null text gives null columns of the encoding; an empty one has no pieces, score 0 and one segmentation.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from array import array
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.llm.pieces import DEFAULT_MODEL, MARK, Vocabulary, load

#: Letters and digits after their spaces, other visible characters after theirs, single line ends and tabs.
_UNITS = re.compile(r" *[^\W_]+| *(?:[^\w\s]|_)+| +|\s", re.DOTALL)
ENCODED = "ids array<int>, others array<array<int>>, n_pieces long, score double, scores array<double>, ids_sha256 string, n_best_sha256 array<string>, round_trip boolean"


def _trie(vocabulary: Vocabulary) -> tuple[dict, int]:
    """(the pieces by characters, the longest piece); a character leads to its followers and the (log probability, ids)
    of the piece that ends there, if one does. Built once per vocabulary."""
    found = vocabulary.__dict__.get("_trie")
    if found is None:
        root: dict = {}
        for piece, entry in vocabulary.entries.items():
            if entry:
                node = root
                for char in piece[:-1]:
                    node = node.setdefault(char, ({}, []))[0]
                node.setdefault(piece[-1], ({}, []))[1][:] = [entry[1], (entry[0],)]
        found = vocabulary.__dict__["_trie"] = (root, max(map(len, vocabulary.entries), default=1))
    return found


def _crossing(vocabulary: Vocabulary) -> tuple[frozenset[str], list[str]]:
    """Neighbours in some piece that _UNITS, which looks only at the two, would cut apart, and a few characters such
    that each pair has one of them. Built once per vocabulary."""
    found = vocabulary.__dict__.get("_crossing")
    if found is None:
        pieces = [p.replace(MARK, " ") for p, entry in vocabulary.entries.items() if entry]
        pairs = {a + b for p in pieces for a, b in zip(p, p[1:])}
        pairs = {p for p in pairs if len(_UNITS.findall(p)) > 1}
        marks, left = [], list(pairs)
        while left:
            count = Counter(c for p in left for c in set(p))
            marks.append(max(count, key=lambda c: (count[c], c)))
            left = [p for p in left if marks[-1] not in p]
        found = vocabulary.__dict__["_crossing"] = (frozenset(pairs), marks)
    return found


def units_of(text: str, vocabulary: Vocabulary) -> list[str]:
    """Parts of a text such that no piece reaches from one into the next."""
    units = _UNITS.findall(text)
    crossing, marks = _crossing(vocabulary)
    if not any([c in text for c in marks]):
        return units
    starts = [i for i in range(len(units)) if not i or units[i - 1][-1] + units[i][0] not in crossing]
    return ["".join(units[i:j]) for i, j in zip(starts, [*starts[1:], len(units)])]


def n_best(unit: str, vocabulary: Vocabulary, n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The n best (score, ids) segmentations of a unit, best first; fewer if there are fewer."""
    size = len(unit)
    root, longest = _trie(vocabulary)
    best = [0.0] + [-1e300] * size
    arcs: list[list] = [[] for _ in range(size + 1)]
    text = unit.replace(MARK, "\0").replace(" ", MARK)  # a literal mark is in no piece
    for start in range(size):
        reached = best[start]
        node = root
        end = start
        for char in text[start : start + longest]:
            found = node.get(char)
            if found is None:
                break
            end += 1
            node, piece = found
            if piece:
                cost, ids = piece
                arcs[end].append((start, cost, ids))
                cost += reached
                if cost > best[end]:
                    best[end] = cost
        into = arcs[start + 1]
        if not into or into[-1][0] != start:  # no piece is this one character
            ids, cost = vocabulary.spell(unit[start])
            into.append((start, cost, ids))
            if reached + cost > best[start + 1]:
                best[start + 1] = reached + cost
    # An open node (rest fixed behind it) stands for its best completion, whose score is known exactly. Popping
    # one follows that completion to the start; each arc passed over opens a node, unless n scores beat it.
    heap = [(-best[size], 0, size, 0.0, None)]
    known = [best[size]]
    out: list = []
    tie = 0
    while heap and len(out) < n:
        _, _, at, behind, chain = heapq.heappop(heap)
        while at:
            into = arcs[at]
            pick = into[0]
            if len(into) > 1:
                top = best[pick[0]] + pick[1]
                for arc in into[1:]:
                    score = best[arc[0]] + arc[1]
                    other, low = arc, score
                    if score > top:
                        other, low, pick, top = pick, top, arc, score
                    low += behind
                    if len(known) < n:
                        heapq.heappush(known, low)
                    elif low > known[0]:
                        heapq.heapreplace(known, low)
                    else:
                        continue
                    tie += 1
                    heapq.heappush(heap, (-low, tie, other[0], behind + other[1], (other[2], chain)))
            behind += pick[1]
            chain = (pick[2], chain)
            at = pick[0]
        ids: list[int] = []
        while chain:
            own, chain = chain
            ids += own
        out.append((behind, tuple(ids)))
    return out


#: The loss of a unit that has one segmentation only.
_NONE = 1e300
#: Units after which an encoder begins to forget older ones, about 300 bytes each; a run of texts has some 80,000.
REMEMBERED = 125_000


def _ends(vocabulary: Vocabulary) -> dict:
    """The pieces by characters, last one first, as in ``_trie``. Built once per vocabulary."""
    root = vocabulary.__dict__.get("_ends")
    if root is None:
        root = vocabulary.__dict__["_ends"] = {}
        for piece, entry in vocabulary.entries.items():
            if entry:
                node = root
                for char in piece[:0:-1]:
                    node = node.setdefault(char, ({}, []))[0]
                node.setdefault(piece[0], ({}, []))[1][:] = [entry[1], (entry[0],)]
    return root


class Forward:
    """The best segmentation of a unit and the loss of its second best, as ``n_best`` gives them for two.

    Each place keeps its two best arcs, which depend on the characters before it only: a unit that begins as the one
    before it goes on from there. The second best leaves the best once, by the second arc into one of its places.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary, self.unit = vocabulary, ""
        self.best: list[float] = [0.0]
        self.second = [-1e300]
        self.arcs: list = [None]  # (start, (log probability, ids)) of the best arc into each place
        self.others: list = [None]

    def solve(self, unit: str) -> tuple[tuple[int, ...], float, float]:
        """(ids, score, what the second best loses)."""
        best, second, arcs, others = self.best, self.second, self.arcs, self.others
        same = 0
        for a, b in zip(unit, self.unit):
            if a != b:
                break
            same += 1
        self.unit = unit
        for held in (best, second, arcs, others):
            del held[same + 1 :]
        root = _ends(self.vocabulary)
        text = unit.replace(MARK, "\0").replace(" ", MARK)  # a literal mark is in no piece
        for start in range(same, len(unit)):
            node, piece = root.get(text[start]) or ({}, None)
            if not piece:  # no piece is this one character
                piece = self.vocabulary.spell(unit[start])[::-1]
            top, arc, low, other = best[start] + piece[0], (start, piece), -1e300, None
            while start:
                start -= 1
                found = node.get(text[start])
                if found is None:
                    break
                node, piece = found
                if piece:
                    score = best[start] + piece[0]
                    if score >= top:
                        low, other, top, arc = top, arc, score, (start, piece)
                    elif score >= low:
                        low, other = score, (start, piece)
            best.append(top)
            second.append(low)
            arcs.append(arc)
            others.append(other)
        at, behind, ids = len(unit), 0.0, ()
        least, turn = -_NONE, None  # the best score of all that leave the best segmentation, and (arc, score behind) there
        while at:
            if others[at] and second[at] + behind > least:
                least, turn = second[at] + behind, (others[at], behind)
            at, (cost, own) = arcs[at]
            behind += cost
            ids = own + ids
        if turn is None:
            return ids, behind, _NONE
        (at, (cost, _)), score = turn
        score += cost
        while at:
            at, (cost, _) = arcs[at]
            score += cost
        return ids, behind, max(behind - score, 0.0)


class Encoder:
    """Encodes whole texts; remembers the units of the last runs of texts, twice ``remembered`` and one run's at most.

    Every unit is solved for its two best segmentations, which give its least loss; the rest only where that is one
    of the least of a text. New units of several texts are solved in order, as neighbours begin alike.
    """

    def __init__(self, vocabulary: Vocabulary, n: int = 3, remembered: int = REMEMBERED) -> None:
        self.vocabulary, self.n, self.remembered = vocabulary, n, remembered
        self.forward = Forward(vocabulary)
        self.solved: dict[str, tuple] = {}
        self.older: dict[str, tuple] = {}  # goes when ``solved`` is full and takes its place
        self.others: dict[str, list] = {}

    def _solve(self, unit: str) -> tuple[bytes, float, float]:
        """(ids as 32-bit integers, score, what the second best loses)."""
        found = self.older.get(unit)
        if found is None:
            ids, score, loss = self.forward.solve(unit)
            found = (array("i", ids).tobytes(), score, loss)
        self.solved[unit] = found
        return found

    def forget(self) -> None:
        """Lets all units go, as a worker process outlives its tasks and then takes memory from others."""
        self.solved, self.older, self.others = {}, {}, {}

    def _others(self, unit: str) -> list[tuple[float, bytes, bool]]:
        """(loss, ids as 32-bit integers, whether they spell what the best spells) of the second to the n-th best."""
        found = self.others.get(unit)
        if found is None:
            (score, best), *rest = n_best(unit, self.vocabulary, self.n)
            text = decode(best, self.vocabulary)
            found = [(max(score - s, 0.0), array("i", ids).tobytes(), decode(ids, self.vocabulary) == text) for s, ids in rest]
            self.others[unit] = found
        return found

    def learn(self, texts: list[str | None]) -> list[list[str]]:
        """The units of each text; those that are new are solved."""
        if len(self.solved) >= self.remembered:  # not amid the units of a text
            self.older, self.solved = self.solved, {}
        if len(self.others) >= self.remembered:
            self.others = {}
        parts = [units_of(" " + text, self.vocabulary) if text else [] for text in texts]
        for unit in sorted(set().union(*parts).difference(self.solved)):
            self._solve(unit)
        return parts

    def segmentations(self, text: str, units: list[str] | None = None) -> list[tuple[float, bytes, bool]]:
        """The n best (score, ids as 32-bit integers, whether they spell what the best spells) of the whole text, best
        first; fewer if there are fewer. ``units`` are those of ``learn``, if at hand."""
        if not text:
            return [(0.0, b"", True)]
        units = units or self.learn([text])[0]
        get, solve = self.solved.get, self._solve
        best, scores, firsts = zip(*[get(u) or solve(u) for u in units])
        total = sum(scores)
        found: list[tuple] = [(0.0, ())]  # the loss, and the (place, ids, spells the same) of units that are not cut best
        losses = list(firsts)
        for _ in range(self.n - 1):  # only the n - 1 smallest first losses can take part in the n best
            least = min(losses)
            if least >= _NONE:
                break
            at = losses.index(least)
            losses[at] = _NONE
            own = [(0.0, ()), *[(x, ((at, ids, same),)) for x, ids, same in self._others(units[at])]]
            found = heapq.nsmallest(self.n, [(s + x, picks + more) for s, picks in found for x, more in own])
        out = []
        for s, picks in found:
            packs = list(best)
            for at, ids, _ in picks:
                packs[at] = ids
            out.append((total - s, b"".join(packs), all([same for *_, same in picks])))
        return out

    def encode(self, text: str) -> tuple[bytes, float, list[float]]:
        """(ids as 32-bit integers, best score, scores of the n best segmentations of the whole text)."""
        found = self.segmentations(text)
        return found[0][1], found[0][0], [s for s, *_ in found]


def _encoder(shared: Broadcast, n: int, kept: list = []) -> Encoder:  # noqa: B006
    """The worker process's encoder: its trees of pieces serve all tasks that the process runs."""
    if not kept or kept[0] is not shared or kept[1].n != n:
        kept.clear()  # before the other vocabulary is read
        kept[:] = [shared, Encoder(shared.value, n)]
    return kept[1]


def decode(ids, vocabulary: Vocabulary) -> str:
    """The text of ids; the space that encoding puts first is taken off."""
    raw = b"".join(map(vocabulary.spelled.__getitem__, ids))
    return raw.decode("utf-8", "replace")[1:] if raw[:1] == b" " else raw.decode("utf-8", "replace")


def _runs(texts: list[str | None], most: int = 1 << 21) -> Iterator[list[str | None]]:
    """The texts in turn, in runs of about ``most`` characters; a longer text is the last of its run."""
    run: list[str | None] = []
    size = 0
    for text in texts:
        run.append(text)
        size += len(text or "")
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run


def _offsets(lengths: list[int]) -> pa.Array:
    return pa.array([0, *itertools.accumulate(lengths)], pa.int32())


def _id_lists(packs: list[bytes | None]) -> pa.ListArray:
    held = [p or b"" for p in packs]
    offsets = _offsets([len(p) // 4 for p in held])
    values = pa.Array.from_buffers(pa.int32(), offsets[-1].as_py(), [None, pa.py_buffer(b"".join(held))])
    return pa.ListArray.from_arrays(offsets, values, mask=pa.array([p is None for p in packs], pa.bool_()))


def _id_lists_of_lists(rows: list[list[bytes] | None]) -> pa.ListArray:
    inner = _id_lists([p for row in rows for p in row or ()])
    return pa.ListArray.from_arrays(_offsets([len(row or ()) for row in rows]), inner, mask=pa.array([row is None for row in rows], pa.bool_()))


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_file: str = DEFAULT_MODEL, n: int = 3, with_ids: bool = True) -> DataFrame:
    """(id, ids, others, n_pieces, score, scores, ids_sha256, n_best_sha256, round_trip) per row.

    ids and score are the best segmentation's, others the ids of the second to the n-th best; scores and
    n_best_sha256 are those of the n best in order, digests over little-endian 32-bit ids. round_trip says that
    every one of them decodes to the text. Without ``with_ids`` ids and others stay null. The vocabulary is read
    on the driver and broadcast: its size is fixed and does not grow with the data.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(load(model_file))
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared, n)
        vocabulary = encoder.vocabulary
        types = [pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.string(), pa.list_(pa.string()), pa.bool_()]
        names = ["id", "ids", "others", "n_pieces", "score", "scores", "ids_sha256", "n_best_sha256", "round_trip"]
        for whole in batches:
            for i in range(0, whole.num_rows, 512):
                batch = whole.slice(i, 512)
                rows, bests, others = [], [], []
                for text, units in ((t, u) for run in _runs(batch.column(1).to_pylist()) for t, u in zip(run, encoder.learn(run))):
                    if text is None:
                        rows.append((None,) * 6)
                        bests.append(None)
                        others.append(None)
                        continue
                    found = encoder.segmentations(text, units)
                    packs = [p for _, p, _ in found]
                    bests.append(packs[0])
                    others.append(packs[1:])
                    digests = [hashlib.sha256(p).hexdigest() for p in packs]
                    exact = decode(memoryview(packs[0]).cast("i"), vocabulary) == text and all([same for *_, same in found])
                    rows.append((len(packs[0]) // 4, found[0][0], [s for s, *_ in found], digests[0], digests, exact))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                if with_ids:
                    lists = [_id_lists(bests), _id_lists_of_lists(others)]
                else:
                    lists = [pa.nulls(len(rows), t) for t in (pa.list_(pa.int32()), pa.list_(pa.list_(pa.int32())))]
                yield pa.RecordBatch.from_arrays([batch.column(0), *lists, *columns], names=names)
        encoder.forget()

    return source.mapInArrow(run, f"id {kind}, {ENCODED}")
