"""Secret scans: fixed patterns, and formats learned from what they find by grammar inference.

Credentials found by the patterns are labelled examples. Each kind's different examples make up a prefix tree of
whole credentials, END included: a prefix of at least ``support`` examples is a state of its own; below that, what
is left of the examples of one such prefix is pooled into one state per length. States whose next steps and
remaining lengths are statistically compatible are merged, which turns the tree into a probabilistic automaton.

Every run of credential characters outside the base spans, as short as the shortest example, is a candidate; runs
that end or are joined by punctuation are also tried without it. A candidate is a secret if an automaton ends where
examples end, finds it about as likely as examples that pass the same states, and more likely, given how rare
secrets are, than the corpus's own runs are by a table of neighbouring character classes.

The tree is learned from up to ``per_form`` different examples (by hash) of each form: kind, exact length (from 64
up to a power of two) and classes of the first four characters. Their weights make up for the rest, so a format
neither grows the tree with the corpus nor vanishes when others grow. All else covers all texts and all runs.

Null and empty texts have no spans. A kind with fewer than ``least`` different examples learns no automaton.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwright.session import materialize

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "format")
#: Candidates are cut from runs of these.
RUN = re.compile(r"[A-Za-z0-9+/_.=-]+")
PART = re.compile(r"[A-Za-z0-9+/_-]+")
END = "$"


def base_spans(text: str | None) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, credential) of the fixed patterns, by start, then kind."""
    if not text:
        return []
    found = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def runs(text: str | None, base: list[tuple[int, int, int, str]]) -> Iterator[tuple[int, str]]:
    """(start, run) of all runs of credential characters, less what base spans cover."""
    if not text:
        return
    starts, covered = [], []
    for s, _, e, _ in base:  # by start; overlapping ones are joined
        if covered and s <= covered[-1]:
            covered[-1] = max(covered[-1], e)
        else:
            starts.append(s)
            covered.append(e)
    if not starts:
        for m in RUN.finditer(text):
            yield m.start(), m[0]
        return
    for m in RUN.finditer(text):
        at, end = m.span()
        k = bisect_right(covered, at)
        while k < len(starts) and starts[k] < end:
            if at < starts[k]:
                yield at, text[at : starts[k]]
            at, k = max(at, covered[k]), k + 1
        if at < end:
            yield at, text[at:end]


def readings(start: int, run: str) -> Iterator[tuple[int, str]]:
    """The run itself, without punctuation at its ends, and its parts between '.' and '='; later ones are tried if none before fits."""
    yield start, run
    if not run.isalnum():
        bare = run.strip("._=+/-")
        if bare and bare != run:
            yield start + run.index(bare), bare
        if "." in run or "=" in run:
            for m in PART.finditer(run):
                yield start + m.start(), m[0]


def shape(value: str) -> str:
    """One class per character: digits 0, letters a (to f), g, A (to F), G, others themselves."""
    return value.translate(_SHAPES)


_SHAPES = {i: "0" for i in range(48, 58)} | {i: "A" if i < 71 else "G" for i in range(65, 91)} | {i: "a" if i < 103 else "g" for i in range(97, 123)}
_WIDTH = {"0": 10, "a": 6, "g": 20, "A": 6, "G": 20}


#: Share of a step's probability for classes that were not seen there, by the whole kind's classes.
FREE = 0.02


class Automaton:
    """A probabilistic automaton: state -> {class: state}; END ends. Counts of steps set its probabilities."""

    def __init__(self, steps: dict[int, dict[str, int]], counts: dict[int, dict[str, float]] | None = None):
        self.steps = steps
        self.expected: dict[int, tuple[float, float]] = {}  # mean and variance of a step's log probability
        self.logs: dict[int, dict[str, float]] = {}
        self.free: dict[str, float] = {}
        self.usual: dict[int, int] = {}
        self.prior = 0.0
        if counts is not None:
            self.set_counts(counts)

    def set_counts(self, counts: dict[int, dict[str, float]]) -> None:
        whole: dict[str, float] = defaultdict(float)
        for state in self.steps:
            seen = counts.get(state, {})
            total = sum(seen.values())
            self.logs[state] = {c: math.log(n / total * (1 - FREE * (c != END)) / _WIDTH.get(c, 1)) for c, n in seen.items()}
            shares = [(n / total, self.logs[state][c]) for c, n in seen.items()]
            mean = sum(p * x for p, x in shares)
            self.expected[state] = (mean, sum(p * (x - mean) ** 2 for p, x in shares))
            self.usual[state] = max(((n, self.steps[state].get(c, 0)) for c, n in seen.items() if c != END), default=(0, 0))[1]
            for c, n in seen.items():
                if c != END:
                    whole[c] += n
        total = sum(whole.values()) + 64
        self.free = {c: math.log(FREE * (n + 1) / total / _WIDTH.get(c, 1)) for c, n in whole.items()}
        self.rare = math.log(FREE / total / 64)

    def walk(self, word: str) -> Iterator[tuple[int, str]]:
        """The (state, class) steps of a shape; a class unknown to a state takes its usual step."""
        state = 0
        for c in word:
            yield state, c
            following = self.steps[state].get(c)
            state = self.usual.get(state, 0) if following is None else following
        yield state, END

    def total(self, word: str) -> tuple[float, float, float]:
        """Log probability, what it should be along these states, and its variance; minus infinity where no example ends."""
        sum_ = mean = variance = 0.0
        for state, c in self.walk(word):
            known = self.logs[state].get(c)
            if known is None:
                if c == END:
                    return -math.inf, mean, variance
                known = self.free.get(c, self.rare)
            sum_ += known
            m, v = self.expected[state]
            mean, variance = mean + m, variance + v
        return sum_, mean, variance

    def score(self, word: str) -> float:
        """Mean log probability per step."""
        return self.total(word)[0] / (len(word) + 1)

    def accepts(self, word: str, usual: float, width: float = 4.0, slack: float = 0.3) -> bool:
        """``usual``: the word's log probability among all runs of the corpus."""
        total, mean, variance = self.total(word)
        if total == -math.inf:
            return False
        return total >= mean - max(width * math.sqrt(variance), slack * (len(word) + 1)) and total + self.prior > usual


class Background:
    """How likely a shape is among all runs: neighbouring classes, ends included."""

    def __init__(self, pairs: dict[str, float]):
        after: dict[str, float] = defaultdict(float)
        for pair, n in pairs.items():
            after[pair[0]] += n
        self.logs = {p: math.log((n + 0.01) / (after[p[0]] + 1) / _WIDTH.get(p[1], 1)) for p, n in pairs.items()}
        self.unseen = {c: math.log(0.01 / (n + 1) / 64) for c, n in after.items()}
        self.never = math.log(0.01 / 64)
        self.runs = after[END]

    def score(self, word: str) -> float:
        logs, before, out = self.logs, END, 0.0
        for c in [*word, END]:
            known = logs.get(before + c)
            out += self.unseen.get(before, self.never) if known is None else known
            before = c
        return out


class Formats:
    """The automata of all kinds, the background, and verdicts on shapes seen before."""

    def __init__(self, automata: dict[int, Automaton], background: Background, shortest: int):
        self.automata, self.background, self.shortest = automata, background, shortest
        self.known: dict[str, bool] = {}

    def is_secret(self, value: str) -> bool:
        if len(value) < self.shortest:
            return False
        word = shape(value)
        found = self.known.get(word)
        if found is None:
            usual = self.background.score(word)
            found = any(a.accepts(word, usual) for a in self.automata.values())
            if len(self.known) > 1_000_000:
                self.known.clear()
            self.known[word] = found
        return found

    def find(self, text: str | None, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
        """Spans of kind format: of each run the first reading that is a secret, or all its parts that are."""
        out: list[tuple[int, int, int, str]] = []
        if not self.automata:
            return out
        for start, run in runs(text, base):
            if len(run) < self.shortest:
                continue
            reach = -1
            for at, value in readings(start, run):
                if at >= reach and self.is_secret(value):
                    out.append((at, 3, at + len(value), value))
                    reach = at + len(value)
                    if at == start and len(value) == len(run):
                        break
        return out


NO_FORMATS = Formats({}, Background({}), 0)


def prefix_tree(words: dict[str, float], support: int = 20, longest: int = 256) -> tuple[dict, dict]:
    """(children, visits) by state of weighted words: see the module's text. Beyond ``longest`` one state goes on to itself."""
    children: dict[int, dict[str, int]] = {0: {}}
    visits: dict[int, dict[str, float]] = {0: {}}

    def state() -> int:
        children[len(children)] = {}
        visits[len(visits)] = {}
        return len(children) - 1

    def add(q: int, c: str, n: float) -> None:
        visits[q][c] = visits[q].get(c, 0) + n

    def pool(q: int, depth: int, part: list[tuple[str, float]]) -> None:
        while part:
            going = [(w, n) for w, n in part if len(w) > depth]
            for w, n in part:
                add(q, w[depth] if len(w) > depth else END, n)
            after = q if depth >= longest else state() if going else q
            for w, _ in going:
                children[q][w[depth]] = after
            q, depth, part = after, depth + 1, going

    todo = [(0, 0, sorted(words.items()))]
    for q, depth, part in todo:
        branches: dict[str, list] = defaultdict(list)
        for w, n in part:
            branches[w[depth] if len(w) > depth else END].append((w, n))
        few: list[tuple[str, float]] = []
        for c, some in sorted(branches.items()):
            add(q, c, sum(n for _, n in some))
            if c != END and len(some) >= support and depth < longest:
                children[q][c] = state()
                todo.append((children[q][c], depth + 1, some))
            elif c != END:
                few += some
        if few:
            rest = state()
            for w, _ in few:
                children[q][w[depth]] = rest
            pool(rest, depth + 1, few)
    return children, visits


def _remaining(children: dict, visits: dict) -> dict[int, Counter]:
    """Per state how many characters are left, by visits. States are numbered parents first."""
    left: dict[int, Counter] = {}
    for q in sorted(children, reverse=True):
        left[q] = Counter({0: visits[q][END]} if END in visits[q] else {})
        total: Counter = Counter()
        for child in set(children[q].values()) - {q}:
            for k, n in left[child].items():
                total[k + 1] += n
        share = sum(n for c, n in visits[q].items() if c != END) / (sum(total.values()) or 1)
        for k, n in total.items():
            left[q][k] += n * share
    return left


def merge_states(prefixes: dict[str, float], alpha: float = 0.05) -> Automaton:
    """The automaton of a prefix tree given as prefix -> visits; END at its end: words that end there."""
    children: dict[int, dict[str, int]] = {0: {}}
    visits: dict[int, dict[str, float]] = {0: {}}
    number = {"": 0}
    for prefix in sorted(prefixes, key=lambda p: (len(p), p)):
        if prefix and prefix[:-1] in number:
            parent = number[prefix[:-1]]
            visits[parent][prefix[-1]] = prefixes[prefix]
            if prefix[-1] != END:
                q = number[prefix] = children[parent][prefix[-1]] = len(number)
                children[q], visits[q] = {}, {}
    return merge_tree(children, visits, alpha)


def merge_tree(children: dict, visits: dict, alpha: float = 0.05, evidence: float = 8.0) -> Automaton:
    """Merges compatible states.

    Red states are final, blue ones are their children. A blue state joins the first red one with which it agrees
    within Hoeffding's bound, in the lengths that are left and in the next steps of both and of all that follows;
    if there is none it turns red. A state of fewer than ``evidence`` visits joins none.
    """
    left = _remaining(children, visits)

    def total(q: int) -> float:
        return sum(visits[q].values())

    def agree(x: dict, n: float, y: dict, m: float) -> bool:
        bound = math.sqrt(0.5 * math.log(2 / alpha)) * (n**-0.5 + m**-0.5)
        return all(abs(x.get(k, 0) / n - y.get(k, 0) / m) <= bound for k in {*x, *y})

    def compatible(a: int, b: int) -> bool:
        n, m = total(a), total(b)
        if min(n, m) < evidence or not agree(left[a], n, left[b], m):
            return False
        pairs, seen = [(a, b)], {(a, b)}
        for x, y in pairs:
            n, m = total(x), total(y)
            if not n or not m:
                continue
            if not agree(visits[x], n, visits[y], m):
                return False
            for c in children[x].keys() & children[y].keys():
                both = (children[x][c], children[y][c])
                if both not in seen:
                    seen.add(both)
                    pairs.append(both)
        return True

    def fold(red: int, blue: int) -> None:
        pairs, seen = [(red, blue)], {(red, blue)}
        for x, y in pairs:
            for c, n in visits[y].items():
                visits[x][c] = visits[x].get(c, 0) + n
            left[x].update(left[y])
            for c, child in children[y].items():
                both = (children[x].setdefault(c, child), child)
                if both[0] != child and both not in seen:
                    seen.add(both)
                    pairs.append(both)

    red, final, queue = [0], {0}, [(0, c) for c in sorted(children[0])]
    for parent, c in queue:
        state = children[parent][c]
        if state in final:
            continue
        same = next((q for q in red if compatible(q, state)), None)
        if same is None:
            red.append(state)
            final.add(state)
            queue += [(state, k) for k in sorted(children[state])]
        else:
            for k, q in children[parent].items():
                if q == state:
                    children[parent][k] = same
            before = {q: set(children[q]) for q in red}
            fold(same, state)
            queue += [(q, k) for q in red for k in sorted(set(children[q]) - before[q])]
    return Automaton({q: dict(children[q]) for q in red})


_SPAN = "array<struct<start: int, kind: int, end: int, value: string>>"


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, pairs): base spans of every row; once a task, instead, how often its runs' classes follow each other."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    item = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))
    counts = pa.map_(pa.string(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("start", "kind", "end", "value")
        shapes: Counter = Counter()
        pairs: Counter = Counter()

        def tally():
            for word, n in shapes.items():
                for x, y in zip(END + word, word + END):
                    pairs[x + y] += n
            shapes.clear()

        id_type = None
        for batch in batches:
            base, id_type = [], batch.column(0).type
            for text in batch.column(1).to_pylist():
                found = base_spans(text)
                base.append([dict(zip(names, s)) for s in found])
                shapes.update([r.translate(_SHAPES) for _, r in runs(text, found)])
            if len(shapes) > 200_000:
                tally()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, item), pa.nulls(len(base), counts)], names=["id", "base", "pairs"])
        tally()
        if id_type is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, id_type), pa.nulls(1, item), pa.array([list(pairs.items())], counts)], names=["id", "base", "pairs"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, base {_SPAN}, pairs map<string, bigint>")


def learn_formats(spans: DataFrame, support: int = 20, least: int = 20, longest: int = 256, per_form: int = 500) -> Formats:
    """The formats of all kinds of labelled credentials, from the different credentials among all base spans."""
    labelled = spans.select(F.explode("base").alias("s")).select("s.kind", "s.value").distinct()

    @F.pandas_udf("string")
    def shaped(values: pd.Series) -> pd.Series:
        return values.map(shape)

    length = F.length("word")
    size = F.when(length < 64, length).otherwise(F.lit(64) + F.floor(F.log2(length.cast("double"))).cast("int"))
    words = labelled.select("kind", shaped("value").alias("word"), F.xxhash64("value").alias("order"))
    words = materialize(words.select("*", F.concat_ws("/", "kind", size, F.substring("word", 1, 4)).alias("form")), "credentials")
    lengths = {r.kind: (r.n, r.low) for r in words.groupBy("kind").agg(F.count("*").alias("n"), F.min(length).alias("low")).collect()}
    forms = words.groupBy("form").agg(F.count("*").alias("n"))
    # Evenly spread hashes: below this bound lie about ``per_form`` of a form's examples, and all of a small one's.
    bound = F.when(F.col("n") <= per_form, F.lit(2.0**63)).otherwise(F.lit(2.0**64) * per_form / F.col("n") - F.lit(2.0**63))
    some = words.join(forms, "form").where(F.col("order").cast("double") <= bound)
    some = some.groupBy("kind", "form", "n", "word").agg(F.count("*").alias("k")).collect()
    drawn: Counter = Counter()
    for r in some:
        drawn[r.form] += r.k
    trees: dict[int, dict[str, float]] = defaultdict(dict)
    for r in some:
        if lengths[r.kind][0] >= least:
            trees[r.kind][r.word] = trees[r.kind].get(r.word, 0) + r.k * r.n / drawn[r.form]
    pairs = {r.p: r.n for r in spans.where("pairs IS NOT NULL").select(F.explode("pairs").alias("p", "n")).groupBy("p").agg(F.sum("n").alias("n")).collect()}
    background = Background(pairs)
    automata = {kind: merge_tree(*prefix_tree(tree, support, longest)) for kind, tree in sorted(trees.items())}
    if not automata:
        return Formats({}, background, 0)

    def uses(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple, float] = defaultdict(float)
        for batch in batches:
            for kind, word in batch.itertuples(index=False):
                if kind in automata:
                    for state, c in automata[kind].walk(word):
                        seen[kind, state, c] += 1
        yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["kind", "state", "c", "n"])

    steps = words.select("kind", "word").mapInPandas(uses, "kind int, state int, c string, n double").groupBy("kind", "state", "c").agg(F.sum("n").alias("n"))
    counts: dict[int, dict[int, dict[str, float]]] = defaultdict(lambda: defaultdict(dict))
    for r in steps.collect():
        counts[r.kind][r.state][r.c] = r.n
    for kind, automaton in automata.items():
        automaton.set_counts(counts[kind])
        automaton.prior = math.log((lengths[kind][0] + 1) / (background.runs + 1))
    return Formats(automata, background, min(lengths[k][1] for k in automata))


def joined(spans: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, added, spans): arrays of (start, kind, end, value) in code points, sorted by start, then kind.

    Texts are read twice: for the examples and the background, and to score all candidates.
    """
    formats = learn_formats(materialize(find_spans(docs, id_col, text_col), "spans"))
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    item = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("start", "kind", "end", "value")
        for batch in batches:
            columns: list[list] = [[], [], []]
            for text in batch.column(1).to_pylist():
                base = base_spans(text)
                added = formats.find(text, base)
                for out, spans in zip(columns, (base, added, sorted(base + added))):
                    out.append([dict(zip(names, s)) for s in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, item) for c in columns)], names=["id", "base", "added", "spans"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, base {_SPAN}, added {_SPAN}, spans {_SPAN}")


def redact_column(formats: Formats, text: Column, mask: str = "[secret]") -> Column:
    """The text with every span of a secret replaced; overlapping spans are replaced together."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: redact(t, formats, mask))

    return run(text)


def redact(text: str | None, formats: Formats | None = None, mask: str = "[secret]") -> str | None:
    base = base_spans(text)
    spans = sorted(base + (formats or NO_FORMATS).find(text, base))
    if not spans:
        return text
    out, at = [], 0
    for start, _, end, _ in spans:
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])
