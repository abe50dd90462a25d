"""Mixing sources to target weights as a min-cost flow over overlapping sources.

A text may occur in several sources; the set of sources that have it is its membership pattern. Documents
are added up by pattern; the flow routes words from patterns over (pattern, source) arcs to the sources'
quotas. The first pass over a pattern's different texts costs 1 a word, each further doubling of repetition
one more, so the flow repeats as little as the quotas allow and evenly over patterns. Costs sit on the arcs
out of the origin only; so taking them in rising order, each filled by augmenting paths, is the successive
shortest path method and its flow is of least cost. Then seeded documents fill each arc.

All patterns enter the flow. The driver holds a row of three numbers for each (pattern, source) that occurs: far
fewer than texts, but their number grows with the data where many sources overlap in many ways.

A null source is a source of its own; a null or empty text has no words and is never taken. Equal rows are
interchangeable.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwright.llm.common import n_words, running_total
from barwright.session import materialize

WEIGHTS = (5.0, 2.0, 1.0)


def targets(sizes: dict, weights: dict, most: float = 3.0) -> dict:
    """Words per source: shares of the whole by weight, none above ``most`` times its size; the excess is shared again."""
    out: dict = {}
    free, left = set(sizes), float(sum(sizes.values()))
    while free:
        total = sum(weights[s] for s in free)
        over = {s for s in free if left * weights[s] / total > most * sizes[s]} if total else set()
        if not over:
            out |= {s: left * weights[s] / total if total else 0.0 for s in free}
            break
        out |= {s: most * sizes[s] for s in over}
        left -= sum(out[s] for s in over)
        free -= over
    return out


def least_cost_flow(distinct: dict, capacity: dict, quota: dict) -> dict:
    """Flow on (pattern, source) arcs that fills the quotas at least cost.

    distinct: words of different texts per pattern; capacity: most words per arc; quota: words per source.
    """
    graph = _Residual(capacity, quota)
    room = {p: sum(capacity[p, s] for s in graph.sources_of[p]) for p in distinct}
    width = dict(distinct)
    open_patterns = [p for p in sorted(distinct) if room[p]]
    level = 1
    while open_patterns and any(graph.need.values()):
        for p in open_patterns:
            supply = min(room[p], width[p])
            room[p] -= supply
            while supply:
                step = graph.augment(p, supply)
                if not step:
                    room[p] = 0  # once cut off from every open quota, a pattern stays so
                    break
                supply -= step
            if level > 1:
                width[p] *= 2
        open_patterns = [p for p in open_patterns if room[p]]
        level += 1
    return {k: f for k, f in graph.flow.items() if f}


class _Residual:
    """The flow and its residual graph, searched over sources only, so that a search does not grow with the patterns.

    ``through[a, b]`` holds patterns that can take words back from source a and give them to b. It may hold some
    that no longer can; they are dropped when met, and come back when their flow changes.
    """

    def __init__(self, capacity: dict, quota: dict) -> None:
        self.capacity, self.need = capacity, dict(quota)
        self.flow: dict = defaultdict(int)
        self.sources_of: dict = defaultdict(list)
        for p, s in sorted(capacity):
            self.sources_of[p].append(s)
        self.through: dict = defaultdict(list)
        self.after: dict = defaultdict(set)

    def _change(self, p, s, step: int) -> None:
        before = self.flow[p, s]
        now = self.flow[p, s] = before + step
        if not before and now:
            steps = [(s, b) for b in self.sources_of[p] if b != s and self.flow[p, b] < self.capacity[p, b]]
        elif before == self.capacity[p, s] and now < before:
            steps = [(a, s) for a in self.sources_of[p] if a != s and self.flow[p, a]]
        else:
            return
        for a, b in steps:
            self.through[a, b].append(p)
            self.after[a].add(b)

    def _way(self, a, b):
        """A pattern that can move words from source a to b, or None."""
        patterns = self.through[a, b]
        while patterns:
            p = patterns[-1]
            if self.flow[p, a] and self.flow[p, b] < self.capacity[p, b]:
                return p
            patterns.pop()
        return None

    def augment(self, start, supply: int) -> int:
        """Pushes words from one pattern along a shortest residual path to a source that needs some."""
        queue = [s for s in self.sources_of[start] if self.flow[start, s] < self.capacity[start, s]]
        came: dict = {s: None for s in queue}
        goal = next((s for s in queue if self.need[s]), None)
        for a in queue:
            if goal is not None:
                break
            for b in sorted(self.after[a]):
                if b in came:
                    continue
                p = self._way(a, b)
                if p is None:
                    self.after[a].discard(b)
                    continue
                came[b] = (a, p)
                queue.append(b)
                if self.need[b]:
                    goal = b
                    break
        if goal is None:
            return 0
        arcs, at = [], goal
        while came[at]:
            a, p = came[at]
            arcs += [(p, at, 1), (p, a, -1)]
            at = a
        arcs.append((start, at, 1))
        step = min([supply, self.need[goal], *(self.capacity[p, s] - self.flow[p, s] if way > 0 else self.flow[p, s] for p, s, way in arcs)])
        for p, s, way in arcs:
            self._change(p, s, way * step)
        self.need[goal] -= step
        return step


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, whole: bool = False, seed: int = 1, max_patterns: int | None = None
) -> DataFrame:
    """All columns of ``docs`` and _size, _source_size, _target, _taken (words, repeats counted).

    Sources in code point order, null last, have the ``weights`` in turn. The last document of an arc is
    taken in part to meet the quota; with ``whole`` it is taken fully or not at all, whichever is nearer.
    Columns of ``docs`` may have any names, also these; then the result has a name twice.
    Only if ``max_patterns`` is given are texts of patterns beyond that many largest left out of the overlap.
    """
    mixed = _mixed(docs, id_col, text_col, source_col, weights, whole, seed, max_patterns)
    return mixed.select(*_named(docs), "_size", "_source_size", "_target", "_taken")


def _named(docs: DataFrame) -> list[Column]:
    """The columns of ``docs`` under their own names again."""
    return [F.col(f"_column{i}").alias(c) for i, c in enumerate(docs.columns)]


def _mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, whole: bool = False, seed: int = 1, max_patterns: int | None = None) -> DataFrame:
    """The same with the columns of ``docs`` as _column0, _column1 and so on."""
    content = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    # Numbered, so that columns may have any names, and one by one, so that those not asked for never travel.
    held = [F.col(f"`{c}`").alias(f"_column{i}") for i, c in enumerate(docs.columns)]
    wide = docs.select(*held, F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), n_words(F.col(text_col)).alias("_size"), content.alias("_content"))
    rows = materialize(wide.select(F.col("_source").alias("source"), "_size", "_content"), "sizes")
    sizes = {r[0]: r[1] for r in rows.groupBy("source").agg(F.sum("_size")).collect()}
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    code = {s: i for i, s in enumerate(names)}
    goal = targets(sizes, {s: weights[code[s] % len(weights)] for s in names})

    spark = docs.sparkSession
    table = spark.createDataFrame([(s, code[s], sizes[s], goal[s]) for s in names], "source string, _s int, _source_size long, _target double")
    coded = rows.join(table, rows["source"].eqNullSafe(table["source"])).select("_content", "_size", "_s")
    texts = coded.groupBy("_content").agg(F.max("_size").alias("_size"), F.sort_array(F.collect_set("_s")).alias("p"), F.min("_s").alias("a"), F.max("_s").alias("b"))
    texts = materialize(texts.select("_content", "_size", F.array_join(F.col("p").cast("array<string>"), ",").alias("_pattern"), (F.col("a") < F.col("b")).alias("shared")), "texts")
    overlap = texts.where("shared")
    if max_patterns is not None:
        overlap = overlap.join(overlap.groupBy("_pattern").agg(F.sum("_size").alias("n")).orderBy(F.desc("n"), "_pattern").limit(max_patterns).select("_pattern"), "_pattern")
    shared = materialize(overlap.select("_content", "_pattern"), "shared_texts")

    own = F.coalesce("_pattern", F.col("_s").cast("string"))
    cells = coded.join(shared, "_content", "left").groupBy(own.alias("_pattern"), "_s").agg(F.sum("_size").alias("n")).collect()
    cells = {(r[0], r[1]): r[2] for r in cells if r[2]}
    single = texts.join(shared.select("_content"), "_content", "left_anti").select("_size", F.explode(F.split("_pattern", ",")).alias("_pattern"))
    together = texts.join(shared.select("_content"), "_content", "left_semi").select("_size", "_pattern")
    distinct = {r[0]: r[1] for r in single.union(together).groupBy("_pattern").agg(F.sum("_size").alias("n")).collect()}
    distinct = {p: distinct[p] for p in {p for p, _ in cells}}
    flow = least_cost_flow(distinct, {k: 3 * n for k, n in cells.items()}, {code[s]: int(goal[s]) for s in names})

    plan = [(f"{p}|{s}", f // cells[p, s], f % cells[p, s]) for (p, s), f in sorted(flow.items())]
    plan = spark.createDataFrame(plan, "_cell string, _times long, _rest long")
    out = wide.join(table.withColumnRenamed("source", "_name"), F.col("_source").eqNullSafe(F.col("_name"))).drop("_name")
    out = out.join(shared, "_content", "left").withColumn("_cell", F.concat_ws("|", own, F.col("_s").cast("string")))
    out = out.withColumn("_order", F.xxhash64(F.lit(seed), F.col("_id"), F.col("_content")))
    out = running_total(out, "_cell", "_order", [], "_size", "_earlier").join(plan, "_cell", "left")
    taken = F.coalesce(F.col("_times") * F.col("_size") + _share(whole), F.lit(0).cast("long"))
    return out.select(*[f"_column{i}" for i in range(len(docs.columns))], "_size", "_source_size", "_target", taken.alias("_taken"))


def _share(whole: bool) -> Column:
    """Words that a document adds to the rest of its arc, given the words before it."""
    left = F.col("_rest") - F.col("_earlier")
    if whole:
        return F.when(2 * left > F.col("_size"), F.col("_size")).otherwise(F.lit(0))
    return F.greatest(F.lit(0).cast("long"), F.least(left, F.col("_size")))


def sample(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents themselves: each row as often as the mix takes it, whole."""
    mixed = _mixed(docs, whole=True, **options).where("_taken > 0")
    times = F.expr("explode(sequence(1L, _taken div _size))")
    return mixed.select(*[f"_column{i}" for i in range(len(docs.columns))], times.alias("_time")).select(*_named(docs))
