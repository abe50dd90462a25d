"""Quality rules as weak supervision: rules vote or abstain, and their accuracies are learned without labels.

Everything per document is built-in functions. Votes of all documents are counted by pattern (at most 3 to
the number of rules, 59,049 rows); expectation-maximisation over that bounded table gives the share of good
texts and each rule's accuracy on good and on bad texts, and the posterior replaces all-must-pass filtering.

A null or empty text has no words: it fails the base rules. Repeated rows vote as often as they occur.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwright.session import materialize

_SPACE = " \t\n\x0b\x0c\r"


def with_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_symbol_runs, n_letters, n_caps, n_bangs, n_lines, n_dup_lines, n_distinct_words, n_repeat_words (longs).

    n_repeat_words finds three-word windows that occur twice without leaving the row: each window becomes
    one long, its hash with the lowest bits replaced by its position; sorted, equal windows are neighbours.
    Neighbours are compared by their whole 64-bit hashes.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    core = F.btrim(text, F.lit(_SPACE))
    rows = docs.withColumn("_words", F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, r"[\x20\x09-\x0D]+", -1)))
    n = F.size("_words")
    word = lambda i: F.get("_words", i)
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(word(i), word(i + 1), word(i + 2)))
    rows = rows.withColumn("_hashes", F.when(n >= 3, windows).otherwise(F.array().cast("array<bigint>")))

    # shiftleft and shiftright take a column of bits only in SQL text.
    bits = "length(bin(size(_words)))"
    keys = F.expr(f"sort_array(transform(_hashes, (h, i) -> shiftleft(shiftright(h, {bits}), {bits}) | bigint(i)))")
    some = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    rows = rows.withColumn("_keys", F.when(some, keys).otherwise(F.array().cast("array<bigint>")))
    low = f"(shiftleft(1L, {bits}) - 1)"

    def twin(step: str) -> str:
        other = f"get(_keys, i {step} 1)"
        full = f"get(_hashes, int(k & {low})) = get(_hashes, int({other} & {low}))"
        return f"coalesce(shiftrightunsigned(k ^ {other}, {bits}) = 0 and {full}, false)"

    repeated = f"sort_array(transform(filter(_keys, (k, i) -> {twin('-')} or {twin('+')}), k -> int(k & {low})))"
    rows = rows.withColumn("_repeated", F.expr(repeated))
    covered = "aggregate(transform(_repeated, (p, j) -> least(3, coalesce(get(_repeated, j + 1) - p, 3))), 0L, (a, x) -> a + x)"

    kept_chars = lambda chars: F.length(F.regexp_replace(text, f"[^{chars}]+", "")).cast("long")
    rows = rows.withColumn("_lines", F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]")))
    rows = rows.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": kept_chars("#*$%&|<>"),
            "n_symbol_runs": (F.size(F.split(text, "[#*$%&|<>]+", -1)) - 1).cast("long"),
            "n_letters": kept_chars(r"\p{L}"),
            "n_caps": kept_chars("A-Z"),
            "n_bangs": kept_chars("!"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_distinct_words": F.size(F.array_distinct("_words")).cast("long"),
            "n_repeat_words": F.expr(covered),
        }
    )
    return rows.drop("_words", "_hashes", "_keys", "_repeated", "_lines")


def base_failed() -> Column:
    return F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")


@dataclass(frozen=True)
class Rule:
    """Votes bad (-1) where ``bad`` holds, good (1) where ``good`` holds, else abstains (0)."""

    name: str
    bad: str
    good: str


RULES = (
    Rule("symbols", "n_symbols > 0.04 * word_chars", "n_symbols < 0.01 * word_chars"),
    Rule("symbol_runs", "n_symbol_runs > 0.15 * n_words", "n_symbol_runs < 0.05 * n_words"),
    Rule("letters", "n_letters < 0.85 * word_chars", "n_letters > 0.92 * word_chars"),
    Rule("capitals", "n_caps > 0.3 * word_chars", "n_caps < 0.08 * word_chars"),
    Rule("bangs", "n_bangs > 0.2 * n_words", "n_bangs < 0.02 * n_words"),
    Rule("repeats", "n_repeat_words > 0.3 * n_words", "n_repeat_words < 0.1 * n_words"),
    Rule("lines", "n_dup_lines > 0.3 * n_lines", "n_lines > 1 AND n_dup_lines = 0"),
    Rule("length", "n_words < 50", "n_words >= 100"),
    Rule("word_length", "word_chars < 2.5 * n_words OR word_chars > 12 * n_words", "word_chars BETWEEN 3.5 * n_words AND 9 * n_words"),
    Rule("variety", "n_words >= 100 AND n_distinct_words < 0.15 * n_words", "n_distinct_words > 0.3 * n_words"),
)


def votes(rules: tuple[Rule, ...] = RULES) -> list[Column]:
    return [F.expr(f"CASE WHEN n_words = 0 OR {r.bad} THEN -1 WHEN {r.good} THEN 1 ELSE 0 END").alias(f"vote_{r.name}") for r in rules]


def estimate(patterns: list[tuple[tuple[int, ...], int]], rules: int, rounds: int = 200) -> tuple[float, list[float], list[float]]:
    """(share of good texts, accuracy per rule on good texts, on bad texts) from counted vote patterns.

    Starts from what rules of this kind are: they seldom reject a good text, and each knows one kind of bad
    text, so on bad texts most votes are wrong. An accuracy has the weight of ten such votes from the start.
    """
    first = (0.9, 0.999, 0.2)
    share, good, bad = first[0], [first[1]] * rules, [first[2]] * rules
    for _ in range(rounds):
        total = kept = 0.0
        right_good, all_good, right_bad, all_bad = ([0.0] * rules for _ in range(4))
        for pattern, count in patterns:
            p = posterior(pattern, share, good, bad)
            total += count
            kept += count * p
            for r, v in enumerate(pattern):
                if v:
                    all_good[r] += count * p
                    all_bad[r] += count * (1 - p)
                    right_good[r] += count * p * (v > 0)
                    right_bad[r] += count * (1 - p) * (v < 0)
        level = lambda right, n, prior: min(0.9999, max(0.01, (right + 10 * prior) / (n + 10)))
        new = (
            min(0.995, max(0.005, (kept + 10 * first[0]) / (total + 10))),
            [level(a, b, first[1]) for a, b in zip(right_good, all_good)],
            [level(a, b, first[2]) for a, b in zip(right_bad, all_bad)],
        )
        moved = max(abs(new[0] - share), *(abs(a - b) for a, b in zip(new[1] + new[2], good + bad)))
        share, good, bad = new
        if moved < 1e-9:
            break
    return share, good, bad


def posterior(pattern, share: float, good: list[float], bad: list[float]) -> float:
    odds = math.log(share / (1 - share))
    for v, g, b in zip(pattern, good, bad):
        odds += math.log(g / (1 - b)) if v > 0 else math.log((1 - g) / b) if v < 0 else 0.0
    return 1 / (1 + math.exp(-odds))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id, the counts, one vote per rule, base_failed, quality, kept) for every row.

    quality is the posterior probability of a good text; kept needs quality of one half and more, and
    the base rules. Counts are written once; the texts are read once.
    """
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    counted = materialize(with_counts(narrow).drop("text").select("*", *votes(rules)), "counts")
    names = [f"vote_{r.name}" for r in rules]
    patterns = [(tuple(row[:-1]), row[-1]) for row in counted.groupBy(*names).count().collect()]
    share, good, bad = estimate(sorted(patterns), len(rules))
    odds = F.lit(math.log(share / (1 - share)))
    for name, g, b in zip(names, good, bad):
        odds = odds + F.when(F.col(name) > 0, math.log(g / (1 - b))).when(F.col(name) < 0, math.log((1 - g) / b)).otherwise(0.0)
    out = counted.withColumn("base_failed", base_failed()).withColumn("quality", 1 / (1 + F.exp(-odds)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))
