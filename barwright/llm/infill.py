"""Fill-in-the-middle examples, cut by a compressed set of unit boundaries.

A text is UTF-8, so the place of its k-th unit is not known from k. ``BoundarySet`` holds the byte offsets at
which units start in containers of 65,536 offsets each, in whichever form is smallest: a sorted array, a
bitmap, or runs of neighbouring offsets (plain ASCII is one run). Cumulative cardinalities lead to the
container of the k-th boundary by binary search, and a select inside the container gives its offset; both
cuts of a text are two such look-ups. Units are code points; ``lines`` and ``words`` cut there only.

Cut points and form follow from the SHA-256 of the document's id alone, so they repeat in every run. A null or
empty text has no units and stays plain, as does a text that contains one of the markers, so that every output
can be read back. A null id hashes as the empty text; rows repeated with one id get equal cuts where the texts
are equal. Other columns are passed on; those named like an output are replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CHUNK = 1 << 16
_ONES = np.array([bin(i).count("1") for i in range(256)], np.int64)


class _Array:
    """Sorted low halves, two bytes each."""

    def __init__(self, low: np.ndarray):
        self.low = low.astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.low[k])


class _Bitmap:
    """One bit an offset, most significant bit of a byte first."""

    def __init__(self, low: np.ndarray):
        bits = np.zeros(CHUNK, np.uint8)
        bits[low] = 1
        self.bytes = np.packbits(bits)

    def select(self, k: int) -> int:
        upto = np.cumsum(_ONES[self.bytes])
        at = int(np.searchsorted(upto, k, side="right"))
        before = int(upto[at - 1]) if at else 0
        inside = np.flatnonzero(np.unpackbits(self.bytes[at : at + 1]))
        return at * 8 + int(inside[k - before])


class _Runs:
    """First offsets of runs with the number of members before each."""

    def __init__(self, starts: np.ndarray, before: np.ndarray):
        self.starts, self.before = starts, before

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.before, k, side="right")) - 1
        return int(self.starts[at]) + k - int(self.before[at])


class BoundarySet:
    """Ascending offsets with ``select(k)``, the k-th of them, counted from zero."""

    def __init__(self, offsets: np.ndarray):
        self.size = len(offsets)
        self.keys, self.containers = [], []
        high = offsets >> 16
        cuts = np.flatnonzero(np.diff(high)) + 1
        edges = [0, *cuts.tolist(), self.size] if self.size else [0]
        for a, b in zip(edges, edges[1:]):
            self.keys.append(int(high[a]))
            self.containers.append(self._pack(offsets[a:b] & (CHUNK - 1)))
        self.upto = np.array(edges[1:], np.int64)

    @staticmethod
    def _pack(low: np.ndarray):
        first = np.concatenate(([0], np.flatnonzero(np.diff(low) != 1) + 1))
        cost = {_Runs: 4 * len(first), _Array: 2 * len(low), _Bitmap: CHUNK // 8}
        kind = min(cost, key=cost.get)
        return _Runs(low[first], first) if kind is _Runs else kind(low)

    def select(self, k: int) -> int:
        if not 0 <= k < self.size:
            raise IndexError(k)
        at = int(np.searchsorted(self.upto, k, side="right"))
        before = int(self.upto[at - 1]) if at else 0
        return (self.keys[at] << 16) + self.containers[at].select(k - before)


def boundaries(raw: bytes, unit: str = "chars") -> BoundarySet:
    """The starts of the units of ``raw`` (UTF-8): code points, lines or words (a word keeps the blanks after it)."""
    data = np.frombuffer(raw, np.uint8)
    if unit == "chars":
        return BoundarySet(np.flatnonzero((data & 0xC0) != 0x80))
    if unit == "lines":
        starts = np.flatnonzero(data == 10) + 1
    elif unit == "words":
        blank = (data == 32) | ((data >= 9) & (data <= 13))
        starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    else:
        raise ValueError(f"unknown unit {unit!r}")
    starts = starts[(starts > 0) & (starts < len(data))]
    return BoundarySet(np.concatenate(([0], starts)) if len(data) else starts)


def cut(raw: bytes, h1: int, h2: int, unit: str = "chars") -> tuple[int, bytes, bytes, bytes, int, int]:
    """(units, prefix, middle, suffix, units of the prefix, units of the middle)."""
    found = boundaries(raw, unit)
    n = found.size
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (found.select(k) if k < n else len(raw) for k in (first, second))
    return n, raw[:a], raw[a:b], raw[b:], first, second - first


def draws(doc_id: Column, seed: str = "1") -> list[Column]:
    """Four numbers of 32 bits from the SHA-256 of seed, colon and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def infill_column(text: Column, doc_id: Column, unit: str = "chars", rate: int = 90, suffix_first: int = 20, seed: str = "1") -> Column:
    """struct<n, form, prefix_chars, middle_chars, output>: ``rate`` of 100 texts are cut, ``suffix_first`` of 100 of these as spm."""
    h1, h2, h3, h4 = draws(doc_id, seed)
    body = F.coalesce(text, F.lit(""))
    marked = F.contains(body, F.lit(PREFIX)) | F.contains(body, F.lit(SUFFIX)) | F.contains(body, F.lit(MIDDLE))
    plain = (body == "") | marked | (h3 % 100 >= rate)
    form = F.when(plain, "plain").when(h4 % 100 < suffix_first, "spm").otherwise("psm")

    @F.pandas_udf("struct<n: long, prefix_chars: long, middle_chars: long, output: string>")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
        for raws, forms, ones, twos in batches:
            rows = []
            for raw, kind, a, b in zip(raws, forms, ones, twos):
                n, before, middle, after, n_before, n_middle = cut(raw, int(a), int(b), unit)
                if kind == "plain":
                    rows.append((n, None, None, raw.decode()))
                else:
                    parts = (p, before, s, after, m, middle) if kind == "psm" else (s, after, p, before, m, middle)
                    rows.append((n, n_before, n_middle, b"".join(parts).decode()))
            out = pd.DataFrame(rows, columns=["n", "prefix_chars", "middle_chars", "output"])
            yield out.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    made = run(body.cast("binary"), form, h1, h2)
    return F.struct(made["n"].alias("n"), form.alias("form"), made["prefix_chars"].alias("prefix_chars"), made["middle_chars"].alias("middle_chars"), made["output"].alias("output"))


def restore_column(output: Column, form: Column) -> Column:
    """The text that an output was made of."""
    parts = F.split(output, "<[PSM]>", -1)
    at = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "psm", F.concat(at(1), at(3), at(2))).when(form == "spm", F.concat(at(2), at(3), at(1))).otherwise(output)


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """All rows with n, form, prefix_chars, middle_chars and output added; see ``infill_column`` for ``options``."""
    names = ["n", "form", "prefix_chars", "middle_chars", "output"]
    taken = {c.lower() for c in names} - {id_col.lower(), text_col.lower()}
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in taken]
    made = "made_" + "_".join(docs.columns)  # longer than any column, so it is none of them
    packed = docs.select(*kept, infill_column(F.col(text_col), F.col(id_col), **options).alias(made))
    return packed.select(*kept, *[F.col(f"`{made}`.{c}").alias(c) for c in names])
