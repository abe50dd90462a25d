from __future__ import annotations

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from barwright.llm.common import ship_package  # noqa: E402

#: Columns beyond those of documents, with names that operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, size string, n int, component_id string, x string"


@pytest.fixture(scope="session")
def make_docs(spark):
    ship_package(spark)

    def make(rows):
        """Documents from (doc_id, text) or (doc_id, text, source)."""
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", None if r[1] is None else len(r[1]), "i", "s", 1, "c", "x") for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


def prose(seed: int, n: int) -> list[str]:
    pick = random.Random(seed)
    parts = "an ber cor del est fin gra hol ist jun kal lom mer nor ost pel qui ran sol tur".split()
    common = "the of and to in is".split()
    return [pick.choice(common) if pick.random() < 0.3 else "".join(pick.choices(parts, k=pick.randint(1, 3))) for _ in range(n)]


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Null and empty texts, blanks, one word, a very long text, ties and repeated rows, a null id."""
    long = " ".join(prose(1, 30_000))
    return make_docs(
        [
            (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, long), (6, long + " end"), (7, "Same text here"), (7, "Same text here"),
            (8, "same TEXT here"), (None, "no id at all"), (None, None), (9, "line\nline\n\nline"), (10, "▁ café 日本語 \U0001f600", None),
        ]
    )


@pytest.fixture(scope="session")
def no_docs(make_docs):
    return make_docs([])
