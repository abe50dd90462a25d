"""The stages of the pipeline, and the registered corpus queries on the smallest tables."""

from __future__ import annotations

import re
from collections import Counter
from pathlib import Path

import pytest

import __spark_entry__ as contract
import corpus_pipeline as pipeline
from barwright.llm import pieces, segment
from tests.llm.conftest import prose
from tests.llm.test_simhash import plain_components, plain_fingerprint

SF_DIR = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def small(spark, make_docs, tmp_path_factory):
    """A folder with documents and labels: clean, junk, copies, near copies and secrets."""
    folder = tmp_path_factory.mktemp("tables")
    rows = [(i, " ".join(prose(i, 120)) + ".", "ab"[i % 2]) for i in range(80)]
    rows += [(100 + i, " ".join(w + "$$$" for w in prose(500 + i, 100)), "a") for i in range(40)]
    rows += [(200 + i, rows[i][1], "b") for i in range(10)]
    rows += [(300 + i, rows[i][1].replace(rows[i][1].split()[50], "edited", 1), "b") for i in range(10)]
    rows += [(320 + i, " ".join(prose(900 + i, 600)), "b") for i in range(6)]
    rows += [(340 + i, " ".join([*prose(900 + i, 600)[:-1], "edited"]), "b") for i in range(6)]
    rows += [(400 + i, " ".join(prose(700 + i, 90)) + f' token = "{i:040x}" end', "b") for i in range(8)]
    rows += [(None, None, None), (500, None, "a"), (501, "", "b"), (0, rows[0][1], "a")]
    make_docs(rows).select(*COLUMNS).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(not 100 <= i < 200)) for i, *_ in rows if i is not None and i < 450 and (i % 7 or i >= 400)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = {}
    for name, stage in pipeline.STAGES[:-1]:
        docs = pipeline.materialize(stage(spark, docs, small), name)
        assert docs.columns == COLUMNS
        kept[name] = docs.collect()
    ids = {name: Counter(r.doc_id for r in rows) for name, rows in kept.items()}
    assert not any(100 <= (i or 0) < 200 for i in ids["quality_classifier"])
    assert set(range(80)) <= set(ids["quality_classifier"])
    assert all(ids["near_dedup"][i] == 1 for i in range(80)) and not any(200 <= (i or 0) < 300 for i in ids["near_dedup"])
    # Two bits decide, not the similarity of words: the least id of each group by brute force over the stage's input.
    prints = sorted({(r.doc_id, plain_fingerprint(r.text)) for r in kept["quality_classifier"]}, key=str)
    groups = plain_components(prints, lambda a, b: (a[1] ^ b[1]).bit_count() <= 2)
    assert ids["near_dedup"] == Counter(set(groups.values()))
    assert any(320 <= first < 340 and i is not None and i >= 340 for (i, _), first in groups.items() if first is not None)
    masked = {r.doc_id: r for r in kept["mask_secrets"]}
    assert len(kept["mask_secrets"]) == len(kept["near_dedup"])
    for i in range(400, 408):
        assert "[secret]" in masked[i].text and not re.search("[0-9a-f]{24}", masked[i].text) and masked[i].n_chars == len(masked[i].text)
    assert masked[1].text == " ".join(prose(1, 120)) + "."
    assert set(ids["mix_sources"]) <= set(ids["mask_secrets"]) and max(ids["mix_sources"].values()) <= 3

    coded = pipeline.run(spark, small).collect()
    vocabulary = pieces.load()
    texts = {r.doc_id: r.text for r in kept["mask_secrets"]}
    assert Counter(r.doc_id for r in coded) == ids["mix_sources"]
    assert all(segment.decode(r.ids, vocabulary) == texts[r.doc_id] for r in coded)


def test_pipeline_on_no_rows(spark, small, no_docs):
    docs = no_docs.select(*COLUMNS)
    for name, stage in pipeline.STAGES:
        docs = pipeline.materialize(stage(spark, docs, small), name)
        assert docs.count() == 0


@pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables not present")
@pytest.mark.parametrize("name", [n for n in contract.queries() if re.match(r"op\d+_", n)])
def test_queries_return_every_row(spark, name):
    table = "pages" if name.startswith("op9_") else "documents"
    assert contract.queries()[name](spark, SF_DIR).count() == spark.read.parquet(f"{SF_DIR}/{table}.parquet").count()
