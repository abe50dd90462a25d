"""Fill-in-the-middle: boundary sets against plain lists, and cuts against the definition."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barwright.llm import infill
from tests.llm.conftest import prose


def test_every_container_selects_like_a_list():
    pick = random.Random(3)
    ascii_, mixed = "a" * 70_000, "".join(pick.choice("aé日\U0001f600") for _ in range(150_000))
    sparse = "".join(pick.choice("abcdefg") + ("\n" if pick.random() < 0.001 else "") for _ in range(100_000))
    kinds = set()
    for text, unit in [(ascii_, "chars"), (mixed, "chars"), (ascii_ + mixed + ascii_, "chars"), (sparse, "lines"), (mixed.replace("a", " "), "words"), ("", "chars"), ("é", "chars")]:
        raw = text.encode()
        found = infill.boundaries(raw, unit)
        kinds |= {type(c).__name__ for c in found.containers}
        if unit == "chars":
            want = np.cumsum([0, *[len(c.encode()) for c in text]])[:-1].tolist() if text else []
        elif unit == "lines":
            want = [0] + [i + 1 for i, b in enumerate(raw[:-1]) if b == 10]
        else:
            want = [0] + [i for i in range(1, len(raw)) if raw[i - 1] == 32 and raw[i] != 32]
        assert found.size == len(want)
        ks = range(found.size) if found.size < 2000 else pick.sample(range(found.size), 500) + [0, found.size - 1]
        assert [found.select(k) for k in ks] == [want[k] for k in ks]
        with pytest.raises(IndexError):
            found.select(found.size)
    assert kinds == {"_Array", "_Bitmap", "_Runs"}


def plain_example(doc_id, text):
    text = text or ""
    d = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(d[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (doc_id, n, "plain", None, None, text)
    if h4 % 100 < 20:
        return (doc_id, n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}")
    return (doc_id, n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}")


def test_examples_match_definition(make_docs, odd_docs, no_docs):
    texts = [" ".join(prose(i, i % 40)) for i in range(300)] + ["<P>", "a <M> b", "<S", "P><", "<<P", "日本\r\n\x00x", "\U0001f600" * 30_000]
    rows = [*enumerate(texts), *[(r.doc_id, r.text) for r in odd_docs.collect()]]
    docs = make_docs(rows).withColumn("FORM", F.lit(1)).withColumn("Output", F.lit("o")).withColumn("made_", F.lit(2))
    made = infill.transform(docs)
    got = made.withColumn("back", infill.restore_column(F.col("output"), F.col("form"))).collect()
    want = [plain_example(*r) for r in rows]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output)) for r in got)
    assert {x[2] for x in want} == {"plain", "psm", "spm"}
    assert all(r.back == (r.text or "") and r.made_ == 2 for r in got)
    assert infill.transform(no_docs).count() == 0
    lines = infill.transform(make_docs([(i, "a b\nc d\n\ne") for i in range(50)]), unit="lines", rate=100).collect()
    assert all(r.n == 4 for r in lines) and all(r.output[3:].split("<")[0][-1:] in ("", "\n", "e") for r in lines)
