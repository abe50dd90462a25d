from __future__ import annotations

import base64
import hashlib
import itertools
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from barwright.llm import mixing, warc
from tests.llm.conftest import prose


def test_targets_share_out_the_excess():
    assert mixing.targets({"a": 100, "b": 100, "c": 100}, {"a": 5, "b": 2, "c": 1}) == {"a": 187.5, "b": 75.0, "c": 37.5}
    got = mixing.targets({"a": 10, "b": 100, "c": 190}, {"a": 5, "b": 2, "c": 1})
    assert got == {"a": 30.0, "b": 180.0, "c": 90.0}
    assert mixing.targets({"a": 0}, {"a": 1}) == {"a": 0.0} and mixing.targets({}, {}) == {}


def cost(flow, distinct):
    used, total = defaultdict(int), 0
    for (p, _), f in flow.items():
        used[p] += f
    for p, f in used.items():
        width, level = distinct[p], 1
        while f > 0:
            step = min(f, width)
            total += step * level
            f -= step
            width *= 2 if level > 1 else 1
            level += 1
    return total


def test_flow_is_of_least_cost():
    """Against all integer flows of small cases."""
    pick = random.Random(2)
    for _ in range(25):
        arcs = [("x", 0), ("x", 1), ("y", 1), ("y", 2), ("z", 0)]
        capacity = {k: pick.randint(1, 4) for k in arcs}
        distinct = {p: pick.randint(1, 2) for p in "xyz"}
        quota = {s: pick.randint(0, sum(c for k, c in capacity.items() if k[1] == s)) for s in range(3)}
        flow = mixing.least_cost_flow(distinct, capacity, quota)
        for s in range(3):
            assert sum(f for k, f in flow.items() if k[1] == s) == quota[s]
        assert all(0 <= f <= capacity[k] for k, f in flow.items())
        best = min(
            cost(dict(zip(arcs, f)), distinct)
            for f in itertools.product(*[range(capacity[k] + 1) for k in arcs])
            if all(sum(x for k, x in zip(arcs, f) if k[1] == s) == quota[s] for s in range(3))
        )
        assert cost(flow, distinct) == best


def test_all_patterns_enter_the_flow(make_docs):
    """Over 500 membership patterns: the mix costs as little as the flow over all of them."""
    pick = random.Random(8)
    patterns = sorted({tuple(sorted(pick.sample(range(16), pick.randint(2, 4)))) for _ in range(900)})
    assert len(patterns) > 600
    rows, cells, distinct = [], {}, {}
    for i, p in enumerate(patterns):
        text = " ".join([f"w{i}"] * pick.randint(1, 9))
        distinct[p] = len(text.split())
        for s in p:
            rows.append((len(rows), text, "abcdefghijklmnop"[s]))
            cells[p, s] = distinct[p]
    sizes = {s: sum(n for (_, t), n in cells.items() if t == s) for s in range(16)}
    goal = mixing.targets(sizes, {s: mixing.WEIGHTS[s % 3] for s in range(16)})
    quota = {s: int(goal[s]) for s in sizes}
    best = mixing.least_cost_flow(distinct, {k: 3 * n for k, n in cells.items()}, quota)
    taken = defaultdict(int)
    at = {f"w{i}": p for i, p in enumerate(patterns)}
    for r in mixing.mix(make_docs(rows)).collect():
        taken[at[r.text.split()[0]], "abcdefghijklmnop".index(r.source)] += r._taken
    assert {s: sum(n for (_, t), n in taken.items() if t == s) for s in quota} == quota
    assert cost(taken, distinct) == cost(best, distinct)


def test_flow_copes_with_many_patterns():
    """20,000 patterns of 20 sources: quotas met, no arc above its capacity, in seconds."""
    pick = random.Random(4)
    patterns = {tuple(sorted(pick.sample(range(20), pick.randint(2, 6)))) for _ in range(20_000)}
    distinct = {p: pick.randint(1, 500) for p in patterns}
    capacity = {(p, s): 3 * distinct[p] for p in patterns for s in p}
    sizes = {s: sum(distinct[p] for p in patterns if s in p) for s in range(20)}
    quota = {s: int(t) for s, t in mixing.targets(sizes, {s: mixing.WEIGHTS[s % 3] for s in sizes}).items()}
    flow = mixing.least_cost_flow(distinct, capacity, quota)
    assert all(0 <= f <= capacity[k] for k, f in flow.items())
    assert {s: sum(f for (_, t), f in flow.items() if t == s) for s in quota} == quota


def test_mix_meets_targets(make_docs, odd_docs, no_docs):
    pick = random.Random(3)
    rows = [(i, " ".join(prose(i % 90, pick.randint(0, 60))), pick.choice(["a", "b", "c", "\U0001f600", None])) for i in range(300)]
    rows += [(400 + i, "one text in many places", s) for i, s in enumerate(["a", "b", "c"] * 40)]
    rows += [(r.doc_id, r.text, r.source) for r in odd_docs.collect() if not r.text or len(r.text) < 1000]
    got = mixing.mix(make_docs(rows)).collect()
    assert len(got) == len(rows)
    by = defaultdict(lambda: [0, 0, None])
    for r in got:
        assert 0 <= r._taken <= 3 * r._size
        assert r._size == len((r.text or "").encode().split())
        by[r.source][0] += r._size
        by[r.source][1] += r._taken
        by[r.source][2] = r._target
    names = sorted(s for s in by if s is not None) + [None]
    want = mixing.targets({s: by[s][0] for s in by}, {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(names)})
    for s in by:
        assert by[s][2] == want[s] and by[s][1] == int(want[s])
    again = mixing.mix(make_docs(rows)).collect()
    key = lambda rs: Counter((r.doc_id, r.text, r._taken) for r in rs)
    assert key(got) == key(again)
    few = mixing.mix(make_docs(rows), max_patterns=1).groupBy("source").sum("_taken").collect()
    assert {r[0]: r[1] for r in few} == {s: int(want[s]) for s in by}
    assert mixing.mix(no_docs).count() == 0


def test_sample_repeats_whole_rows(make_docs, no_docs):
    rows = [(i, " ".join(prose(i, 40)), "ab"[i % 5 == 0]) for i in range(200)]
    docs = make_docs(rows)
    out = mixing.sample(docs).collect()
    times = Counter(r.doc_id for r in out)
    assert max(times.values()) <= 3 and out[0].asDict().keys() == set(docs.columns)
    words = Counter()
    for r in out:
        words[r.source] += 40
    want = mixing.targets({"a": 160 * 40, "b": 40 * 40}, {"a": 5.0, "b": 2.0})
    assert all(abs(words[s] - want[s]) <= 40 * 3 for s in want)
    assert mixing.sample(no_docs).count() == 0


def pages_of(spark, rows):
    return spark.createDataFrame([(i, u, h, "clash") for i, u, h in rows], "page_id long, url string, html string, record string")


def test_archive_round_trip(spark, make_docs):
    pick = random.Random(1)
    long = "".join(pick.choices("abc \n\r", k=3_000_000)) + "\r\n\r\nWARC/1.1\r\n\r\n"
    rows = [(1, "http://a/", "<p>x</p>"), (2, None, None), (3, "http://b/ c\r\nX: y", ""), (4, "http://ä/", long), (5, "u", "<p>x</p>"), (6, "u", "<p>x</p>"), (7, "u", "é\r\n\r\n"), (None, "u", "<p>x</p>"), (8, "u", "own"), (8, "u", "own"), (9, "u", long)]
    table = warc.write_archive(pages_of(spark, rows), chunk_bytes=4096)
    got = warc.read_archive(table).collect()
    last = {}
    for i, _, h in rows:
        last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)

    def want(i, h):
        raw = (h or "").encode()
        keep = last[h or ""]
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        return str((i, len(raw), digest, "response" if i == keep else "revisit", None if i == keep else keep))

    assert sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got) == sorted(want(i, h) for i, _, h in rows)
    assert all(r.intact for r in got)
    assert table.where("chunk > 500").count() > 0 and max(len(r.data) for r in table.select("data").collect()) < 5000
    by_record = defaultdict(dict)
    for r in table.collect():
        by_record[r.record][r.chunk] = bytes(r.data)
    whole = [b"".join(c[k] for k in sorted(c)) for c in by_record.values()]
    assert all(w.startswith(b"WARC/1.1\r\n") and w.endswith(b"\r\n\r\n") for w in whole)
    for w in whole:
        head, _, block = w.partition(b"\r\n\r\n")
        fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
        assert len(block) - 4 == int(fields[b"Content-Length"]) and fields[b"Content-Type"] == b"application/http;msgtype=response"


def test_small_payloads_stay_responses(spark):
    got = warc.read_archive(warc.write_archive(pages_of(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")]), min_bytes=3)).collect()
    assert {r.page_id: r.refers_to for r in got} == {1: None, 2: None, 3: 4, 4: None}


def test_damage_is_seen(spark):
    from pyspark.sql import functions as F

    table = warc.write_archive(pages_of(spark, [(1, "u", "x" * 9000)]), chunk_bytes=1000)
    assert not warc.read_archive(table.where("chunk <> 3")).collect()[0].intact
    assert not warc.read_archive(table.where("chunk < 8")).collect()[0].intact
    other = table.withColumn("data", F.when(F.col("chunk") == 4, F.lit(b"y" * 1000)).otherwise(F.col("data")))
    assert not warc.read_archive(other).collect()[0].intact


def test_no_pages(spark):
    assert warc.read_archive(warc.write_archive(pages_of(spark, []))).count() == 0


def test_columns_of_any_name(make_docs):
    """Names that the operator uses itself, in several cases."""
    rows = [(i, " ".join(prose(i, 5 + i % 9)), "ab"[i % 2]) for i in range(60)]
    names = ["_SIZE", "_content", "_Row", "_s", "_source", "_source_size", "_target", "_name", "_cell", "_order", "_bucket", "_times", "_rest", "_taken", "_time", "_pattern", "_id", "_earlier", "shared", "p"]
    plain = make_docs(rows)
    docs = plain.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    out = mixing.sample(docs)
    assert out.columns == docs.columns and all(r["_SIZE"] == 0 and r["_time"] == 14 for r in out.collect())
    assert Counter(r.doc_id for r in out.collect()) == Counter(r.doc_id for r in mixing.sample(plain).collect())
    assert mixing.mix(docs).count() == 60
