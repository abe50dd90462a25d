from __future__ import annotations

import hashlib
import math
import random
import re

from barwright.llm import secret_scan as s


def make_secrets(n=60, seed=1):
    pick = random.Random(seed)
    hexes = lambda k: "".join(pick.choices("0123456789abcdef", k=k))
    access = lambda: "AKIA" + "".join(pick.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", k=16))
    return [(i, f'some text token = "{hexes(40)}" and {access()} then password={hexes(18)} end') for i in range(n)]


def plain_base(text):
    out = []
    for k, (kind, pattern, flags, group, least) in enumerate(
        [("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 0, 20), ("hex", "[0-9a-f]+", 0, 0, 24)]
    ):
        out += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text or "", flags) if len(m[group]) >= least]
    return [x[2] for x in sorted(out)]


def test_base_spans_match_definition(make_docs, odd_docs):
    rows = make_secrets() + [(900, "\U0001f600 API_KEY: abc Token=abcdefg tokens secret:'x.y=z-1'"), (901, "ſecret=abcdefgh paſſword=abcdefgh"), (902, "f" * 24 + "AKIA" + "A" * 15 + " AKIA" + "B" * 16)]
    rows += [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = s.scan(make_docs(rows)).select("id", s.joined(s.F.col("base")).alias("b")).collect()
    assert sorted((str(r.id), r.b) for r in got) == sorted((str(i), ",".join(plain_base(t))) for i, t in rows)


def test_formats_are_learned(make_docs):
    rows = make_secrets()
    other = s.make if False else random.Random(9)
    lone = "".join(other.choices("0123456789abcdef", k=18))
    upper = "AKIX" + "".join(other.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", k=16))
    rows += [(500, f"nothing before {lone} nothing after"), (501, f"key {upper}"), (502, "plain words only, internationalisation-and-localisation of 2024"), (503, "see chapter-12-of-the-long-handbook-on-gardening")]
    found = {r.id: r for r in s.scan(make_docs(rows)).collect()}
    assert [x.value for x in found[500].added] == [lone]
    assert [x.value for x in found[501].added] == [upper]
    assert not found[502].spans and not found[503].spans
    assert all(len(found[i].base) == 4 and not found[i].added for i in range(60))


def test_merging_finds_loops():
    """Words of (ab)* merge into few states, which accept longer words of that form and no others."""
    prefixes = {}
    for k, n in ((1, 400), (2, 200), (3, 100), (4, 50), (5, 25)):
        for i in range(1, 2 * k + 1):
            prefixes[("ab" * k)[:i]] = prefixes.get(("ab" * k)[:i], 0) + n
        prefixes["ab" * k + s.END] = n
    machine = s.merge_states(prefixes)
    assert len(machine.steps) <= 3
    counts = {}
    for k, n in ((1, 400), (2, 200), (3, 100), (4, 50), (5, 25)):
        for state, c in machine.walk("ab" * k):
            counts.setdefault(state, {}).setdefault(c, 0)
            counts[state][c] += n
    machine.set_counts(counts)
    assert machine.score("ab" * 20) > machine.score("aabb") and machine.score("ab" * 20) > machine.score("ba")


def test_redaction():
    text = 'x token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" y'
    assert s.redact(text, {}) == 'x [secret]" y'
    assert s.redact(None, {}) is None and s.redact("", {}) == "" and s.redact("clean", {}) == "clean"


def test_empty_table_and_few_examples(no_docs, make_docs):
    assert s.scan(no_docs).count() == 0
    row = s.scan(make_docs([(1, "password=abcdef1234567890ab and abcdef1234567890aa")])).collect()[0]
    assert len(row.base) == 1 and not row.added
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


def hexes(pick, k):
    return "".join(pick.choices("0123456789abcdef", k=k))


def tokens(pick, head="ghp_", k=36):
    return head + "".join(pick.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=k))


def learned(spark, make_docs, n_hex, others=()):
    pick = random.Random(4)
    values = [hexes(pick, 40) for _ in range(n_hex)] + [tokens(pick) for _ in range(90)] + [make(pick) for make, n in others for _ in range(n)]
    rows = [(i, f"once upon a time the password was kept well; token={v}, and so on it went") for i, v in enumerate(values)]
    return s.learn_formats(s.materialize(s.find_spans(make_docs(rows)), "spans"))


def test_lengths_rare_formats_and_growth(spark, make_docs):
    """Lengths are learned, and so is a format that few examples have, however many others there are."""
    pick = random.Random(8)
    probes = {k: [hexes(pick, k) for _ in range(50)] for k in (16, 20, 30, 39, 40, 41, 60, 120)}
    fresh, longer = [tokens(pick) for _ in range(50)], [tokens(pick, k=40) for _ in range(50)]
    small = learned(spark, make_docs, 1500)
    grown = learned(spark, make_docs, 1500, [(lambda p: "AKIA" + hexes(p, 20).upper(), 3000), (lambda p: "sk." + tokens(p, "live.", 24), 1500), (lambda p: hexes(p, 64), 2500)])
    for formats in (small, grown):
        assert all(sum(map(formats.is_secret, v)) == (50 if k == 40 else 0) for k, v in probes.items())
        assert sum(map(formats.is_secret, fresh)) >= 48 and not any(map(formats.is_secret, longer))
        assert not any(map(formats.is_secret, ["internationalisation-and-localisation", "see/the/handbook/of/gardening/2024/vol2", "_" * 40]))
    dotted = "sk." + tokens(pick, "live.", 24)
    assert grown.is_secret(dotted) and not small.is_secret(dotted)
    text = f"({dotted}) or {dotted}. Then x={fresh[0]} end"
    assert [(x[0], x[3]) for x in grown.find(text, [])] == [(1, dotted), (text.index(dotted, 9), dotted), (text.index(fresh[0]), fresh[0])]


def test_runs_beside_base_spans():
    text = "ab_" + "f" * 24 + "-tail token=abcdef1/x " + "0" * 24 + "z"
    base = s.base_spans(text)
    covered = {i for a, _, b, _ in base for i in range(a, b)}
    plain = "".join(c if i not in covered else " " for i, c in enumerate(text))
    assert list(s.runs(text, base)) == [(m.start(), m[0]) for m in re.finditer(r"[A-Za-z0-9+/_.=-]+", plain)]
    assert list(s.runs(None, [])) == []
    many = " ".join(f"x{i}-" + "a" * 24 for i in range(5000))
    assert len(list(s.runs(many, s.base_spans(many)))) == 5000


def test_scores_are_products_along_the_words():
    """An automaton's score against the counts it was made of, step by step."""
    words = {"00a": 30.0, "0a": 20.0, "a": 50.0}
    children, visits = s.prefix_tree(words, support=1)
    machine = s.merge_tree(children, visits, evidence=1e9)  # nothing merges: the tree itself
    counts = {}
    for w, n in words.items():
        for q, c in machine.walk(w):
            counts.setdefault(q, {}).setdefault(c, 0)
            counts[q][c] += n
    machine.set_counts(counts)
    step = lambda p, width: math.log(p * (1 - s.FREE) / width)
    assert abs(machine.total("00a")[0] - (step(0.5, 10) + step(0.6, 10) + step(1, 6))) < 1e-9
    assert abs(machine.total("a")[0] - step(0.5, 6)) < 1e-9
    assert machine.total("aa")[0] == machine.total("")[0] == -math.inf
    assert machine.accepts("0a", -1e9) and not machine.accepts("0a", 0.0)
    pairs = {"$g": 8.0, "gg": 20.0, "g$": 8.0, "$0": 2.0, "0$": 2.0}
    usual = s.Background(pairs)
    want = math.log(8.01 / 11 / 20) + math.log(20.01 / 29 / 20) + math.log(8.01 / 29)
    assert abs(usual.score("gg") - want) < 1e-9 and usual.score("g0") < want


def test_pooled_tails_keep_lengths():
    pick = random.Random(6)
    words = {s.shape(hexes(pick, k)): 1.0 for k in (12, 18) for _ in range(200)}
    machine = s.merge_tree(*s.prefix_tree(words))
    counts = {}
    for w in words:
        for q, c in machine.walk(w):
            counts.setdefault(q, {}).setdefault(c, 0)
            counts[q][c] += 1
    machine.set_counts(counts)
    assert len(machine.steps) < 120
    for k in range(8, 24):
        assert any(machine.accepts(s.shape(hexes(pick, k)), -1e9) for _ in range(20)) == (k in (12, 18))
    long = {"0" * k: 1.0 for k in range(300, 330)}
    assert s.merge_tree(*s.prefix_tree(long, longest=64)).walk("0" * 400)
