"""Bootstrapping against a direct computation on random graphs, and long words."""

import random
from collections import defaultdict
from math import exp, log

import pytest

pytest.importorskip("kinfold.llm")

from kinfold.llm import pii  # noqa: E402

from test_operators import docs  # noqa: E402

SHAPE = "id long, key long, found array<struct<kind:int,start:long,end:long,instance:long,patterns:array<long>>>"


def brute_discover(rows, sure=0.8, support=3.0):
    known, instances, opens, of = {}, defaultdict(set), set(), defaultdict(set)
    for _, _, found in rows:
        for kind, _, _, x, patterns in found:
            if kind is not None:
                known[x, kind] = 1.0
            for p in patterns:
                instances[p].add(x)
                if kind is None:
                    opens.add(p)
                    of[x].add(p)
    seeds, rounds = {x for x, _ in known}, 0
    while True:
        score = defaultdict(dict)
        for p in opens:
            for k in range(4):
                w = round(sum(known.get((x, k), 0.0) for x in instances[p]), 9)
                if w >= support:
                    score[p][k] = w / (len(instances[p]) + 1)
        new = {}
        for x, patterns in of.items():
            for k in range(4):
                s = [score[p][k] for p in patterns if k in score[p]]
                w = round(1 - exp(sum(log(1 - v) for v in s)), 9) if s else 0
                if x not in seeds and (x, k) not in known and w >= sure:
                    new[x, k] = w
        if not new:
            break
        known |= new
        rounds += 1
    best = {}
    for (x, k), w in known.items():
        if x not in seeds and (x not in best or (-w, k) < best[x]):
            best[x] = (-w, k)
    out = defaultdict(set)
    for i, key, found in rows:
        for kind, a, b, x, _ in found:
            if kind is None and x in best:
                out[i, key].add((best[x][1], a, b))
    return {k: sorted(v) for k, v in out.items()}, rounds


@pytest.mark.parametrize("seed", range(3))
def test_rounds_match_a_direct_computation(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(400):
        level = rng.randint(0, 3)  # contexts of a level are shared with instances of the next one
        x = level * 100 + rng.randint(0, 24)
        kind = rng.choice([0, 0, 2]) if level == 0 else None
        found = [(kind, 0, 5, x, [level * 10 + rng.randint(0, 2), 1000 + level * 10 + rng.randint(0, 1)])]
        if level:
            found.append((None, 10, 15, x, [(level - 1) * 10 + rng.randint(0, 2)]))
        rows.append((i, i % 3, found))
    want, rounds = brute_discover(rows)
    got = {(r.id, r.key): sorted((m.kind, m.start, m.end) for m in r.more) for r in pii.discover(spark.createDataFrame(rows, SHAPE)).collect()}
    assert got == want
    assert seed or rounds >= 2


def test_a_chain_of_contexts_is_followed_to_its_end(spark):
    rows = [(i, 0, [(0, 0, 1, i, [0])]) for i in range(40)]
    for step in range(5):
        rows += [(10_000 * (step + 1) + j, 0, [(None, 0, 1, 10_000 * (step + 1) + j, [step]), (None, 5, 6, 10_000 * (step + 1) + j, [step + 1])]) for j in range(5 + 40 * step)]
    want, rounds = brute_discover(rows)
    got = {(r.id, r.key): sorted((m.kind, m.start, m.end) for m in r.more) for r in pii.discover(spark.createDataFrame(rows, SHAPE)).collect()}
    assert got == want and rounds >= 1


def test_long_words_stay_whole(spark):
    token = "user1234" + "x" * 300 + "@localhost"
    text = f"please write to {token}, today"
    assert pii.candidates(text, []) == [(16, 16 + len(token))]
    words = [(m.start(), m.end()) for m in pii._WORD.finditer(text)]
    split = ([a for a, _ in words], [b for _, b in words])
    assert pii.contexts(text, split, 16, 16 + len(token)) == [pii._hash("L\x00write\x00to"), pii._hash("R\x00to\x00,")]
    assert pii.candidates("1" * 200_000, []) == [(0, 200_000)]


def test_redaction_keeps_columns_of_any_name(spark):
    names = ["more", "more_id", "_more", "KEY", "kept_id"]
    table = spark.createDataFrame([(1, "mail a@b.com now", 16, *"vwxyz"), (None, None, None, *"vwxyz")], "doc_id long, text string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    got = {r.doc_id: r for r in pii.redact(table).collect()}
    assert got[1].text == "mail [EMAIL] now" and got[1].n_chars == 16 and [got[1][n] for n in names] == list("vwxyz") and got[None].text is None
    assert pii.redact(table.limit(0)).count() == 0
