"""Annotated responses against brute force, and what they write."""

import random

from meshflux.operators import signed
from meshflux.session import Lineage

DEPTH = 3
ARCS = "src string, dst string, status string"


def simple_paths(arcs, a, b):
    found, live = [], [[a]]
    for _ in range(DEPTH):
        live = [p + [d] for p in live for s, d, _ in arcs if s == p[-1] and d not in p]
        found += [p for p in live if p[-1] == b]
        live = [p for p in live if p[-1] != b]
    return found


def reach(arcs, a):
    seen, edge = {a}, {a}
    for _ in range(DEPTH):
        edge = {d for s, d, _ in arcs if s in edge} - seen
        seen |= edge
    return seen - {a}


def test_annotated_responses_against_brute_force(spark):
    draw = random.Random(5)
    names = [f"n{k:02d}" for k in range(26)]
    arcs = [(draw.choice(names[:22]), draw.choice(names[:22]), draw.choice(["activation", "inhibition"])) for _ in range(38)]
    arcs += [("n22", "n23", "activation"), ("n23", "n22", "activation"), ("n24", "n24", "unsigned"), (arcs[0][0], arcs[0][1], "unsigned")]
    sources = ["n00", "n01", "n22", "n24"]
    out = signed.annotate_responses(
        spark.createDataFrame(arcs, ARCS), spark.createDataFrame([(n,) for n in names], "id string"), spark.createDataFrame([(s,) for s in sources], "id string"), max_depth=DEPTH)
    got = {(r["source"], r["target"]): (r["path_count"], r["shortest"], r["alternative_route"]) for r in out.collect()}
    want = {}
    for s in sources:
        for t in names:
            if s != t:
                paths = simple_paths(arcs, s, t) or simple_paths(arcs, t, s)
                want[(s, t)] = (len(paths), min(map(len, paths)) - 1 if paths else None, bool((reach(arcs, s) & reach(arcs, t)) - {s, t}))
    assert got == want
    assert {w[2] for w in want.values()} == {True, False}


def test_no_row_for_each_pair_of_response_and_node(spark, monkeypatch):
    """Responses with the same many nodes before and behind them: 300 x 300 rows are never written."""
    n = 300
    arcs = [("s", "hub", "activation")]
    arcs += [("hub", f"t{k}", "activation") for k in range(n)] + [(f"f{k}", "hub", "activation") for k in range(n)]
    arcs += [(f"t{k}", "well", "activation") for k in range(n)] + [("well", f"w{k}", "activation") for k in range(n)]
    written, cut = [], Lineage.cut

    def counted(self, df):
        table = cut(self, df)
        written.append(table.count())
        return table

    monkeypatch.setattr(Lineage, "cut", counted)
    out = signed.annotate_responses(
        spark.createDataFrame(arcs, ARCS), spark.createDataFrame([(f"t{k}",) for k in range(n)], "id string"), spark.createDataFrame([("s",)], "id string"), max_depth=DEPTH)
    rows = out.collect()
    assert {(r["relation"], r["path_count"], r["alternative_route"]) for r in rows} == {("indirect downstream", 1, True)} and len(rows) == n
    assert max(written) < 10 * n
