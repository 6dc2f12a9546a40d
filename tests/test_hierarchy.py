"""Hierarchies against brute force, on small graphs with loops, shared parents, nulls and repeats."""

from __future__ import annotations

import random

import pytest

from pathweave.operators import hierarchy as h

SCHEMA = "id string, parents array<string>, parent string, root string"


def brute(rows):
    par = {}
    name = {}
    for i, ps, *_ in rows:
        if i is None or not i.strip():
            continue
        k = i.strip().lower()
        name.setdefault(k, i)
        par.setdefault(k, set()).update((p or "").strip().lower() for p in ps or [])
    par = {k: {p for p in ps if p and p in par} for k, ps in par.items()}
    out = set()
    for k in par:
        dist, front, own = {k: 0}, [k], False
        while front:
            nxt = []
            for x in front:
                for p in par[x]:
                    own |= p == k
                    if p not in dist:
                        dist[p] = dist[x] + 1
                        nxt.append(p)
            front = nxt
        roots = [(name[k], name[x], d) for x, d in dist.items() if not par[x]]
        out |= set(roots)
        if own:
            out.add((name[k], "cycle", -1))
        elif not roots:
            out.add((name[k], "none", -1))
    return out


def random_rows(seed, n):
    r = random.Random(seed)
    out = []
    for i in range(n):
        ps = [f" n{r.randrange(n)} ".upper() if r.random() < 0.2 else f"n{max(0, i - r.randrange(1, 6))}" for _ in range(r.choice([0, 1, 1, 1, 1, 2, 2, 3]))]
        out.append((f"n{i}", r.choice([None, ps + [None, "", "unknown"], ps, ps, ps]), "x", "y"))
    return out + out[:3]


@pytest.mark.parametrize("seed,small", [(1, 100_000), (1, 0), (2, 0), (3, 100_000)])
def test_matches_brute_force(spark, monkeypatch, seed, small):
    monkeypatch.setattr(h, "SMALL_GRAPH", small)
    monkeypatch.setattr(h, "LINKS_PER_TASK", 25 if small == 0 else 200_000)
    data = random_rows(seed, 60)
    got = {tuple(r) for r in h.hierarchy(spark.createDataFrame(data, SCHEMA)).collect()}
    assert got == brute(data)


def test_loops_chains_and_self(spark):
    data = [("a", None, "", ""), ("b", ["A "], "", ""), ("c", ["b"], "", ""), ("x", ["y"], "", ""), ("y", ["x"], "", ""), ("z", ["x"], "", ""), ("s", ["s"], "", ""), (None, ["a"], "", ""), (" ", ["a"], "", "")]
    got = {tuple(r) for r in h.hierarchy(spark.createDataFrame(data, SCHEMA)).collect()}
    assert got == {("a", "a", 0), ("b", "a", 1), ("c", "a", 2), ("x", "cycle", -1), ("y", "cycle", -1), ("z", "none", -1), ("s", "cycle", -1)}


def test_empty(spark):
    e = spark.createDataFrame([], SCHEMA)
    assert h.hierarchy(e).count() == h.paths(e).count() == h.descendants(e).count() == 0


def test_paths_and_descendants(spark, rows):
    data = [("r", [], "", ""), ("a", ["r"], "", ""), ("b", ["r"], "", ""), ("c", ["b", "a"], "", ""), ("d", ["c", "r"], "", "")]
    df = spark.createDataFrame(data, SCHEMA)
    p = {r["id"]: r["path"] for r in h.paths(df).collect()}
    assert p == {"r": "r", "a": "r > a", "b": "r > b", "c": "r > a > c", "d": "r > d"}
    assert rows(h.descendants(df), "id", "descendant_id", "depth") == sorted([("r", "a", 1), ("r", "b", 1), ("r", "c", 2), ("r", "d", 1), ("a", "c", 1), ("b", "c", 1), ("a", "d", 2), ("b", "d", 2), ("c", "d", 1)])


def test_long_chain(spark):
    data = [(f"k{i:04}", [f"k{i - 1:04}"] if i else None, "", "") for i in range(700)]
    got = {r["id"]: r["depth"] for r in h.hierarchy(spark.createDataFrame(data, SCHEMA)).collect()}
    assert got["k0699"] == 699 and len(got) == 700
