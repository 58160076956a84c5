import random

from kernmill.operators import hierarchy as H
from kernmill.operators import reports as R


def _brute(edges):
    up = {}
    for c, p in edges:
        if c is not None and p is not None:
            up[c] = min(p, up.get(c, p))
    ids = {x for e in edges for x in e if x is not None}
    out = {}
    for n in ids:
        path, seen = [n], {n}
        while path[-1] in up:
            nxt = up[path[-1]]
            if nxt in seen:
                path = None
                break
            path.append(nxt)
            seen.add(nxt)
        out[n] = path[::-1] if path else None
    return out, up


def _check(spark, edges):
    f = H.build_forest(spark.createDataFrame(edges, "child string, parent string"))
    chains = H.labelled_chains(f)
    nodes = {r["prop"]: r for r in H.node_paths(f, chains).collect()}
    want, up = _brute(edges)
    assert set(nodes) == set(want)
    below = {n: 0 for n in want}
    for n, path in want.items():
        assert nodes[n]["path"] == path
        for a in path or []:
            below[a] += 1
    for n, path in want.items():
        if path:
            assert nodes[n]["subtree_size"] == below[n]
        else:
            at, on = up[n], False
            for _ in range(len(up)):
                on = on or at == n
                at = up[at]
            assert nodes[n]["status"] == ("loop" if on else "below_loop")
    pairs = {(r["prop"], r["descendant"]) for r in H.descendants(chains).collect()}
    assert pairs == {(a, n) for n, path in want.items() if path for a in path[:-1]}
    roots = {r["prop"]: (r["root"], r["depth"]) for r in H.roots_and_depths(f).collect()}
    assert roots == {n: (p[0], len(p) - 1) if p else ("cycle", -1) for n, p in want.items()}


def test_random_forest_with_loops(spark):
    random.seed(9)
    ids = [f"P{i}" for i in range(120)]
    edges = [(ids[i], ids[random.randrange(max(1, i - 6), i + 1) - 1]) for i in range(2, 100)]
    edges += [(ids[100], ids[101]), (ids[101], ids[102]), (ids[102], ids[100]), (ids[103], ids[101]), (ids[104], ids[104]), (ids[105], ids[103])]
    edges += edges[:5] + [(None, "P1"), ("P119", None)]
    _check(spark, edges)


def test_chain_and_star(spark):
    _check(spark, [(f"P{i:02}", f"P{i - 1:02}") for i in range(1, 40)] + [(f"P9{i:02}", "P00") for i in range(30)])


def test_nothing(spark):
    f = H.build_forest(spark.createDataFrame([], "child string, parent string"))
    chains = H.labelled_chains(f)
    assert f.nodes.count() == 0 and H.descendants(chains).count() == 0
    assert H.node_paths(f, chains).count() == 0 and H.roots_and_depths(f).count() == 0


def test_several_parents_lose_no_link(spark):
    e = spark.createDataFrame([("P1", "P3"), ("P1", "P2"), ("P1", "P3"), ("P4", "P2"), (None, "P2"), ("P5", None)], "child string, parent string")
    assert [tuple(r) for r in H.other_parents(e).collect()] == [("P1", "P3")]
    assert {(r["prop"], r["n_parents"]) for r in H.build_forest(e).nodes.collect()} == {
        ("P1", 2), ("P2", 0), ("P3", 0), ("P4", 1), ("P5", 0)}


def test_only_property_rows_count(spark):
    d = spark.createDataFrame([("P1", "P2", "x"), ("P1", "Q2", "x"), ("Q1", "P1", None), (None, "P1", "x"), ("P1", None, "x")], "s string, o string, child string")
    assert [(r["child"], r["parent"]) for r in H.property_edges(d).collect()] == [("P1", "P2")]


def test_all_roots_with_several_parents(spark):
    edges = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("c", "e"), ("x", "y"), ("y", "x"), ("x", "d"), ("z", "z")]
    got = {(r["prop"], r["root"]) for r in R.root_ancestors(spark.createDataFrame(edges, "child string, parent string")).collect()}
    assert got == {("a", "d"), ("a", "e"), ("b", "d"), ("c", "d"), ("c", "e"), ("x", "d"), ("y", "d")}
