"""Collections against a loop over counts of references."""

import random

from loamgraph.operators import collect as O

EDGE, PATH = "id long, parent_uuid string, child_uuid string", "namespace string, domain string, path string, edge_id long, node_uuid string"


def loop(nodes, edges, paths, hard):
    """Node by node, until nothing changes."""
    edges, paths, dead = dict(edges), dict(paths), set()
    drop = lambda key: [paths.pop(k) for k in [k for k in paths if k[:2] == key[:2] and (k[2] == key[2] or k[2].startswith(key[2] + "/"))]]
    while True:
        new = [n for n in nodes if n not in dead and n != "ROOT" and (n in hard or all(p[1] != n for p in paths.values()))]
        if not new:
            break
        n = new[0]
        dead.add(n)
        for e in [e for e, (a, b) in edges.items() if n in (a, b)]:
            for key in [k for k, p in paths.items() if p[0] == e]:
                drop(key)
            del edges[e]
    return dead, set(paths)


def tables(spark, nodes, edges, paths):
    return (
        spark.createDataFrame([(n,) for n in nodes], "uuid string"),
        spark.createDataFrame([(e, *x) for e, x in edges.items()], EDGE),
        spark.createDataFrame([(*k, *x) for k, x in paths.items()], PATH),
    )


def test_against_a_loop(spark):
    r = random.Random(12)
    for turn in range(3):
        nodes = ["ROOT", *(f"n{k}" for k in range(26))]
        edges = {k: (r.choice(nodes), f"n{r.randrange(26)}") for k in range(40)}
        paths = {}
        for e, (a, b) in edges.items():
            if r.random() < 0.6:
                ups = [k for k, (_, n) in paths.items() if n == a]
                up = r.choice(ups) if ups and r.random() < 0.7 else None
                paths[("", "core", f"{up[2]}/e{e}" if up else f"e{e}")] = (e, b)
        hard = {f"n{k}" for k in range(26) if turn and k % 9 == turn}
        dead, left = loop(nodes, edges, paths, hard)
        found, gone = O.dead_nodes(*tables(spark, nodes, edges, paths), spark.createDataFrame([(h,) for h in hard], "uuid string"))
        assert {x.uuid for x in found.collect()} == dead
        assert {(x.namespace, x.domain, x.path) for x in gone.collect()} == set(paths) - left


def test_a_chain_and_a_ring(spark):
    """Thirteen links die one after the other; a ring whose nodes have paths stays; a second path stops it."""
    edges = {k: (f"n{k}", f"n{k + 1}") for k in range(13)} | {50: ("a", "b"), 51: ("b", "a")} | {60: ("ROOT", "n9")}
    paths = {("", "core", f"p{k}"): (k, f"n{k + 1}") for k in range(13)} | {("", "core", "a"): (51, "a"), ("", "core", "b"): (50, "b")}
    nodes = ["ROOT", "a", "b", *(f"n{k}" for k in range(14))]
    found, _ = O.dead_nodes(*tables(spark, nodes, edges, paths))
    assert {x.uuid: x["round"] for x in found.collect()} == {f"n{k}": k for k in range(14)}
    held, gone = O.dead_nodes(*tables(spark, nodes, edges, paths | {("u", "core", "p"): (60, "n9")}))
    assert {x.uuid for x in held.collect()} == {f"n{k}" for k in range(9)} and gone.count() == 9
    none = O.dead_nodes(*(t.where("false") for t in tables(spark, nodes, edges, paths)))
    assert [x.count() for x in none] == [0, 0]
