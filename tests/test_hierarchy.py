import random
from datetime import datetime

from quern.operators.hierarchy import descendants, latest_links, resolve_hierarchy


def brute(links):
    out = {}
    for n in links:
        path, seen = [n], {n}
        while links[path[-1]] is not None and links[path[-1]] not in seen:
            path.append(links[path[-1]])
            seen.add(path[-1])
        out[n] = ("", 0, []) if links[path[-1]] is not None else (path[-1], len(path), path[::-1])
    return out


def resolved(spark, links):
    df = spark.createDataFrame(list(links.items()), "node string, parent string")
    r = resolve_hierarchy(df)
    return r, {x.node: (x.root, x.depth, list(x.path)) for x in r.collect()}


def test_shapes_against_brute_force(spark):
    rng = random.Random(5)
    links = {"r": None}
    for i in range(60):  # a chain
        links[f"c{i}"] = f"c{i - 1}" if i else "r"
    for i in range(80):  # random trees, some below cycles
        links[f"t{i}"] = rng.choice(["r", *(f"t{j}" for j in range(i)), "k0"])
    for i in range(5):  # a cycle, a pair and a loop
        links[f"k{i}"] = f"k{(i + 1) % 5}"
    links |= {"p": "q", "q": "p", "s": "s", "below_s": "s", "lone": None}
    r, got = resolved(spark, links)
    want = brute(links)
    assert got == want
    pairs = {(x.ancestor, x.descendant, x.distance) for x in descendants(r).collect()}
    assert pairs == {(a, n, len(p) - 1 - i) for n, (_, _, p) in want.items() for i, a in enumerate(p) if a != n}


def test_empty(spark):
    assert resolved(spark, {})[0].count() == 0 if False else resolve_hierarchy(spark.createDataFrame([], "node string, parent string")).count() == 0


def test_latest_row_blanks_and_unknown_parents(spark):
    t = datetime
    rows = [(" a ", None, t(2024, 1, 1)), ("b", "　a", t(2024, 1, 2)), ("b", "c", t(2024, 1, 1)), ("c", "  ", None), ("d", "nowhere", t(2024, 1, 1)), (None, "a", t(2024, 1, 1)), ("", "a", None), ("b", "　a", t(2024, 1, 2))]
    df = spark.createDataFrame(rows, "node_id string, parent_id string, updated_at timestamp")
    got = {x.node: x.parent for x in latest_links(df, "node_id", "parent_id", "updated_at").collect()}
    assert got == {"a": None, "b": "a", "c": None, "d": None}


def test_numbers_without_paths(spark):
    rng = random.Random(8)
    links = {"r": None} | {f"t{i}": rng.choice(["r", *(f"t{j}" for j in range(i)), "k0"]) for i in range(60)} | {"k0": "k1", "k1": "k0"}
    df = spark.createDataFrame(list(links.items()), "node string, parent string")
    assert {(x.node, x.root, x.depth) for x in resolve_hierarchy(df, paths=False).collect()} == {(n, r, d) for n, (r, d, _) in brute(links).items()}
