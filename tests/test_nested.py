"""Nested trees of any depth, and level-wise operators without a depth, against recursion."""

import json
import random
import statistics

from pyspark.sql import functions as F

from tracewright.operators import nested, trees


def grow(rng, deep):
    node = {"id": rng.randrange(10**6), "score": rng.choice([None, 0.0, 0.5, 1.0])}
    if deep and rng.random() < 0.8:
        node["children"] = [grow(rng, deep - 1) for _ in range(rng.randrange(4))]
    return node


def walk(node, out, parent=None, depth=0):
    me = len(out)
    out.append(None)
    below = [walk(c, out, me, depth + 1) for c in node.get("children", [])]
    values = [out[c][4] for c in below]
    value = statistics.fmean(values) if values else node["score"] or 0.0
    out[me] = (parent, max([out[c][1] for c in below], default=me), depth, node["id"], value, statistics.pstdev(values) if values else 0.0)
    return me


def test_flattened_and_folded(spark):
    rng = random.Random(5)
    texts, want = [], {}
    for k in range(60):
        tree, out = grow(rng, rng.randrange(9)), []
        walk(tree, out)
        want |= {(k, n): row for n, row in enumerate(out)}
        texts.append((k, json.dumps(tree)))
    chain = {"id": 1, "score": 1.0}
    for _ in range(300):
        chain = {"id": 2, "score": None, "children": [chain]}
    texts += [(97, None), (98, "[1]"), (99, "{broken"), (96, json.dumps({"id": 3, "score": 0.5, "children": [1, "x"]})), (95, json.dumps(chain))]
    nodes = nested.flattened(spark.createDataFrame(texts, "t int, tree string"), "t", "tree")
    got = {(r["t"], r["node"]): r for r in nested.folded(nodes, "t", F.get_json_object("fields", "$.score").cast("double")).collect()}
    assert {k for k in got if k[0] < 90} == set(want) and sum(k[0] == 95 for k in got) == 301 and got[96, 0]["value"] == 0.5 and got[95, 0]["value"] == 1.0
    for k, (parent, last, depth, name, value, std) in want.items():
        r = got[k]
        assert (r["parent"], r["last"], r["depth"], json.loads(r["fields"])["id"]) == (parent, last, depth, name)
        assert abs(r["value"] - value) < 1e-9 and abs(r["value_std"] - std) < 1e-9
    closure = nested.ancestors(nodes.where("t < 90"), "t")
    assert closure.count() == sum(row[2] + 1 for row in want.values())


def test_levels_without_a_depth(spark):
    rng, rows = random.Random(6), []
    for t in range(8):
        rows.append((t, 0, None, 0, None))
        depth = {0: 0}
        for n in range(1, rng.randrange(2, 40)):
            p = rng.choice(list(depth))
            depth[n] = depth[p] + 1
            rows.append((t, n, p, depth[n], rng.random()))
    nodes = spark.createDataFrame(rows, "tree_id int, node_id int, parent_id int, depth int, score double")
    deepest = max(r[3] for r in rows)
    rounded = lambda df: sorted((r["tree_id"], r["node_id"], round(r["value"], 9), round(r["value_std"], 9)) for r in df.collect())
    assert rounded(trees.fold_means(nodes, F.col("score"))) == rounded(trees.fold_means(nodes, F.col("score"), deepest))
    plain = lambda df: sorted(map(str, df.collect()))
    assert plain(trees.paths(nodes, None, ["node_id", "score"])) == plain(trees.paths(nodes, deepest, ["node_id", "score"]))
    assert plain(trees.preorder(nodes)) == plain(trees.preorder(nodes, deepest)) and trees.preorder(nodes).count() == len(rows)


def test_folds_send_no_nodes_through_the_driver(spark):
    rows = spark.range(1).withColumn("tree", F.lit('{"children": [{"score": 1}, {"score": 0}]}'))
    folded = nested.folded(nested.flattened(rows, "id", "tree"), "id", F.get_json_object("fields", "$.score").cast("double"))
    plan = folded._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert folded.where("node = 0").select("value", "value_std").first()[:] == (0.5, 0.5)
