"""Walks of threads in which messages have several parents, against the plain recursive one."""

import random

import pandas as pd
from pyspark.sql import functions as F

from postweave.operators import threads


def graphs(seed, lists, n, late):
    rng, nodes, edges = random.Random(seed), [], []
    for k in range(lists):
        for i in range(n):
            nodes.append((f"l{k}", i, rng.choice([0, 5, 10 * (i % 7), 1000 - i])))
            for j in range(rng.choice([0, 1, 1, 2, 3])):
                p = rng.randrange(max(0, i - 12), i) if i else None
                if p is not None:
                    edges.append((f"l{k}", p, i, j * threads.PASS + i))
            if late and rng.random() < late:
                edges.append((f"l{k}", rng.randrange(n), i, 2 * threads.PASS + i))
    return nodes, edges


def plain(nodes, edges):
    out = []
    for name in {x[0] for x in nodes}:
        own = pd.DataFrame([x[1:] for x in nodes if x[0] == name], columns=["msgnum", "date"])
        own.insert(0, "list_id", name)
        up, ends = {}, pd.DataFrame([x[1:] for x in edges if x[0] == name], columns=["parent_msgnum", "child_msgnum", "seq"])

        def top(x):
            while up.get(x, x) != x:
                x = up[x]
            return x

        for p, c, _ in ends.itertuples(index=False):
            up[top(int(p))] = top(int(c))
        for part in {top(x) for x in own["msgnum"]}:
            inside = [x for x in own["msgnum"] if top(x) == part]
            walk = threads._walk_component(own[own["msgnum"].isin(inside)], ends[ends["child_msgnum"].isin(inside)], 50)
            out += walk.itertuples(index=False, name=None)
    return sorted((a, int(b), int(c), int(d), int(e), bool(f)) for a, b, c, d, e, f in out)


def found(spark, nodes, edges):
    m = spark.createDataFrame(nodes, "list_id string, msgnum int, date long")
    e = spark.createDataFrame(edges, "list_id string, parent_msgnum int, child_msgnum int, seq long")
    return sorted(tuple(r) for r in threads.thread_walk_general(m, e).select("list_id", "root", "msgnum", "depth", "ord", "shown").collect())


def test_second_parents_in_many_tasks_as_the_loop_visits_them(spark):
    nodes, edges = graphs(1, 6, 30, 0)
    assert found(spark, nodes, edges) == plain(nodes, edges)
    # none of them is left for one task
    real = spark.createDataFrame(edges, "list_id string, p long, c long, seq long").groupBy("list_id", "p", "c").agg(F.min("seq").alias("seq"))
    walk, left = threads._settled(spark.createDataFrame([(*x, 0) for x in nodes], "list_id string, msgnum int, date long, component int"), real)
    assert left.isEmpty() and walk.count() == len(nodes)


def test_cycles_and_late_parents(spark):
    nodes, edges = graphs(2, 6, 20, 0.1)
    assert found(spark, nodes, edges) == plain(nodes, edges)


def test_each_reply_quotes_all_before_it(spark):
    nodes = [("a", i, i) for i in range(16)]
    edges = [("a", p, i, (0 if p == i - 1 else 2 * threads.PASS) + i) for i in range(16) for p in range(i)]
    # and the other way round: the header names the oldest, so that the first guess is wrong at each step
    edges += [("b", p, i, (0 if p == 0 else (2 + i - p) * threads.PASS) + i) for i in range(8) for p in range(i)]
    nodes += [("b", i, i) for i in range(8)]
    assert found(spark, nodes, edges) == plain(nodes, edges)
