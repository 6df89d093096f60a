"""Graphs of accepted pairs: components, keepers, conflicts, covers."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package
from ..sources.storage import discard, small, written

ROUNDS = 40


def components(links: DataFrame) -> DataFrame:
    """Of links (a, b): a row for each node that has one: id, component, the smallest id of its component.

    Alternating large-star and small-star steps link neighbours to their smallest until the graph is a forest of stars;
    the number of rounds grows as the logarithm of a component's size, and edges stay about as many as they were. A node
    may have any number of links: what is joined to them is broadcast, or a table of its own whose joins Spark can split.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    for k in range(ROUNDS):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m")), f"least-{k}")
        large = written(both.where("v > u").join(small(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), f"large-{k}")
        lowest = written(large.groupBy("u").agg(F.min("v").alias("m")), f"lowest-{k}")
        joined = large.join(small(lowest), "u")
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(lowest.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        old, edges = edges, written(moved, f"links-{k}")
        discard(old, least, large, lowest)
        if edges.select("u").join(edges.select(F.col("v").alias("u")), "u", "left_semi").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)


def clusters(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Every node of ``nodes`` (id) with its component, singletons too: id, component, component_size."""
    found = components(links)
    rows = nodes.select("id").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    sizes = rows.groupBy("component").agg(F.count(F.lit(1)).alias("component_size"))
    return rows.join(sizes, "component").select("id", "component", "component_size")


def unknown_ends(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Ends of links that aren't nodes; building clusters needs none."""
    ends = links.select(F.col("a").alias("id")).union(links.select(F.col("b").alias("id"))).distinct()
    return ends.join(nodes.select("id"), "id", "left_anti")


def keepers(members: DataFrame, order: list[Column]) -> DataFrame:
    """``members`` (component and what ``order`` uses) with is_keeper: the first of its component in that order."""
    return members.withColumn("is_keeper", F.row_number().over(Window.partitionBy("component").orderBy(*order)) == 1)


def conflicts(rejected: DataFrame, members: DataFrame) -> DataFrame:
    """Rejected pairs (a, b) whose ends are in one component: a, b, component, component_size."""
    one = members.select(F.col("id").alias("a"), "component", "component_size")
    two = members.select(F.col("id").alias("b"), F.col("component").alias("other"))
    return rejected.join(one, "a").join(two, "b").where("component = other").select("a", "b", "component", "component_size")


def _cover_within(edges: list[tuple], seconds: float) -> tuple[set, bool]:
    """A smallest vertex cover: forced moves (a neighbour of a leaf), then a branch on the node of highest degree, bounded
    by a matching. After ``seconds`` the best so far, and whether it is proven to be smallest."""
    best: list[set] = [set(x for e in edges for x in e)]
    end, proven = time.monotonic() + seconds, [True]

    def go(adj: dict, chosen: set) -> None:
        if time.monotonic() > end:
            proven[0] = False
            return
        adj, chosen = {u: set(v) for u, v in adj.items() if v}, set(chosen)

        def take(u) -> None:
            chosen.add(u)
            for v in adj.pop(u, ()):
                adj[v].discard(u)
                if not adj[v]:
                    del adj[v]

        while leaf := min((u for u, v in adj.items() if len(v) == 1), default=None):
            take(next(iter(adj[leaf])))
        if not adj:
            if len(chosen) < len(best[0]):
                best[0] = chosen
            return
        used: set = set()
        for u in sorted(adj):
            if u not in used and (v := next((x for x in sorted(adj[u]) if x not in used), None)) is not None:
                used |= {u, v}
        if len(chosen) + len(used) // 2 >= len(best[0]):
            return
        top = max(sorted(adj), key=lambda u: len(adj[u]))
        around = set(adj[top])
        saved = {u: set(v) for u, v in adj.items()}, set(chosen)
        take(top)
        go(adj, chosen)
        adj, chosen = saved
        for u in sorted(around):
            if u in adj:
                take(u)
            chosen.add(u)
        go(adj, chosen)

    graph: dict = {}
    for a, b in edges:
        graph.setdefault(a, set()).add(b)
        graph.setdefault(b, set()).add(a)
    go(graph, set())
    return best[0], proven[0]


def _cover(edges: list[tuple]) -> set:
    return _cover_within(edges, float("inf"))[0]


def vertex_cover(links: DataFrame, seconds: float = 900) -> DataFrame:
    """A minimum vertex cover of each component: component, id, component_nodes, cover_size, proven. The nodes left out of
    it have no link among them. Components are solved one by one; a component's links must fit a task, and one that takes more
    than ``seconds`` gives the best cover found, which isn't proven to be a minimum."""
    import pandas as pd

    ship_package(links.sparkSession)
    comps = components(links)
    rows = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(comps.withColumnRenamed("id", "a"), "a")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        cover, proven = _cover_within(list(zip(pdf["a"].tolist(), pdf["b"].tolist())), seconds)
        cover = sorted(cover)
        nodes = len(set(pdf["a"]) | set(pdf["b"]))
        return pd.DataFrame({"component": pdf["component"].iloc[0], "id": cover, "component_nodes": nodes, "cover_size": len(cover), "proven": proven})

    return rows.groupBy("component").applyInPandas(solve, "component long, id long, component_nodes long, cover_size long, proven boolean")


def _matching(edges: list[tuple]) -> int:
    """The size of a largest matching of a bipartite graph, first ends on one side: each first end in turn gets a partner by
    an alternating path, searched breadth first."""
    graph: dict = {}
    for a, b in edges:
        graph.setdefault(a, set()).add(b)
    partner: dict = {}
    for start in sorted(graph):
        came, queue, end = {}, [start], None
        for u in queue:
            for v in sorted(graph[u] - came.keys()):
                came[v] = u
                if v not in partner:
                    end = v
                    break
                queue.append(partner[v])
            if end is not None:
                break
        held = {u: v for v, u in partner.items()} if end is not None else {}
        while end is not None:
            u = came[end]
            partner[end], end = u, held.get(u)
    return len(partner)


def matching_sizes(links: DataFrame) -> DataFrame:
    """For each component of a bipartite graph, all ``a`` on one side and all ``b`` on the other, the size of a largest
    matching, which is that of a minimum vertex cover: component, matching_size. A component's links must fit a task."""
    import pandas as pd

    ship_package(links.sparkSession)
    rows = links.select("a", "b").distinct().join(components(links).withColumnRenamed("id", "a"), "a")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"component": [pdf["component"].iloc[0]], "matching_size": [_matching(list(zip(pdf["a"].tolist(), pdf["b"].tolist())))]})

    return rows.groupBy("component").applyInPandas(solve, "component long, matching_size long")


def witnesses(cover: DataFrame, links: DataFrame) -> DataFrame:
    """For each node of a cover its smallest neighbour outside it: id, witness (null where all neighbours are inside)."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).toDF("id", "other").distinct()
    outside = both.join(cover.select(F.col("id").alias("other")), "other", "left_anti")
    return cover.select("id").join(outside.groupBy("id").agg(F.min("other").alias("witness")), "id", "left")
