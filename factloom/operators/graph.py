"""Closure, reachability and cycles by frontier loops over DataFrames; orders within a case by grouped functions."""

from __future__ import annotations

import heapq
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.sources.shared import stored


def shortest_paths(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a, b, path): for each pair the lexicographically least of the shortest paths, of one edge or more."""
    steps = stored(edges.select(*keys, "a", "b").distinct())
    frontier = stored(steps.withColumn("path", F.array("a", "b")))
    done = frontier
    while not frontier.isEmpty():
        nxt = frontier.select(*keys, "a", F.col("b").alias("via"), "path").join(steps.select(*keys, F.col("a").alias("via"), "b"), [*keys, "via"])
        nxt = nxt.groupBy(*keys, "a", "b").agg(F.min(F.concat("path", F.array("b"))).alias("path"))
        frontier = stored(nxt.join(done.select(*keys, "a", "b"), [*keys, "a", "b"], "left_anti"))
        done = done.union(frontier)
    return done


def closure(edges: DataFrame) -> DataFrame:
    """Derived edges by type: paths of two edges or more between different nodes that have no edge; via is the path."""
    paths = shortest_paths(edges, ["type"]).where("a <> b and size(path) > 2")
    return paths.select("type", "a", "b", (F.size("path") - 1).cast("bigint").alias("n_edges"), F.array_join("path", ">").alias("via"))


def support_tree(edges: DataFrame, target: str) -> DataFrame:
    """What supports or implies the target, directly or not, with the distance."""
    steps = stored(edges.where("type in ('supports', 'implies')").select("a", "b").distinct())
    found = stored(steps.sparkSession.createDataFrame([(target, 0)], "node string, depth bigint"))
    frontier = found
    while not frontier.isEmpty():
        nxt = steps.join(frontier, steps["b"] == frontier["node"]).select(F.col("a").alias("node"), F.col("depth") + 1).toDF("node", "depth").groupBy("node").agg(F.min("depth").alias("depth"))
        frontier = stored(nxt.join(found.select("node"), "node", "left_anti"))
        found = found.union(frontier)
    return found.where("depth > 0")


def arranged(events: DataFrame, edges: DataFrame) -> DataFrame:
    """(case_id, part, position, event_id) of each case's graph of before-edges: those given, and one from each event with a known
    time to each with a later one.

    Part `cycle` holds the nodes on a cycle, by id. Without a cycle, part `order` is the topological order, the least (unknown
    time, value, id) first, and part `chain` the longest chain, the least by ids among equals. Edges by time aren't made: a gate
    between neighbouring times stands for them, so a case takes memory in proportion to its events and given edges. A case is
    one task's work. Who wants cycles only asks cycles().
    """
    return _arranged(events, edges, _parts)


def cycles(events: DataFrame, edges: DataFrame) -> DataFrame:
    """(case_id, node) on the cycles of arranged(); neither orders nor chains are looked for."""
    return cycle_nodes(_arranged(events, edges, lambda nxt, rank, ids: {"cycle": _cycle(nxt, ids)}))


def _parts(nxt: list[list[int]], rank: list[tuple], ids: list[int]) -> dict[str, list[int]]:
    order = _topological(nxt, rank)
    if len(order) < len(nxt):
        return {"cycle": _cycle(nxt, ids)}
    return {"order": [ids[k] for k in order if k < len(ids)], "chain": _longest(nxt, order, ids)}


def _cycle(nxt: list[list[int]], ids: list[int]) -> list[int]:
    return sorted(ids[k] for k in _on_cycles(nxt) if k < len(ids))


def _arranged(events: DataFrame, edges: DataFrame, parts: Callable[[list[list[int]], list[tuple], list[int]], dict[str, list[int]]]) -> DataFrame:
    into = edges.groupBy("case_id", F.col("b").alias("event_id")).agg(F.collect_set("a").alias("before"))
    known = F.when(F.col("kind") != "unknown", F.col("value"))
    rows = events.select("case_id", "event_id", known.alias("time"), F.coalesce("value", F.lit("~")).alias("value")).join(into, ["case_id", "event_id"], "left")
    schema = "case_id bigint, part string, position bigint, event_id bigint"

    def arrange(case: pa.Table) -> pa.Table:
        ids, known_times, values, befores = (case.column(c).to_pylist() for c in ("event_id", "time", "value", "before"))
        place = {e: k for k, e in enumerate(ids)}
        times = sorted({t for t in known_times if t is not None})
        gate = {t: len(ids) + k for k, t in enumerate(times)}  # reached from events of its time, leads to the next time's
        nxt: list[list[int]] = [[] for _ in range(len(ids) + len(times))]
        for k, (time, before) in enumerate(zip(known_times, befores, strict=True)):
            for e in before or ():
                if e in place:
                    nxt[place[e]].append(k)
            if time is not None:
                nxt[k].append(gate[time])
                if gate[time] > len(ids):
                    nxt[gate[time] - 1].append(k)
        for k in range(len(ids), len(nxt) - 1):
            nxt[k].append(k + 1)
        made = parts(nxt, list(zip(values, ids, strict=True)), ids)
        out = [(part, k, e) for part, found in made.items() for k, e in enumerate(found)]
        kinds = [("case_id", pa.int64()), ("part", pa.string()), ("position", pa.int64()), ("event_id", pa.int64())]
        columns = [[case.column("case_id")[0].as_py()] * len(out), *([row[i] for row in out] for i in range(3))]
        return pa.table([pa.array(c, kind) for c, (_, kind) in zip(columns, kinds, strict=True)], schema=pa.schema(kinds))

    return rows.groupBy("case_id").applyInArrow(arrange, schema)


def _topological(nxt: list[list[int]], rank: list[tuple]) -> list[int]:
    """Nodes in order, the least rank of those that are free first; nodes without a rank go as soon as they are free."""
    waits = [0] * len(nxt)
    for out in nxt:
        for b in out:
            waits[b] += 1
    key = lambda k: (1, *rank[k], k) if k < len(rank) else (0, k)
    ready = [key(k) for k, n in enumerate(waits) if not n]
    heapq.heapify(ready)
    order = []
    while ready:
        order.append(heapq.heappop(ready)[-1])
        for b in nxt[order[-1]]:
            waits[b] -= 1
            if not waits[b]:
                heapq.heappush(ready, key(b))
    return order


def _on_cycles(nxt: list[list[int]]) -> set[int]:
    """Nodes on a cycle: those that share a strong component with another node or have an edge to themselves."""
    back: list[list[int]] = [[] for _ in nxt]
    for a, out in enumerate(nxt):
        for b in out:
            back[b].append(a)
    seen, finished = set(), []
    for root in range(len(nxt)):
        stack = [(root, iter(nxt[root]))] if root not in seen else []
        seen.add(root)
        while stack:
            node, rest = stack[-1]
            new = next((b for b in rest if b not in seen), None)
            if new is None:
                finished.append(stack.pop()[0])
            else:
                seen.add(new)
                stack.append((new, iter(nxt[new])))
    done, found = set(), set()
    for root in reversed(finished):
        if root in done:
            continue
        done.add(root)
        component = [root]
        for node in component:
            new = {a for a in back[node] if a not in done}
            done |= new
            component += new
        if len(component) > 1 or root in nxt[root]:
            found.update(component)
    return found


def _longest(nxt: list[list[int]], order: list[int], ids: list[int]) -> list[int]:
    """The longest chain; a node's best continuation is the longest, by the least id among equals, as chains of two nodes differ in
    their first id."""
    best: list[tuple] = [(0, 0, None)] * len(nxt)  # (-length, id, node) of the best chain that starts at or behind the node
    then: list[tuple] = list(best)
    for k in reversed(order):
        then[k] = min((best[b] for b in nxt[k]), default=(0, 0, None))
        best[k] = (then[k][0] - 1, ids[k], k) if k < len(ids) else then[k]
    node, chain = min(best[: len(ids)], default=(0, 0, None))[2], []
    while node is not None:
        chain.append(ids[node])
        node = then[node][2]
    return chain


def cycle_nodes(found: DataFrame) -> DataFrame:
    """Nodes that reach themselves, of what arranged() found."""
    return found.where("part = 'cycle'").select("case_id", F.col("event_id").alias("node"))
