"""Assembly of a locus: splice graph, minimum-cost flow with lower bounds, and its paths.

The solver is a grouped function: one locus is one group, reduced beforehand to its exon segments
and arcs.  Ties are broken by the lowest node, so results don't depend on the order of rows.
"""

from __future__ import annotations

import heapq
from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.joins import interval_join

#: Positions on each side of a joint that a block must hold to count for it.
JOINT = 5
#: Arc: (from, to, cost); nodes are numbered in order of position.
Arc = tuple[int, int, int]
INFINITE = 1 << 40


def min_cost_paths(nodes: int, arcs: list[Arc], required: list[bool] | None = None, inner: dict[int, list[int]] | None = None) -> tuple[list[list[int]], int]:
    """The paths of a cheapest flow that uses every required arc, and its cost.

    Every arc carries any amount; a required one carries at least 1.  Sources are nodes without
    an arc in, sinks those without one out.  The graph is acyclic.  Lower bounds are turned into demands, met by
    successive shortest paths with potentials.  inner: the nodes that an arc (by its place) leads over.
    """
    if not arcs:
        return [[v] for v in range(nodes)], 0
    required = required or [True] * len(arcs)
    source, sink, top, bottom = nodes, nodes + 1, nodes + 2, nodes + 3
    has_in, has_out = {b for _, b, _ in arcs}, {a for a, _, _ in arcs}
    used = sorted(has_in | has_out)
    every = [*arcs, *((source, v, 0) for v in used if v not in has_in), *((v, sink, 0) for v in used if v not in has_out), (sink, source, 0)]
    low = [*map(int, required), *[0] * (len(every) - len(arcs))]
    graph: list[list[int]] = [[] for _ in range(nodes + 4)]
    to, cap, cost = [], [], []

    def add(a: int, b: int, c: int, w: int) -> None:
        for x, y, k, z in ((a, b, c, w), (b, a, 0, -w)):
            graph[x].append(len(to))
            to.append(y)
            cap.append(k)
            cost.append(z)

    need = [0] * (nodes + 4)
    for (a, b, w), n in zip(every, low):
        add(a, b, INFINITE, w)
        need[b] += n
        need[a] -= n
    for v, n in enumerate(need):
        if n > 0:
            add(top, v, n, 0)
        elif n < 0:
            add(v, bottom, -n, 0)
    potential = [0] * (nodes + 4)
    while True:
        far, via = [INFINITE * 4] * (nodes + 4), [-1] * (nodes + 4)
        far[top], queue = 0, [(0, top)]
        while queue:
            d, v = heapq.heappop(queue)
            if d > far[v]:
                continue
            for e in graph[v]:
                step = d + cost[e] + potential[v] - potential[to[e]]
                if cap[e] > 0 and step < far[to[e]]:
                    far[to[e]], via[to[e]] = step, e
                    heapq.heappush(queue, (step, to[e]))
        if via[bottom] < 0:
            break
        potential = [p + min(d, far[bottom]) for p, d in zip(potential, far)]
        amount, v = INFINITE, bottom
        while v != top:
            amount = min(amount, cap[via[v]])
            v = to[via[v] ^ 1]
        v = bottom
        while v != top:
            cap[via[v]] -= amount
            cap[via[v] ^ 1] += amount
            v = to[via[v] ^ 1]
    flow = {(a, b, k): n + cap[2 * k + 1] for k, ((a, b, _), n) in enumerate(zip(every, low))}
    total = sum(flow[a, b, k] * w for k, (a, b, w) in enumerate(every))
    return _decompose(every, flow, source, sink, inner or {}), total


def _decompose(every: list[Arc], flow: dict, source: int, sink: int, inner: dict[int, list[int]]) -> list[list[int]]:
    """Unit paths, each along the cheapest arc that has flow left; a source arc costs what its cheapest next one does."""
    leaving: dict[int, list[tuple[int, int, int]]] = {}
    for k, (a, b, w) in enumerate(every):
        if (a, b) != (sink, source):
            leaving.setdefault(a, []).append((w, b, k))
    cheapest = {a: min(w for w, _, _ in out) for a, out in leaving.items()}
    leaving[source] = [(cheapest.get(b, 0), b, k) for _, b, k in leaving.get(source, [])]
    paths = []
    while any(flow[source, b, k] > 0 for _, b, k in leaving[source]):
        path, v = [], source
        while v != sink:
            _, nxt, k = min(x for x in leaving[v] if flow[v, x[1], x[2]] > 0)
            flow[v, nxt, k] -= 1
            if nxt != sink:
                path += [*inner.get(k, []), nxt]
            v = nxt
        paths.append(path)
    return paths


def arcs_of(segments: list[tuple[int, int]], junctions: dict[tuple[int, int], float], joint: dict[int, float]) -> list[Arc]:
    """Arcs between exon segments: along junctions, and between segments that touch.

    joint: reads that span the place after a position.  An arc's cost is the greatest support
    of all less its own, whole.
    """
    by_left = {left: k for k, (left, _) in enumerate(segments)}
    leaving: dict[int, list[tuple[int, float]]] = {}
    for (start, stop), n in sorted(junctions.items()):
        leaving.setdefault(start, []).append((stop, n))
    found = []
    for k, (_, right) in enumerate(segments):
        if right + 1 in by_left:
            found.append((k, by_left[right + 1], joint.get(right, 0.0)))
        found += [(k, by_left[stop + 1], n) for stop, n in leaving.get(right + 1, []) if stop + 1 in by_left]
    most = max((n for _, _, n in found), default=0.0)
    return [(a, b, int(most - int(n))) for a, b, n in found]


def _hops(out: dict[int, list[int]], start: int, goal: int) -> list[int]:
    """The nodes of a path with the fewest arcs, start and goal included; empty if there is none."""
    via, queue = {start: start}, deque([start])
    while queue and goal not in via:
        v = queue.popleft()
        for w in out.get(v, []):
            if w not in via:
                via[w] = v
                queue.append(w)
    if goal not in via:
        return []
    path = [goal]
    while path[-1] != start:
        path.append(via[path[-1]])
    return path[::-1]


def constrained(arcs: list[Arc], paths: list[list[int]]) -> tuple[list[Arc], list[bool], dict[int, list[int]]]:
    """The arcs with one more for each path that must be taken, which arcs are required, and the inner nodes of those added.

    paths: lists of nodes that reads go through.  One counts if no arc leads from its start to its end and
    an inner node has several arcs in and several out.  Where its nodes aren't neighbours, the fewest
    arcs between them are taken.  Its own arcs need not be used otherwise.
    """
    at = {(a, b): k for k, (a, b, _) in enumerate(arcs)}
    out: dict[int, list[int]] = {}
    ins: dict[int, int] = {}
    for a, b, _ in arcs:
        out.setdefault(a, []).append(b)
        ins[b] = ins.get(b, 0) + 1
    out = {a: sorted(b) for a, b in out.items()}
    chosen = []
    for path in sorted(set(map(tuple, paths))):
        if len(path) < 3 or (path[0], path[-1]) in at or not any(ins.get(v, 0) > 1 and len(out.get(v, [])) > 1 for v in path[1:-1]):
            continue
        own: list[int] = []
        for a, b in zip(path, path[1:]):
            hops = [a, b] if (a, b) in at else _hops(out, a, b)
            own += [at[x, y] for x, y in zip(hops, hops[1:])]
        if own:
            chosen.append(own)
    covered = {k for own in chosen for k in own}
    more, required, inner = list(arcs), [k not in covered for k in range(len(arcs))], {}
    for own in chosen:
        start, stop = arcs[own[0]][0], arcs[own[-1]][1]
        if len(own) == 1:
            required[own[0]] = True
        elif (start, stop) not in at:
            at[start, stop] = len(more)
            inner[len(more)] = [arcs[k][1] for k in own[:-1]]
            more.append((start, stop, sum(arcs[k][2] for k in own)))
            required.append(True)
    return more, required, inner


def transcripts(segments: list[tuple[int, int, float]], junctions: dict[tuple[int, int], float], joint: dict[int, float], paths: list[list[int]], least_length: int, least_depth: float) -> tuple[list[list[tuple[int, int]]], int]:
    """Transcripts of one locus as lists of exons, in order and each once, and the cost of the flow.

    An exon's depth is that of its first segment; a transcript's is the mean of its exons'.
    """
    arcs, required, inner = constrained(arcs_of([s[:2] for s in segments], junctions, joint), paths)
    found, cost = min_cost_paths(len(segments), arcs, required, inner)
    out = set()
    for path in found:
        exons: list[list] = []
        for left, right, depth in (segments[k] for k in path):
            if exons and exons[-1][1] + 1 == left:
                exons[-1][1] = right
            else:
                exons.append([left, right, depth])
        if sum(b - a + 1 for a, b, _ in exons) >= least_length and sum(d for _, _, d in exons) / len(exons) >= least_depth:
            out.add(tuple((a, b) for a, b, _ in exons))
    return [list(x) for x in sorted(out)], cost


def joints(blocks: DataFrame, segments: DataFrame) -> DataFrame:
    """locus, at, n: the mass of the blocks that span the joint of two touching segments by ``JOINT`` positions on each side.

    blocks: locus, left, right, mass; segments: locus, left, right.  Joints that no block spans have no row.
    """
    nexts = Window.partitionBy("locus").orderBy("left")
    touching = segments.select("locus", F.col("right").alias("at"), F.lead("left").over(nexts).alias("next")).where("next = at + 1")
    need = touching.select("locus", "at", (F.col("at") - JOINT).alias("left"), (F.col("at") + 1 + JOINT).alias("right"))
    equal = blocks.groupBy("locus", "left", "right").agg(F.sum("mass").alias("mass"))
    pairs = interval_join(equal, need, ["locus"], predicate="contain")
    return pairs.groupBy("locus", F.col("b_at").alias("at")).agg(F.sum("mass").cast("double").alias("n"))


def read_paths(blocks: DataFrame, segments: DataFrame, least: int = 3) -> DataFrame:
    """locus, path: the distinct lists of segments (numbered from 0 by position) that fragments touch, of ``least`` or more.

    blocks: locus, id (of the fragment), left, right.
    """
    order = Window.partitionBy("locus").orderBy("left")
    numbered = segments.select("locus", "left", "right", (F.row_number().over(order) - 1).cast("int").alias("k"))
    pairs = interval_join(blocks.select("locus", "id", "left", "right"), numbered, ["locus"])
    return pairs.groupBy("locus", "id").agg(F.array_sort(F.collect_set("b_k")).alias("path")).where(F.size("path") >= least).select("locus", "path").distinct()


TRANSCRIPTS = "locus long, transcript int, exons array<struct<left:bigint,right:bigint>>, cost long"


def assemble(found: DataFrame, joint: DataFrame | None = None, paths: DataFrame | None = None, least_length: int = 200, least_depth: float = 0.0) -> DataFrame:
    """Transcripts of each locus, from ``segments.parts`` and, where given, ``joints`` and ``read_paths``."""
    none = F.lit(None).cast("array<int>")
    rows = found.select("locus", "kind", "left", "right", "n", none.alias("path"))
    if joint is not None:
        rows = rows.unionByName(joint.select("locus", F.lit("joint").alias("kind"), F.col("at").alias("left"), F.col("at").alias("right"), "n", none.alias("path")))
    if paths is not None:
        rows = rows.unionByName(paths.select("locus", F.lit("path").alias("kind"), F.lit(0).cast("long").alias("left"), F.lit(0).cast("long").alias("right"), F.lit(0.0).alias("n"), "path"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        by = {kind: own.sort_values(["left", "right"]) for kind, own in pdf.groupby("kind")}
        rows = lambda kind: by[kind][["left", "right", "n"]].itertuples(index=False, name=None) if kind in by else ()
        cut = list(rows("segment"))
        if not cut:
            return pd.DataFrame(columns=["locus", "transcript", "exons", "cost"])
        walked = [list(map(int, x)) for x in by["path"]["path"]] if "path" in by else []
        made, cost = transcripts(cut, {(a, b): n for a, b, n in rows("junction")}, {a: n for a, _, n in rows("joint")}, walked, least_length, least_depth)
        out = [(pdf["locus"].iat[0], k + 1, [{"left": int(a), "right": int(b)} for a, b in exons], cost) for k, exons in enumerate(made)]
        return pd.DataFrame(out, columns=["locus", "transcript", "exons", "cost"])

    return rows.groupBy("locus").applyInPandas(run, TRANSCRIPTS)
