"""Directed multigraphs.

``nodes(id, sort_key)`` and ``edges(id, sort_key, role, src, dst, weight)``.  The canonical order is (sort_key, id) by
code point; it is carried as a struct, never as a global row number, so no step needs all rows in one task.

Two ways to execute, with the same results.  Weak components up to ``COMPONENT_ROWS`` nodes and edges run whole in a
grouped Arrow task, in linear time whatever their depth (a chain of 100 000 nodes is one group).  Larger components run
as rounds of joins over written tables: as many as the graph is deep, each distributed.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.stages import staged
from ledgerloom.operators.findings import every, rule

COMPONENT_ROWS = 2_000_000
#: A graph of so many nodes and edges is one group outright: finding its components would take longer than solving it.
WHOLE_ROWS = 200_000
#: Rounds of joins that a reachability may take before components are looked for.
FIRST_ROUNDS = 5


class NotADag(ValueError):
    """``args[0]``: the cycle's witness, a list of node ids."""


# ---- declaration ------------------------------------------------------------------------------------------------


def graph_findings(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Duplicate ids, one finding each, and, if no node id is at fault, unresolved endpoints."""
    twice = lambda df: df.groupBy("id").count().where("count > 1")
    double = twice(nodes)
    ends = edges.select("id", F.explode(F.array(F.struct(F.lit("from").alias("end"), F.col("src").alias("n")), F.struct(F.lit("to").alias("end"), F.col("dst").alias("n")))).alias("e")).select("id", "e.*")
    sound = double.agg((F.count(F.lit(1)) == 0).alias("ok")).where("ok")
    lost = ends.join(nodes.select(F.col("id").alias("n")), "n", "left_anti").crossJoin(F.broadcast(sound))  # one row
    return every(
        rule(double, "duplicate-node-id", "id"), rule(twice(edges), "duplicate-edge-id", "id"),
        rule(lost, "unresolved-endpoint", "concat(id, '.', end)"),
    )


def canonical(df: DataFrame) -> DataFrame:
    return df.orderBy("sort_key", "id")


def adjacency(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, out_edges, in_edges``: for every node the ids of its edges in canonical order."""
    side = lambda end, name: edges.groupBy(F.col(end).alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("sort_key", F.col("id").alias("e")))), lambda x: x["e"]).alias(name))
    none = F.array().cast("array<string>")
    out = nodes.select("id").join(side("src", "out_edges"), "id", "left").join(side("dst", "in_edges"), "id", "left")
    return out.select("id", F.coalesce("out_edges", none).alias("out_edges"), F.coalesce("in_edges", none).alias("in_edges"))


# ---- reachability -----------------------------------------------------------------------------------------------


def reachable(nodes: DataFrame, edges: DataFrame, starts: DataFrame) -> DataFrame:
    """``id`` of every node that a start (id) leads to, starts included; unknown starts are an error.

    A few rounds of joins, in which only the frontier moves, settle shallow graphs; in deeper ones components run whole
    where they fit, and giant ones in further rounds.
    """
    lost = starts.join(nodes, "id", "left_anti").select("id").limit(1).collect()
    if lost:
        raise ValueError(f"unknown-start-node: {lost[0][0]}")
    near, done = _frontier(edges, starts.select("id").distinct(), FIRST_ROUNDS)
    if done:
        return near
    starts = near
    marked = nodes.join(starts.select("id").distinct().withColumn("mark", F.lit(True)), "id", "left")

    def solve(ids, src, dst, _, mark):
        order, cut = _out_lists(len(ids), src)
        seen = mark.copy()
        todo = np.flatnonzero(mark).tolist()
        while todo:
            v = todo.pop()
            for w in dst[order[cut[v] : cut[v + 1]]].tolist():
                if not seen[w]:
                    seen[w] = True
                    todo.append(w)
        return pd.DataFrame({"id": pd.Series([x for x, s in zip(ids, seen) if s], dtype=object)})

    return _grouped(marked, edges, solve, "id string", lambda n, e: _frontier(e, n.where("mark").select("id"))[0])


def _frontier(edges: DataFrame, starts: DataFrame, rounds: int | None = None) -> tuple[DataFrame, bool]:
    """(what was reached, whether that is all) after so many rounds of joins."""
    steps = edges.select("src", "dst").distinct()
    seen = frontier = staged(starts, "reach")
    k = 0
    while rounds is None or k < rounds:
        k += 1
        ahead = frontier.join(steps, frontier.id == steps.src).select(F.col("dst").alias("id")).distinct()
        frontier = staged(ahead.join(seen, "id", "left_anti"), "reach")
        if frontier.isEmpty():
            return seen, True
        seen = seen.unionAll(frontier)
    return seen, False


# ---- weak components --------------------------------------------------------------------------------------------


def weak_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, component``: the smallest id that edges, either way, lead to.

    Large and small stars in turn, so the rounds are logarithmic in the size of a component.
    """
    links = staged(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "weak")
    state = None
    while True:
        both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        links = staged(small, "weak")
        now = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state:
            break
        state = now
    roots = links.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return nodes.select("id").join(roots, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def _grouped(nodes: DataFrame, edges: DataFrame, solve, schema: str, large) -> DataFrame:
    """``solve(ids, src, dst, edges)`` per weak component; ids in canonical order, edges too, src and dst as positions.

    Where nodes have a boolean column ``mark``, solve gets it as a fifth argument.
    ``large``: what to run for components over COMPONENT_ROWS, as solve(nodes, edges) -> DataFrame of the same schema.
    """
    nodes, edges = staged(nodes, "nodes"), staged(edges, "edges")
    if nodes.count() + edges.count() <= min(WHOLE_ROWS, COMPONENT_ROWS):
        comp = nodes.select("id", F.lit("").alias("component"))
    else:
        comp = staged(weak_components(nodes, edges), "component")
    owner = comp.select(F.col("id").alias("src"), "component")
    marks = "mark" in nodes.columns
    mark = F.coalesce("mark", F.lit(False)) if marks else F.lit(False)
    n = nodes.join(comp, "id").select("component", F.lit(True).alias("is_node"), "id", "sort_key", F.lit("").alias("src"), F.lit("").alias("dst"), F.lit(None).cast("double").alias("weight"), mark.alias("mark"))
    e = edges.join(owner, "src").select("component", F.lit(False).alias("is_node"), "id", "sort_key", "src", "dst", "weight", F.lit(False).alias("mark"))
    rows = n.unionByName(e)
    big = rows.groupBy("component").count().where(F.col("count") > COMPONENT_ROWS).select("component")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["sort_key", "id"], key=lambda s: s.map(lambda x: x.encode("utf-8", "surrogatepass")))
        points, lines = pdf[pdf.is_node], pdf[~pdf.is_node].reset_index(drop=True)
        place = {x: i for i, x in enumerate(points.id)}
        src, dst = (np.array([place[x] for x in lines[c]], np.int64) for c in ("src", "dst"))
        return solve(points.id.tolist(), src, dst, lines, *([points.mark.to_numpy(bool)] if marks else []))

    if large is None or big.isEmpty():
        return rows.groupBy("component").applyInPandas(one, schema)
    few = rows.join(big, "component", "left_anti").groupBy("component").applyInPandas(one, schema)
    giant = comp.join(big, "component").select("id")
    return few.unionByName(large(nodes.join(giant, "id", "left_semi"), edges.join(giant.withColumnRenamed("id", "src"), "src", "left_semi")))


def grouped_whole(nodes: DataFrame, edges: DataFrame, solve, schema: str) -> DataFrame:
    """``solve`` per weak component of any size, for what has no distributed form."""
    return _grouped(nodes, edges, solve, schema, None)


def _out_lists(n: int, src: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges by source: positions into `order` per node."""
    order = np.argsort(src, kind="stable")
    return order, np.searchsorted(src[order], np.arange(n + 1))


def _scc(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The least position of each node's strongly connected component (two passes of depth-first search)."""
    def finish_order(starts, order, cut, ends):
        seen, done, groups = np.zeros(n, bool), [], []
        for s in starts:
            if seen[s]:
                continue
            seen[s], stack, group = True, [(s, cut[s])], []
            while stack:
                v, at = stack.pop()
                while at < cut[v + 1] and seen[ends[order[at]]]:
                    at += 1
                if at < cut[v + 1]:
                    w = ends[order[at]]
                    seen[w] = True
                    stack += [(v, at + 1), (w, cut[w])]
                else:
                    done.append(v)
                    group.append(v)
            groups.append(group)
        return done, groups

    done, _ = finish_order(range(n), *_out_lists(n, src), dst)
    _, groups = finish_order(done[::-1], *_out_lists(n, dst), src)
    root = np.zeros(n, np.int64)
    for g in groups:
        root[g] = min(g)
    return root


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, component``: the canonically first member of each node's strongly connected component.

    Giant weak components are coloured in rounds: the greatest key that reaches a node, then backwards within a colour.
    """
    def solve(ids, src, dst, _):
        root = _scc(len(ids), src, dst)
        return pd.DataFrame({"id": ids, "component": [ids[r] for r in root]})

    return _grouped(nodes, edges, solve, "id string, component string", _coloured)


def _coloured(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    left = staged(nodes.select("id", F.struct("sort_key", "id").alias("key")), "scc")
    lines = edges.select("src", "dst").distinct()
    out = None
    while not left.isEmpty():
        alive = staged(lines.join(left.select(F.col("id").alias("src")), "src", "left_semi").join(left.select(F.col("id").alias("dst")), "dst", "left_semi"), "scc")
        colour = left.select("id", F.col("key").alias("c"))
        while True:  # the least key that leads here
            offered = alive.join(colour.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("c").alias("o"))
            new = staged(colour.join(offered, "id", "left").select("id", F.least("c", "o").alias("c"), (F.col("o") < F.col("c")).alias("moved")), "scc")
            moved = not new.where("moved").isEmpty()
            colour = new.drop("moved")
            if not moved:
                break
        inside = alive.join(colour.select(F.col("id").alias("src"), F.col("c").alias("cs")), "src").join(colour.select(F.col("id").alias("dst"), F.col("c").alias("cd")), "dst").where("cs = cd")
        roots = colour.where("c.id = id").select("id")
        mine = _frontier(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")), roots)[0]
        found = colour.join(mine, "id", "left_semi").select("id", F.col("c.id").alias("component"))
        out = found if out is None else out.unionAll(found)
        left = staged(left.join(found, "id", "left_anti"), "scc")
    return out


def condensed(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The component of every node, and the edges between components, unaggregated."""
    comp = staged(strong_components(nodes, edges), "condensed")
    a, b = (comp.select(F.col("id").alias(end), F.col("component").alias(f"{end}_component")) for end in ("src", "dst"))
    return comp, edges.join(a, "src").join(b, "dst").where("src_component <> dst_component").select("id", "role", "src_component", "dst_component")


# ---- waves ------------------------------------------------------------------------------------------------------


def _levels(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Longest hops from a source, -1 on and after cycles."""
    order, cut = _out_lists(n, src)
    waiting, level = np.bincount(dst, minlength=n), np.full(n, -1)
    now = np.flatnonzero(waiting == 0)
    depth = 0
    while len(now):
        level[now] = depth
        ahead = []
        for v in now.tolist():
            for w in dst[order[cut[v] : cut[v + 1]]].tolist():
                waiting[w] -= 1
                if waiting[w] == 0:
                    ahead.append(w)
        now = np.array(ahead, np.int64)
        depth += 1
    return level


def wave_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, wave``: the longest number of hops from a source; null for nodes on a cycle or behind one."""
    def solve(ids, src, dst, _):
        level = _levels(len(ids), src, dst)
        return pd.DataFrame({"id": ids, "wave": pd.array(np.where(level < 0, None, level), "Int64")})

    return _grouped(nodes, edges, solve, "id string, wave bigint", _peeled)


def _peeled(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Waves of a giant component: every round takes the nodes without an edge from what is left."""
    left, lines, depth, out = staged(nodes.select("id"), "waves"), staged(edges.select("src", "dst").distinct(), "waves"), 0, None
    while True:
        free = left.join(lines.select(F.col("dst").alias("id")), "id", "left_anti")
        wave = staged(free.withColumn("wave", F.lit(depth).cast("long")), "waves")
        if wave.isEmpty():
            rest = left.withColumn("wave", F.lit(None).cast("long"))
            return rest if out is None else out.unionAll(rest)
        out = wave if out is None else out.unionAll(wave)
        left = staged(left.join(wave, "id", "left_anti"), "waves")
        lines = staged(lines.join(wave.select(F.col("id").alias("src")), "src", "left_anti"), "waves")
        depth += 1


def waves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Waves of a DAG; ``NotADag`` with the witness of a cycle otherwise."""
    found = staged(wave_levels(nodes, edges), "waves")
    if not found.where("wave IS NULL").isEmpty():
        raise NotADag(cycle_witness(nodes, edges))
    return found


def cycle_witness(nodes: DataFrame, edges: DataFrame) -> list[str]:
    """From the first node on a cycle, always on to the first target of its component, up to the first repetition.

    The functional graph of first targets stays distributed; only the walk's own component comes to the driver.
    """
    comp = staged(strong_components(nodes, edges), "witness")
    a, b = (comp.select(F.col("id").alias(e), F.col("component").alias(f"c_{e}")) for e in ("src", "dst"))
    key = nodes.select(F.col("id").alias("dst"), F.struct("sort_key", "id").alias("k"))
    inside = edges.select("src", "dst").distinct().join(a, "src").join(b, "dst").where("c_src = c_dst").join(key, "dst")
    step = staged(inside.groupBy("src", "c_src").agg(F.min_by("dst", "k").alias("next")), "witness")
    start = step.join(nodes.select(F.col("id").alias("src"), "sort_key"), "src").agg(F.min(F.struct("sort_key", "src", "c_src"))).first()[0]
    if start is None:
        return []
    ahead = dict(step.where(F.col("c_src") == start["c_src"]).select("src", "next").collect())
    walk, seen, at = [], {}, start["src"]
    while at not in seen:
        seen[at] = len(walk)
        walk.append(at)
        at = ahead[at]
    return walk[seen[at] :]


# ---- longest paths ----------------------------------------------------------------------------------------------


def _longest(n: int, src: np.ndarray, dst: np.ndarray, weight: np.ndarray):
    """(value, the in-edge that gave it or -1, tainted) by node; edges are in canonical order, so ties keep the first."""
    value, via, bad = np.zeros(n), np.full(n, -1, np.int64), np.zeros(n, bool)
    order, cut = _out_lists(n, src)
    into, into_cut = _out_lists(n, dst)
    waiting = np.bincount(dst, minlength=n)
    ready = np.flatnonzero(waiting == 0).tolist()
    heapq.heapify(ready)
    done = 0
    while ready:
        v = heapq.heappop(ready)
        done += 1
        lines = into[into_cut[v] : into_cut[v + 1]]
        if len(lines):
            with np.errstate(over="ignore", invalid="ignore"):
                offers = value[src[lines]] + weight[lines]
            bad[v] = bool(bad[src[lines]].any() or not np.isfinite(offers).all())
            best = int(np.argmax(np.where(np.isnan(offers), -np.inf, offers)))
            value[v], via[v] = offers[best], lines[best]
        for w in dst[order[cut[v] : cut[v + 1]]].tolist():
            waiting[w] -= 1
            if waiting[w] == 0:
                heapq.heappush(ready, w)
    if done < n:
        raise NotADag([])
    return value, via, bad


def longest_paths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, value, via_edge, overflow`` on a DAG: the weight of the heaviest path from a source, its last edge.

    An edge without a weight counts 1; ties keep the first edge; a sum that is not finite taints all behind it.
    """
    def solve(ids, src, dst, lines):
        value, via, bad = _longest(len(ids), src, dst, lines["weight"].fillna(1.0).to_numpy(float))
        names = lines["id"].tolist()
        return pd.DataFrame({"id": ids, "value": value, "via_edge": [names[k] if k >= 0 else None for k in via], "overflow": bad})

    return _grouped(nodes, edges, solve, "id string, value double, via_edge string, overflow boolean", _longest_rounds)


def _longest_rounds(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Longest paths of a giant component, wave by wave."""
    wave = staged(_peeled(nodes, edges), "longest")
    if not wave.where("wave IS NULL").isEmpty():
        raise NotADag([])
    last = wave.agg(F.max("wave")).first()[0]
    done = staged(wave.where("wave = 0").select("id", F.lit(0.0).alias("value"), F.lit(None).cast("string").alias("via_edge"), F.lit(False).alias("overflow")), "longest")
    for k in range(1, (last or 0) + 1):
        lines = edges.join(wave.where(F.col("wave") == k).select(F.col("id").alias("dst")), "dst", "left_semi").join(done.select(F.col("id").alias("src"), "value", "overflow"), "src")
        offer = F.col("value") + F.coalesce("weight", F.lit(1.0))
        finite = ~F.isnan(offer) & (F.abs(offer) < F.lit(float("inf")))
        best = lines.groupBy(F.col("dst").alias("id")).agg(
            F.min_by(F.struct(offer.alias("value"), F.col("id").alias("via_edge")), F.struct(-offer, "sort_key", "id")).alias("b"),
            F.bool_or(F.col("overflow") | ~finite).alias("overflow"),
        )
        done = done.unionAll(staged(best.select("id", "b.value", "b.via_edge", "overflow"), "longest"))
    return done


def critical_path(nodes: DataFrame, edges: DataFrame, paths: DataFrame) -> list[str]:
    """The node ids of the heaviest path: back from the first node of the greatest value."""
    end = nodes.join(paths, "id").agg(F.min_by("id", F.struct(-F.col("value"), "sort_key", "id"))).first()[0]
    if end is None:
        return []
    back = paths.join(edges.select(F.col("id").alias("via_edge"), "src"), "via_edge").select("id", "src")
    if nodes.count() > WHOLE_ROWS:  # only the path's own component comes to the driver
        comp = weak_components(nodes, edges)
        back = back.join(comp.join(comp.where(F.col("id") == end).select("component"), "component").select("id"), "id", "left_semi")
    before = dict(back.collect())
    walk = [end]
    while walk[-1] in before:
        walk.append(before[walk[-1]])
    return walk[::-1]
