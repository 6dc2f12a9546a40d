"""Parent-child links to full hierarchies: roots, depths, cycles, paths and descendants.

Method. Links of nodes with one parent form forests and pure loops. Every partition folds its links in a
weighted disjoint-set forest (node -> top, offset = links to the top), the partial forests are merged
hierarchically (a top that has a parent elsewhere takes that parent's top and the sum of both offsets; a
merge doubles the length covered, so rounds grow with the logarithm of the longest chain). What remains
are the nodes with several parents; they and the roots form a far smaller graph with weighted links, on
which shortest distances to roots and strongly connected components are found by frontier joins. Paths and
descendants are then materialised through indexed parent traversal.

Defined results
  * A key is the id in lower case without outer blanks. Null and blank ids are no nodes; null and blank
    parent members and references to unknown ids are ignored; repeated rows and members count once, and
    the parents of rows that share a key are united.
  * An empty table gives empty results. A node that names itself as parent is a loop of one.
  * Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, norm_key

#: Links folded by one task in the first step; a bound on a task's memory, not on the input.
LINKS_PER_TASK = 200_000
#: Links between nodes of several parents, or towards pure loops, up to which one task solves them at once;
#: beyond it frontier joins do. Both give the same rows.
SMALL_GRAPH = 100_000


def fold_links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Weighted disjoint-set forest over the links of one partition, with path compression.

    Nodes that lead into a loop inside the partition keep their first link, for the global step to judge.
    """
    up: dict[str, tuple[str, int]] = {}
    for b in batches:
        up.update(zip(b["child"], zip(b["top"], b["off"])))
    loop: set[str] = set()
    first = dict(up)
    done: set[str] = set()
    for start in first:
        trail, at, on = [], start, set()
        while at in first and at not in done and at not in on and at not in loop:
            on.add(at)
            trail.append(at)
            at = first[at][0]
        if at in on or at in loop:
            loop.update(trail)
            continue
        top, off = up[at] if at in done else (at, 0)
        for node in reversed(trail):
            off += first[node][1]
            up[node] = (top, off)
            done.add(node)
    for node in loop:
        up[node] = first[node]
    if up:
        yield pd.DataFrame({"child": list(up), "top": [t for t, _ in up.values()], "off": [o for _, o in up.values()]})


def on_loops(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The nodes on loops of a function given as rows (child, parent)."""
    up: dict[str, str] = {}
    for b in batches:
        up.update(zip(b["child"], b["parent"]))
    state: dict[str, int] = {}
    loops: list[str] = []
    for turn, start in enumerate(up):
        at = start
        while at in up and at not in state:
            state[at] = turn
            at = up[at]
        if state.get(at) == turn and at in up:
            end = at
            while True:
                loops.append(at)
                at = up[at]
                if at == end:
                    break
    if loops:
        yield pd.DataFrame({"key": loops})


def solve_small(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (child, top, w, is_root) to rows (kind, a, b, n): 'd' least distance n of node a to root b, and 's'
    component b of node a, for components that hold a loop."""
    down: dict[str, list[tuple[str, int]]] = {}
    up: dict[str, list[str]] = {}
    roots: set[str] = set()
    for b in batches:
        for child, top, w, is_root in zip(b["child"], b["top"], b["w"], b["is_root"]):
            down.setdefault(top, []).append((child, int(w)))
            if is_root:
                roots.add(top)
            else:
                up.setdefault(child, []).append(top)
                up.setdefault(top, [])
    for r in sorted(roots):
        best: dict[str, int] = {}
        heap = [(w, c) for c, w in down[r]]
        heapq.heapify(heap)
        while heap:
            d, at = heapq.heappop(heap)
            if at not in best:
                best[at] = d
                for c, w in down.get(at, ()):
                    if c not in best:
                        heapq.heappush(heap, (d + w, c))
        yield pd.DataFrame({"kind": ["d"] * len(best), "a": list(best), "b": [r] * len(best), "n": list(best.values())})
    order: dict[str, int] = {}
    low: dict[str, int] = {}
    stack: list[str] = []
    held: set[str] = set()
    rows: list[tuple[str, str]] = []
    for start in up:
        if start in order:
            continue
        work = [(start, iter(up[start]))]
        order[start] = low[start] = len(order)
        stack.append(start)
        held.add(start)
        while work:
            at, nexts = work[-1]
            step = next(nexts, None)
            if step is not None:
                if step not in order:
                    order[step] = low[step] = len(order)
                    stack.append(step)
                    held.add(step)
                    work.append((step, iter(up[step])))
                elif step in held:
                    low[at] = min(low[at], order[step])
                continue
            work.pop()
            if work:
                low[work[-1][0]] = min(low[work[-1][0]], low[at])
            if low[at] == order[at]:
                part = []
                while True:
                    x = stack.pop()
                    held.discard(x)
                    part.append(x)
                    if x == at:
                        break
                if len(part) > 1 or at in up[at]:
                    rows += [(x, at) for x in part]
    if rows:
        yield pd.DataFrame({"kind": ["s"] * len(rows), "a": [x for x, _ in rows], "b": [y for _, y in rows], "n": [0] * len(rows)})


@dataclass
class Forest:
    """The folded hierarchy of one table of links."""

    ids: DataFrame  #: key, id
    edges: DataFrame  #: child, parent
    rooted: DataFrame  #: key, root, depth
    cycles: DataFrame  #: key


def links(df: DataFrame, id_col: str = "id", parents_col: str = "parents") -> tuple[DataFrame, DataFrame]:
    """(ids: key, id) and (edges: child, parent) of a table with an array of parent references."""
    base = df.select(norm_key(id_col).alias("key"), F.col(id_col).alias("id"), F.col(parents_col).alias("ps")).where("key <> ''")
    ids = base.select("key", "id").distinct()
    refs = base.select(F.col("key").alias("child"), F.explode("ps").alias("p")).select("child", norm_key("p").alias("parent"))
    edges = refs.where("parent <> ''").distinct().join(ids.select(F.col("key").alias("parent")).distinct(), "parent", "left_semi")
    return ids, edges.select("child", "parent")


def _fold(single: DataFrame) -> tuple[DataFrame, int]:
    """Every node with one parent to its top and offset; and how many nodes lead into a pure loop."""
    n = single.count()
    cur = single.select("child", F.col("parent").alias("top"), F.lit(1).cast("long").alias("off"))
    cur = cut(cur.repartition(max(1, math.ceil(n / LINKS_PER_TASK)), "child").mapInPandas(fold_links, "child string, top string, off long"))
    before = -1
    while True:
        a, b = cur.alias("a"), cur.alias("b")
        step = a.join(b, F.col("a.top") == F.col("b.child"), "left").select(
            "a.child",
            F.coalesce("b.top", "a.top").alias("top"),
            (F.col("a.off") + F.coalesce("b.off", F.lit(0))).alias("off"),
            F.col("b.child").isNotNull().alias("moved"),
        )
        step = cut(step)
        moved = step.where("moved").count()
        if moved == 0 or moved == before:
            return (cur if moved == 0 else step.select("child", "top", "off")), moved
        before, cur = moved, step.select("child", "top", "off")


def _pure_loops(single: DataFrame, folded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes that lead into a pure loop, and among them those on it: the image of the parent function's
    power beyond the number of such nodes."""
    tail = cut(folded.join(single.select(F.col("child").alias("top")), "top", "left_semi").select("child"))
    fn = cut(single.join(tail, "child", "left_semi"))
    if fn.count() <= SMALL_GRAPH:
        return tail, fn.coalesce(1).mapInPandas(on_loops, "key string")
    for _ in range(max(1, math.ceil(math.log2(fn.count() + 1)))):
        a, b = fn.alias("a"), fn.alias("b")
        fn = cut(a.join(b, F.col("a.parent") == F.col("b.child")).select("a.child", "b.parent"))
    return tail, fn.select(F.col("parent").alias("key")).distinct()


def _trim(e: DataFrame) -> tuple[DataFrame, int]:
    """Drop links that cannot lie on a loop, until none is left to drop."""
    n = e.count()
    while n:
        kept = e.join(e.select(F.col("b").alias("a")).distinct(), "a", "left_semi")
        kept = kept.join(kept.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b")
        e = cut(kept)
        m = e.count()
        if m == n:
            break
        n = m
    return e, n


def _components(e: DataFrame) -> DataFrame | None:
    """(key, scc) of the nodes on loops of the link table ``e`` (a, b), by colouring: the largest key that
    reaches a node is its colour; what reaches the colour's own node inside the colour is one component."""
    found = None
    e, n = _trim(cut(e.select("a", "b").distinct()))
    while n:
        colour = cut(e.select(F.explode(F.array("a", "b")).alias("v")).distinct().select("v", F.col("v").alias("c")))
        while True:
            spread = e.join(colour, e.a == colour.v).groupBy("b").agg(F.max("c").alias("cc"))
            new = cut(colour.join(spread, colour.v == spread.b, "left").select("v", F.greatest("c", "cc").alias("c"), (F.col("cc") > F.col("c")).alias("up")))
            grew = not new.where("up").isEmpty()
            colour = new.select("v", "c")
            if not grew:
                break
        same = cut(
            e.join(colour.select(F.col("v").alias("a"), F.col("c").alias("ca")), "a")
            .join(colour.select(F.col("v").alias("b"), F.col("c").alias("cb")), "b")
            .where("ca = cb")
            .select("a", "b", "ca")
        )
        scc = front = cut(colour.where("v = c"))
        while True:
            back = same.join(front, same.b == front.v).select(F.col("a").alias("v"), F.col("ca").alias("c")).distinct()
            front = cut(back.join(scc, "v", "left_anti"))
            if front.isEmpty():
                break
            scc = cut(scc.unionByName(front))
        on = same.join(scc.select(F.col("v").alias("a")), "a", "left_semi").join(scc.select(F.col("v").alias("b")), "b", "left_semi")
        part = cut(on.select(F.col("a").alias("key"), F.col("ca").alias("scc")).distinct())
        found = part if found is None else found.unionByName(part)
        gone = scc.select(F.col("v").alias("a"))
        rest = e.join(gone, "a", "left_anti").join(gone.select(F.col("a").alias("b")), "b", "left_anti")
        e, n = _trim(cut(rest.select("a", "b")))
    return found


def _distances(jedges: DataFrame, inner: DataFrame, roots: DataFrame) -> DataFrame:
    """(child, root, d): least distances of nodes with several parents; only improved rows go on."""
    best = cut(jedges.join(roots.select(F.col("key").alias("top")), "top", "left_semi").groupBy("child", F.col("top").alias("root")).agg(F.min("w").alias("d")))
    delta = best
    while not delta.isEmpty():
        nxt = inner.join(delta.select(F.col("child").alias("top"), "root", "d"), "top").groupBy("child", "root").agg(F.min(F.col("d") + F.col("w")).alias("d"))
        old = best.select("child", "root", F.col("d").alias("had"))
        delta = cut(nxt.join(old, ["child", "root"], "left").where("had is null or d < had").select("child", "root", "d"))
        best = cut(best.unionByName(delta).groupBy("child", "root").agg(F.min("d").alias("d")))
    return best


def resolve(df: DataFrame, id_col: str = "id", parents_col: str = "parents") -> Forest:
    """Roots with least depths, and the nodes on loops, of every node of ``df``."""
    ids, edges = links(df, id_col, parents_col)
    ids, edges = cut(ids), cut(edges)
    fan = edges.groupBy("child").agg(F.count(F.lit(1)).alias("n"), F.min("parent").alias("parent"))
    fan = cut(fan)
    single = fan.where("n = 1").select("child", "parent")
    several = fan.where("n > 1").select("child")
    roots = cut(ids.select("key").distinct().join(fan.select(F.col("child").alias("key")), "key", "left_anti"))

    folded, looping = _fold(single)
    cycles = None
    if looping:
        tail, cycles = _pure_loops(single, folded)
        folded = cut(folded.join(tail, "child", "left_anti"))
    else:
        tail = single.select("child").limit(0)

    # Links of nodes with several parents, shortened to the parent's top.
    j = edges.join(several, "child", "left_semi").join(tail.select(F.col("child").alias("parent")), "parent", "left_anti")
    f = folded.select(F.col("child").alias("parent"), "top", "off")
    jedges = cut(j.join(f, "parent", "left").select("child", "parent", F.coalesce("top", "parent").alias("top"), (F.coalesce("off", F.lit(0)) + 1).alias("w")))
    inner = jedges.join(several.select(F.col("child").alias("top")), "top", "left_semi").select("child", "parent", "top", "w")
    if jedges.count() <= SMALL_GRAPH:
        flagged = jedges.join(roots.select(F.col("key").alias("top"), F.lit(True).alias("is_root")), "top", "left").select("child", "top", "w", F.coalesce("is_root", F.lit(False)).alias("is_root"))
        solved = cut(flagged.coalesce(1).mapInPandas(solve_small, "kind string, a string, b string, n long"))
        best = solved.where("kind = 'd'").select(F.col("a").alias("child"), F.col("b").alias("root"), F.col("n").alias("d"))
        scc = solved.where("kind = 's'").select(F.col("a").alias("key"), F.col("b").alias("scc"))
        scc = None if scc.isEmpty() else scc
    else:
        inner = cut(inner)
        best = _distances(jedges, inner, roots)
        scc = _components(inner.select(F.col("child").alias("a"), F.col("top").alias("b")))
    if scc is not None:
        on = scc.select("key")
        near = inner.join(scc.select(F.col("key").alias("child"), F.col("scc").alias("s1")), "child").join(scc.select(F.col("key").alias("top"), F.col("scc").alias("s2")), "top")
        walk = near.where("s1 = s2 and w > 1").select(F.col("parent").alias("key"), "top").distinct()
        walk = cut(walk)
        while not walk.isEmpty():  # the chains between two such nodes of one loop
            on = on.unionByName(walk.select("key"))
            walk = cut(walk.join(single, walk.key == single.child).where("parent <> top").select(F.col("parent").alias("key"), "top").distinct())
        cycles = on if cycles is None else cycles.unionByName(on)
    cycles = cut(cycles.distinct()) if cycles is not None else ids.select("key").limit(0)

    own = roots.select("key", F.col("key").alias("root"), F.lit(0).cast("long").alias("depth"))
    many = best.select(F.col("child").alias("key"), "root", F.col("d").alias("depth"))
    straight = folded.join(roots.select(F.col("key").alias("top")), "top", "left_semi").select(F.col("child").alias("key"), F.col("top").alias("root"), F.col("off").alias("depth"))
    via = folded.join(best.select(F.col("child").alias("top"), "root", "d"), "top").select(F.col("child").alias("key"), "root", (F.col("off") + F.col("d")).alias("depth"))
    rooted = cut(own.unionByName(many).unionByName(straight).unionByName(via))
    return Forest(ids, edges, rooted, cycles)


def hierarchy(df: DataFrame, id_col: str = "id", parents_col: str = "parents") -> DataFrame:
    """(id, root_id, depth): a row for each node and root above it with the least number of links; a row
    (id, 'cycle', -1) for each node that is its own ancestor; (id, 'none', -1) for other nodes without root."""
    f = resolve(df, id_col, parents_col)
    name = f.ids.select(F.col("key").alias("root"), F.col("id").alias("root_id"))
    rooted = f.rooted.join(name, "root").select("key", "root_id", F.col("depth").cast("int").alias("depth"))
    loops = f.cycles.select("key", F.lit("cycle").alias("root_id"), F.lit(-1).alias("depth"))
    rest = f.ids.select("key").distinct().join(f.rooted.select("key").unionByName(f.cycles), "key", "left_anti")
    none = rest.select("key", F.lit("none").alias("root_id"), F.lit(-1).alias("depth"))
    return rooted.unionByName(loops).unionByName(none).join(f.ids, "key").select("id", "root_id", "depth")


def paths(df: DataFrame, id_col: str = "id", parents_col: str = "parents", sep: str = " > ") -> DataFrame:
    """(id, root_id, depth, path): the shortest path from each root, of several the one whose nodes, seen
    from below, have the smallest keys. Path pieces are joined end to end, so rounds grow with the
    logarithm of the depth. A path has depth + 1 keys: its length is the hierarchy's own depth."""
    f = resolve(df, id_col, parents_col)
    up = f.rooted.select(F.col("key").alias("parent"), "root", F.col("depth").alias("pd"))
    here = f.rooted.where("depth > 0")
    pick = f.edges.join(here, f.edges.child == here.key).join(up, ["parent", "root"]).where("pd = depth - 1")
    seg = pick.groupBy("key", "root", "depth").agg(F.min("parent").alias("at")).select("key", "root", "depth", "at", F.array("at").alias("way"))
    seg = cut(seg.unionByName(f.rooted.where("depth = 0").select("key", "root", "depth", F.lit(None).cast("string").alias("at"), F.array().cast("array<string>").alias("way"))))
    while not seg.where("at <> root").isEmpty():
        b = seg.select(F.col("key").alias("at"), "root", F.col("at").alias("at2"), F.col("way").alias("way2"))
        todo = seg.where("at <> root").join(b, ["at", "root"]).select("key", "root", "depth", F.col("at2").alias("at"), F.concat("way2", "way").alias("way"))
        seg = cut(todo.unionByName(seg.where("at is null or at = root")))
    name = f.ids.select(F.col("key").alias("root"), F.col("id").alias("root_id"))
    whole = seg.select("key", "root", "depth", F.concat_ws(sep, F.concat("way", F.array("key"))).alias("path"))
    return whole.join(f.ids, "key").join(name, "root").select("id", "root_id", F.col("depth").cast("int").alias("depth"), "path")


def closure(edges: DataFrame) -> DataFrame:
    """(node, ancestor, distance): least number of links from every node to each ancestor but itself.

    A round joins the pairs at the greatest distance known (2^k) to all known pairs of their ancestors, so it
    doubles the distance covered and finds every further pair by way of its node half-way."""
    known = cut(edges.where("child <> parent").select(F.col("child").alias("node"), F.col("parent").alias("ancestor"), F.lit(1).cast("long").alias("distance")).distinct())
    span = 1
    while True:
        far = known.where(F.col("distance") == span).select("node", F.col("ancestor").alias("mid"))
        on = known.select(F.col("node").alias("mid"), "ancestor", "distance")
        nxt = far.join(on, "mid").where("node <> ancestor").groupBy("node", "ancestor").agg((F.min("distance") + span).alias("distance"))
        new = cut(nxt.join(known.select("node", "ancestor"), ["node", "ancestor"], "left_anti"))
        if new.isEmpty():
            return known
        known = cut(known.unionByName(new))
        span *= 2


def descendants(df: DataFrame, id_col: str = "id", parents_col: str = "parents") -> DataFrame:
    """(id, descendant_id, depth): every descendant of every node but itself, with the least number of links."""
    ids, edges = links(df, id_col, parents_col)
    ids, edges = cut(ids), cut(edges)
    c = closure(edges)
    low = ids.select(F.col("key").alias("node"), F.col("id").alias("descendant_id"))
    return c.join(low, "node").join(ids.select(F.col("key").alias("ancestor"), "id"), "ancestor").select("id", "descendant_id", F.col("distance").cast("int").alias("depth"))
