"""Closures, shortest paths, longest paths and components on edge tables (program_id, src, dst).

Programs don't touch one another, and a program's graph was made from one text in
one place, so each program of up to GROUPED edges is closed in one grouped pass: a
single shuffle for a corpus of any number of programs.  Greater ones go level by
level, all at once; a level is written to the shared checkpoint folder, so that
plans stay small and lost executors cost one level.
"""

from __future__ import annotations

import tempfile
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_LEVELS = 1000
#: Edges of a program up to which one task holds its graph and what is reached in it.
GROUPED = 4000
#: Levels after which what is known is written anew, so that plans stay small.
COMPACT = 16


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir.  Only a session whose executors run in the driver's own process may go without; it gets a temporary folder."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir")
    if not folder and sc.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return folder or tempfile.mkdtemp(prefix="ckpt-")


def cut(df: DataFrame) -> DataFrame:
    """df written to the session's checkpoint folder and read back; Spark's cleaner deletes the files once nothing refers to them."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    sc._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    return df.checkpoint(eager=True)


def _by_size(edges: DataFrame, grouped, stepwise) -> DataFrame:
    """grouped(edges) of the programs of up to GROUPED edges, stepwise(edges) of the others, if there are any."""
    e = cut(edges.select("program_id", "src", "dst").distinct())
    great = cut(e.groupBy("program_id").count().where(F.col("count") > GROUPED).select("program_id"))
    if great.isEmpty():
        return grouped(e)
    return grouped(e.join(great, "program_id", "left_anti")).unionByName(stepwise(e.join(great, "program_id", "left_semi")))


class _Graph:
    """One program's edges, nodes numbered in order of their names."""

    def __init__(self, t: pa.Table, more: list = ()):
        src, dst = (t.column(c).to_pylist() if c in t.column_names else [] for c in ("src", "dst"))
        self.names = sorted({*src, *dst, *more})
        self.number = {n: k for k, n in enumerate(self.names)}
        self.after = defaultdict(list)
        for a, b in zip(src, dst):
            self.after[self.number[a]].append(self.number[b])

    def levels(self, start: int):
        """Levels of nodes by shortest distance from a start, the start itself only where a cycle leads back to it."""
        level, seen = sorted(set(self.after[start])), set()
        while level:
            seen.update(level)
            yield level
            level = sorted({b for a in level for b in self.after.get(a, ())} - seen)

    def said(self, numbers) -> pa.Array:
        return pa.array(self.names, pa.string()).take(pa.array(np.asarray(numbers, np.int64)))


def _renewed(df: DataFrame) -> DataFrame:
    """df with columns that the planner takes for new ones: a cogroup of two frames of one origin would lose columns of the second."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def _starts(t: pa.Table) -> list:
    """The starts of a cogroup's side, which has no columns where it has no rows."""
    return t.column("src").to_pylist() if "src" in t.column_names else []


def _program(t: pa.Table, n: int) -> pa.Array:
    return pa.array([t.column("program_id")[0].as_py()] * n if n else [], pa.string())


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select("program_id", F.col("dst").alias("src"), F.col("src").alias("dst"))


def reach(edges: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """(program_id, src, dst, distance): all nodes reached from each start (program_id, src), by shortest distance.

    Without `start`, from every node that has an edge.  A start reaches itself only over a cycle.
    """
    starts = None if start is None else cut(start.select("program_id", "src").distinct())

    def grouped(e: DataFrame) -> DataFrame:
        def closed(t: pa.Table, wanted: pa.Table) -> pa.Table:
            g = _Graph(t)
            src, dst, distance = [], [], []
            for s in sorted(g.number[x] for x in _starts(wanted) if x in g.number):
                for d, level in enumerate(g.levels(s), 1):
                    dst.append(np.array(level))
                    src.append(np.full(len(level), s))
                    distance.append(np.full(len(level), d, np.int32))
            if not dst:
                return _REACH.empty_table()
            src, dst, distance = (np.concatenate(x) for x in (src, dst, distance))
            return pa.table([_program(t, len(src)), g.said(src), g.said(dst), pa.array(distance)], schema=_REACH)  # what is reached has edges

        begin = _renewed(starts if starts is not None else e.select("program_id", "src").distinct())
        return e.groupBy("program_id").cogroup(begin.groupBy("program_id")).applyInArrow(closed, "program_id string, src string, dst string, distance int")

    return _by_size(edges, grouped, lambda e: _reach_stepwise(e, starts))


_REACH = pa.schema([("program_id", pa.string()), ("src", pa.string()), ("dst", pa.string()), ("distance", pa.int32())])


def _reach_stepwise(e: DataFrame, starts: DataFrame | None) -> DataFrame:
    e = cut(e)
    begin = e.select("program_id", "src").distinct() if starts is None else starts
    level = cut(e.join(begin, ["program_id", "src"]).select("program_id", "src", "dst"))
    seen = level.withColumn("distance", F.lit(1))
    hop = e.select("program_id", F.col("src").alias("dst"), F.col("dst").alias("to"))
    for distance in count(2):
        known = seen.select("program_id", "src", "dst")
        level = level.join(hop, ["program_id", "dst"]).select("program_id", "src", F.col("to").alias("dst")).distinct()
        level = cut(level.join(known, ["program_id", "src", "dst"], "left_anti"))
        if level.isEmpty():
            return seen
        seen = seen.union(level.withColumn("distance", F.lit(distance)))
        if distance % COMPACT == 0:
            seen = cut(seen)


def shortest_paths(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(program_id, src, dst, path): one shortest path to each node reached, the first in order where several are; a start's own path is itself."""
    starts = cut(start.select("program_id", "src").distinct())

    def grouped(e: DataFrame) -> DataFrame:
        def walked(t: pa.Table, wanted: pa.Table) -> pa.Table:
            g = _Graph(t, _starts(wanted))
            src, dst, path = [], [], []
            for s in sorted(g.number[x] for x in _starts(wanted)):
                best, level = {s: (s,)}, {s: (s,)}
                while level:
                    onward: dict = {}
                    for a, p in level.items():
                        for b in g.after.get(a, ()):
                            if b not in best and (b not in onward or p + (b,) < onward[b]):
                                onward[b] = p + (b,)
                    best |= onward
                    level = onward
                src += [s] * len(best)
                dst += list(best)
                path += list(best.values())
            program = t if len(t) else wanted
            flat = pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(p) for p in path]), pa.int32()), g.said([x for p in path for x in p]))
            return pa.table([_program(program, len(src)), g.said(src), g.said(dst), flat], names=["program_id", "src", "dst", "path"])

        # Programs that no start is in, and starts without an edge, have a side that is empty.
        return e.groupBy("program_id").cogroup(_renewed(starts).groupBy("program_id")).applyInArrow(walked, "program_id string, src string, dst string, path array<string>")

    def stepwise(e: DataFrame) -> DataFrame:
        return _paths_stepwise(e, starts.join(e.select("program_id").distinct(), "program_id", "left_semi"))

    return _by_size(edges, grouped, stepwise).dropDuplicates(["program_id", "src", "dst"])


def _paths_stepwise(e: DataFrame, starts: DataFrame) -> DataFrame:
    e = cut(e)
    level = starts.withColumn("dst", F.col("src")).withColumn("path", F.array("src"))
    seen = level = cut(level)
    hop = e.select("program_id", F.col("src").alias("dst"), F.col("dst").alias("to"))
    for k in count(1):
        onward = level.join(hop, ["program_id", "dst"]).select("program_id", "src", F.col("to").alias("dst"), F.array_append("path", F.col("to")).alias("path"))
        onward = onward.groupBy("program_id", "src", "dst").agg(F.min("path").alias("path"))
        level = cut(onward.join(seen.select("program_id", "src", "dst"), ["program_id", "src", "dst"], "left_anti"))
        if level.isEmpty():
            return seen
        seen = seen.union(level)
        if k % COMPACT == 0:
            seen = cut(seen)


def depths(edges: DataFrame) -> DataFrame:
    """(program_id, node, depth): the longest path to each node from one without a source.

    Nodes on a cycle, and behind one, get the depth at which the program's number
    of nodes is used up; a node without sources has 0.
    """

    def grouped(e: DataFrame) -> DataFrame:
        def ranked(t: pa.Table) -> pa.Table:
            g = _Graph(t)
            n = len(g.names)
            waits, depth = np.zeros(n, np.int64), np.zeros(n, np.int32)
            for ends in g.after.values():
                for b in ends:
                    waits[b] += 1
            ready = np.flatnonzero(waits == 0).tolist()
            done = set(ready)
            while ready:
                a = ready.pop()
                for b in g.after.get(a, ()):
                    depth[b] = max(depth[b], depth[a] + 1)
                    waits[b] -= 1
                    if not waits[b]:
                        ready.append(b)
                        done.add(b)
            depth[[k for k in range(n) if k not in done]] = n - 1  # walks of any length end there
            return pa.table([_program(t, n), pa.array(g.names, pa.string()), pa.array(depth)], names=["program_id", "node", "depth"])

        return e.groupBy("program_id").applyInArrow(ranked, "program_id string, node string, depth int")

    return _by_size(edges.where("src != dst"), grouped, _depths_stepwise)


def _depths_stepwise(e: DataFrame) -> DataFrame:
    e = cut(e)
    nodes = e.select("program_id", F.col("src").alias("node")).union(e.select("program_id", F.col("dst").alias("node"))).distinct()
    limit = nodes.groupBy("program_id").agg(F.count("*").alias("limit"))
    level = cut(nodes.withColumn("depth", F.lit(0)))
    out = level
    hop = e.select("program_id", F.col("src").alias("node"), F.col("dst").alias("to"))
    for depth in count(1):  # the limit ends it
        level = level.join(hop, ["program_id", "node"]).select("program_id", F.col("to").alias("node")).distinct()
        level = cut(level.join(limit, "program_id").where(F.col("limit") > depth).select("program_id", "node", F.lit(depth).alias("depth")))
        if level.isEmpty():
            break
        out = out.union(level)
        if depth % 50 == 0:  # the plan of a long chain stays small
            out = cut(out.groupBy("program_id", "node").agg(F.max("depth").alias("depth")))
    return out.groupBy("program_id", "node").agg(F.max("depth").alias("depth"))


def components(edges: DataFrame) -> DataFrame:
    """(program_id, node, component): the smallest node connected with each, whatever the direction."""

    def grouped(e: DataFrame) -> DataFrame:
        def joined(t: pa.Table) -> pa.Table:
            g = _Graph(t)
            up = list(range(len(g.names)))

            def top(k: int) -> int:
                while up[k] != k:
                    up[k] = up[up[k]]
                    k = up[k]
                return k

            for a, ends in g.after.items():
                for b in ends:
                    x, y = sorted((top(a), top(b)))
                    up[y] = x  # numbers are in order of names
            return pa.table([_program(t, len(up)), pa.array(g.names, pa.string()), g.said([top(k) for k in range(len(up))])], names=["program_id", "node", "component"])

        return e.groupBy("program_id").applyInArrow(joined, "program_id string, node string, component string")

    return _by_size(edges, grouped, _components_stepwise)


def _components_stepwise(e: DataFrame) -> DataFrame:
    both = cut(e.union(reverse(e)).distinct())
    label = cut(both.select("program_id", F.col("src").alias("node")).distinct().withColumn("component", F.col("node")))
    for _ in range(MAX_LEVELS):
        near = both.join(label.select("program_id", F.col("node").alias("dst"), "component"), ["program_id", "dst"])
        least = near.groupBy("program_id", F.col("src").alias("node")).agg(F.min("component").alias("m"))
        now = label.join(least, ["program_id", "node"]).select("program_id", "node", F.least("component", "m").alias("component"), (F.col("m") < F.col("component")).alias("moved"))
        # A label follows its own label, which halves the way that is left.
        jump = now.select("program_id", F.col("node").alias("component"), F.col("component").alias("further"))
        now = cut(now.join(jump, ["program_id", "component"], "left").select("program_id", "node", F.least("component", F.coalesce("further", "component")).alias("component"), "moved"))
        label = now.drop("moved")
        if now.where("moved").isEmpty():
            return label
    raise RuntimeError(f"components: more than {MAX_LEVELS} rounds")


def on_cycles(edges: DataFrame) -> DataFrame:
    """(program_id, node) of nodes that reach themselves."""
    return reach(edges).where("src = dst").select("program_id", F.col("src").alias("node"))
