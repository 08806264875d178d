"""Links between the members of colliding groups, and connected components, at bounded cost for hot groups.

A group (a band, a shared token) of k near copies has k^2 links, but its classes need far fewer: members are first
compared with one pivot of their group, and what that joins is one class. Only pairs whose members are still in different
classes are then compared one by one. So every link between different classes is looked at, and none within one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.common import in_files
from gaugeline.session import durable

ROUNDS = 2
FILE_ROWS = 100_000        # rows of nodes, edges or members that a written file holds


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of every node of `edges` (a, b): comp is the smallest node reachable. Each turn hangs larger
    neighbours on the smallest one (first around every node, then below it) until no edge moves; the edges of each turn
    are written, so a lost executor costs one turn. Hubs are reduced to their minimum before the shuffle."""
    e = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not now[0] or tuple(now) == state:
            break
        state = tuple(now)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e = durable(in_files(small.where("u <> v").distinct(), 2 * now[0], FILE_ROWS), "edges")
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def link(members: DataFrame, verify: Callable[[DataFrame], DataFrame], may_link: Callable[[str, str], str], rest: DataFrame | None = None) -> DataFrame:
    """(node, comp) of all nodes that have a link.

    members: written table of (key, node, n, rank, lead, far): `lead` marks those that may be the smaller side of a pair
    met here, `far` is smallest in the middle of a family, where pivots are taken. verify: (a, b) -> those pairs that link. may_link(x, y): SQL condition under which rows x (smaller) and y of
    one key can link and meet here first. rest: groups for the last turn, if others than `members` (every link must
    have its two nodes together in one of them)."""
    comp, size = None, members.count()
    for turn in range(ROUNDS + 1):
        m = members if rest is None or turn < ROUNDS else rest
        total = size if m is members else rest.count()
        if comp is None:
            m = m.withColumn("comp", F.col("node"))
        else:
            m = m.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        open_ = m.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.max("lead").alias("lead")).where("c0 <> c1 and lead").select("key")
        m = durable(in_files(m.join(open_, "key", "left_semi"), total, FILE_ROWS), "open")
        if m.isEmpty():                            # every group lies within one class
            if rest is None or turn == ROUNDS:
                break
            continue
        before = F.expr("x.n < y.n or (x.n = y.n and x.node < y.node)")
        if turn < ROUNDS:
            middle = F.struct("far", F.xxhash64("node"), "node")
            lead = m.where("lead")
            if turn:                               # another class than that of the first pivot
                seen = lead.groupBy("key").agg(F.min_by("comp", middle).alias("had"))
                lead = lead.join(seen, "key").where("comp <> had")
            pivot = lead.groupBy("key").agg(F.min_by(F.struct("node", "n", "rank", "comp"), middle).alias("p"))
            pairs = m.alias("y").join(pivot.alias("q"), "key").select("key", F.struct("y.*").alias("y"), F.col("q.p").alias("x")).where("x.comp <> y.comp")
            ordered = pairs.where(f"if(x.n < y.n or (x.n = y.n and x.node < y.node), {may_link('x', 'y')}, {may_link('y', 'x')})")
            pairs = ordered.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
        else:
            pairs = m.where("lead").alias("x").join(m.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.comp") != F.col("y.comp")) & before & F.expr(may_link("x", "y")))
            pairs = pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
        new = durable(verify(pairs.distinct()), "links")
        if comp is None:
            comp = durable(in_files(components(new), size, FILE_ROWS), "components")
        elif not new.isEmpty():                    # what is joined already enters as a star, so few turns are left
            comp = durable(in_files(components(new.unionByName(comp.select(F.col("node").alias("a"), F.col("comp").alias("b")))), size, FILE_ROWS), "components")
    return comp if comp is not None else members.select("node", F.col("node").alias("comp")).limit(0)
