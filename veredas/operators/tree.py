"""Trees and prerequisite graphs: ancestors, interval labels, cycles, reachability.

Rounds grow with the logarithm of a tree's depth, by doubling: each round reads the table that the one before has written,
and removes it. Closures are made only by the operators that give them out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veredas.sources.shared import remove, written

SUMS = 4  # doublings of the second half that are one round
CELL = 1024  # numbers of nodes that meet scopes together


def ancestors(nodes: DataFrame) -> DataFrame:
    """(id, ancestor, depth) of every node, itself at depth 0, up to the root, or on a cycle until a node repeats.

    Ids are unique. A round doubles the depth that is known: of 2^k levels the first half is there, and the second is the first half of
    the ancestor at its end.
    """
    first = nodes.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("depth"))
    above = nodes.filter("parent is not null and parent <> id").select("id", F.col("parent").alias("ancestor"), F.lit(1).alias("depth"))
    known, reach = written(first.unionAll(above), "ancestors"), 1
    while not known.filter(F.col("depth") == reach).isEmpty():
        ends = known.filter(F.col("depth") == reach).select("id", F.col("ancestor").alias("at"))
        more = ends.join(known.filter("depth > 0").select(F.col("id").alias("at"), "ancestor", "depth"), "at").select("id", "ancestor", (F.col("depth") + reach).alias("depth"))
        every = written(known.unionAll(more).groupBy("id", "ancestor").agg(F.min("depth").alias("depth")), "ancestors")
        remove(known)
        known, reach = every, 2 * reach
    return known


def intervals(nodes: DataFrame) -> DataFrame:
    """(id, parent, type, root, depth, low, high): a node's number in preorder, and the last number below it, both within its tree.

    A node is below another if both have one root and its ``low`` lies between the other's ``low`` and ``high``. Nodes on a cycle or below
    one have no root and no numbers. A parent that isn't among the nodes is a root of its own, without a type. Rounds: twice the logarithm of the depth. A round
    of the first half adds to each node the sizes of the subtrees that hang 2^k levels below it, and jumps to its ancestor 2^k levels up; one of the
    second half adds up the numbers that come before it on its path.
    """
    absent = nodes.filter("parent is not null").select(F.col("parent").alias("id")).distinct().join(nodes.select("id"), "id", "left_anti")
    every = nodes.select("id", "parent", "type").unionByName(absent, allowMissingColumns=True)
    start = every.select("id", "parent", "type", F.col("parent").alias("jump"), F.lit(1).cast("long").alias("size"), F.coalesce("parent", "id").alias("root"), F.col("parent").isNotNull().cast("int").alias("depth"))
    at = written(start, "tree")
    longest, reach, jumps = at.count(), 1, []
    while not at.filter("jump is not null").isEmpty() and reach <= longest:
        jumps.append(at)
        above = at.select(F.col("id").alias("jump"), F.col("jump").alias("_jump"), F.col("root").alias("_root"), F.col("depth").alias("_depth"))
        below = at.filter("jump is not null").groupBy(F.col("jump").alias("id")).agg(F.sum("size").alias("_size"))
        met = at.join(above, "jump", "left").join(below, "id", "left")
        at = written(met.select(
            "id", "parent", "type", F.col("_jump").alias("jump"), (F.col("size") + F.coalesce("_size", F.lit(0))).alias("size"),
            F.coalesce("_root", "root").alias("root"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"),
        ), "tree")
        reach *= 2
    endless = F.col("jump").isNotNull()
    before = F.coalesce(F.sum("size").over(Window.partitionBy("parent").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1
    inner = at.filter(~endless & F.col("parent").isNotNull()).select("id", before.alias("low"))
    low = written(inner.unionAll(at.filter("parent is null").select("id", F.lit(0).cast("long").alias("low"))), "numbers")
    for i in range(0, len(jumps), SUMS):
        step = low
        for table in jumps[i : i + SUMS]:
            above = table.filter("jump is not null").select("id", "jump").join(step.select(F.col("id").alias("jump"), F.col("low").alias("_low")), "jump")
            step = step.join(above.select("id", "_low"), "id", "left").select("id", (F.col("low") + F.coalesce("_low", F.lit(0))).alias("low"))
        step = written(step, "numbers")
        remove(low)
        low = step
    known = at.join(low, "id", "left")
    found = known.select("id", "parent", "type", *[F.when(~endless, c).alias(n) for n, c in (("root", F.col("root")), ("depth", F.col("depth")), ("low", F.col("low")), ("high", F.col("low") + F.col("size") - 1))])
    found = written(found, "intervals")
    for table in (*jumps, *([] if at in jumps else [at]), low):
        remove(table)
    return found


def within(tree: DataFrame, scopes: DataFrame) -> DataFrame:
    """(scope, id) of all nodes that are a scope or below it, by range comparison; ``tree`` is from ``intervals``.

    Numbers are cut into cells: a scope stands in each cell that its interval touches, so a node meets only the scopes of its cell.
    """
    asked = scopes.select(F.col("id").alias("scope")).distinct().join(tree.select(F.col("id").alias("scope"), F.col("root").alias("of"), F.col("low").alias("first"), F.col("high").alias("last")), "scope")
    cells = asked.filter("of is not null").withColumn("cell", F.explode(F.expr(f"sequence(first div {CELL}, last div {CELL})")))
    own = tree.filter("root is not null").select("id", "root", "low", F.expr(f"low div {CELL}").alias("cell"))
    met = own.join(cells, (own["root"] == cells["of"]) & (own["cell"] == cells["cell"]) & F.col("low").between(F.col("first"), F.col("last"))).select("scope", "id")
    endless = tree.filter("root is null").select("id", "parent", "type")
    if endless.isEmpty():
        return met
    on_cycles = ancestors(endless).join(asked.filter("of is null").select(F.col("scope").alias("ancestor")), "ancestor")
    return met.unionAll(on_cycles.select(F.col("ancestor").alias("scope"), "id"))


def reachable(edges: DataFrame, source: str, target: str) -> DataFrame:
    """(source, target, depth): all pairs along edges, with the shortest depth; ends on cycles too.

    A round doubles the length of the paths known, so rounds grow with the logarithm of the longest.
    """
    known = written(edges.select(source, target).distinct().withColumn("depth", F.lit(1)), "closure")
    n = known.count()
    while True:
        a, b = known.alias("a"), known.alias("b")
        longer = a.join(b, F.col(f"a.{target}") == F.col(f"b.{source}")).select(f"a.{source}", f"b.{target}", (F.col("a.depth") + F.col("b.depth")).alias("depth"))
        every = written(known.unionAll(longer).groupBy(source, target).agg(F.min("depth").alias("depth")), "closure")
        remove(known)
        known, now = every, every.count()
        if now == n:
            return known
        n = now


PEELS = 4  # layers of a round


def peeled(edges: DataFrame, source: str, target: str) -> DataFrame:
    """The edges that are left when those of nodes without an edge in, or without one out, are taken away until there are none such.

    They hold every cycle and what lies between cycles; a graph without a cycle has none left. A round takes ``PEELS`` layers from each end.
    """
    left = written(edges.select(source, target).distinct(), "peeled")
    n = left.count()
    while n:
        rest = left
        for _ in range(PEELS):
            rest = rest.join(rest.select(F.col(target).alias(source)).distinct(), source, "left_semi")
            rest = rest.join(rest.select(F.col(source).alias(target)).distinct(), target, "left_semi")
        rest = written(rest.select(source, target), "peeled")
        now = rest.count()
        remove(left)
        left = rest
        if now == n:
            break
        n = now
    return left


def on_cycles(edges: DataFrame, source: str, target: str) -> DataFrame:
    """The nodes that lie on a cycle, as ``node``. Paths are followed only among the edges that peeling leaves."""
    left = peeled(edges, source, target)
    return reachable(left, source, target).filter(F.col(source) == F.col(target)).select(F.col(source).alias("node"))


def levels(edges: DataFrame, source: str, target: str) -> DataFrame:
    """(node, level, least): how many edges the longest path from a node has, and the least label that it reaches, its own included.

    A label is a fixed hash. If a node reaches another, its level is greater and its least label isn't greater: so most questions of
    reachability are answered without a search. Nodes that reach a cycle have neither. Rounds: one a level, over the edges into
    the nodes that the round before has settled.
    """
    rows = written(edges.select(F.col(source).alias("s"), F.col(target).alias("t")).distinct(), "edges")
    state = written(rows.groupBy(F.col("s").alias("node")).agg(F.count(F.lit(1)).alias("open")).withColumns({"level": F.lit(0), "least": F.xxhash64("node")}), "state")
    ends = rows.select(F.col("t").alias("node")).distinct().join(state, "node", "left_anti")
    settled = [written(ends.withColumns({"level": F.lit(0), "least": F.xxhash64("node")}), "settled")]
    while not settled[-1].isEmpty():
        met = rows.join(settled[-1].withColumnRenamed("node", "t"), "t").groupBy(F.col("s").alias("node"))
        met = met.agg(F.count(F.lit(1)).alias("_n"), (F.max("level") + 1).alias("_level"), F.min("least").alias("_least"))
        step = state.filter("open > 0").join(met, "node", "left").select(
            "node", (F.col("open") - F.coalesce("_n", F.lit(0))).alias("open"), F.greatest("level", "_level").alias("level"), F.least("least", "_least").alias("least")
        )
        step = written(step, "state")
        remove(state)
        state = step
        settled.append(written(state.filter("open = 0").drop("open"), "settled"))
    every = settled[0]
    for part in settled[1:]:
        every = every.unionAll(part)
    found = written(every, "levels")
    for table in (rows, state, *settled):
        remove(table)
    return found


def reaches(questions: DataFrame, edges: DataFrame, source: str, target: str) -> DataFrame:
    """The pairs (a, b) of the questions where b can be reached from a by one edge or more.

    Levels and labels refuse most of them; of the others all paths are followed at once, edge by edge, each node once a question,
    and only nodes that may still reach their b.
    """
    of = levels(edges, source, target)
    rows = written(edges.select(F.col(source).alias("at"), F.col(target).alias("next")).distinct(), "edges")
    at, goal = of.select(F.col("node").alias("at"), "level", "least"), of.select(F.col("node").alias("b"), F.col("level").alias("b_level"), F.col("least").alias("b_least"))
    open_ = F.col("level").isNull() | ((F.col("level") >= F.col("b_level")) & (F.col("least") <= F.col("b_least")))

    def may(df: DataFrame) -> DataFrame:
        return df.join(at, "at", "left").filter(open_).drop("level", "least")

    asked = questions.select("a", "b").distinct().join(goal, "b", "left")
    front = written(may(asked.withColumn("at", F.col("a"))).select("a", "b", "b_level", "b_least", "at"), "front")
    seen, found = None, front.select("a", "b").limit(0)
    old: list[DataFrame] = []
    while not front.isEmpty():
        step = may(front.join(rows, "at").drop("at").withColumnRenamed("next", "at").distinct())
        step = step if seen is None else step.join(seen, ["a", "b", "at"], "left_anti")
        new = written(step.select("a", "b", "b_level", "b_least", "at"), "front")
        met = new.filter("at = b").select("a", "b")
        every = written(new.select("a", "b", "at") if seen is None else seen.unionAll(new.select("a", "b", "at")), "seen")
        found = written(found.unionAll(met).distinct(), "found")
        after = written(new.join(found, ["a", "b"], "left_anti"), "front")
        old += [front, new, found] + ([] if seen is None else [seen])
        front, seen = after, every
    for table in (of, rows, front, *[t for t in old if t is not found], *([] if seen is None else [seen])):
        remove(table)
    return found


def path_by_type(nodes: DataFrame, types: tuple[str, ...], topmost: bool = False) -> DataFrame:
    """One row a node: the id of its nearest (or topmost) ancestor of each type, itself included."""
    closure = ancestors(nodes).join(nodes.select(F.col("id").alias("ancestor"), "type"), "ancestor")
    pick = F.max_by if topmost else F.min_by
    return closure.groupBy("id").agg(*[pick("ancestor", F.when(F.col("type") == t, F.col("depth"))).alias(t.lower()) for t in types])


def expand(nodes: DataFrame, scopes: DataFrame) -> DataFrame:
    """Distinct nodes of the scopes (id, descendants): the node, and all below it where that is asked for."""
    below = within(intervals(nodes), scopes.filter("descendants"))
    met = below.join(nodes.select("id"), "id", "left_semi").select("id")
    return met.unionAll(nodes.join(scopes.select("id"), "id", "left_semi").select("id")).distinct()
