"""Tree and graph operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from veredas.operators import tree as G
from veredas.plans import tables as T
from veredas.plans.registry import query

CLOSURE = """WITH RECURSIVE up(id, ancestor, depth) AS (SELECT id, id, 0 FROM nodes UNION ALL SELECT up.id, n.parent, depth + 1 FROM up JOIN nodes n ON n.id = up.ancestor WHERE n.parent IS NOT NULL),
t AS (SELECT up.id, up.ancestor, up.depth, n.type FROM up JOIN nodes n ON n.id = up.ancestor)"""
REACH = "WITH RECURSIVE r(content, needs) AS (SELECT content, needs FROM edges WHERE content <> needs UNION SELECT r.content, e.needs FROM r JOIN edges e ON e.content = r.needs WHERE e.content <> e.needs)"


@query("tree_path_up", CLOSURE + " SELECT id, arg_min(ancestor, depth) FILTER (type = 'DISCIPLINE') AS discipline, arg_min(ancestor, depth) FILTER (type = 'AREA') AS area, arg_min(ancestor, depth) FILTER (type = 'CONTENT') AS content, arg_min(ancestor, depth) FILTER (type = 'SUBCONTENT') AS subcontent FROM t GROUP BY 1")
def tree_path_up(spark, d):
    return G.path_by_type(T.nodes(spark, d), ("DISCIPLINE", "AREA", "CONTENT", "SUBCONTENT"))


@query("tree_codes_under", CLOSURE + " SELECT a.id AS root, x.id FROM nodes a JOIN t x ON x.ancestor = a.id JOIN nodes n ON n.id = x.id WHERE a.type IN ('DISCIPLINE', 'AREA') AND n.type IN ('CONTENT', 'SUBCONTENT')")
def tree_codes_under(spark, d):
    """The contents below each discipline and area; a node with none below stands for itself."""
    nodes = T.nodes(spark, d)
    below = G.within(G.intervals(nodes), nodes.filter("type in ('DISCIPLINE', 'AREA')").select("id"))
    return below.join(nodes.filter("type in ('CONTENT', 'SUBCONTENT')").select("id"), "id", "left_semi").select(F.col("scope").alias("root"), "id")


@query("tree_contains_nodes", CLOSURE + " SELECT DISTINCT id FROM t WHERE ancestor = 'R1' OR (ancestor IN ('S7', 'N3') AND depth = 0)")
def tree_contains_nodes(spark, d):
    scopes = spark.createDataFrame([("R1", True), ("S7", False), ("N3", False)], "id string, descendants boolean")
    return G.expand(T.nodes(spark, d), scopes)


@query("tree_expand_scope", CLOSURE + " SELECT DISTINCT id FROM t WHERE ancestor IN ('N4', 'N5', 'S2')")
def tree_expand_scope(spark, d):
    return G.expand(T.nodes(spark, d), spark.createDataFrame([(x, True) for x in ("N4", "N5", "S2")], "id string, descendants boolean"))


@query("tree_ancestry_area", CLOSURE + " SELECT id, arg_max(ancestor, depth) FILTER (type = 'AREA') AS area, arg_max(ancestor, depth) AS root FROM t GROUP BY 1")
def tree_ancestry_area(spark, d):
    """The topmost area above a node, and its root."""
    nodes = T.nodes(spark, d)
    roots = G.ancestors(nodes).groupBy("id").agg(F.max_by("ancestor", "depth").alias("root"))
    return G.path_by_type(nodes, ("AREA",), topmost=True).join(roots, "id")


@query("tree_list_levels", "SELECT parent, count(*) AS children, min(name) AS first FROM nodes GROUP BY 1")
def tree_list_levels(spark, d):
    return T.nodes(spark, d).groupBy("parent").agg(F.count(F.lit(1)).alias("children"), F.min("name").alias("first"))


@query("dag_cycle", "WITH RECURSIVE w AS (SELECT content, needs FROM edges WHERE content <> needs UNION SELECT 'S' || (s_suppkey // 4), 'S' || s_suppkey FROM supplier WHERE s_suppkey >= 4 AND s_suppkey % 4 = 3), r(content, needs) AS (SELECT * FROM w UNION SELECT r.content, w.needs FROM r JOIN w ON w.content = r.needs) SELECT content AS node FROM r WHERE content = needs")
def dag_cycle(spark, d):
    """Nodes on a cycle: some contents are also needed by the one two levels up that they need themselves."""
    back = T.read(spark, d, "supplier").filter("s_suppkey >= 4 and s_suppkey % 4 = 3").selectExpr("concat('S', s_suppkey div 4) as content", "concat('S', s_suppkey) as needs")
    return G.on_cycles(T.edges(spark, d).filter("content <> needs").unionAll(back), "content", "needs")


@query("dag_transitive", REACH + " SELECT content, needs FROM r")
def dag_transitive(spark, d):
    return G.reachable(T.edges(spark, d).filter("content <> needs"), "content", "needs").select("content", "needs")


@query("tree_ancestors_list", CLOSURE + " SELECT id, string_agg(ancestor, '/' ORDER BY depth DESC) AS path FROM t GROUP BY 1")
def tree_ancestors_list(spark, d):
    steps = F.sort_array(F.collect_list(F.struct("depth", "ancestor")), asc=False)
    return G.ancestors(T.nodes(spark, d)).groupBy("id").agg(F.array_join(F.transform(steps, lambda x: x["ancestor"]), "/").alias("path"))


@query("dag_would_cycle", REACH + ", n AS (SELECT 'S' || (s_suppkey // 4) AS a, 'S' || s_suppkey AS b FROM supplier WHERE s_suppkey > 0) SELECT a, b, a = b OR EXISTS (SELECT 1 FROM r WHERE r.content = n.b AND r.needs = n.a) AS cycle FROM n")
def dag_would_cycle(spark, d):
    """Whether a new edge a -> b would close a cycle: b already needs a."""
    new = T.read(spark, d, "supplier").filter("s_suppkey > 0").selectExpr("concat('S', s_suppkey div 4) as a", "concat('S', s_suppkey) as b")
    back = G.reaches(new.selectExpr("b as a", "a as b"), T.edges(spark, d).filter("content <> needs"), "content", "needs").selectExpr("b as a", "a as b", "true as back")
    return new.join(back, ["a", "b"], "left").select("a", "b", ((F.col("a") == F.col("b")) | F.col("back").isNotNull()).alias("cycle"))


@query("dag_blockers", """WITH m AS (SELECT DISTINCT 'S' || student_id AS id FROM mastery WHERE score >= 60)
SELECT content, coalesce(string_agg(needs, ',' ORDER BY needs) FILTER (needs NOT IN (SELECT id FROM m)), '') AS unsatisfied FROM edges GROUP BY 1""")
def dag_blockers(spark, d):
    done = T.mastery(spark, d).filter("score >= 60").select(F.expr("concat('S', student_id)").alias("needs")).distinct().withColumn("done", F.lit(True))
    open_ = F.when(F.col("done").isNull(), F.col("needs"))
    return T.edges(spark, d).join(done, "needs", "left").groupBy("content").agg(F.array_join(F.array_sort(F.collect_list(open_)), ",").alias("unsatisfied"))


@query("dag_candidates", REACH + ", o AS (SELECT DISTINCT 'S' || student_id AS id FROM mastery WHERE score < 30) SELECT DISTINCT id FROM (SELECT id FROM o UNION SELECT needs FROM r JOIN o ON r.content = o.id UNION SELECT 'S5') WHERE id IN (SELECT id FROM nodes)")
def dag_candidates(spark, d):
    seen = T.mastery(spark, d).filter("score < 30").select(F.expr("concat('S', student_id)").alias("id")).distinct()
    closure = G.reachable(T.edges(spark, d).filter("content <> needs"), "content", "needs")
    needed = closure.join(seen, F.col("content") == F.col("id"), "left_semi").select(F.col("needs").alias("id"))
    every = seen.union(needed).union(spark.createDataFrame([("S5",)], "id string")).distinct()
    return every.join(T.nodes(spark, d).select("id"), "id", "left_semi")
