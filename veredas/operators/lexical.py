"""Lexical classification: a question's catalogue nodes by the words of their names and descriptions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veredas.functions.text import plain
from veredas.operators.tree import ancestors
from veredas.sources.shared import written

# Points, and words too general to place a question by themselves.
LABEL, DESCRIPTION, SPECIFIC, GENERIC, UPPER, EARLY = 20, 10, 100, 40, 2, 10
GENERAL_TERMS = ("quimica", "celular", "funcao")
TYPES = ("DISCIPLINE", "AREA", "CONTENT", "SUBCONTENT")
MOST_BROADCAST = 200_000  # pairs of term and node


def stem(term: Column) -> Column:
    """Without its plural ending."""
    n = F.length(term)
    return F.when(F.endswith(term, F.lit("oes")), F.concat(F.substring(term, F.lit(1), n - 3), F.lit("ao"))).when(F.endswith(term, F.lit("es")), F.substring(term, F.lit(1), n - 2)).when(F.endswith(term, F.lit("s")), F.substring(term, F.lit(1), n - 1)).otherwise(term)


def terms(text: Column, least: int = 3) -> Column:
    """Plain words of ``least`` letters or more without plural endings, in the order of the text, with repeats."""
    form = plain(F.coalesce(text, F.lit("")))
    ascii_only = F.when(F.octet_length(form) == F.char_length(form), F.lower(form)).otherwise(F.regexp_replace(F.lower(form), r"[^\x00-\x7F]+", ""))
    return F.transform(F.regexp_extract_all(ascii_only, F.lit(f"[a-z0-9]{{{least},}}"), F.lit(0)), stem)


def vocabulary(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, term, label, description) of the terms that tell a node from those above it, and (id, type, depth, path)."""
    above = ancestors(nodes)
    own = nodes.select("id", "type", terms(F.col("name")).alias("label"), terms(F.col("description")).alias("about"))
    held = above.filter("depth > 0").join(own.select(F.col("id").alias("ancestor"), F.concat("label", "about").alias("terms")), "ancestor")
    held = held.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("held"))  # a path's terms
    none = F.array().cast("array<string>")
    told = own.join(held, "id", "left").select("id", *[F.array_except(F.array_distinct(c), F.coalesce("held", none)).alias(c) for c in ("label", "about")])
    rows = told.select("id", F.explode("label").alias("term"), F.lit(1).alias("label"), F.lit(0).alias("description")).unionAll(told.select("id", F.explode("about").alias("term"), F.lit(0), F.lit(1)))
    types = above.join(nodes.select(F.col("id").alias("ancestor"), "type"), "ancestor").groupBy("id")
    paths = types.agg(F.count_distinct("type").alias("depth"), *[F.min_by("ancestor", F.when(F.col("type") == t, F.col("depth"))).alias(t.lower()) for t in TYPES])
    return rows.groupBy("id", "term").agg(F.max("label").alias("label"), F.max("description").alias("description")), nodes.select("id", "type").join(paths, "id")


PARTS = ("specificity", "lexical", "position", "penalty")


def _used(texts: DataFrame, text: str) -> DataFrame:
    """text, term, at: each distinct text's terms, and the first place of each."""
    return texts.select(text).distinct().select(text, F.posexplode(terms(F.col(text))).alias("at", "term")).groupBy(text, "term").agg(F.min("at").alias("at"))


def _scored(met: DataFrame, text: str, by: str, of: DataFrame, general: Sequence[str]) -> DataFrame:
    """Scores, with their parts, of what has met: rows (text, by, term, at, label, description); ``of`` has by, leaf, depth."""
    sums = met.groupBy(text, by).agg(
        F.sum("label").alias("labels"), F.sum("description").alias("descriptions"), F.min("at").alias("first"), F.min(F.col("term").isin(*general)).alias("general"),
    )
    parts = {
        "specificity": F.when(F.col("leaf"), SPECIFIC).otherwise(0), "lexical": F.col("labels") * LABEL + F.col("descriptions") * DESCRIPTION + F.col("depth"),
        "position": F.greatest(F.lit(0), EARLY - F.col("first")), "penalty": F.when(F.col("leaf"), 0).otherwise(UPPER + F.when(F.col("general"), GENERIC).otherwise(0)),
    }
    return sums.join(of, by).withColumns(parts).withColumn("score", F.expr("specificity + lexical + position - penalty")).filter("score > 0")


def classes(nodes: DataFrame, best: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """An index of what nodes score by: postings (term, class, label, description), classes (class, leaf, depth, nodes, path), and members (class, id, path).

    Nodes of the same terms, type and depth score the same in every text: they are one class. A class keeps its number of nodes, its first path,
    and its first ``best`` nodes by path, as no more of it can be among the best.
    """
    known, places = vocabulary(nodes)
    own = known.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("term", "label", "description"))).alias("terms"))  # a node's few terms
    path = F.struct(*[F.col(t.lower()) for t in TYPES])
    signed = own.join(places, "id").select("id", (F.col("type") == "SUBCONTENT").alias("leaf"), "depth", "terms", path.alias("path"))
    signed = written(signed.withColumn("class", F.xxhash64("leaf", "depth", "terms")), "classes")
    every = signed.groupBy("class", "leaf", "depth").agg(F.count(F.lit(1)).alias("nodes"), F.min("path").alias("path"))
    postings = signed.groupBy("class").agg(F.first("terms").alias("terms")).select("class", F.explode("terms").alias("t")).select("t.term", "class", "t.label", "t.description")
    members = signed.withColumn("_i", F.row_number().over(Window.partitionBy("class").orderBy("path"))).filter(F.col("_i") <= best).select("class", "id", "path")
    return postings, every, members


def promising(used: DataFrame, text: str, postings: DataFrame, of: DataFrame, best: int, general: Sequence[str] = GENERAL_TERMS) -> DataFrame:
    """(text, class) pairs that hold all of a text's ``best`` nodes: those of its telling terms.

    A term has an upper bound, the most that it gives any class. The classes of a text's rarest term are scored first; when they have ``best``
    nodes, the lowest of these is a threshold, and the most frequent terms, as long as all of them together with everything
    else that a class can get stay below it, bring in no class of their own.
    """
    bounds = postings.groupBy("term").agg(F.count(F.lit(1)).alias("held"), F.max(F.col("label") * LABEL + F.col("description") * DESCRIPTION).alias("most"))
    rest = of.agg((F.max(F.when(F.col("leaf"), SPECIFIC).otherwise(0) + F.col("depth")) + EARLY).alias("rest"))  # one row
    frequent = Window.partitionBy(text).orderBy(F.desc("held"), "term")
    ranked = used.join(bounds, "term").withColumns({
        "bound": F.sum("most").over(frequent.rowsBetween(Window.unboundedPreceding, 0)), "rarest": F.row_number().over(Window.partitionBy(text).orderBy("held", F.desc("term"))) == 1,
    })
    seeds = ranked.filter("rarest").join(postings.select("term", "class"), "term").select(text, "class")
    first = _scored(matches(seeds, used, text, postings), text, "class", of, general)
    upto = F.sum("nodes").over(Window.partitionBy(text).orderBy(F.desc("score"), "class").rowsBetween(Window.unboundedPreceding, 0))
    threshold = first.withColumn("_upto", upto).filter(F.col("_upto") >= best).groupBy(text).agg(F.max("score").alias("threshold"))
    telling = ranked.join(threshold, text, "left").crossJoin(F.broadcast(rest)).filter(F.col("threshold").isNull() | (F.col("bound") + F.col("rest") >= F.col("threshold")))
    return telling.join(postings.select("term", "class"), "term").select(text, "class").distinct()


def matches(pairs: DataFrame, used: DataFrame, text: str, postings: DataFrame) -> DataFrame:
    """The terms that the pairs (text, class) have in common: text, class, term, at, label, description."""
    return pairs.join(postings, "class").join(used, [text, "term"])


def _best(texts: DataFrame, text: str, nodes: DataFrame, best: int, general: Sequence[str], most_broadcast: int) -> DataFrame:
    postings, of, members = classes(nodes, best)
    postings, of = written(postings, "postings"), written(of, "class-sizes")
    if postings.count() <= most_broadcast:
        postings, of = F.broadcast(postings), F.broadcast(of)
    used = _used(texts, text)
    met = matches(promising(used, text, postings, of, best, general), used, text, postings)
    scored = _scored(met, text, "class", of, general)
    order = Window.partitionBy(text).orderBy(F.desc("score"), "path")
    top = scored.withColumn("_i", F.row_number().over(order)).filter(F.col("_i") <= best).select(text, "class", "score", *PARTS)
    ranked = top.join(members, "class").withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= best)


def candidates(texts: DataFrame, text: str, nodes: DataFrame, best: int | None = None, general: Sequence[str] = GENERAL_TERMS, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """text, id, score, its parts, and rank (from 1): for each distinct text the nodes of positive score, or the ``best`` of them.

    ``nodes`` has id, parent, type, name, description. A node scores 100 if it is a subcontent, 20 for each telling
    term of its name in the text, 10 for each of its description, its depth, and up to 10 for an early match; less 40 if
    it is none and only general terms match, and less 2 if it is none. Ties go by path. The catalogue's terms are
    broadcast after they are counted; texts meet them term by term, never node by node. Where only the best are asked for, nodes that
    score alike are scored once, and terms that can't reach the best bring in none.
    """
    if best:
        ranked = _best(texts, text, nodes, best, general, most_broadcast)
    else:
        known, places = vocabulary(nodes)
        if known.count() <= most_broadcast:
            known, places = F.broadcast(known), F.broadcast(places)
        places = places.withColumn("leaf", F.col("type") == "SUBCONTENT")
        scored = _scored(_used(texts, text).join(known, "term"), text, "id", places, general)
        ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy(text).orderBy(F.desc("score"), *[F.col(t.lower()).asc_nulls_first() for t in TYPES])))
    return ranked.select(text, "id", *[F.col(c).cast("long").alias(c) for c in ("score", *PARTS)], "rank")
