"""Authors' material as sections and exercises: headings of seasons, episodes, chapters and subsections, numbered items, options.

As in ``extraction``, a heading is marked in the text with control characters and the text is split there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns and limits of headings, items and options.
SEASON = r"(?iuU)TEMPORADA\s+(\d+)\s*[:\-–]\s*([^\n\f]{2,120})"
HEADING = r"(?iuU)(?:EPISÓDIO\s+(\d+)|Cap[íi]tulo\s+(\d+))\s*[–\-:]?\s*"
SUBSECTION = r"(?U)(?<![\d.])(\d{1,2}\.\d{1,2})\s+(?=[A-ZÀ-Úa-zà-ú])"
ITEM = r"(?U)(?:^|(?<=\.))\s*(\d{1,3})\s*[.)]\s*(?=[A-ZÀ-Ú(])"
ITEM_START = r"(?U)^\s*\d{1,3}\s*[.)]\s"
OPTION = r"(?U)\b([a-eA-E])\)\s*"
SENTENCE_END = r"(?dU)[.?!:]\s|$"
TITLE_LEAST, TITLE_MOST, TITLE_WINDOW, SUBTITLE_WINDOW, LEAD_LEAST, ITEM_LEAST = 3, 140, 200, 160, 20, 15
WHOLE_SETS = (0, 4, 5)


def _single(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def _title(text: Column, window: int) -> Column:
    """Up to the end of the first sentence, if that isn't too near, and TITLE_MOST characters at most."""
    bare = F.regexp_replace(F.substring(text, 1, window), r"\A[ \t–\-:]+|[ \t–\-:]+\z", "")
    end = F.regexp_instr(bare, F.lit(SENTENCE_END)) - 1
    return _single(F.substring(bare, F.lit(1), F.when((end > TITLE_LEAST) & (end < TITLE_MOST), end).otherwise(TITLE_MOST)))


def season(text: Column) -> Column:
    """struct(number, title) of the season's heading among the first 2000 characters, where such headings stand; null without one."""
    head = F.substring(text, 1, 2000)
    number = F.nullif(F.regexp_extract(head, SEASON, 1), F.lit(""))
    return F.when(number.isNotNull(), F.struct(number.cast("int").alias("number"), _single(F.regexp_extract(head, SEASON, 2)).alias("title")))


def content_lines(body: Column) -> Column:
    """The body's text, a line for each subsection's title (after ``## ``) and for what follows it. A title ends where the next subsection starts."""
    parts = F.split(F.regexp_replace(body, SUBSECTION, "\x01$1\x02"), "\x01")

    def lines(part: Column, at: Column) -> Column:
        rest = F.substring(part, F.instr(part, "\x02") + 1, F.length(part))
        title = _title(rest, SUBTITLE_WINDOW)
        marked = F.array(F.concat(F.lit("## "), F.substring_index(part, "\x02", 1), F.lit(" "), title), _single(F.substring(rest, F.length(title) + 1, F.length(rest))))
        return F.when(at == 0, F.array(_single(part))).otherwise(marked)

    return F.filter(F.flatten(F.transform(parts, lines)), lambda x: x != "")


def sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, position, kind, number, title, body, lines: a row for each episode or chapter, and one for an introduction before them.

    A text without such headings is one section, named after its season. A title is what follows the heading, unless
    an exercise does. A null text has no sections.
    """
    clean = F.translate(F.col(text), "\x01\x02\x03", "")
    marked = docs.filter(F.col(text).isNotNull()).select(key, clean.alias("_text"), F.split(F.regexp_replace(clean, HEADING, "\x01$1\x02$2\x03"), "\x01").alias("_parts"))
    cut = marked.select(key, season(F.col("_text"))["title"].alias("_season"), F.size("_parts").alias("_n"), F.posexplode("_parts").alias("_at", "_part"))
    head, after = F.substring_index("_part", "\x03", 1), F.substring(F.col("_part"), F.instr("_part", "\x03") + 1, F.length("_part"))
    lead, only = F.col("_at") == 0, F.col("_n") == 1
    cut = cut.withColumns({"_episode": F.substring_index(head, "\x02", 1), "_chapter": F.substring_index(head, "\x02", -1), "_after": F.when(lead, _strip(F.regexp_replace("_part", SEASON, ""))).otherwise(after)})
    cut = cut.filter(~lead | only | (F.length("_after") > LEAD_LEAST))
    named = cut.withColumn("_title", F.when(lead, F.when(only, F.col("_season")).otherwise("Introdução")).when(F.substring(F.col("_after"), 1, TITLE_WINDOW).rlike(ITEM_START), "").otherwise(_title(F.col("_after"), TITLE_WINDOW)))
    kind = F.when(lead, "SECTION").when(F.col("_episode") != "", "EPISODE").otherwise("CHAPTER")
    number = F.when(~lead, F.when(F.col("_episode") != "", F.col("_episode")).otherwise(F.col("_chapter")))
    body = F.when(lead, F.col("_after")).otherwise(F.substring(F.col("_after"), F.length("_title") + 1, F.length("_after")))
    told = named.select(key, F.col("_at").alias("position"), kind.alias("kind"), number.alias("number"), "_title", body.alias("body"))
    title = F.when((F.col("_title") == "") & F.col("number").isNotNull(), F.concat(F.initcap("kind"), F.lit(" "), "number")).otherwise(F.col("_title"))
    return told.select(key, "position", "kind", "number", title.alias("title"), "body", content_lines(F.col("body")).alias("lines"))


def exercises(df: DataFrame, keys: list[str], body: str) -> DataFrame:
    """keys, at, number, statement, options, requires_review: the numbered items of ``body``.

    Options are marks a) to e) in the text of an item, if they come in order without a gap and none is empty; else the
    item is all statement. Items of fewer than ITEM_LEAST characters, or without a statement, are dropped.
    """
    one = F.regexp_replace(F.translate(F.col(body), "\x01\x02", ""), r"(?U)\s+", " ")
    parts = F.split(F.regexp_replace(one, ITEM, "\x01$1\x02"), "\x01")
    rows = df.select(*keys, F.posexplode(F.slice(parts, F.lit(2), F.greatest(F.lit(0), F.size(parts) - 1))).alias("at", "_part"))
    rows = rows.select(*keys, "at", F.substring_index("_part", "\x02", 1).cast("int").alias("number"), _strip(F.substring(F.col("_part"), F.instr("_part", "\x02") + 1, F.length("_part"))).alias("_body"))
    rows = rows.filter(F.length("_body") >= ITEM_LEAST).withColumn("_cut", F.split(F.regexp_replace("_body", OPTION, "\x01$1\x02"), "\x01"))
    marks = F.slice("_cut", F.lit(2), F.greatest(F.lit(0), F.size("_cut") - 1))
    rows = rows.withColumn("_marks", F.transform(marks, lambda m: F.struct(F.lower(F.substring(m, 1, 1)).alias("letter"), _single(F.substring(m, F.lit(3), F.length(m))).alias("text"))))
    letters = F.array_distinct(F.transform("_marks", lambda m: m["letter"]))
    ordered = letters == F.slice(F.array(*map(F.lit, "abcde")), F.lit(1), F.size(letters))
    good = (F.size("_marks") >= 2) & ordered
    whole = good & ~F.exists("_marks", lambda m: m["text"] == "")
    options = F.when(whole, F.transform("_marks", lambda m: F.concat(m["letter"], F.lit(") "), m["text"]))).otherwise(F.array().cast("array<string>"))
    statement = _single(F.when(good, F.element_at("_cut", 1)).otherwise(F.col("_body")))
    told = rows.select(*keys, "at", "number", statement.alias("statement"), options.alias("options")).filter("statement <> ''")
    return told.withColumn("requires_review", ~F.size("options").isin(*WHOLE_SETS))
