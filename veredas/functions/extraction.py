"""Questions in running text, as column expressions: markers, spans, options, drafts with flags, confidence and status.

A marker is found by its pattern and marked in the text with control characters, and the text is split there; so
positions are never handled one by one, and all of it stays in generated code. Control characters 1 to 4 of a text
are taken out first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veredas.functions.text import strange_script

# Patterns of question markers, options and hints; the character that stands after a confirmed lone number.
SENTINEL = "\ue000"
MARKERS = (
    ("PERIOD", r"(?dmU)^[ \t]*(\d{1,3})[.)](?:[ \t]+(?=\S)|(?=[^\d\s]))"),
    ("PAREN", r"(?dmU)^[ \t]*\((\d{1,3})\)[ \t]*(?=\S)"),
    ("STANDALONE", r"(?dmU)^[ \t]*(\d{1,3})" + SENTINEL + r"[ \t]*\n[ \t]*\n?(?=[ \t]*\S)"),
    ("WORD", r"(?dmiuU)^[ \t]*quest[aã]o\s*(\d{1,3})\b[.:)]?[ \t]*"),
)
OPTION = r"(?dmU)^[ \t]*(?:([A-Ea-e])[.)\-:][ \t]*\n?[ \t]*|([A-E])[ \t]*\([ \t]*\)[ \t]*|([A-E])[ \t]+)(?=\S)|\(([A-Ea-e])\)[ \t]*(?=\S)"
LETTERS = ("A", "B", "C", "D", "E")
TRUE_FALSE = r"(?iu)\b(verdadeiro|falso|\(V\)|\(F\)|V ou F)\b"
NUMERIC = r"(?U)^[\s\d.,eE+\-x×%°ºa-zA-Z/]{1,80}$"
HEADING = r"(?iuU)\bEPIS[ÓO]DIO\s+\d+|\bCAP[ÍI]TULO\s+\d+"
LEAST_STATEMENT = 12
LEAST_CONFIDENCE = 0.6
FULL = (4, 5)  # options of a whole set
# What page furniture, broken glyphs and broken formulas look like in a recovered text.
ARTIFACTS = {
    "barcode": r"\*[0-9A-Z]{6,}\*",
    "watermark": r"(?U)(?:ENE[MN]\s?\d{4}){2,}",
    "running_header": r"(?iuU)(?:LINGUAGENS|MATEM[ÁA]TICA|CI[ÊE]NCIAS(?:\s+(?:HUMANAS|DA\s+NATUREZA))?|REDA[ÇC][ÃA]O).{0,60}[|•·]\s*\d\s*[ºo]?\s*DIA\s*[|•·]\s*CADERNO",
}
BROKEN_GLYPHS = r"/g\d+|\x{FFFD}"
CUT_OFF = r"(?:[-/(]| e| de)\z"
JOINED_FORMULA = r"\d\s*,\s*\z|[A-Za-zÀ-ÿ]\s*[A-Za-zÀ-ÿ]?\s*=\s*\S|\A[0-9]{1,4}\s+[0-9][0-9 ,]*\z"


def _clean(text: Column) -> Column:
    return F.translate(text, "\x01\x02\x03\x04", "")


def _collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def spans(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, at, number, style, preceded, body: a row for each marker, with what follows it up to the next.

    ``preceded`` says whether a blank line comes before the marker. A number line that a word marker takes in as its
    own number is one marker, not two. A null text has no markers.
    """
    marked = _clean(F.col(text))
    for style, pattern in MARKERS:
        marked = F.regexp_replace(marked, pattern, f"\x01{style}\x02$1\x03")
    parts = docs.select(key, F.split(marked, "\x01").alias("_parts")).filter(F.size("_parts") > 1)
    cut = parts.select(key, F.posexplode(F.arrays_zip(F.col("_parts").alias("before"), F.slice("_parts", 2, F.size("_parts")).alias("part"))).alias("at", "x"))
    cut = cut.filter("x.part is not null").select(key, "at", "x.before", "x.part").withColumn("_head", F.substring_index("part", "\x03", 1))
    return cut.select(
        key, "at", F.substring_index("_head", "\x02", -1).cast("int").alias("number"), F.substring_index("_head", "\x02", 1).alias("style"),
        F.col("before").rlike(r"\n[ \t]*\n[ \t]*\z").alias("preceded"), F.substring(F.col("part"), F.length("_head") + 2, F.length("part")).alias("body"),
    )


def _ascending(letters: Column) -> Column:
    """Length of the run A, B, C ... that ends at the last letter; 0 if there is none of two or more."""
    out = F
    for n in range(2, len(LETTERS) + 1):
        out = out.when((F.size(letters) >= n) & (_tail(letters, n) == F.array(*map(F.lit, LETTERS[:n]))), n)
    return out.otherwise(0)


def _permuted(letters: Column) -> Column:
    """Length of the longest tail that has each of A, B, C ... once, in any order; 0 if there is none."""
    out = F
    for n in range(len(LETTERS), 1, -1):
        out = out.when((F.size(letters) >= n) & (F.array_sort(_tail(letters, n)) == F.array(*map(F.lit, LETTERS[:n]))), n)
    return out.otherwise(0)


def _tail(letters: Column, n: int) -> Column:
    return F.slice(letters, F.greatest(F.lit(1), F.size(letters) - (n - 1)), n)


def with_options(df: DataFrame, body: str) -> DataFrame:
    """The rows with ``statement`` and ``options``: struct(label, text) in the order of labels, or none.

    Marks are a letter with a stop, bracket, dash or colon, a letter with an empty box, a letter in brackets, or a
    bare capital at the start of a line. Taken is the tail of the marks that runs A, B, C ...: first of the
    unmistakable ones, then of all; last, a tail of unmistakable ones that has each letter once (a grid read by rows).
    What is used more than once is a column of its own, so that it is worked out once.
    """
    marked = F.regexp_replace(_clean(F.col(body)), OPTION, "\x01$1$2$4\x02$3\x02$0\x04")

    def mark(x: Column) -> Column:
        head = F.substring_index(x, "\x04", 1)  # a firm letter, a bare one, the mark as it stood; no pattern, which would be compiled for each mark
        firm = F.substring_index(head, "\x02", 1)
        letter = F.replace(F.substring_index(head, "\x02", 2), F.lit("\x02"), F.lit(""))
        tail = F.substring(x, F.length(head) + 2, F.length(x))
        return F.struct((firm != "").alias("firm"), F.upper(letter).alias("letter"), F.substring_index(head, "\x02", -1).alias("sign"), tail.alias("tail"))

    staged = df.withColumn("_parts", F.split(marked, "\x01")).withColumn("_marks", F.transform(F.slice("_parts", 2, F.size("_parts")), mark))
    staged = staged.withColumns({"_firm": F.transform(F.filter("_marks", lambda x: x["firm"]), lambda x: x["letter"]), "_all": F.transform("_marks", lambda x: x["letter"])})
    staged = staged.withColumns({"_one": _ascending(F.col("_firm")), "_every": _ascending(F.col("_all")), "_grid": _permuted(F.col("_firm"))})
    staged = staged.withColumns({"_only_firm": (F.col("_one") > 0) | (F.col("_every") == 0), "_taken": F.when(F.col("_one") > 0, F.col("_one")).when(F.col("_every") > 0, F.col("_every")).otherwise(F.col("_grid"))})
    places = F.filter(F.transform("_marks", lambda x, i: F.when(~F.col("_only_firm") | x["firm"], i + 1)), lambda i: i.isNotNull())
    staged = staged.withColumn("_places", places).withColumn("_first", F.when(F.col("_taken") > 0, F.try_element_at("_places", -F.col("_taken"))))
    whole = lambda x: F.concat(x["sign"], x["tail"])
    said = F.transform(F.slice("_marks", F.coalesce("_first", F.lit(1)), F.size("_marks")), lambda x: F.when(~F.col("_only_firm") | x["firm"], F.concat(F.lit("\x01"), x["letter"], x["tail"])).otherwise(whole(x)))
    before = F.concat(F.element_at("_parts", 1), F.array_join(F.transform(F.slice("_marks", 1, F.coalesce(F.col("_first") - 1, F.lit(0))), whole), ""))
    staged = staged.withColumns({"_said": F.split(F.array_join(said, ""), "\x01"), "_before": before})
    staged = staged.withColumn("_found", F.transform(F.slice("_said", 2, F.size("_said")), lambda x: F.struct(F.substring(x, 1, 1).alias("label"), _collapsed(F.substring(x, F.lit(2), F.length(x))).alias("text"))))
    good = F.col("_first").isNotNull() & ~F.exists("_found", lambda x: x["text"] == "")
    staged = staged.withColumn("_good", good)
    out = {"statement": F.when(F.col("_good"), F.col("_before")).otherwise(F.col(body)), "options": F.when(F.col("_good"), F.array_sort("_found")).otherwise(F.array().cast("array<struct<label:string,text:string>>"))}
    return staged.withColumns(out).select(*df.columns, "statement", "options")


def confidence(n_options: Column, statement: Column, preceded: Column, style: Column, missing: Column) -> Column:
    """0 to 1 by what speaks for a whole question."""
    full = n_options.isin(*FULL)
    score = (
        F.lit(0.4) + F.when(full, 0.25).when(n_options > 0, -0.1).otherwise(0.0) + F.when(F.length(statement) >= 40, 0.15).otherwise(0.0)
        + F.when(preceded | (style == "STANDALONE"), 0.1).otherwise(0.0) - F.when(missing, 0.3).otherwise(0.0)
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(score, 3)))


def review_status(score: Column, kind: Column, flags: Column, least: float = LEAST_CONFIDENCE) -> Column:
    bad = (score < least) | (kind == "unknown") | F.array_contains(flags, "possible_missing_content") | F.array_contains(flags, "garbled_encoding")
    return F.when(bad, "REVIEW_REQUIRED").otherwise("VALIDATED")


def questions(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row a question of each text: key, number, style, preceded, body, statement, options, kind, flags, confidence, status.

    Of several spans of one number in a text that with a whole set of options stays, then that after a blank line,
    then the longest, then the first. Spans are rows: a text with many of them is no group of one task.
    """
    rows = with_options(spans(docs, key, text), "body").withColumn("_full", F.size("options").isin(*FULL))
    better = F.struct("_full", "preceded", F.length("body").alias("length"), (-F.col("at")).alias("first"))
    fields = F.struct("style", "preceded", "body", "statement", "options")
    best = rows.groupBy(key, "number").agg(F.max_by(fields, better).alias("q")).select(key, "number", "q.style", "q.preceded", "q.body", _collapsed(F.col("q.statement")).alias("statement"), "q.options")
    n, statement = F.size("options"), F.col("statement")
    again = F.regexp_like(statement, F.concat(F.lit(r"(?sU)^.+\b"), F.col("number").cast("string"), F.lit(r"\.\s+[A-ZÀ-Ú]")))
    kind = (
        F.when(n > 0, "multiple_choice").when(F.col("body").rlike(TRUE_FALSE), "true_false")
        .when((statement != "") & statement.rlike(NUMERIC) & (F.length(statement) < 40), "numeric").when(statement != "", "discursive").otherwise("unknown")
    )
    told = best.withColumns({"kind": kind, "_orphan": again | statement.rlike(HEADING)})
    told = told.withColumn("_missing", (~n.isin(*FULL) & (F.length(statement) < LEAST_STATEMENT)) | F.col("_orphan") | (F.col("kind") == "unknown"))
    named = {"garbled_encoding": strange_script(statement), "options_complete_false": (n > 0) & (n < 4), "orphan_prefix_contamination": F.col("_orphan"), "possible_missing_content": F.col("_missing")}
    flags = F.filter(F.array(*[F.when(c, k) for k, c in named.items()]), lambda x: x.isNotNull())
    told = told.withColumns({"flags": flags, "confidence": confidence(n, statement, F.col("preceded"), F.col("style"), F.col("_missing"))})
    return told.withColumn("status", review_status(F.col("confidence"), F.col("kind"), F.col("flags"))).drop("_orphan", "_missing")


def option_check(number: Column, statement: Column, options: Column) -> Column:
    """struct(reasons, status) of a recovered question with ``options``: array of struct(label, text).

    IMPORT_READY without a reason; INVALID if the labels aren't A to E and no formula is broken; else
    OPTION_RECOVERY_PENDING. A reason is named ``label: what`` or, for the whole question, ``what``.
    """
    labels = F.transform(options, lambda o: o["label"])
    whole = labels == F.array(*map(F.lit, LETTERS))

    def found(o: Column) -> Column:
        text = F.coalesce(o["text"], F.lit(""))
        bare = F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")
        rules = {"empty": bare == "", **{f"contains {k}": text.rlike(v) for k, v in ARTIFACTS.items()}, "glyph garbage": text.rlike(BROKEN_GLYPHS), "looks truncated": text.rlike(CUT_OFF), "joined formula": bare.rlike(JOINED_FORMULA)}
        return F.array(*[F.when(broken, F.concat(o["label"], F.lit(f": {what}"))) for what, broken in rules.items()])

    own = {"labels are not A to E": ~F.coalesce(whole, F.lit(False)), **{f"statement contains {k}": statement.rlike(v) for k, v in ARTIFACTS.items()}, "no official number": F.coalesce(number, F.lit(0)) == 0}
    every = F.array_compact(F.concat(F.array(*[F.when(broken, F.lit(what)) for what, broken in own.items()]), F.coalesce(F.flatten(F.transform(options, found)), F.array().cast("array<string>"))))
    formula = F.exists(every, lambda r: F.endswith(r, F.lit(": joined formula")))
    status = F.when(F.size(every) == 0, "IMPORT_READY").when(formula | F.coalesce(whole, F.lit(False)), "OPTION_RECOVERY_PENDING").otherwise("INVALID")
    return F.struct(every.alias("reasons"), status.alias("status"))
