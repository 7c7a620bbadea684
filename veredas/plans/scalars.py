"""Scalar functions: text, scores, times, hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from veredas.functions import extraction as E
from veredas.functions import hashing as H
from veredas.functions import scoring as S
from veredas.functions import text as X
from veredas.functions.headings import exercises, season, sections
from veredas.functions.ranking import resource_score, video_score
from veredas.functions.study import Vocabulary, request, vocabulary_match
from veredas.operators import aggregates as A
from veredas.operators import lexical
from veredas.operators.filters import reasons
from veredas.operators.joins import band
from veredas.operators.layout import reading_order
from veredas.plans import tables as T
from veredas.plans.aggregates import MX, STATE_SQL
from veredas.plans.joins import BAND_SQL
from veredas.plans.registry import query
from veredas.plans.windows import CURVE_SQL


def _docs(spark, d):
    return T.read(spark, d, "documents")


def _spread(texts, key):
    """Texts made of short rows, dealt over tasks by their key: a file that is small enough for one task can hold a million of them.

    The number of tasks is given, as rows that take long but are short would be put together again.
    """
    return texts.repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


PLAIN_SQL = f"translate({{0}}, '{X.MARKED}', '{X.PLAIN}')"


@query("fn_norm_accents", f"SELECT doc_id, md5({PLAIN_SQL.format('lower(trim(text))')}) AS h FROM documents")
def fn_norm_accents(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(X.folded(F.col("text"))).alias("h"))


@query("fn_norm_person", rf"SELECT doc_id, md5(trim(regexp_replace(upper(replace({PLAIN_SQL.format('text')}, 'ß', 'SS')), '\s+', ' ', 'g'))) AS h FROM documents")
def fn_norm_person(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(X.person_name(F.col("text"))).alias("h"))


@query("fn_norm_essay", r"SELECT conv_id, turn, md5(regexp_replace(regexp_replace(text, '[ \t]+\n', chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS h FROM conversations")
def fn_norm_essay(spark, d):
    return T.read(spark, d, "conversations").select("conv_id", "turn", F.md5(X.essay_text(F.col("text"))).alias("h"))


@query("fn_collapse_ws", r"SELECT doc_id, md5(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS h FROM documents")
def fn_collapse_ws(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(X.single_spaced(F.col("text"))).alias("h"))


STOP = ("the", "of", "and", "de", "la", "der")


@query("fn_tokenize_stop", f"SELECT doc_id, count(DISTINCT t) AS n FROM (SELECT doc_id, unnest(regexp_extract_all({PLAIN_SQL.format('lower(text)')}, '[a-z0-9]+')) AS t FROM documents) WHERE length(t) >= 2 AND t NOT IN {STOP} GROUP BY 1")
def fn_tokenize_stop(spark, d):
    n = F.size(X.tokens(F.col("text"), STOP)).cast("long")
    return _docs(spark, d).select("doc_id", F.explode(F.filter(F.array(n), lambda n: n > 0)).alias("n"))  # a filter after it would find the tokens twice


@query("fn_term_sequence", f"""WITH t AS (SELECT doc_id, list_transform(list_filter(regexp_extract_all(regexp_replace(lower({PLAIN_SQL.format('text')}), '[^\\x00-\\x7F]', '', 'g'), '[a-z0-9]+'), lambda x: length(x) >= 3),
  lambda x: CASE WHEN suffix(x, 'oes') THEN left(x, length(x) - 3) || 'ao' WHEN suffix(x, 'es') THEN left(x, length(x) - 2) WHEN suffix(x, 's') THEN left(x, length(x) - 1) ELSE x END) AS ts FROM documents)
SELECT doc_id, len(ts)::BIGINT AS terms, md5(array_to_string(ts, ' ')) AS sequence, (list_position(ts, ts[len(ts)]) - 1)::BIGINT AS first FROM t""")
def fn_term_sequence(spark, d):
    """The normalised terms of each text in their order, and the first place of its last one; a null text has none."""
    rows = _docs(spark, d).select("doc_id", lexical.terms(F.col("text")).alias("ts"))
    first = F.when(F.size("ts") > 0, F.array_position("ts", F.element_at("ts", -1)) - 1)
    return rows.select("doc_id", F.size("ts").cast("long").alias("terms"), F.md5(F.array_join("ts", " ")).alias("sequence"), first.alias("first"))


@query("fn_cpf_digits", r"SELECT doc_id, length(regexp_replace(text, '\D', '', 'g')) AS n, CASE WHEN length(regexp_replace(text, '\D', '', 'g')) = 11 THEN regexp_replace(text, '\D', '', 'g') END AS cpf FROM documents")
def fn_cpf_digits(spark, d):
    return _docs(spark, d).select("doc_id", F.length(X.digits(F.col("text"))).cast("long").alias("n"), X.cpf(F.col("text")).alias("cpf"))


@query("fn_header_parse", "SELECT c_custkey AS page_id, CASE WHEN c_custkey % 3 = 0 THEN 'CUSTOMER NAME' ELSE 'MARIA DA SILVA' END AS name, CASE WHEN c_custkey % 2 = 0 THEN '123456' || lpad((c_custkey % 100000)::VARCHAR, 5, '0') END AS cpf FROM customer")
def fn_header_parse(spark, d):
    made = """if(c_custkey % 3 = 0, 'Nome: Customer  Name\\n', 'ESCOLA 12\\nmaria da silva\\nana b\\n') || if(c_custkey % 2 = 0, concat('CPF 123.456.', substr(lpad(c_custkey % 100000, 5, '0'), 1, 3), '-', substr(lpad(c_custkey % 100000, 5, '0'), 4, 2)), 'sem')"""
    rows = T.read(spark, d, "customer").select(F.col("c_custkey").alias("page_id"), X.header(F.expr(made)).alias("h"))
    return rows.select("page_id", "h.name", "h.cpf")


@query("fn_name_like", r"SELECT p_partkey AS id, regexp_matches(p_name, '^[a-zA-Z]+(\s+[a-zA-Z]+)+$') AS by_name, regexp_matches(p_brand, '^[a-zA-Z]+(\s+[a-zA-Z]+)+$') AS by_brand FROM part")
def fn_name_like(spark, d):
    return T.read(spark, d, "part").select(F.col("p_partkey").alias("id"), X.name_like(F.col("p_name")).alias("by_name"), X.name_like(F.col("p_brand")).alias("by_brand"))


TOKEN_SQL = """t AS (SELECT conv_id, turn, role, turn * 10 - (turn % 4) * 4 AS start, role || turn || CASE WHEN turn % 3 = 0 THEN '-tail' ELSE '' END AS text FROM conversations),
e AS (SELECT *, start + length(text) - CASE WHEN turn % 5 = 0 THEN 2 ELSE 0 END AS stop, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS i FROM t), n AS (SELECT conv_id, max(stop) AS n FROM e GROUP BY 1),
c AS (SELECT conv_id, start + k AS pos, i, text[k + 1:k + 1] AS ch FROM (SELECT *, unnest(generate_series(0, length(text) - 1)) AS k FROM e)), p AS (SELECT conv_id, pos, arg_max(ch, i) AS ch FROM c GROUP BY 1, 2),
b AS (SELECT conv_id, unnest(generate_series(0, n - 1)) AS pos FROM n)"""


@query("fn_token_reconstruct", f"WITH {TOKEN_SQL} SELECT conv_id, trim(string_agg(coalesce(ch, ' '), '' ORDER BY pos)) AS line FROM b LEFT JOIN p USING (conv_id, pos) GROUP BY 1")
def fn_token_reconstruct(spark, d):
    """Tokens painted by their places: some overlap the one before, some leave gaps, some are longer than the text."""
    text = F.expr("concat(role, turn, if(turn % 3 = 0, '-tail', ''))")
    rows = T.read(spark, d, "conversations").withColumn("text", text).withColumn("start", F.expr("cast(turn * 10 - (turn % 4) * 4 as int)"))
    rows = rows.withColumn("end", F.expr("cast(start + length(text) - if(turn % 5 = 0, 2, 0) as int)"))
    tokens = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "start", "end", "text"))), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), t["text"].alias("text")))
    return rows.groupBy("conv_id").agg(tokens.alias("tokens")).select("conv_id", X.painted(F.col("tokens")).alias("line"))  # a conversation's turns


@query("fn_secret_scrub", r"SELECT doc_id, md5(regexp_replace(text, '(sk-[A-Za-z0-9_-]{8,}|(?:postgres(?:ql)?|mysql|redis)://\S+|[0-9a-f]{40})', '[REDACTED]', 'g')) AS h FROM documents")
def fn_secret_scrub(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(X.scrubbed(F.col("text"))).alias("h"))


# A made exam sheet for each order: a preamble, and a question a line of it, in one of three styles; its parts as SQL.
STYLE_SQL = "CASE l_linenumber % 3 WHEN 0 THEN 'PERIOD' WHEN 1 THEN 'PAREN' ELSE 'WORD' END"
MARK_SQL = "CASE l_linenumber % 3 WHEN 0 THEN l_partkey % 90 + 1 || '. ' WHEN 1 THEN '(' || (l_partkey % 90 + 1) || ') ' ELSE 'Questão ' || (l_partkey % 90 + 1) || ': ' END"
BODY_SQL = """repeat('palavra ', l_quantity::INT % 9) || 'do item ' || l_suppkey || chr(10) ||
  CASE l_orderkey % 4 WHEN 0 THEN 'a) um' || chr(10) || 'b) dois' || chr(10) || 'c) três' || chr(10) || 'd) quatro' || chr(10) WHEN 1 THEN '(A) um (C) três' || chr(10) || '(B) dois (D) quatro' || chr(10)
  WHEN 2 THEN 'A um' || chr(10) || 'B dois' || chr(10) ELSE '' END"""
GAP_SQL = "CASE WHEN l_tax > 0.04 THEN chr(10) ELSE '' END"


def _sheets(spark, d):
    """(doc, text): the lines of an order, in the order of their numbers, as one exam text."""
    as_spark = lambda sql: sql.replace("l_quantity::INT", "cast(l_quantity as int)").replace("chr(10)", "'\\n'")
    rows = T.read(spark, d, "lineitem").selectExpr("l_orderkey as doc", "l_linenumber as at", f"concat({as_spark(GAP_SQL)}, {as_spark(MARK_SQL)}, {as_spark(BODY_SQL)}) as part")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda x: x["part"])  # an order has a few lines
    return rows.groupBy("doc").agg(F.concat(F.lit("Leia com atenção.\n"), F.array_join(parts, "")).alias("text"))


@query("fn_question_markers", f"SELECT l_orderkey AS doc, string_agg((l_partkey % 90 + 1) || ' ' || {STYLE_SQL}, ',' ORDER BY l_linenumber, {GAP_SQL} || {MARK_SQL} || {BODY_SQL}) AS markers FROM lineitem GROUP BY 1")
def fn_question_markers(spark, d):
    found = E.spans(_sheets(spark, d), "doc", "text").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("at", "number", "style"))).alias("m"))
    shown = F.transform("m", lambda m: F.concat(m["number"].cast("string"), F.lit(" "), m["style"]))
    return found.select("doc", F.array_join(shown, ",").alias("markers"))


SPANS_SQL = f"""SELECT l_orderkey AS doc, row_number() OVER o AS at_, (l_partkey % 90 + 1)::INT AS number, {STYLE_SQL} AS style,
l_tax > 0.04 AS preceded, {BODY_SQL} AS own, own || lead({GAP_SQL}, 1, '') OVER o AS body, l_orderkey % 4 AS form
FROM lineitem WINDOW o AS (PARTITION BY l_orderkey ORDER BY l_linenumber, {GAP_SQL} || {MARK_SQL} || {BODY_SQL})"""
BEST_SQL = f"SELECT * FROM ({SPANS_SQL}) QUALIFY row_number() OVER (PARTITION BY doc, number ORDER BY form < 2 DESC, preceded DESC, length(body) DESC, at_) = 1"


@query("fn_boundary_detect", f"SELECT doc, number, style, preceded, md5(body) AS body FROM ({BEST_SQL})")
def fn_boundary_detect(spark, d):
    """Of spans with the same number the one with a whole set of options, then after a blank line, then the longest, then the first."""
    return E.questions(_sheets(spark, d), "doc", "text").select("doc", "number", "style", "preceded", F.md5("body").alias("body"))


@query("fn_option_extract", f"""SELECT doc, number, md5(trim(regexp_replace(string_split(own, chr(10))[1], '\\s+', ' ', 'g'))) AS statement,
CASE form WHEN 3 THEN '' WHEN 2 THEN 'A um|B dois' ELSE 'A um|B dois|C três|D quatro' END AS options FROM ({BEST_SQL})""")
def fn_option_extract(spark, d):
    shown = F.transform("options", lambda o: F.concat(o["label"], F.lit(" "), o["text"]))
    return E.questions(_sheets(spark, d), "doc", "text").select("doc", "number", F.md5("statement").alias("statement"), F.array_join(shown, "|").alias("options"))


CONF_SQL = """round(greatest(0.0, least(1.0, 0.4 + CASE WHEN form < 2 THEN 0.25 WHEN form = 2 THEN -0.1 ELSE 0 END
  + CASE WHEN length(string_split(own, chr(10))[1]) >= 40 THEN 0.15 ELSE 0 END + CASE WHEN preceded THEN 0.1 ELSE 0 END - CASE WHEN form >= 2 AND length(string_split(own, chr(10))[1]) < 12 THEN 0.3 ELSE 0 END)), 3)::DOUBLE"""


@query("fn_extract_confidence", f"SELECT doc, number, {CONF_SQL} AS confidence FROM ({BEST_SQL})")
def fn_extract_confidence(spark, d):
    return E.questions(_sheets(spark, d), "doc", "text").select("doc", "number", "confidence")


@query("fn_review_status", f"SELECT doc, number, CASE WHEN form < 3 THEN 'multiple_choice' WHEN length(string_split(own, chr(10))[1]) < 40 THEN 'numeric' ELSE 'discursive' END AS kind, CASE WHEN {CONF_SQL} >= 0.6 AND NOT (form >= 2 AND length(string_split(own, chr(10))[1]) < 12) THEN 'VALIDATED' ELSE 'REVIEW_REQUIRED' END AS status FROM ({BEST_SQL})")
def fn_review_status(spark, d):
    return E.questions(_sheets(spark, d), "doc", "text").select("doc", "number", "kind", "status")


@query("fn_unexpected_script", "SELECT id, id % 12 NOT IN (7, 8, 9, 10, 11) AS strange FROM (SELECT p_partkey AS id FROM part)")
def fn_unexpected_script(spark, d):
    """The first and last characters of some ranges, and neighbours of ranges."""
    signs = F.array(*[F.lit(chr(c)) for c in (0x0590, 0x08FF, 0x0980, 0x0E01, 0x10A0, 0x1100, 0x9FFF, 0xAC00, 0x058F, 0x03B1, 0x00E9, 0x1D7D8)])
    made = F.concat(F.lit("texto "), F.element_at(signs, (F.col("p_partkey") % 12 + 1).cast("int")))
    return T.read(spark, d, "part").select(F.col("p_partkey").alias("id"), X.strange_script(made).alias("strange"))


@query("fn_cut_answer_key", "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN p_name || chr(10) WHEN 1 THEN p_name || ' gabarito de ' || p_type ELSE p_name || chr(10) END AS text FROM part")
def fn_cut_answer_key(spark, d):
    made = F.expr("case p_partkey % 3 when 0 then concat(p_name, '\\n GABARITO:\\n1 - A\\n2 - B') when 1 then concat(p_name, ' gabarito de ', p_type) else concat(p_name, '\\nResolução comentada\\n1. x') end")
    return T.read(spark, d, "part").select(F.col("p_partkey").alias("id"), X.before_answer_key(made).alias("text"))


@query("fn_reading_order", """WITH RECURSIVE l AS (SELECT l_orderkey AS page, l_linenumber AS id, l_suppkey AS x0, l_partkey AS y0, l_partkey + 5 + l_quantity::BIGINT % 40 AS y1 FROM lineitem),
numbered AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY y0, x0, id, y1) AS i FROM l),
f AS (SELECT page, i, id, x0, y0, 0 AS r, y0 AS top, y1 AS bottom, y1 - y0 AS low FROM numbered WHERE i = 1
UNION ALL SELECT n.page, n.i, n.id, n.x0, n.y0, f.r + (NOT j)::INT, CASE WHEN j THEN f.top ELSE n.y0 END, CASE WHEN j THEN greatest(f.bottom, n.y1) ELSE n.y1 END, CASE WHEN j THEN least(f.low, n.y1 - n.y0) ELSE n.y1 - n.y0 END
FROM f JOIN (SELECT * FROM numbered) n ON n.page = f.page AND n.i = f.i + 1 CROSS JOIN LATERAL (SELECT 2 * (least(n.y1, f.bottom) - greatest(n.y0, f.top)) >= least(n.y1 - n.y0, f.low) AS j))
SELECT page, id, r AS row, row_number() OVER (PARTITION BY page ORDER BY r, x0, y0, id) - 1 AS place FROM f""")
def fn_reading_order(spark, d):
    """Lines of an order as lines of a page: rows by the overlap of their heights, each from left to right."""
    lines = T.read(spark, d, "lineitem").selectExpr("l_orderkey as page", "l_linenumber as id", "l_suppkey as x0", "l_partkey as y0", "l_partkey + 5 + cast(l_quantity as bigint) % 40 as y1")
    return reading_order(lines, ["page"], ["id", "y1"]).select("page", "id", F.col("row").cast("int").alias("row"), F.col("place").cast("long").alias("place"))


@query("fn_intent", """SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'STUDY' WHEN 1 THEN 'PRACTICE' WHEN 2 THEN 'REVIEW' ELSE 'SEARCH' END AS intent, CASE p_size % 3 WHEN 0 THEN 'Química' WHEN 1 THEN 'Matemática' ELSE 'Geral' END AS discipline,
CASE WHEN p_size % 5 = 0 THEN 'Ensino Médio' ELSE 'Ensino Fundamental' END AS grade_level, CASE WHEN p_size % 4 = 0 THEN 'EASY' WHEN p_size % 4 = 1 AND p_size % 5 > 0 THEN 'HARD' ELSE 'MEDIUM' END AS difficulty, CASE p_partkey % 4 WHEN 0 THEN 'MATERIAL' WHEN 1 THEN 'QUESTION' WHEN 2 THEN 'MATERIAL' ELSE 'VIDEO' END AS resource_type FROM part""")
def fn_intent(spark, d):
    """Requests made of parts; the SQL says what each must be understood as. Words of medium difficulty are tried before those of high, and a level of school has one."""
    ask = F.expr("""concat(case p_partkey % 4 when 0 then 'Quero  estudar' when 1 then 'hoje quero praticar' when 2 then 'QUERO REVISAR' else 'vídeo' end, case p_size % 3 when 0 then ' soluções' when 1 then ' funções' else ' flores' end,
        case when p_size % 5 = 0 then ' no ensino médio' else ' do 9º ano' end, case p_size % 4 when 0 then ' fácil' when 1 then ' avançado' else '' end)""")
    return T.read(spark, d, "part").select(F.col("p_partkey").alias("id"), request(ask).alias("r")).select("id", "r.*")


TERMS_SQL = """list_transform(list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda x: length(x) >= 3),
  lambda x: CASE WHEN suffix(x, 'oes') THEN left(x, length(x) - 3) || 'ao' WHEN suffix(x, 'es') THEN left(x, length(x) - 2) WHEN suffix(x, 's') THEN left(x, length(x) - 1) ELSE x END)"""
#: The five best nodes of each distinct statement: paths of the tree's four levels, terms, scores, ranks.
LEXICAL_SQL = f"""k AS (SELECT *, CASE type WHEN 'SUBCONTENT' THEN 'made of ' || lower(name) || ' nations' WHEN 'CONTENT' THEN 'ring parts' END AS description FROM nodes),
u AS (SELECT a.id, a.type, a.name, a.description, b.id AS i1, c.id AS i2, e.id AS i3, concat_ws(' ', b.name, b.description, c.name, c.description, e.name, e.description) AS held
  FROM k a LEFT JOIN k b ON a.parent = b.id LEFT JOIN k c ON b.parent = c.id LEFT JOIN k e ON c.parent = e.id),
w AS (SELECT id, type, 1 + (i1 IS NOT NULL)::INT + (i2 IS NOT NULL)::INT + (i3 IS NOT NULL)::INT AS depth, list_reverse(list_filter([id, i1, i2, i3], lambda x: x IS NOT NULL)) AS path, {TERMS_SQL.format("held")} AS held,
  {TERMS_SQL.format("name")} AS label, {TERMS_SQL.format("coalesce(description, '')")} AS about FROM u),
v AS (SELECT id, unnest(list_distinct(list_filter(label, lambda x: NOT list_contains(held, x)))) AS term, 1 AS l, 0 AS b FROM w UNION ALL SELECT id, unnest(list_distinct(list_filter(about, lambda x: NOT list_contains(held, x)))), 0, 1 FROM w),
t AS (SELECT id, term, max(l) AS l, max(b) AS b FROM v GROUP BY ALL),
s AS (SELECT DISTINCT statement FROM bank), p AS (SELECT statement, {TERMS_SQL.format("statement")} AS ts FROM s), q AS (SELECT statement, unnest(list_distinct(ts)) AS term, ts FROM p),
m AS (SELECT statement, id, sum(l) AS labels, sum(b) AS descriptions, min(list_position(ts, term) - 1) AS first FROM q JOIN t USING (term) GROUP BY ALL),
z AS (SELECT statement, id, path, CASE WHEN type = 'SUBCONTENT' THEN 100 ELSE -2 END + 20 * labels + 10 * descriptions + depth + greatest(0, 10 - first) AS score FROM m JOIN w USING (id)),
best AS (SELECT statement, id, score::BIGINT AS score, row_number() OVER (PARTITION BY statement ORDER BY score DESC, path) AS rank FROM z WHERE score > 0 QUALIFY rank <= 5)"""


def _lexical_score(spark, d):
    """The five best nodes of a question, found once for each distinct statement."""
    about = F.when(F.col("type") == "SUBCONTENT", F.concat(F.lit("made of "), F.lower("name"), F.lit(" nations"))).when(F.col("type") == "CONTENT", "ring parts")
    bank = T.bank(spark, d).select("question_id", "statement")
    best = lexical.candidates(bank, "statement", T.nodes(spark, d).withColumn("description", about), best=5)
    return bank.join(best, "statement").select("question_id", "id", "score", F.col("rank").cast("long").alias("rank"))


@query("fn_lexical_score", f"WITH {LEXICAL_SQL} SELECT question_id, id, score, rank FROM bank JOIN best USING (statement)")
def fn_lexical_score(spark, d):
    return _lexical_score(spark, d)


@query("fn_lexical_score_all", """WITH q AS (SELECT question_id, unnest(list_distinct(string_split(statement, ' '))) AS t FROM bank), n AS (SELECT id, length(name) AS depth, unnest(list_distinct(string_split(lower(name), ' '))) AS t FROM nodes WHERE type = 'SUBCONTENT')
SELECT * FROM (SELECT question_id, id, count(*) * 20 + max(depth) - CASE WHEN count(*) = 1 THEN 40 ELSE 0 END AS score FROM q JOIN n USING (t) GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id) <= 5""")
def fn_lexical_score_all(spark, d):
    """A plain score of names alone, without the tree."""
    from veredas.operators.joins import token_overlap
    from veredas.operators.keys import first_per_key

    bank = T.bank(spark, d)
    statements = bank.select("statement").distinct().withColumn("tokens", F.split("statement", " "))
    places = T.nodes(spark, d).filter("type = 'SUBCONTENT'").select("id", F.length("name").alias("depth"), F.split(F.lower("name"), " ").alias("tokens"))
    met = token_overlap(statements, "statement", places, "id").join(places.select("id", "depth"), "id")
    scored = met.withColumn("score", F.col("common") * 20 + F.col("depth") - F.when(F.col("common") == 1, 40).otherwise(0))
    best = first_per_key(scored, ["statement"], [F.desc("score"), F.asc("id")], 5).select("statement", "id", "score")
    return bank.select("question_id", "statement").join(best, "statement").select("question_id", "id", "score")


@query("fn_overlap_score", "SELECT question_id, round(len(list_intersect(list_distinct(string_split(statement, ' ')), ['red', 'ring', 'widget']))::DOUBLE / 3, 4) AS score FROM bank WHERE len(list_intersect(list_distinct(string_split(statement, ' ')), ['red', 'ring', 'widget']))::DOUBLE / 3 >= 0.34")
def fn_overlap_score(spark, d):
    node = F.array(*map(F.lit, ("red", "ring", "widget")))
    rows = T.bank(spark, d).withColumn("s", X.overlap(X.tokens(F.col("statement")), node)).filter("s >= 0.34")
    return rows.select("question_id", F.round("s", 4).alias("score"))


VOCABULARY = Vocabulary("WIDGETS", ("red widget", "blue bolts"), ("ring",), ("small green gear",), ("red", "plate"))


@query("fn_vocab_match", """WITH w AS (SELECT question_id, statement, list_filter(['red widget', 'blue bolts'], lambda p: contains(statement, rtrim(p, 's'))) AS p, list_filter(['ring'], lambda p: contains(statement, p)) AS s, list_filter(['small green gear'], lambda p: contains(statement, p)) AS c FROM bank)
SELECT question_id, p AS primary_terms, s AS specific_terms, c AS contextual, list_filter(['red', 'plate'], lambda g: list_contains(string_split(statement, ' '), g)) AS generic_ignored, 60 * len(p) + 30 * len(s) + 50 * len(c) + CASE WHEN len(p) + len(s) + len(c) > 1 THEN 10 ELSE 0 END AS score
FROM w WHERE len(p) + len(s) + len(c) > 0""", lists=("primary_terms", "specific_terms", "contextual", "generic_ignored"))
def fn_vocab_match(spark, d):
    """Questions with a phrase of an entry that isn't a generic one."""
    found = T.bank(spark, d).select("question_id", vocabulary_match(F.col("statement"), VOCABULARY).alias("m")).filter("m is not null")
    return found.select("question_id", F.col("m.primary").alias("primary_terms"), F.col("m.specific").alias("specific_terms"), "m.contextual", "m.generic_ignored", "m.score")


@query("fn_band_score", f"SELECT essay_id, {BAND_SQL} AS label FROM scores WHERE score <= 1000")
def fn_band_score(spark, d):
    return T.scores(spark, d).filter("score <= 1000").select("essay_id", band(F.col("score"), S.ESSAY_BANDS).alias("label"))


@query("fn_band_accuracy", "SELECT student_id, content, round(correct / answered, 4) AS accuracy, CASE WHEN answered < 3 THEN 'DADOS_INSUFICIENTES' WHEN round(correct / answered, 4) >= 0.8 THEN 'PONTO_FORTE' WHEN round(correct / answered, 4) < 0.6 THEN 'PONTO_MELHORIA' ELSE 'DESEMPENHO_INTERMEDIARIO' END AS band FROM mastery")
def fn_band_accuracy(spark, d):
    rows = T.mastery(spark, d).withColumn("accuracy", S.accuracy(F.col("correct"), F.col("answered")))
    return rows.select("student_id", "content", "accuracy", S.accuracy_band(F.col("answered"), F.col("accuracy")).alias("band"))


@query("fn_state_mastery", f"SELECT student_id, content, {STATE_SQL} AS state FROM mastery")
def fn_state_mastery(spark, d):
    return T.mastery(spark, d).select("student_id", "content", S.mastery_state(F.col("score"), F.col("confidence"), F.col("answered")).alias("state"))


@query("fn_confidence_curve", f"SELECT i AS n, round({CURVE_SQL.format('i::DOUBLE')}, 6)::DOUBLE AS confidence FROM generate_series(0, 100) t(i)")
def fn_confidence_curve(spark, d):
    return spark.range(101).select(F.col("id").alias("n"), F.round(S.confidence_curve(F.col("id")), 6).alias("confidence"))


@query("fn_mastery_score", "SELECT student_id, content, round(CASE WHEN answered % 2 = 0 THEN correct * 100.0::DOUBLE / answered ELSE 0.6 * (CASE WHEN answered % 5 > 0 THEN least(correct, answered % 5) * 100.0::DOUBLE / (answered % 5) ELSE 0 END) + 0.4 * correct * 100.0::DOUBLE / answered END, 3) AS score FROM mastery")
def fn_mastery_score(spark, d):
    recent = F.when(F.col("answered") % 2 == 1, F.col("answered") % 5)
    score = S.mastery_score(F.col("answered"), F.col("correct"), F.when(recent.isNotNull(), F.least("correct", recent)), recent)
    return T.mastery(spark, d).select("student_id", "content", F.round(score, 3).alias("score"))


LEVEL_SQL = "CASE answered % 3 WHEN 0 THEN 'EASY' WHEN 1 THEN 'MEDIUM' ELSE 'HARD' END"


def _levelled(spark, d):
    return T.mastery(spark, d).withColumn("level", F.expr("case answered % 3 when 0 then 'EASY' when 1 then 'MEDIUM' else 'HARD' end"))


@query("fn_next_level", f"""SELECT student_id, content, CASE WHEN confidence < 0.6 THEN l WHEN l = 'EASY' AND score >= 70 THEN 'MEDIUM' WHEN l = 'MEDIUM' AND score >= 70 THEN 'HARD' WHEN l = 'MEDIUM' AND score < 50 THEN 'EASY' WHEN l = 'HARD' AND score < 40 THEN 'MEDIUM' ELSE l END AS next FROM (SELECT *, {LEVEL_SQL} AS l FROM mastery)""")
def fn_next_level(spark, d):
    return _levelled(spark, d).select("student_id", "content", S.next_level(F.col("level"), F.col("score"), F.col("confidence")).alias("next"))


@query("fn_transfer_level", f"""SELECT student_id, ['EASY', 'MEDIUM', 'HARD'][coalesce(max(CASE l WHEN 'EASY' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END) FILTER (confidence >= 0.6 AND score >= CASE l WHEN 'HARD' THEN 60 ELSE 70 END), 1)] AS level FROM (SELECT *, {LEVEL_SQL} AS l FROM mastery) GROUP BY 1""")
def fn_transfer_level(spark, d):
    ok = S.qualifies(F.col("level"), F.col("score"), F.col("confidence"))
    best = F.max_by("level", F.when(ok, S.level_rank(F.col("level"))))
    return _levelled(spark, d).groupBy("student_id").agg(F.coalesce(best, F.lit("EASY")).alias("level"))


@query("fn_nba_score", """WITH m AS (SELECT *, CASE student_id % 3 WHEN 0 THEN 'DECLINING' ELSE 'STABLE' END AS trend, CASE student_id % 5 WHEN 0 THEN 'TEACHER' WHEN 1 THEN 'COORDINATION' WHEN 2 THEN 'SCHOOL_PLAN' END AS source FROM mastery),
a AS (SELECT *, CASE WHEN answered = 0 OR score IS NULL THEN 'COMPLETE_MISSING_EVIDENCE' WHEN confidence < 0.3 THEN 'COMPLETE_MISSING_EVIDENCE' WHEN score < 40 THEN 'PRACTICE_CONTENT' WHEN score < 70 THEN 'REINFORCE_CONTENT' WHEN trend = 'DECLINING' THEN 'REVIEW_CONTENT' WHEN score >= 85 AND confidence >= 0.6 THEN 'ADVANCE_CONTENT' ELSE 'REVIEW_CONTENT' END AS action,
CASE WHEN answered = 0 OR score IS NULL THEN 90 WHEN confidence < 0.3 THEN 85 WHEN score < 40 THEN 80 WHEN score < 70 THEN 65 WHEN trend = 'DECLINING' THEN 60 WHEN score >= 85 AND confidence >= 0.6 THEN 30 ELSE 45 END AS base FROM m)
SELECT student_id, content, action, round(base + CASE source WHEN 'TEACHER' THEN 18 WHEN 'COORDINATION' THEN 12 WHEN 'SCHOOL_PLAN' THEN 8 ELSE 0 END + CASE WHEN student_id % 4 = 0 THEN 12 ELSE 0 END + CASE WHEN trend = 'DECLINING' THEN 8 ELSE 0 END - least(15, 3 * (correct % 7)), 2)::DOUBLE AS priority FROM a""")
def fn_nba_score(spark, d):
    e = F.expr
    trend, source = e("if(student_id % 3 = 0, 'DECLINING', 'STABLE')"), e("case student_id % 5 when 0 then 'TEACHER' when 1 then 'COORDINATION' when 2 then 'SCHOOL_PLAN' end")
    rows = T.mastery(spark, d).withColumn("a", S.next_best_action(F.col("score"), F.col("confidence"), F.col("answered"), trend))
    bonus = S.action_bonus(source, e("student_id % 4 = 0"), trend, e("correct % 7"))
    return rows.select("student_id", "content", F.col("a.action").alias("action"), F.round(F.col("a.base") + bonus, 2).alias("priority"))


@query("fn_rec_score", """SELECT student_id, content, (CASE student_id % 4 WHEN 0 THEN 100 WHEN 1 THEN 90 WHEN 2 THEN 80 ELSE 50 END + CASE WHEN score < 50 THEN 40 WHEN score < 70 THEN 30 WHEN score < 85 THEN 20 ELSE -30 END + CASE WHEN correct % 3 > 1 THEN 20 ELSE 0 END + CASE WHEN answered % 11 = 0 THEN -50 ELSE 0 END)::DOUBLE AS score FROM mastery""")
def fn_rec_score(spark, d):
    e = F.expr
    source = e("case student_id % 4 when 0 then 'TEACHER' when 1 then 'COORDINATION' when 2 then 'SCHOOL_PLAN' else 'AUTONOMOUS' end")
    return T.mastery(spark, d).select("student_id", "content", S.recommendation_score(source, F.col("score"), e("correct % 3"), e("answered % 11 = 0")).alias("score"))


@query("fn_resource_score", """SELECT question_id, (CASE WHEN content = 'Brand#4' THEN 30 ELSE 0 END + CASE WHEN owner = 'o3' THEN 25 ELSE 0 END + CASE WHEN origin IN ('AUTHOR', 'SCHOOL') THEN 20 ELSE 0 END + CASE WHEN number <= 16 THEN 15 ELSE 0 END
+ CASE number % 7 WHEN 0 THEN 10 WHEN 1 THEN 8 WHEN 2 THEN 5 WHEN 3 THEN 5 WHEN 4 THEN 3 ELSE 2 END - CASE WHEN question_id % 13 = 0 THEN 40 ELSE 0 END)::DOUBLE AS score FROM bank""")
def fn_resource_score(spark, d):
    role = F.expr("case number % 7 when 0 then 'THEORY' when 1 then 'explanation' when 2 then 'REVIEW' when 3 then 'VIDEO' when 4 then 'PRACTICE' when 5 then 'REFERENCE' end")
    c = F.col
    return T.bank(spark, d).select("question_id", resource_score(c("content") == "Brand#4", c("owner") == "o3", c("origin"), c("number") <= 16, role, c("question_id") % 13 == 0).alias("score"))


@query("fn_video_score", """SELECT question_id, (CASE WHEN content = 'Brand#4' THEN 35 WHEN question_id % 5 = 0 THEN 25 ELSE 0 END + CASE WHEN owner = 'o3' THEN 25 ELSE 0 END + CASE WHEN origin IN ('AUTHOR', 'SCHOOL') THEN 20 WHEN origin = 'PLATFORM' THEN 15 ELSE 0 END + CASE WHEN number <= 16 THEN 20 ELSE 0 END
+ CASE WHEN number * 60 BETWEEN 180 AND 900 THEN 10 WHEN number * 60 > 1800 THEN -15 ELSE 0 END + CASE WHEN question_id % 11 = 0 THEN -30 WHEN question_id % 11 < 3 THEN 20 WHEN question_id % 11 = 3 THEN 0 ELSE 15 END + CASE question_id % 7 WHEN 0 THEN 30 WHEN 1 THEN -60 ELSE 0 END
+ CASE question_id % 6 WHEN 0 THEN -40 WHEN 1 THEN -30 ELSE 0 END + CASE WHEN number * 60 < 300 THEN -30 ELSE 0 END + CASE WHEN number <= 16 THEN -40 ELSE 0 END + CASE WHEN contains(statement, 'ring') THEN 25 ELSE 0 END)::DOUBLE AS score FROM bank""")
def fn_video_score(spark, d):
    """For a student at level EASY who found videos too fast, too basic and short of examples; every question is a video."""
    c, qid = F.col, F.col("question_id")
    progress = F.when(qid % 11 == 0, 100.0).when(qid % 11 < 3, 40.0).otherwise(0.0)
    level = F.when(c("number") <= 16, "EASY").otherwise("HARD")
    verdict = F.when(qid % 7 == 0, "LIKED").when(qid % 7 == 1, "DISLIKED")
    reason = F.when(qid % 6 == 0, "TOO_ADVANCED").when(qid % 6 == 1, "TOO_FAST")
    about = F.regexp_replace(c("statement"), "ring", "Exemplo")
    score = video_score(
        c("content") == "Brand#4", qid % 5 == 0, c("owner") == "o3", c("origin"), level, F.lit("EASY"), c("number") * 60, progress, qid % 11 == 3, verdict, reason, about,
        {"TOO_FAST": F.lit(2), "TOO_BASIC": F.lit(1), "NEEDS_EXAMPLES": F.lit(1)},
    )
    return T.bank(spark, d).select("question_id", score.alias("score"))


def _path(spark, d):
    e = F.expr
    share = S.accuracy(F.col("correct"), F.col("answered"))
    rows = T.mastery(spark, d).withColumn("accuracy", share)
    weak = F.when(F.col("accuracy") < 0.6, F.least(F.lit(1.0), (0.6 - F.col("accuracy")) / 0.6)).otherwise(0.0)
    mastered = (F.col("answered") >= 3) & (F.col("accuracy") >= 0.8)
    stale = mastered & (F.col("last_at") < e("timestamp_ntz'2001-06-01' - interval 30 days"))
    return rows.withColumns({"weak": weak, "mastered": mastered, "stale": stale, "blocked": e("student_id % 6 = 0") & ~mastered, "observed": F.col("answered") >= 10})


PATH_SQL = """p AS (SELECT *, CASE WHEN accuracy < 0.6 THEN least(1.0::DOUBLE, (0.6::DOUBLE - accuracy) / 0.6::DOUBLE) ELSE 0 END AS weak, mastered AND last_at < TIMESTAMP '2001-06-01' - INTERVAL 30 DAYS AS stale, student_id % 6 = 0 AND NOT mastered AS blocked, answered >= 10 AS observed
FROM (SELECT *, answered >= 3 AND accuracy >= 0.8 AS mastered FROM (SELECT *, round(correct / answered, 4) AS accuracy FROM mastery)))"""


@query("fn_path_score", f"""WITH {PATH_SQL} SELECT student_id, content, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.35 * CASE WHEN NOT observed AND NOT mastered THEN 1 ELSE 0 END + 0.30 * weak * (1 - 0.5 * 0.25) + 0.25 * least(1.0::DOUBLE, (correct % 4) / 3.0::DOUBLE) + 0.15 * CASE WHEN student_id % 2 = 0 THEN 0.5 ELSE 0 END + 0.10 * stale::INT - 0.50 * blocked::INT)), 4)::DOUBLE AS priority FROM p""")
def fn_path_score(spark, d):
    one = lambda c: c.cast("int")
    score = S.path_score(one(~F.col("observed") & ~F.col("mastered")), F.col("weak"), F.least(F.lit(1.0), (F.col("correct") % 4) / 3), F.expr("if(student_id % 2 = 0, 0.5D, 0.0D)"), one(F.col("stale")), one(F.col("blocked")), F.lit(0.25))
    return _path(spark, d).select("student_id", "content", score.alias("priority"))


@query("fn_path_state", f"WITH {PATH_SQL} SELECT student_id, content, CASE WHEN mastered AND stale THEN 'NEEDS_REVIEW' WHEN mastered THEN 'MASTERED' WHEN blocked THEN 'BLOCKED_BY_PREREQUISITE' WHEN NOT observed THEN 'INSUFFICIENT_EVIDENCE' WHEN weak > 0 THEN 'RECOMMENDED' ELSE 'READY' END AS state FROM p")
def fn_path_state(spark, d):
    c = F.col
    state = F.when(c("mastered") & c("stale"), "NEEDS_REVIEW").when(c("mastered"), "MASTERED").when(c("blocked"), "BLOCKED_BY_PREREQUISITE").when(~c("observed"), "INSUFFICIENT_EVIDENCE").when(c("weak") > 0, "RECOMMENDED").otherwise("READY")
    return _path(spark, d).select("student_id", "content", state.alias("state"))


@query("fn_coverage_decide", """SELECT essay_id, CASE WHEN score * 3 >= hard THEN 'FINISH_TIME' WHEN stop THEN 'FINISH_SUFFICIENT' WHEN wide THEN 'CONTINUE' WHEN essay_id % 4 = 0 THEN 'CONTINUE_PREREQUISITE_INVESTIGATION' WHEN essay_id % 4 = 1 THEN 'FINISH_SUFFICIENT' ELSE 'CONTINUE' END AS action,
CASE WHEN score * 3 >= hard THEN 'HARD_LIMIT_REACHED' WHEN stop THEN 'GLOBAL_SUFFICIENCY_REACHED' WHEN wide THEN 'GLOBAL_COVERAGE_INCOMPLETE' WHEN essay_id % 4 = 0 THEN 'POSSIBLE_PREREQUISITE_GAP' WHEN essay_id % 4 = 1 THEN 'CONTENT_SUFFICIENCY_REACHED' WHEN score * 3 >= soft THEN 'SOFT_LIMIT_HIGH_INFORMATION_ONLY' ELSE 'INSUFFICIENT_EVIDENCE' END AS reason,
score * 3 < hard AND NOT stop AND score * 3 >= soft AND (wide OR essay_id % 4 <> 1) AS high_information_only
FROM (SELECT *, essay_id % 7 = 0 AS stop, essay_id % 5 = 0 AS wide, CASE status WHEN 'F' THEN 2700 WHEN 'O' THEN 2400 ELSE 1500 END AS hard, CASE status WHEN 'F' THEN 2400 WHEN 'O' THEN 2100 ELSE 1320 END AS soft FROM scores)""")
def fn_coverage_decide(spark, d):
    e = F.expr
    mode = e("case status when 'F' then 'ENEM' when 'O' then 'GLOBAL' else 'DISCIPLINE' end")
    told = S.diagnostic_decision(mode, F.col("score") * 3, e("essay_id % 4 = 0"), e("essay_id % 4 = 1"), e("essay_id % 7 = 0"), e("essay_id % 5 = 0"))
    return T.scores(spark, d).select("essay_id", told.alias("t")).select("essay_id", "t.*")


@query("fn_hypothesis_update", """WITH e AS (SELECT student_id, content, CASE WHEN response = 'UNKNOWN' THEN 'U' WHEN is_correct THEN 'C' WHEN NOT is_correct THEN 'S' ELSE 'U' END AS k, at_, event_id FROM history),
g AS (SELECT student_id, content, count(*) FILTER (k = 'S') AS supporting, count(*) FILTER (k = 'C') AS contradictory, count(*) FILTER (k = 'U') AS unknown, arg_max(k, (at_, event_id)) AS last FROM e GROUP BY ALL)
SELECT student_id, content, supporting, contradictory, unknown, CASE last WHEN 'U' THEN 'INCONCLUSIVE' WHEN 'C' THEN CASE WHEN contradictory >= 2 THEN 'REFUTED' ELSE 'UNDER_INVESTIGATION' END ELSE CASE WHEN supporting >= 2 THEN 'SUPPORTED' ELSE 'UNDER_INVESTIGATION' END END AS status,
coalesce(round(abs(supporting - contradictory)::DOUBLE / nullif(supporting + contradictory, 0), 4), 0) AS confidence FROM g""")
def fn_hypothesis_update(spark, d):
    """Counts and the kind of the last evidence say all that stepping through the evidence would."""
    kind = F.when(F.col("response") == "UNKNOWN", "U").when(F.col("is_correct"), "C").when(~F.col("is_correct"), "S").otherwise("U")
    rows = T.history(spark, d).withColumn("k", kind).groupBy("student_id", "content")
    rows = rows.agg(*[F.count_if(F.col("k") == k).alias(n) for k, n in (("S", "supporting"), ("C", "contradictory"), ("U", "unknown"))], F.max_by("k", F.struct("at", "event_id")).alias("last"))
    decided = lambda n, done: F.when(F.col(n) >= 2, done).otherwise("UNDER_INVESTIGATION")
    status = F.when(F.col("last") == "U", "INCONCLUSIVE").when(F.col("last") == "C", decided("contradictory", "REFUTED")).otherwise(decided("supporting", "SUPPORTED"))
    confidence = F.coalesce(F.round(F.try_divide(F.abs(F.col("supporting") - F.col("contradictory")), F.col("supporting") + F.col("contradictory")), 4), F.lit(0.0))
    return rows.select("student_id", "content", "supporting", "contradictory", "unknown", status.alias("status"), confidence.alias("confidence"))


@query("fn_strength_class", f"SELECT content, CASE WHEN m >= 50 AND s <= 0.10 THEN 'STRENGTH' WHEN m < 50 OR s > 0.20 THEN 'IMPROVEMENT' ELSE 'NEITHER' END AS class FROM (SELECT content, {MX} AS m, count(*) FILTER (score < 35)::DOUBLE / count(*) AS s FROM mastery GROUP BY 1)")
def fn_strength_class(spark, d):
    stats = T.mastery(spark, d).groupBy("content").agg(A.exact_mean("score").alias("m"), (F.count_if(F.col("score") < 35) / F.count(F.lit(1))).alias("s"))
    return stats.select("content", F.when((F.col("m") >= 50) & (F.col("s") <= 0.10), "STRENGTH").when((F.col("m") < 50) | (F.col("s") > 0.20), "IMPROVEMENT").otherwise("NEITHER").alias("class"))


@query("fn_action_plan", f"SELECT content, CASE WHEN m < 50 THEN 'HIGH' WHEN m < 70 THEN 'MEDIUM' ELSE 'LOW' END AS priority, printf('%d de %d alunos em nível crítico', s, n) AS evidence FROM (SELECT content, {MX} AS m, count(*) FILTER (score < 50) AS s, count(*) AS n FROM mastery GROUP BY 1)")
def fn_action_plan(spark, d):
    stats = T.mastery(spark, d).groupBy("content").agg(A.exact_mean("score").alias("m"), F.count_if(F.col("score") < 50).alias("s"), F.count(F.lit(1)).alias("n"))
    return stats.select("content", S.steps(F.col("m"), ((50, "HIGH"), (70, "MEDIUM")), "LOW").alias("priority"), F.format_string("%d de %d alunos em nível crítico", "s", "n").alias("evidence"))


@query("fn_essay_plan", "SELECT school, list_filter([CASE WHEN n < 600 THEN 'COLLECT' END, CASE WHEN m < 500 THEN 'TOTAL' END, CASE WHEN a < 100 THEN 'C1' END, CASE WHEN b < 100 THEN 'C2' END], lambda x: x IS NOT NULL) AS plan FROM (SELECT school, count(*) AS n, avg(score) AS m, avg(c1) AS a, avg(c2) AS b FROM scores GROUP BY 1)", lists=("plan",))
def fn_essay_plan(spark, d):
    stats = T.scores(spark, d).groupBy("school").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("m"), F.avg("c1").alias("a"), F.avg("c2").alias("b"))
    return stats.select("school", reasons(COLLECT=F.col("n") < 600, TOTAL=F.col("m") < 500, C1=F.col("a") < 100, C2=F.col("b") < 100).alias("plan"))


@query("fn_score_rules", "SELECT essay_id, CASE WHEN status = 'P' THEN 0 ELSE least(c3, 40) END AS c3, CASE WHEN status = 'P' OR c1 < 20 THEN 0 ELSE least(c5, 40) END AS c5 FROM scores")
def fn_score_rules(spark, d):
    void = F.col("status") == "P"
    return T.scores(spark, d).select("essay_id", F.when(void, 0).otherwise(F.least("c3", F.lit(40))).alias("c3"), F.when(void | (F.col("c1") < 20), 0).otherwise(F.least("c5", F.lit(40))).alias("c5"))


@query("fn_priority_bucket", "SELECT event_id, CASE WHEN kind = 'error' AND value < 20 THEN 'P1' WHEN kind = 'error' THEN 'P2' WHEN value < 20 THEN 'P3' ELSE 'P4' END AS priority FROM history")
def fn_priority_bucket(spark, d):
    found = reasons(MISSING=F.col("kind") == "error", LOW=F.col("value") < 20)
    severe = F.arrays_overlap(found, F.array(F.lit("MISSING")))
    return T.history(spark, d).select("event_id", F.when(severe & (F.size(found) > 1), "P1").when(severe, "P2").when(F.size(found) > 0, "P3").otherwise("P4").alias("priority"))


@query("fn_options_balanced", "SELECT essay_id, greatest(c1, c2, c3, c4, c5) <= 2 * list_sort([c1, c2, c3, c4, c5])[3] AS balanced FROM scores")
def fn_options_balanced(spark, d):
    return T.scores(spark, d).select("essay_id", X.balanced(F.array("c1", "c2", "c3", "c4", "c5")).alias("balanced"))


@query("fn_quality_tuple", "SELECT essay_id, (c1 % 5, c2) > (c3 % 5, c4) AS better FROM scores")
def fn_quality_tuple(spark, d):
    of = lambda a, b: F.struct((F.col(a) % 5).alias("options"), F.col(b).alias("length"))
    return T.scores(spark, d).select("essay_id", (of("c1", "c2") > of("c3", "c4")).alias("better"))


@query("fn_confidence_band", "SELECT student_id, content, CASE WHEN confidence >= 0.85 THEN 'HIGH' WHEN confidence >= 0.60 THEN 'MEDIUM' ELSE 'LOW' END AS band FROM mastery")
def fn_confidence_band(spark, d):
    exact = F.col("confidence").cast("decimal(5,4)")
    return T.mastery(spark, d).select("student_id", "content", F.when(exact.isNull(), None).when(exact >= 0.85, "HIGH").when(exact >= 0.60, "MEDIUM").otherwise("LOW").alias("band"))


@query("fn_option_validate", """SELECT question_id, CASE number % 8 WHEN 1 THEN 'labels are not A to E' WHEN 2 THEN 'C: empty' WHEN 3 THEN 'B: contains barcode' WHEN 4 THEN 'E: looks truncated' WHEN 5 THEN 'labels are not A to E;D: joined formula' WHEN 6 THEN 'no official number' WHEN 7 THEN 'A: glyph garbage;E: contains watermark' ELSE '' END AS reasons,
CASE number % 8 WHEN 0 THEN 'IMPORT_READY' WHEN 1 THEN 'INVALID' ELSE 'OPTION_RECOVERY_PENDING' END AS status FROM bank""")
def fn_option_validate(spark, d):
    """Options made of each question, whole or broken in one of seven ways."""
    kind, word = F.col("number") % 8, F.split("statement", " ")[0]
    broken = {("C", 2): F.lit("  "), ("B", 3): F.lit("*123ABC* x"), ("E", 4): F.concat(word, F.lit(" de")), ("D", 5): F.lit("108 25,"), ("A", 7): F.lit("/g12"), ("E", 7): F.lit("ENEM2025ENEM2025")}

    def option(letter):
        text = F.concat(word, F.lit(f" {letter}"))
        for (at, k), bad in broken.items():
            text = F.when(kind == k, bad).otherwise(text) if at == letter else text
        return F.struct(F.lit(letter).alias("label"), text.alias("text"))

    options = F.array(*map(option, E.LETTERS))
    rows = T.bank(spark, d).withColumn("options", F.when(kind == 1, F.slice(options, 1, 3)).when(kind == 5, F.slice(options, 1, 4)).otherwise(options))
    found = rows.select("question_id", E.option_check(F.when(kind != 6, F.col("number")), F.col("statement"), F.col("options")).alias("x"))
    return found.select("question_id", F.array_join("x.reasons", ";").alias("reasons"), "x.status")


@query("fn_heading_parse", r"""WITH p AS (SELECT *, upper(left(p_name, 1)) || substr(p_name, 2) AS t FROM part)
SELECT p_partkey AS id, 1 AS position, 'EPISODE' AS kind, lpad((p_partkey % 50)::VARCHAR, 2, '0') AS number, t AS title, '. Texto inicial.|## 1.1 Parte|. Fim.' AS lines, p_size AS season FROM p
UNION ALL SELECT p_partkey, 2, 'CHAPTER', p_size::VARCHAR, 'Chapter ' || p_size, '1. Calcule ' || p_name || '.', p_size FROM p
UNION ALL SELECT p_partkey, 0, 'SECTION', NULL, 'Introdução', 'Objetivo: estudar ' || p_name, p_size FROM p""")
def fn_heading_parse(spark, d):
    """A season's text made of each part: an introduction, an episode with a subsection, and a chapter of exercises."""
    made = F.expr("concat('TEMPORADA ', p_size, ': ', p_type, '\\nObjetivo: estudar ', p_name, '\\nEPISÓDIO ', lpad(cast(p_partkey % 50 as string), 2, '0'), ' – ', upper(left(p_name, 1)), substr(p_name, 2), '. Texto inicial. 1.1 Parte. Fim.\\nCapítulo ', p_size, ': 1. Calcule ', p_name, '.')")
    texts = _spread(T.read(spark, d, "part").select(F.col("p_partkey").alias("id"), made.alias("text")), "id")
    found = sections(texts, "id", "text").select("id", "position", "kind", "number", "title", F.array_join("lines", "|").alias("lines"))
    return found.join(texts.select("id", season(F.col("text"))["number"].alias("season")), "id")


@query("fn_exercise_split", """SELECT p_partkey AS id, 1 AS number, 'Calcule ' || p_name || ' com cuidado.' AS statement, 'a) um|b) dois|c) três|d) ' || p_name || '.' AS options, false AS requires_review FROM part
UNION ALL SELECT p_partkey, 2, 'Explique ' || p_name || ' em detalhe.', '', false FROM part UNION ALL SELECT p_partkey, 3, 'Escolha entre as opções:', 'a) sim|b) não', true FROM part""")
def fn_exercise_split(spark, d):
    """Three items for each part: with a whole set of options, with none, and with too few."""
    made = F.expr("concat('1. Calcule ', p_name, ' com cuidado. a) um b) dois\\nc) três D) ', p_name, '.\\n2) Explique ', p_name, ' em detalhe.\\n03. Escolha entre as opções: a) sim b) não')")
    rows = exercises(_spread(T.read(spark, d, "part").select(F.col("p_partkey").alias("id"), made.alias("body")), "id"), ["id"], "body")
    return rows.select("id", "number", "statement", F.array_join("options", "|").alias("options"), "requires_review")


@query("fn_attempt_expiry", "SELECT essay_id, CASE WHEN essay_id % 3 = 0 THEN at_ + INTERVAL 1 HOUR WHEN essay_id % 3 = 1 THEN least(at_ + INTERVAL 1 HOUR, at_ + INTERVAL 30 MINUTES) END AS expires FROM scores")
def fn_attempt_expiry(spark, d):
    limit = F.expr("if(essay_id % 3 < 2, at + interval 1 hour, null)")
    closes = F.expr("if(essay_id % 3 = 1, at + interval 30 minutes, null)")
    return T.scores(spark, d).select("essay_id", F.least(limit, closes).alias("expires"))


@query("fn_remaining_seconds", "SELECT essay_id, greatest(0, date_diff('second', TIMESTAMP '1998-01-01', at_))::BIGINT AS remaining FROM scores")
def fn_remaining_seconds(spark, d):
    return T.scores(spark, d).select("essay_id", F.greatest(F.lit(0), F.expr("timestampdiff(SECOND, timestamp_ntz'1998-01-01', at)")).cast("long").alias("remaining"))


@query("fn_quota_check", """WITH r AS (SELECT result_id, (count(*) FILTER (difficulty = 'EASY'))::INT AS e, (count(*) FILTER (difficulty = 'MEDIUM'))::INT AS m, (count(*) FILTER (difficulty = 'HARD'))::INT AS h, (max(position) + CASE WHEN result_id % 4 = 1 THEN 1 ELSE 0 END)::INT AS q FROM items GROUP BY 1)
SELECT result_id, CASE WHEN result_id % 16 = 5 THEN 'UNKNOWN_LEVEL' WHEN result_id % 9 = 3 THEN 'NEGATIVE' WHEN e + m + h <> q THEN 'SUM_DIFFERS' ELSE 'VALID' END AS verdict FROM r""")
def fn_quota_check(spark, d):
    """A requested distribution against a requested quantity; some ask for one more, for a level that there isn't, or for less than none."""
    count = lambda k: F.count_if(F.col("difficulty") == k).cast("int")
    rows = T.items(spark, d).groupBy("result_id").agg(*[count(k).alias(k) for k in S.LEVELS], F.max("position").alias("asked"))
    entry = lambda name, n: F.struct(F.lit(name).alias("level"), n.alias("n"))
    levels = [entry(k, F.when((F.col("result_id") % 9 == 3) & F.lit(k == "HARD"), -1).otherwise(F.col(k))) for k in S.LEVELS]
    asked = F.when(F.col("result_id") % 16 == 5, F.array(*levels, entry("EXTREME", F.lit(0)))).otherwise(F.array(*levels))
    quantity = (F.col("asked") + F.when(F.col("result_id") % 4 == 1, 1).otherwise(0)).cast("int")
    return rows.select("result_id", S.quota_verdict(quantity, asked).alias("verdict"))


@query("fn_node_type_check", "SELECT c.id FROM nodes c LEFT JOIN nodes p ON c.parent = p.id WHERE NOT coalesce((c.type = 'DISCIPLINE' AND p.id IS NULL) OR (c.type = 'AREA' AND p.type = 'DISCIPLINE') OR (c.type = 'CONTENT' AND p.type = 'AREA') OR (c.type = 'SUBCONTENT' AND p.type = 'CONTENT' AND p.id <> 'S2'), false)")
def fn_node_type_check(spark, d):
    allowed = spark.createDataFrame([("DISCIPLINE", None), ("AREA", "DISCIPLINE"), ("CONTENT", "AREA"), ("SUBCONTENT", "CONTENT")], "type string, above string")
    nodes = T.nodes(spark, d)
    above = nodes.filter("id <> 'S2' or type <> 'CONTENT'").select(F.col("id").alias("parent"), F.col("type").alias("above"))
    met = nodes.join(above, "parent", "left").alias("n").join(F.broadcast(allowed.alias("a")), F.expr("n.type = a.type and n.above <=> a.above"), "left_anti")
    return met.select("id")


@query("fn_period_start", "SELECT i AS day, CASE i % 4 WHEN 0 THEN t - INTERVAL 30 DAYS WHEN 1 THEN t - INTERVAL 60 DAYS WHEN 2 THEN t - INTERVAL 180 DAYS ELSE date_trunc('year', t)::TIMESTAMP END AS start FROM (SELECT i, TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * i AS t FROM generate_series(0, 365) g(i))")
def fn_period_start(spark, d):
    days = spark.range(366).selectExpr("id as day", "timestamp_ntz'2024-01-01' + make_dt_interval(id) as t")
    start = F.expr("case day % 4 when 0 then t - interval 30 days when 1 then t - interval 60 days when 2 then t - interval 180 days else cast(trunc(t, 'YEAR') as timestamp_ntz) end")
    return days.select("day", start.alias("start"))


@query("fn_as_utc", "SELECT event_id, epoch_us(ts) AS us FROM events")
def fn_as_utc(spark, d):
    """A time without a zone is UTC."""
    return T.read(spark, d, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))


@query("fn_iso", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS iso FROM events")
def fn_iso(spark, d):
    return T.read(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("iso"))


@query("fn_parse_range", "SELECT event_id, ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-09' AS inside FROM events")
def fn_parse_range(spark, d):
    since, until = "2024-01-05", "2024-01-09"
    if since > until:
        raise ValueError("since is after until")
    return T.read(spark, d, "events").select("event_id", F.col("ts").between(F.lit(since).cast("timestamp_ntz"), F.lit(until).cast("timestamp_ntz")).alias("inside"))


@query("fn_sha256_canonical", """SELECT question_id, sha256('{"content":"' || content || '","number":' || number || ',"owner":' || coalesce('"' || owner || '"', 'null') || '}') AS h FROM bank""")
def fn_sha256_canonical(spark, d):
    return T.bank(spark, d).select("question_id", H.sha256(H.canonical_json("number", "owner", "content")).alias("h"))


@query("fn_fingerprint", """SELECT question_id, sha256('{"content": "' || content || '", "number": ' || number || '}') AS h FROM bank""")
def fn_fingerprint(spark, d):
    return T.bank(spark, d).select("question_id", H.sha256(H.spaced_json(number=F.col("number").cast("string"), content=F.concat(F.lit('"'), "content", F.lit('"')))).alias("h"))


@query("fn_data_hash", """SELECT gre, sha256('{"n":' || count(*) || ',"total":' || sum(score) || '}') AS h FROM scores GROUP BY 1""")
def fn_data_hash(spark, d):
    sums = T.scores(spark, d).groupBy("gre").agg(F.sum("score").alias("total"), F.count(F.lit(1)).alias("n"))
    return sums.select("gre", H.sha256(H.canonical_json("total", "n")).alias("h"))


@query("fn_unit_interval", "SELECT c_custkey AS id, substr(sha256(unhex(md5(c_custkey::VARCHAR))), 1, 16) AS head, ('0x' || substr(sha256(unhex(md5(c_custkey::VARCHAR))), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0::DOUBLE AS u FROM customer")
def fn_unit_interval(spark, d):
    h = F.md5(F.col("c_custkey").cast("string"))
    uuid = F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return T.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.substring(F.sha2(F.unhex(h), 256), 1, 16).alias("head"), H.unit_interval(uuid).alias("u"))


@query("fn_json_get_default", "SELECT event_id, coalesce(json_extract_string(props, '$.k')::BIGINT, 0) AS k, coalesce(json_extract_string(props, '$.none')::BIGINT, 0) AS none FROM events")
def fn_json_get_default(spark, d):
    props = F.parse_json("props")
    return T.read(spark, d, "events").select("event_id", *[F.coalesce(F.try_variant_get(props, f"$.{k}", "bigint"), F.lit(0)).alias(k) for k in ("k", "none")])


@query("fn_map_increment", "SELECT student_id, map_from_entries(list((kind, n) ORDER BY kind)) AS counts FROM (SELECT student_id, kind, count(*) AS n FROM history GROUP BY ALL) GROUP BY 1", maps=("counts",))
def fn_map_increment(spark, d):
    from veredas.operators.aggregates import histogram

    return histogram(T.history(spark, d), ["student_id"], "kind", "counts")


@query("fn_array_first3", "SELECT student_id, list(content ORDER BY score, content)[1:3] AS first FROM mastery GROUP BY 1", lists=("first",))
def fn_array_first3(spark, d):
    worst = F.transform(F.array_sort(F.collect_list(F.struct("score", "content"))), lambda x: x["content"])
    return T.mastery(spark, d).groupBy("student_id").agg(F.slice(worst, 1, 3).alias("first"))


QUOTE_SQL = "SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN length(text) < 11 THEN -1 ELSE position(substr(text, 11, 30) IN text) - 1 END AS at_quote FROM documents"


#: Quotes of a text and where they are said to be: as they are, some with a wrong place; their words with other white space; short ones; changed ones.
SPAN_SQL = r"""w AS (SELECT doc_id, text, length(text) AS n, list_filter(regexp_split_to_array(text, '[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'), lambda x: x <> '') AS ws FROM documents),
q AS (SELECT *, CASE doc_id % 5 WHEN 0 THEN substr(text, 11, 30) WHEN 1 THEN substr(text, 11, 30) WHEN 2 THEN array_to_string(ws[4:8], '  ') WHEN 3 THEN array_to_string(ws[2:3], ' ') ELSE substr(text, 11, 30) || '|' END AS quote,
  CASE doc_id % 5 WHEN 0 THEN 10 WHEN 1 THEN (doc_id % 11) * 60 WHEN 3 THEN n // 2 ELSE 0 END::INT AS said FROM w),
r AS (SELECT *, said + length(quote) AS stop, array_to_string(list_filter(regexp_split_to_array(quote, '\s+'), lambda x: x <> ''), ' ') AS tight, regexp_extract_all(text, '\s+') AS gaps, regexp_replace(text, '\s+', ' ', 'g') AS flat FROM q),
x AS (SELECT *, CASE WHEN length(quote) > 0 THEN list_filter(generate_series(0, n - length(quote)), lambda i: text[i + 1:i + length(quote)] = quote) END AS exact,
  CASE WHEN length(tight) > 0 THEN list_filter(generate_series(0, length(flat) - length(tight)), lambda i: flat[i + 1:i + length(tight)] = tight) END AS loose FROM r),
y AS (SELECT *, list_transform(loose, lambda i: {'a': i + coalesce(list_sum(list_transform(gaps[1:length(flat[1:i]) - length(replace(flat[1:i], ' ', ''))], lambda g: length(g) - 1)), 0),
  'b': i + length(tight) + coalesce(list_sum(list_transform(gaps[1:length(flat[1:i + length(tight)]) - length(replace(flat[1:i + length(tight)], ' ', ''))], lambda g: length(g) - 1)), 0)}) AS spans FROM x),
z AS (SELECT *, list_filter(exact, lambda i: abs(i - said) <= 400) AS near, list_filter(spans, lambda s: abs(s.a - said) <= 400) AS near_spans FROM y),
f AS (SELECT doc_id, CASE WHEN length(tight) = 0 THEN NULL WHEN text[said + 1:stop] = quote OR (trim(quote) = quote AND trim(text[said + 1:stop]) = quote) THEN {'a': said + position(quote IN text[said + 1:stop]) - 1, 'b': said + position(quote IN text[said + 1:stop]) - 1 + length(quote)}
  WHEN len(exact) > 0 THEN CASE WHEN len(near) = 1 THEN {'a': near[1], 'b': near[1] + length(quote)} WHEN len(exact) = 1 AND length(trim(quote)) >= 12 THEN {'a': exact[1], 'b': exact[1] + length(quote)} END
  WHEN len(near_spans) = 1 THEN near_spans[1] WHEN len(spans) = 1 AND length(tight) >= 12 THEN spans[1] END AS s FROM z)"""


@query("fn_quote_offset", f"WITH {SPAN_SQL} SELECT doc_id, s.a::BIGINT AS start, s.b::BIGINT AS stop FROM f")
def fn_quote_offset(spark, d):
    """Places of quotes in the texts as they are, for quotes that are there, elsewhere than said, with other white space, often, or not at all."""
    words = F.filter(F.split("text", X.WHITE), lambda w: w != "")
    cut, kind = F.substring("text", 11, 30), F.col("doc_id") % 5
    quote = F.when(kind < 2, cut).when(kind == 2, F.array_join(F.slice(words, 4, 5), "  ")).when(kind == 3, F.array_join(F.slice(words, 2, 2), " ")).otherwise(F.concat(cut, F.lit("|")))
    said = F.when(kind == 0, 10).when(kind == 1, F.col("doc_id") % 11 * 60).when(kind == 3, F.floor(F.length("text") / 2)).otherwise(0).cast("int")
    rows = _docs(spark, d).select("doc_id", "text", quote.alias("quote"), said.alias("said"))
    span = X.quote_span(F.col("text"), F.col("said"), F.col("said") + F.length("quote"), F.col("quote"))
    return rows.select("doc_id", span.alias("s")).select("doc_id", F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("stop"))


@query("fn_quote_offset_all", QUOTE_SQL)
def fn_quote_offset_all(spark, d):
    return _quoted(_docs(spark, d))


def _quoted(docs):
    rows = docs.select("doc_id", "text", F.substring("text", 11, 30).alias("quote"))
    at = F.when(F.col("quote") == "", -1).otherwise(X.quote_offset(F.col("text"), F.col("quote")))
    return rows.select("doc_id", at.cast("long").alias("at_quote"))


@query("fn_minutes_alloc")
def fn_minutes_alloc(spark, d):
    """60 minutes of a session among a student's five weakest contents, by weight."""
    from veredas.operators.keys import first_per_key
    from veredas.operators.planning import allocate_minutes

    worst = first_per_key(T.mastery(spark, d), ["student_id"], [F.asc("score"), F.asc("content")], 5)
    return allocate_minutes(worst.select("student_id", "content", ((100 - F.col("score")) / 100).alias("weight")), "student_id", "content", "weight", 60, 10)


@query("fn_blocks", """SELECT student_id, content, block FROM (SELECT student_id, content, unnest(list_filter([CASE WHEN score < 40 THEN 'STUDY' END, CASE WHEN score < 85 THEN 'PRACTICE' END, CASE WHEN score >= 60 THEN 'REVIEW' END], lambda x: x IS NOT NULL)) AS block FROM mastery)""")
def fn_blocks(spark, d):
    s = F.col("score")
    return T.mastery(spark, d).select("student_id", "content", F.explode(reasons(STUDY=s < 40, PRACTICE=s < 85, REVIEW=s >= 60)).alias("block"))
