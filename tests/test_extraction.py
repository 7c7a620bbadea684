"""Question extraction and lexical classification on texts whose results are known."""

import time

import pytest
from pyspark.sql import functions as F

from veredas.functions import extraction, text
from veredas.operators import lexical

LONG = "Esta é a questão real, com bastante texto substantivo e conteúdo relevante para a disciplina em questão, sem qualquer duvida quanto a sua validade como pergunta de exame."
FOUR = ["A", "B", "C", "D"]
TEXTS = {
    "styles": "1.   Primeira questão com texto suficiente para ser válida.\n\n(2)   Segunda questão, formato parêntese, com texto suficiente.\n\nQuestão 3: Terceira questão, formato por extenso, texto suficiente.\n",
    "decimal": "1.   Questão real com texto longo o suficiente para ser válida.\n\n1.1 Isto é uma subseção teórica, não uma questão nova.\nMais texto da subseção que não deve virar outra questão.\n",
    "thousands": "7. Uma cidade tinha\n281.472 pessoas e passou a ter\n50.000 pessoas.\n",
    "twice": f"5. Um passo curto\n5. Resolva algo\n\n5.   {LONG}\n",
    "rules": "13. Na parte superior da carteira, ficarão somente a caneta transparente, o documento de identidade, o caderno de prova e a folha de respostas.\n14. Outra regra qualquer do mesmo tipo.\n13.   A soma dos divisores positivos do número 9438 é igual a\nA) 25.\nB) 29.\nC) 18.\nD) 26.\n",
    "five": "1.   Qual a resposta correta?\na) primeira alternativa\nb) segunda alternativa\nc) terceira alternativa\nd) quarta alternativa\ne) quinta alternativa\n",
    "tabs": "1. Texto do enunciado.\nA\tum\nB\tdois\nC\ttrês\nD\tquatro\n",
    "article": "1. Leia o texto.\nA lei impulsiona o setor.\nA um\nB dois\nC três\nD quatro\n",
    "lower": "1. Leia.\na lei impulsiona o setor\nA) um\nB) dois\nC) três\nD) quatro\n",
    "inline": "1. Qual o valor?\n(A) 0,07 (B) 0,13 (C) 0,26 (D) 0,38\n",
    "alone": "1. Qual?\nA)\num\nB)\ndois\nC)\ntrês\nD)\nquatro\n",
    "grid": "1. Qual a medida?\na)\t6 cm.\nc)\t10 cm.\n\nb)\t8 cm.\nd)\t12 cm.\n",
    "boxes": "1. Choose.\nA (   ) honest.\nC (   ) kind.\nB (   ) dishonest.\nD (   ) cold.\n",
    "repeated": "1. Qual das alternativas?\nA) um\nA) dois\nB) três\nC) quatro\nC) cinco\n",
    "stray": "1. Veja a figura (A) acima e responda.\n",
    "lone number": "3\ue000\n\nExplique com suas palavras o processo descrito no texto acima.\n",
    "no space": "Questão33\nExplique.\n",
    "garbled": "1. Calcule o valor de \u0b15 no intervalo indicado pelo enunciado.\n",
    "leak": "4. resto da anterior. 4. Agora a questão de verdade começa aqui.\n",
    "none": "Nenhuma questão aqui.",
    "null": None,
    "empty": "",
}


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame(list(TEXTS.items()), "name string, sheet string")
    out = {}
    for r in extraction.questions(df, "name", "sheet").collect():
        out.setdefault(r["name"], {})[r["number"]] = r
    return out


def labels(q):
    return [o["label"] for o in q["options"]]


@pytest.mark.parametrize("name,numbers", [("styles", {1, 2, 3}), ("decimal", {1}), ("thousands", {7}), ("twice", {5}), ("rules", {13, 14}), ("lone number", {3}), ("no space", {33})])
def test_numbers(found, name, numbers):
    assert set(found[name]) == numbers


def test_texts_without_questions(found):
    assert not {"none", "null", "empty"} & set(found)


def test_styles(found):
    assert [found["styles"][n]["style"] for n in (1, 2, 3)] == ["PERIOD", "PAREN", "WORD"]
    assert [found["styles"][n]["preceded"] for n in (1, 2, 3)] == [False, True, True]


def test_duplicates(found):
    assert "questão real" in found["twice"][5]["body"] and found["twice"][5]["preceded"]
    assert "soma dos divisores" in found["rules"][13]["statement"] and labels(found["rules"][13]) == FOUR


@pytest.mark.parametrize("name", ["tabs", "article", "lower", "inline", "alone", "grid", "boxes"])
def test_option_forms(found, name):
    q = found[name][1]
    assert labels(q) == FOUR and q["kind"] == "multiple_choice"


def test_option_texts(found):
    assert [o["text"] for o in found["grid"][1]["options"]] == ["6 cm.", "8 cm.", "10 cm.", "12 cm."]
    assert [o["text"] for o in found["inline"][1]["options"]] == ["0,07", "0,13", "0,26", "0,38"]
    assert [o["text"] for o in found["boxes"][1]["options"]] == ["honest.", "dishonest.", "kind.", "cold."]
    assert found["five"][1]["options"][0]["text"] == "primeira alternativa" and labels(found["five"][1]) == [*FOUR, "E"]
    assert found["article"][1]["statement"] == "Leia o texto. A lei impulsiona o setor."


def test_no_options_are_made_up(found):
    assert not labels(found["repeated"][1]) and not labels(found["stray"][1])
    assert "(A) acima" in found["stray"][1]["statement"]


def test_flags_and_status(found):
    assert "garbled_encoding" in found["garbled"][1]["flags"] and found["garbled"][1]["status"] == "REVIEW_REQUIRED"
    assert {"orphan_prefix_contamination", "possible_missing_content"} <= set(found["leak"][4]["flags"])
    assert found["five"][1]["confidence"] == pytest.approx(0.65) and found["five"][1]["status"] == "VALIDATED"
    lone = found["lone number"][3]
    assert lone["style"] == "STANDALONE" and lone["confidence"] == pytest.approx(0.65) and lone["kind"] == "discursive"
    assert all(0 <= q["confidence"] <= 1 for qs in found.values() for q in qs.values())


def test_answer_key_is_cut_at_its_heading(spark):
    sheets = ["1. Questão.\n\nGabarito:\n\nResposta: [A]\n", "o gabarito da prova\nfim", "a\n respostas comentadas \nb", "a\nResolução:\nb", "a\nRespostas da questão\nb"]
    df = spark.createDataFrame(list(enumerate(sheets)), "i int, t string")
    got = {r["i"]: r["x"] for r in df.select("i", text.before_answer_key(df["t"]).alias("x")).collect()}
    assert [got[i] for i in range(5)] == ["1. Questão.\n\n", sheets[1], "a\n", "a\n", sheets[4]]


def test_normal_forms(spark):
    import unicodedata

    rows = ["Çédille ñ", "ﬁm ½ ①", "e\u0301 a\u0308", "Ŵ ẞ ǅ", "plain", None, "x \u00a0\r\n y\t\n\nz  "]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, t string")
    got = {r["i"]: r for r in df.select("i", text.plain(df["t"]).alias("p"), text.essay_text(df["t"]).alias("e")).collect()}
    for i, t in enumerate(rows):
        if t is None:
            assert got[i]["p"] is None and got[i]["e"] is None
            continue
        assert got[i]["p"] == "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
        lines = unicodedata.normalize("NFC", t.replace("\r\n", "\n").replace("\r", "\n")).split("\n")
        assert got[i]["e"] == "\n".join(x.rstrip() for x in lines).strip()


NODES = [
    ("BIO", None, "DISCIPLINE", "Biologia", None), ("CEL", "BIO", "AREA", "Biologia Celular", None), ("ORG", "CEL", "CONTENT", "Organelas", "estruturas da célula"),
    ("MIT", "ORG", "SUBCONTENT", "Mitocôndrias", "respiração e energia"), ("RIB", "ORG", "SUBCONTENT", "Ribossomos", "síntese de proteínas"), ("QUI", None, "DISCIPLINE", "Química", None),
]


def test_lexical_candidates(spark):
    nodes = spark.createDataFrame(NODES, "id string, parent string, type string, name string, description string")
    asked = spark.createDataFrame([("As mitocôndrias produzem energia na respiração",), ("Organelas do meio celular",), ("Aula de química",), ("nada aqui",)], "q string")
    found = {}
    for r in lexical.candidates(asked, "q", nodes).collect():
        found.setdefault(r["q"], []).append((r["rank"], r["id"], r["score"]))
    # 100 + 20 for the name + 2 * 10 for the description + depth 4 + 10 for the first word of three letters or more
    assert sorted(found["As mitocôndrias produzem energia na respiração"]) == [(1, "MIT", 100 + 20 + 20 + 4 + 10)]
    # a content: 20 + depth 3 + 10 - 2; an area by a general term alone: not above zero
    assert sorted(found["Organelas do meio celular"]) == [(1, "ORG", 31)]
    assert "Aula de química" not in found and "nada aqui" not in found
    first = lexical.candidates(asked, "q", nodes, most_broadcast=0).collect()
    assert len(first) == 2


def test_ranks_match_a_plain_score(spark):
    """All candidates of many texts against plain Python, ties by path."""
    import random
    import re
    import unicodedata

    draw = random.Random(2)
    pool = ["celula", "energia", "ribossomos", "atomos", "reacoes", "funcao", "grafico", "limite", "ondas", "luz"]
    nodes = [(f"D{i}", None, "DISCIPLINE", " ".join(draw.sample(pool, 2)), None) for i in range(3)]
    for kind, up, n in (("AREA", "D", 5), ("CONTENT", "A", 8), ("SUBCONTENT", "C", 20)):
        above = [x for x in nodes if x[0][0] == up]
        nodes += [(f"{kind[0]}{i}", draw.choice(above)[0], kind, " ".join(draw.sample(pool, 2)), draw.choice([None, " ".join(draw.sample(pool, 3))])) for i in range(n)]
    texts = sorted({" ".join(draw.choices(pool, k=5)) for _ in range(30)})

    def terms(t):
        t = unicodedata.normalize("NFKD", t or "").encode("ascii", "ignore").decode().lower()
        out = [w for w in re.findall("[a-z0-9]+", t) if len(w) >= 3]
        return [w[:-3] + "ao" if w.endswith("oes") else w[:-2] if w.endswith("es") else w.removesuffix("s") for w in out]

    by = {n[0]: n for n in nodes}
    want = []
    for t in texts:
        asked, scored = terms(t), []
        for n in nodes:
            path = [n]
            while path[0][1]:
                path.insert(0, by[path[0][1]])
            held = {w for p in path[:-1] for w in terms(f"{p[3]} {p[4] or ''}")}
            label, about = (set(asked) & set(terms(x)) - held for x in (n[3], n[4]))
            if not label | about:
                continue
            leaf = n[2] == "SUBCONTENT"
            score = 100 * leaf + 20 * len(label) + 10 * len(about) + len(path) + max(0, 10 - min(asked.index(w) for w in label | about))
            score -= 0 if leaf else 2 + 40 * ((label | about) <= set(lexical.GENERAL_TERMS))
            if score > 0:
                codes = {p[2]: p[0] for p in path}
                scored.append((-score, [codes.get(k, "") for k in lexical.TYPES], n[0]))
        want += [(t, k, node, -s) for k, (s, _, node) in enumerate(sorted(scored), 1)]
    df = lexical.candidates(spark.createDataFrame([(t,) for t in texts] * 2, "q string"), "q", spark.createDataFrame(nodes, "id string, parent string, type string, name string, description string"))
    assert sorted((r["q"], r["rank"], r["id"], r["score"]) for r in df.collect()) == sorted(want)


ACCENTED = "a coração São João É Ünïcode straße ação não está além "  # every text of these languages has some


def _seconds(spark, column):
    """Of a text of 4 million characters. Looking each character up in place took over 5 seconds a million."""
    df = spark.createDataFrame([(ACCENTED * 70_000,)], "text string").localCheckpoint()
    spark.range(1).select(text.plain(F.lit("é"))).collect()  # Python has started
    began = time.time()
    df.select(column(F.col("text")).alias("x")).write.format("noop").mode("overwrite").save()
    return time.time() - began


def test_tokens_of_long_texts_are_quick(spark):
    assert _seconds(spark, lambda t: text.tokens(t, ("de",))) < 8


def test_names_of_long_texts_are_quick(spark):
    assert _seconds(spark, text.person_name) < 8


def test_terms_of_long_texts_are_quick(spark):
    assert _seconds(spark, lexical.terms) < 8


def test_terms_are_found_in_one_pass(spark):
    """Short words are never made, and only texts with other than ASCII characters are searched for them."""
    texts = ["Razões são 漢字 iguais", "ab cd", "Straße-Quest\u0131on\u00a0abc\u212a", "A b2 cde12s\tOES coes", "", None]
    found = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", lexical.terms(F.col("t")).alias("x"), lexical.terms(F.col("t"), 1).alias("y"))
    got = {r["i"]: (r["x"], r["y"]) for r in found.collect()}
    assert [got[i][0] for i in range(6)] == [["razao", "sao", "iguai"], [], ["strae", "queston", "abck"], ["cde12", "ao", "cao"], [], []]
    assert got[1][1] == ["ab", "cd"] and got[3][1][:2] == ["a", "b2"]
    plan = found._jdf.queryExecution().analyzed().toString()
    assert "filter(" not in plan and "octet_length" in plan.split("lower(")[0]


def test_marks_are_taken_apart_without_a_pattern(spark):
    found = extraction.with_options(spark.createDataFrame([("Qual?\nA) um\nb. dois\n(C) três\nD- quatro\n",)], "body string"), "body")
    assert [tuple(o) for o in found.first()["options"]] == [("A", "um"), ("B", "dois"), ("C", "três"), ("D", "quatro")]
    assert "split(lambda" not in found._jdf.queryExecution().analyzed().toString()


def test_letter_share_takes_runs_at_once(spark):
    df = spark.createDataFrame([("0" * 1000 + "  ab\n c",)], "t string").select(text.letter_share(F.col("t")).alias("s"))
    assert df.first()["s"] == 0.003 and r"\s+" in df._jdf.queryExecution().analyzed().toString()
