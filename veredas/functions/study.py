"""What a student's request asks for, and which catalogue entries a controlled vocabulary finds in a text."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from veredas.operators.lexical import terms

# Fixed values of the domain: words by which a request is understood, in the order in which they are tried.
INTENTS = {"STUDY": ("quero estudar", "quero aprender"), "PRACTICE": ("quero praticar",), "REVIEW": ("quero revisar",)}
DISCIPLINES = {
    "Matemática": ("matematica", "matemática", "álgebra", "algebra", "equação", "equações", "fração", "frações", "função", "funções", "geometria", "derivada", "derivadas"),
    "Química": ("quimica", "química", "solução", "soluções", "diluição", "reação", "reações", "mol", "molaridade", "concentração"),
    "História": ("historia", "história", "revolução", "revolução industrial", "imperialismo", "colonialismo"),
    "Biologia": ("biologia", "genética", "ecologia", "celula", "célula"),
    "Física": ("fisica", "física", "mecânica", "movimento", "energia"),
    "Geografia": ("geografia", "mapa", "território", "urbanização"),
    "Português": ("portugues", "português", "literatura", "texto", "interpretação"),
    "Inglês": ("ingles", "inglês", "grammar", "vocabulary", "reading"),
    "Artes": ("arte", "artes", "música", "musica"),
    "Filosofia": ("filosofia", "ética", "pensamento"),
    "Sociologia": ("sociologia", "sociedade", "trabalho"),
}
DIFFICULTY = {
    "EASY": ("fácil", "facil", "fáceis", "facis", "simples", "iniciante", "básico", "basico"),
    "MEDIUM": ("médio", "media", "média", "intermediário", "intermediario", "nivel medio", "nível médio", "nível medio"),
    "HARD": ("difícil", "dificeis", "difíceis", "desafio", "avançado", "complexo"),
}
UPPER_SCHOOL = ("ensino médio", "ensino medio", "ensino-medio")
# Points of a vocabulary match.
PRIMARY, SPECIFIC, CONTEXTUAL, SEVERAL = 60, 30, 50, 10


def _first(text: Column, words: Mapping[str, Sequence[str]], rest: str, holds=F.contains) -> Column:
    out = F
    for label, found in words.items():
        for w in found:
            out = out.when(holds(text, F.lit(w)), label)
    return out.otherwise(rest)


def request(text: Column) -> Column:
    """struct(intent, discipline, grade_level, difficulty, resource_type) of a request; a null or blank one is a SEARCH for all."""
    low = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+", " "))
    intent = _first(F.concat(F.lit(" "), low), {k: tuple(f" {w}" for w in v) for k, v in INTENTS.items()}, "SEARCH")
    kind = (
        F.when(F.contains(low, F.lit("video")) | F.contains(low, F.lit("vídeo")), "VIDEO").when(F.contains(low, F.lit("questões")) | F.contains(low, F.lit("questoes")) | (intent == "PRACTICE"), "QUESTION")
        .when(intent.isin("STUDY", "REVIEW"), "MATERIAL").otherwise("ALL")
    )
    grade = _first(low, {"Ensino Médio": UPPER_SCHOOL}, "Ensino Fundamental")
    return F.struct(intent.alias("intent"), _first(low, DISCIPLINES, "Geral").alias("discipline"), grade.alias("grade_level"), _first(low, DIFFICULTY, "MEDIUM").alias("difficulty"), kind.alias("resource_type"))


@dataclass(frozen=True)
class Vocabulary:
    """A catalogue entry's phrases. Generic ones are reported, but never make a match."""

    code: str
    primary: tuple[str, ...] = ()
    specific: tuple[str, ...] = ()
    contextual: tuple[str, ...] = ()
    generic: tuple[str, ...] = ()


def _singular(term: str) -> str:
    return term[:-3] + "ao" if term.endswith("oes") else term[:-2] if term.endswith("es") else term[:-1] if term.endswith("s") else term


def phrase(text: str) -> str:
    """A phrase in the form of ``operators.lexical.terms``, joined by blanks; for the few phrases of a vocabulary."""
    ascii_only = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode().lower()
    return " ".join(_singular(t) for t in re.findall("[a-z0-9]+", ascii_only) if len(t) >= 3)


def vocabulary_match(text: Column, entry: Vocabulary) -> Column:
    """struct(code, primary, specific, contextual, generic_ignored, score), or null where no phrase but generic ones is in the text."""
    words = terms(text)
    line = F.array_join(words, " ")

    def found(phrases: Sequence[str]) -> Column:
        forms: dict[str, str] = {}
        for p in phrases:
            forms.setdefault(phrase(p), p)  # of two phrases of one form the first counts
        hits = [F.when(F.contains(line, F.lit(form)), F.lit(p)) for form, p in forms.items()]
        return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")

    primary, specific, contextual = (found(p) for p in (entry.primary, entry.specific, entry.contextual))
    generic = [F.when(F.array_contains(words, phrase(g)), F.lit(g)) for g in entry.generic]
    n = F.size(primary) + F.size(specific) + F.size(contextual)
    score = F.size(primary) * PRIMARY + F.size(specific) * SPECIFIC + F.size(contextual) * CONTEXTUAL + F.when(n > 1, SEVERAL).otherwise(0)
    ignored = F.array_compact(F.array(*generic)) if generic else F.array().cast("array<string>")
    whole = F.struct(F.lit(entry.code).alias("code"), primary.alias("primary"), specific.alias("specific"), contextual.alias("contextual"), ignored.alias("generic_ignored"), score.cast("long").alias("score"))
    return F.when(n > 0, whole)
