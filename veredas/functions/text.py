"""Text as column expressions: normal forms, tokens, markers, headers, options, quality."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Letters of western European languages with their plain forms.
MARKED = "áàâãäåéèêëíìîïóòôõöúùûüçñýÿÁÀÂÃÄÅÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑÝ"
PLAIN = "aaaaaaeeeeiiiiooooouuuucnyyAAAAAAEEEEIIIIOOOOOUUUUCNY"
# Scripts that a text of these languages shouldn't have.
SCRIPTS = r"[\x{0590}-\x{08FF}\x{0900}-\x{0DFF}\x{0E00}-\x{0E7F}\x{10A0}-\x{10FF}\x{1100}-\x{11FF}\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}]"
# Fixed value: a heading of an answer key, alone on its line.
ANSWER_HEADING = r"(?dimu)^[ \t]*(?:gabarito|respostas?(?: comentadas?)?|resolu[cç][aã]o(?: comentada)?)[ \t]*:?[ \t]*$"
SECRETS = r"(sk-[A-Za-z0-9_-]{8,}|(?:postgres(?:ql)?|mysql|redis)://\S+|[0-9a-f]{40})"


@lru_cache(maxsize=1)
def _is_mark() -> np.ndarray:
    """For each code point whether it is a combining character."""
    return np.array([unicodedata.combining(chr(c)) > 0 for c in range(0x110000)])


def _without_marks(text: str) -> str:
    points = np.frombuffer(unicodedata.normalize("NFKD", text).encode("utf-32-le", "surrogatepass"), "<u4")
    return points[~_is_mark()[points]].tobytes().decode("utf-32-le", "surrogatepass")


@F.pandas_udf(StringType())
def _decomposed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else _without_marks(t))


@F.pandas_udf(StringType())
def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def plain(text: Column) -> Column:
    """Compatibility decomposition without marks.

    ASCII is plain already and stays here; other texts go through Python, whose library does a text at a time. A table of thousands of
    characters looked up in place, or a pattern of as many ranges tried at each character, takes many times as long.
    """
    return F.coalesce(_decomposed(F.when(F.octet_length(text) != F.char_length(text), text)), text)


def composed(text: Column) -> Column:
    """Canonical composition. A text without combining marks or rare forms is composed already: it stays here."""
    return F.coalesce(_composed(F.when(text.rlike(r"[\p{M}\x{1100}-\x{11FF}\x{340}-\x{345}\x{374}\x{37E}\x{387}\x{958}-\x{95F}\x{9DC}-\x{9DF}\x{A33}-\x{A5E}\x{B5C}-\x{B5D}\x{F43}-\x{FB9}\x{1F71}-\x{1FFD}\x{2000}-\x{2001}\x{2126}-\x{212B}\x{2329}-\x{232A}\x{2ADC}\x{F900}-\x{FB4E}\x{1D15E}-\x{1D1C0}\x{2F800}-\x{2FA1D}]"), text)), text)


def folded(text: Column) -> Column:
    return plain(F.lower(F.trim(text)))


def _capitals(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.upper(text), r"\s+", " "))


def person_name(text: Column) -> Column:
    return _capitals(plain(text))


def essay_text(text: Column) -> Column:
    """Line ends as \\n, composed, no white space at line ends, trimmed. Doing it twice changes nothing."""
    unix = composed(F.regexp_replace(text, "\r\n?", "\n"))
    return F.regexp_replace(F.regexp_replace(unix, r"(?U)[\s&&[^\n]]+(?=\n)", ""), r"(?U)\A\s+|\s+\z", "")


def single_spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def tokens(text: Column, stop: Sequence[str] = (), least: int = 2) -> Column:
    """Distinct plain words in the order of their first use."""
    found = F.regexp_extract_all(plain(F.lower(text)), F.lit(r"[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) >= least) & ~t.isin(list(stop)) if stop else F.length(t) >= least))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def cpf(text: Column) -> Column:
    """Eleven digits, or null."""
    return F.when(F.length(digits(text)) == 11, digits(text))


def name_like(text: Column) -> Column:
    return text.rlike(r"^\p{L}+(\s+\p{L}+)+$")


def header(text: Column) -> Column:
    """struct(name, cpf) of a header: after its labels; without a name label the longest line that looks like a name."""
    named = F.nullif(F.trim(F.regexp_extract(text, r"(?im)^\s*nome\s*:\s*(.*)$", 1)), F.lit(""))
    lines = F.filter(F.transform(F.split(plain(text), "\n"), _capitals), name_like)
    longest = F.try_element_at(F.array_sort(F.transform(lines, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("line")))), F.lit(1))["line"]
    number = F.regexp_extract(text, r"(\d{3}\.?\d{3}\.?\d{3}-?\d{2})", 1)
    return F.struct(F.coalesce(person_name(named), longest).alias("name"), cpf(number).alias("cpf"))


def scrubbed(text: Column) -> Column:
    return F.regexp_replace(text, SECRETS, "[REDACTED]")


def markers(text: Column) -> Column:
    """Numbers of question markers: ``QUESTÃO 7``, ``7.``, ``7)`` or a number alone, at the start of a line."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?im)^\s*(?:quest[aã]o\s+)?(\d{1,3})\s*(?:[.)]|$)"), F.lit(1)), lambda x: x.cast("int"))


def options(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?m)^\s*([A-Ea-e])\s*[).]"), F.lit(1))


def strange_script(text: Column) -> Column:
    return text.rlike(SCRIPTS)


def before_answer_key(text: Column) -> Column:
    """What comes before the first heading of an answer key or of worked solutions, which stands alone on its line."""
    return F.element_at(F.split(text, ANSWER_HEADING, 2), 1)


def answer_key(text: Column) -> Column:
    """Map from number to letter of ``12 - C`` pairs; the first of a number counts."""
    pair = r"(\d{1,3})\s*[-.:)]\s*([A-E])\b"
    numbers, letters = (F.regexp_extract_all(text, F.lit(pair), F.lit(k)) for k in (1, 2))
    pairs = F.arrays_zip(numbers.alias("n"), letters.alias("l"))
    first = F.filter(pairs, lambda p, i: F.array_position(numbers, p["n"]) == i + 1)
    return F.map_from_entries(first)


def balanced(lengths: Column) -> Column:
    """The longest of three or more options is at most twice the (upper) median."""
    s = F.array_sort(lengths)
    return (F.size(s) < 3) | (F.element_at(s, -1) <= 2 * F.element_at(s, F.floor(F.size(s) / 2).cast("int") + 1))


def overlap(query: Column, node: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(query, node)), F.size(node)), F.lit(0.0))


def phrases_in(text: Column, phrases: Sequence[str]) -> Column:
    return F.filter(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(text, p))


# How far from the claimed place a quote is looked for, and the length from which its only occurrence counts anywhere.
DRIFT = 400
DISTINCTIVE = 12
#: A run of white space, with the four separators that only some engines count.
WHITE = r"[\p{IsWhite_Space}\x{1C}-\x{1F}]+"


def _literal(text: Column) -> Column:
    return F.concat(F.lit(r"\Q"), F.replace(text, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{WHITE}|{WHITE}\z", "")


def occurrences(text: Column, pattern: Column, near: Column, drift: int = DRIFT) -> Column:
    """struct(n, first, near_n, near): how often a pattern occurs, its first place, and the same within ``drift`` of a place.

    Occurrences may overlap. The text is split before each of them, so a place is the sum of the lengths before it, in characters
    of the text as it is.
    """
    pieces = F.split(text, F.concat(F.lit("(?="), pattern, F.lit(")")), -1)
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("first"), F.lit(0).alias("near_n"), F.lit(None).cast("int").alias("near"))
    leads = F.regexp_instr(text, F.concat(F.lit(r"\A(?:"), pattern, F.lit(")"))) == 1  # an empty piece before the first place isn't given

    def add(s: Column, piece: Column) -> Column:
        here = (s["i"] > 0) | leads
        close = here & (F.abs(s["at"] - near) <= drift)
        return F.struct(
            (s["at"] + F.length(piece)).alias("at"), (s["i"] + 1).alias("i"), (s["n"] + here.cast("int")).alias("n"), F.coalesce(s["first"], F.when(here, s["at"])).alias("first"),
            (s["near_n"] + close.cast("int")).alias("near_n"), F.coalesce(s["near"], F.when(close, s["at"])).alias("near"),
        )

    return F.aggregate(pieces, start, add)


def _loose(quote: Column) -> tuple[Column, Column]:
    """A quote's words, and the pattern of them with any white space between."""
    words = F.filter(F.split(quote, WHITE), lambda w: w != "")
    return words, F.array_join(F.transform(words, _literal), WHITE)


def quote_offset(text: Column, quote: Column) -> Column:
    """Where the quote first starts (from 0), else where it does with runs of white space as any other, in the text as it is; -1 if nowhere."""
    exact = F.position(quote, text)
    words, loose = _loose(quote)
    return F.when(exact > 0, exact - 1).when(F.size(words) > 0, F.regexp_instr(text, loose) - 1).otherwise(-1)


def _only(found: Column, length: Column) -> Column:
    """The one occurrence near the claimed place, or the only one of a long quote; null if it is open which one is meant."""
    return F.when(found["near_n"] == 1, found["near"]).when((found["n"] == 1) & (length >= DISTINCTIVE), found["first"])


def quote_span(text: Column, start: Column, end: Column, quote: Column) -> Column:
    """struct(start, end): the place that a quote has in the text, from 0, the end not in it; null if there is none or it is open which.

    ``start`` and ``end`` are where it is said to be: that holds if the quote is there, give or take white space around it. Else
    its only occurrence within DRIFT characters of ``start`` counts, or, of a quote of DISTINCTIVE characters, its only one at all. A quote
    that is nowhere is looked for with each run of white space as any other; the place is one in the text as it is.
    """
    start = F.greatest(start, F.lit(0))
    said = F.substring(text, start + 1, F.greatest(end - start, F.lit(0)))
    tight = F.when(said == quote, start).when((quote == _trimmed(quote)) & (_trimmed(said) == quote), start + F.position(quote, said) - 1)
    exact = occurrences(text, _literal(quote), start)
    words, loose = _loose(quote)
    spread = occurrences(text, loose, start)
    at = _only(spread, F.length(F.array_join(words, " ")))
    length = F.length(F.regexp_substr(F.substring(text, at + 1, F.length(text)), F.concat(F.lit(r"\A(?:"), loose, F.lit(")"))))
    place = lambda a, n: F.when(a.isNotNull(), F.struct(a.cast("int").alias("start"), (a + n).cast("int").alias("end")))
    n = F.length(quote)
    found = F.when(tight.isNotNull(), place(tight, n)).when(exact["n"] > 0, place(_only(exact, F.length(_trimmed(quote))), n)).otherwise(place(at, length))
    return F.when(F.size(words) > 0, found)


def painted(tokens: Column) -> Column:
    """The text of tokens (start, end, text) on blanks as long as the last end, each painted over those before it, trimmed.

    What a token has beyond the last end is left out. Tokens that don't overlap are put side by side with the blanks between; only
    where some do, each place takes the last token that covers it.
    """
    ends = F.transform(tokens, lambda t: F.greatest(t["end"], F.lit(0)))
    length = F.array_max(ends)
    spans = F.filter(
        F.transform(tokens, lambda t, i: F.struct(t["start"].alias("start"), F.least(t["start"] + F.length(t["text"]), length).alias("stop"), i.alias("i"), t["text"].alias("text"))),
        lambda t: t["stop"] > t["start"],
    )
    ordered = F.array_sort(spans)
    apart = F.forall(F.sequence(F.lit(1), F.size(ordered) - 1), lambda i: F.get(ordered, i)["start"] >= F.get(ordered, i - 1)["stop"])
    disjoint = (F.size(ordered) < 2) | apart
    gap = lambda t, i: F.repeat(F.lit(" "), t["start"] - F.when(i > 0, F.get(ordered, i - 1)["stop"]).otherwise(0))
    side = F.array_join(F.transform(ordered, lambda t, i: F.concat(gap(t, i), F.substring(t["text"], F.lit(1), t["stop"] - t["start"]))), "")

    def letter(at: Column) -> Column:
        over = F.filter(spans, lambda t: (t["start"] <= at) & (at < t["stop"]))
        top = F.get(over, F.size(over) - 1)
        return F.when(F.size(over) > 0, F.substring(top["text"], at - top["start"] + 1, F.lit(1))).otherwise(" ")

    layered = F.array_join(F.transform(F.sequence(F.lit(0), length - 1), letter), "")
    return F.when((F.size(tokens) == 0) | tokens.isNull() | (length == 0), "").otherwise(_trimmed(F.when(disjoint, side).otherwise(layered)))


def letter_share(text: Column) -> Column:
    solid = F.length(F.regexp_replace(text, r"\s+", ""))
    return F.round(F.try_divide(F.length(F.regexp_replace(text, r"[^\p{L}]+", "")), solid), 4)


# Heads of questions and their options in text layers, names of glyphs that a font left open, and words.
LAYER_HEAD = r"(?miu)^\s*quest[ãÃ]o\s+(\d+)\s*"
LAYER_OPTION = r"(?m)^\s*([A-E])\s{2,}(?=\S)"
GLYPH = r"/g\d+"
WORD_LIKE = r"\A[A-Za-zÀ-ÿ]{2,}\z"
OPTIONS = "ABCDE"


def quality(text: Column) -> Column:
    """struct of what tells a good text layer: chars, letters, solid (not white space), glyphs, legibility, words, headers, numbers, first, last, runs.

    legibility: letters among solid characters; words: the share of words of letters alone; both 1 where there is nothing. runs: questions
    whose options have A to E one after the other.
    """
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("long")
    words = F.filter(F.split(text, WHITE), lambda w: w != "")
    numbers = F.transform(F.regexp_extract_all(text, F.lit(LAYER_HEAD), F.lit(1)), lambda n: n.cast("long"))
    bodies = F.split(text, LAYER_HEAD, -1)
    letters_of = lambda body: F.array_join(F.regexp_extract_all(body, F.lit(LAYER_OPTION), F.lit(1)), "")
    runs = F.size(F.filter(F.slice(bodies, F.lit(2), F.size(bodies)), lambda b: F.contains(letters_of(b), F.lit(OPTIONS))))
    share = lambda part, whole: F.round(F.coalesce(F.try_divide(part, whole), F.lit(1.0)), 4)
    letters, solid = count(r"\p{L}"), F.length(F.regexp_replace(text, WHITE, "")).cast("long")
    return F.struct(
        F.length(text).cast("long").alias("chars"), letters.alias("letters"), solid.alias("solid"), count(GLYPH).alias("glyphs"), share(letters, solid).alias("legibility"),
        share(F.size(F.filter(words, lambda w: w.rlike(WORD_LIKE))), F.size(words)).alias("words"), F.size(numbers).cast("long").alias("headers"), F.size(F.array_distinct(numbers)).cast("long").alias("numbers"),
        F.array_min(numbers).alias("first"), F.array_max(numbers).alias("last"), runs.cast("long").alias("runs"),
    )
