"""Token counts, language ID, language model, fingerprints, toxicity and the pipeline against plain Python or held-out rows."""

import hashlib
import math
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

from tests.llm import brute
from veredas.llm import language_id, piecewise_hash, queries, suffix_tree, token_counts, toxicity

SCHEMA = "doc_id long, text string, lang string, source string"
ODD = [
    (1, "Hello world. This is good.", "en", "x"), (1, "Hello world. This is good.", "en", "x"), (1, "other text", "en", "x"), (2, None, None, None), (None, "no id here", "en", "y"),
    (3, "", None, ""), (4, " \t\n ", "en", "y"), (5, "123 456 !!", "en", "x"), (6, "Ünïcode ß 漢字 \U0001f600 ▁▁ <s> </s> <unk>", "de", "z"), (7, "the " * 40_000, "en", "x"), (8, "x" * 3000, "en", "x"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).withColumns({c: F.lit("?") for c in ("held_out", "score", "p", "chunk", "part", "n", "tie", "toxic")})


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def more(spark, sf):
    return sf.replace("sf0.001", "sf0.01")


def test_token_counts(docs, odd):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(token_counts.MODEL))
    for df in (docs, odd):
        rows = df.select("doc_id", "text").collect()
        want = sorted(str((d, len((t or "").encode()), n := len(library.encode(t or "")), n > 4096)) for d, t in rows)
        for chunk in (token_counts.CHUNK, 200):
            assert sorted(str(tuple(r)) for r in token_counts.token_counts(df, chunk=chunk, overlap=16).collect()) == want


@pytest.mark.parametrize("text", ["", " ", "  a", "a  b   ", "▁a ▁ b", "日本語" * 400, "a\u0000b", "\t\n x", "é" * 500, "x " * 500, " " * 1000, "ab" * 2000])
def test_chunks_are_spliced_exactly(text):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(token_counts.MODEL))
    for chunk, overlap in ((50, 3), (64, 16)):
        assert token_counts.counts([text], chunk=chunk, overlap=overlap) == [len(library.encode(text))]


@pytest.mark.parametrize("kind", ["letters", "han", "mixed", "words", "run"])
def test_huge_texts_in_bounded_chunks(kind):
    """Texts without spaces too: the library's count, and no more encoded at a time than chunks and overlaps are long."""
    draw = np.random.default_rng(7)
    text = {
        "letters": lambda: "".join(draw.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"), 300_000)),
        "han": lambda: "".join(map(chr, draw.integers(0x4E00, 0x9FFF, 60_000))),
        "mixed": lambda: "".join(draw.choice(["é", "\U0001f600", "漢", "字", "the", " ", "  ", "▁", "\n", "quick", "a", "aa"], 100_000)),
        "words": lambda: " ".join(draw.choice(["alpha", "beta", "un", "antidisestablishmentarianism"], 60_000)),
        "run": lambda: "x " * 10_000 + "a" * 90_000 + " end" * 10_000,
    }[kind]()
    counter = token_counts._counter(token_counts.MODEL)
    encode, longest, all_ = counter.offsets, [0], [0]

    def watched(data, start, end):
        longest[0], all_[0] = max(longest[0], end - start), all_[0] + end - start
        return encode(data, start, end)

    counter.offsets = watched
    try:
        found = counter.chunked(text, 8192, 64)
    finally:
        del counter.offsets
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(token_counts.MODEL))
    assert found == len(library.encode(text))
    assert longest[0] <= (400_000 if kind == "run" else 3 * 8192) and all_[0] <= (6 if kind == "run" else 3) * len(text.encode())


def test_languages_on_held_out_rows(spark, more):
    found = queries.QUERIES["op4_language_id"](spark, more)
    rows = found.join(spark.read.parquet(f"{more}/documents.parquet").select("doc_id", "lang", "text"), "doc_id").filter("held_out and lang is not null and text rlike '[a-z]'").collect()
    assert rows and sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_languages_of_odd_rows(odd):
    found = language_id.languages(odd).collect()
    assert len(found) == len(ODD)
    und = [r for r in found if r["doc_id"] in (2, 3, 4, 5)]
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in und)
    assert all(r["held_out"] == (brute.rest(r["doc_id"], 4) == 2) for r in found)
    assert all(r["lang_pred"] in ("en", "de") for r in found if r["doc_id"] not in (2, 3, 4, 5))
    kept = language_id.accepted(odd)
    assert kept.columns == odd.columns and not {r["doc_id"] for r in kept.collect()} & {2, 3, 4, 5}


def brute_languages(train, texts):
    """(language, score) by the definition, from (language, text) of the training rows."""
    split = lambda t: "".join(c if c.isalpha() else " " for c in (t or "").lower()).split()
    langs = sorted({x for x, _ in train})
    share = {x: sum(y == x for y, _ in train) / len(train) for x in langs}
    tables = {k: {x: Counter() for x in langs} for k in (0, *language_id.ORDERS)}
    for lang, t in train:
        for w in split(t):
            tables[0][lang][w] += 1
            for n in language_id.ORDERS:
                tables[n][lang].update(language_id.grams(w, n))
    known = {k: set().union(*x.values()) for k, x in tables.items()}
    sums = {k: {x: sum(c.values()) for x, c in t.items()} for k, t in tables.items()}
    log = lambda k, x, g: math.log((tables[k][x][g] + 0.5) / (sums[k][x] + 0.5 * len(known[k]) + 1e-9))
    out = []
    for t in texts:
        total = {x: math.log(share[x]) for x in langs}
        found = split(t)
        for w in found:
            if w in known[0]:
                add = {x: log(0, x, w) for x in langs}
            else:
                hits = next((h for n in language_id.ORDERS if (h := [(n, g) for g in language_id.grams(w, n) if g in known[n]])), [])
                add = {x: sum(log(n, x, g) for n, g in hits) / len(hits) if hits else 0.0 for x in langs}
            for x in langs:
                total[x] += add[x]
        best = max(langs, key=lambda x: total[x])
        out.append((best, 1 / sum(math.exp(v - total[best]) for v in total.values())) if found else ("und", 0.0))
    return out


def test_languages_by_brute_force(spark, docs, odd):
    """With a sample that takes every labelled row."""
    few = [(r["doc_id"], r["text"], r["lang"]) for df in (docs.limit(120), odd) for r in df.collect()]
    few += [(1000 + i, t, None) for i, t in enumerate(["½", "²①Ⅷ", "a½b xyz", "ſtraße Ωmega", "12 _ 34"])]
    want = brute_languages([(x, t) for d, t, x in few if x is not None and t is not None and brute.rest(d, 4) != 2], [t for _, t, _ in few])
    found = language_id.languages(spark.createDataFrame(few, "doc_id long, text string, lang string"), sample=10**9).collect()
    got = sorted((str(r["doc_id"]), r["lang_pred"], round(r["score"], 3)) for r in found)
    assert got == sorted((str(d), x, round(s, 3)) for (d, _, _), (x, s) in zip(few, want, strict=True))
    assert {r["lang_pred"] for r in found if r["doc_id"] in (1000, 1001, 1004)} == {"und"}


def test_nothing_learned(spark):
    rows = spark.createDataFrame([(1, "text", None, "x")], SCHEMA)
    assert language_id.languages(rows).first()["lang_pred"] == "und"
    none = spark.createDataFrame([], SCHEMA)
    assert language_id.languages(none).count() == token_counts.token_counts(none).count() == suffix_tree.language_model_scores(none).count() == piecewise_hash.fingerprints(none).count() == 0


def test_words_come_before_grams():
    tables = {k: ({"<a": 0, "a": 0}, np.log(np.array([[0.9, 0.1]]))) for k in language_id.ORDERS}
    model = language_id.Model(["l", "m"], [0.5, 0.5], ({"a": 0}, np.log(np.array([[0.1, 0.9]]))), tables)
    assert model.predict("a")[0] == "m" and model.predict("ab")[0] == "l"


def test_lm_scoring_splits_a_text_once(monkeypatch):
    """A chunk's answers are looked up in one pass over the words of its texts."""
    texts = ["a b a", None, "b c", ""]
    codes, _ = suffix_tree._counted(texts)
    packed = suffix_tree._pack(codes)
    prices = (0, len(packed).to_bytes(8, "big") + packed + np.full(len(codes), -0.5).tobytes(), -1, False)
    answers = pd.DataFrame([prices, (0, b"a", 9, True), (0, b"b", 99, True), (0, b"c", 0, False)], columns=["chunk", "word", "c", "first"])
    docs = pd.DataFrame({"doc_id": range(4), "text": texts, "held_out": [False, False, True, False]})
    seen, split = [], suffix_tree.words
    monkeypatch.setattr(suffix_tree, "words", lambda t: seen.append(t) or split(t))
    found = suffix_tree._answered(docs, answers)
    assert found[["n_tokens", "n_known", "logs", "score"]].to_numpy().tolist() == [[3, 3, 4, -3], [0, 0, 0, -0.5], [2, 1, 2, -2], [0, 0, 0, -0.5]]
    assert len(seen) == len(texts)


def test_lm_scoring_holds_few_symbols_at_a_time():
    """Texts of 8 MB: what a task holds beside them goes with a batch, not with a chunk."""
    texts = ["red green blue sea sky " * 1000] * 350
    tracemalloc.start()
    suffix_tree._counted(texts)
    counting = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    for found in suffix_tree._batched(texts):
        suffix_tree._scored(found, lambda codes: np.zeros(len(codes)))
    scoring = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert max(counting, scoring) < 60e6


@pytest.mark.parametrize("chunk_bytes", [suffix_tree.CHUNK_BYTES, 50_000])
def test_base_scores(docs, odd, chunk_bytes):
    for df in (docs, odd):
        rows = df.select("doc_id", "text").collect()
        counts, ends = Counter(), 0
        for d, t in rows:
            if brute.rest(d, 7) != 2:
                counts.update(brute.words(t))
                ends += 1
        n, v = sum(counts.values()) + ends, len(counts) + 1
        want = []
        for d, t in rows:
            w = brute.words(t)
            score = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w) + math.log10((ends + 1) / (n + v + 1))
            want.append((str(d), brute.rest(d, 7) == 2, len(w) + 1, sum(x in counts for x in w) + 1, n, round(score, 4)))
        found = suffix_tree.language_model_scores(df, chunk_bytes=chunk_bytes).collect()
        assert sorted((str(r["doc_id"]), *r[1:5], round(r["base_score"], 4)) for r in found) == sorted(want)
        assert all(r["score"] <= 0 for r in found)


@pytest.mark.parametrize("n, parts", [(1, 8), (4, 211), (31, 54), (54, 54), (100, 8), (211, 211)])
def test_chunks_are_dealt_evenly(docs, n, parts):
    names = suffix_tree._names(docs, n, parts)
    rows = docs.sparkSession.range(n).select(F.element_at(names, F.col("id").cast("int") + 1).alias("chunk"))
    tasks = rows.select("chunk", F.pmod(F.hash("chunk"), F.lit(parts)).alias("task")).collect()
    assert len({r["chunk"] for r in tasks}) == n
    assert max(Counter(r["task"] for r in tasks).values()) <= -(-n // parts) + 1
    if 2 * n <= parts or parts == 8:
        assert max(Counter(r["task"] for r in tasks).values()) == -(-n // parts)
    assert suffix_tree._names(docs, suffix_tree.NAMED * parts + 1, parts) is None


def test_tree_gives_distributions(docs):
    model = suffix_tree.Model(*suffix_tree.tree(docs, states=500))
    for context in (b"\n\n\n\n\n", b" the ", b"zzqq\xff"):
        codes = np.array([int.from_bytes(context + bytes([s]), "big") for s in range(256)], np.uint64)
        assert (10 ** model.log10(codes)).sum() == pytest.approx(1, abs=1e-6)


def test_contexts_help_on_held_out_texts(docs):
    """The tree needn't beat the word-count base score on tables as small as these: the README has both."""
    out = suffix_tree.held_out(F.col("doc_id"))
    texts = [r["text"] for r in docs.filter(out).collect()]
    with_contexts, without = (sum(suffix_tree.Model(*suffix_tree.tree(docs.filter(~out), states=n)).scores(texts)) for n in (suffix_tree.STATES, 1))
    assert with_contexts > 0.9 * without  # log10, below 0


def diverging(texts, telling):
    """The contexts (length, symbols as a number) that pass the test, and their suffixes."""
    grams = Counter()
    for t in texts:
        symbols = suffix_tree.END * suffix_tree.DEPTH + b" ".join(brute_words(t)) + suffix_tree.END
        for i in range(suffix_tree.DEPTH, len(symbols)):
            for d in range(suffix_tree.DEPTH + 1):
                grams[symbols[i - d : i + 1]] += 1
    after = defaultdict(dict)
    for g, n in grams.items():
        after[g[:-1]][g[-1]] = n
    total = {c: sum(x.values()) for c, x in after.items()}
    kept = {b""}
    for c, x in after.items():
        if c and sum(n * math.log(n / total[c] / (after[c[1:]][s] / total[c[1:]])) for s, n in x.items()) >= telling * len(x):
            kept |= {c[i:] for i in range(len(c) + 1)}
    return {(len(c), int.from_bytes(c, "big")) for c in kept}


def brute_words(text):
    return text.encode().lower().split()


def test_every_diverging_context_is_a_state(spark):
    """More contexts than 200,000, where the tree was cut."""
    letters = np.random.default_rng(5).integers(97, 123, (200, 300, 8), np.uint8)
    texts = [" ".join(w.tobytes().decode() for w in rows) for rows in letters]
    d, k, _ = suffix_tree.tree(spark.createDataFrame([(t,) for t in texts], "text string").repartition(8))
    want = diverging(texts, suffix_tree.TELLING)
    assert len(want) > 200_000
    assert set(zip(d.tolist(), (k >> 8).tolist(), strict=True)) == want


@pytest.mark.parametrize("sizes", [{}, {"chunk_bytes": 50_000, "part": 2_000}])
def test_scores_are_those_of_the_whole_tree(docs, odd, sizes):
    for df in (docs, odd):
        rows = df.withColumn("out", suffix_tree.held_out(F.col("doc_id"))).select("doc_id", "out", "text")
        model = suffix_tree.Model(*suffix_tree.tree(rows.filter("not out")))
        texts = rows.collect()
        want = sorted((str(r["doc_id"]), round(s, 6)) for r, s in zip(texts, model.scores([r["text"] for r in texts]), strict=True))
        found = suffix_tree.language_model_scores(df, **sizes).collect()
        assert sorted((str(r["doc_id"]), round(r["score"], 6)) for r in found) == want


def brute_scores(train, texts, depth, telling, escape):
    """Scores by the definition: counts of contexts as dictionaries, states, and the recursion over shorter states."""
    pad = suffix_tree.END * depth
    code = lambda t: pad + b" ".join(brute_words(t or "")) + suffix_tree.END
    after = defaultdict(Counter)
    for t in train:
        data = code(t)
        for i in range(depth, len(data)):
            for d in range(depth + 1):
                after[data[i - d : i]][data[i]] += 1
    total = {c: sum(x.values()) for c, x in after.items()}
    states = {b""}
    for c, x in after.items():
        if c and sum(n * math.log(n / total[c] / (after[c[1:]][s] / total[c[1:]])) for s, n in x.items()) >= telling * len(x):
            states |= {c[i:] for i in range(len(c) + 1)}

    def p(context, symbol):
        if not total:
            return 1 / 256
        while context not in states:
            context = context[1:]
        x, shorter = after[context], p(context[1:], symbol) if context else 1 / 256
        return (x[symbol] + escape * len(x) * shorter) / (total[context] + escape * len(x))

    out = []
    for t in texts:
        data = code(t)
        out.append(sum(math.log10(p(data[i - depth : i], data[i])) for i in range(depth, len(data))))
    return out


def test_scores_by_brute_force(spark, docs, odd):
    few = [(r["doc_id"], (r["text"] or "")[:400]) for r in docs.limit(60).collect()] + [(r["doc_id"], r["text"] and r["text"][:300]) for r in odd.collect()]
    df = spark.createDataFrame(few, "doc_id long, text string")
    train = [t for d, t in few if brute.rest(d, 7) != 2]
    want = brute_scores(train, [t for _, t in few], suffix_tree.DEPTH, suffix_tree.TELLING, suffix_tree.ESCAPE)
    found = suffix_tree.language_model_scores(df, chunk_bytes=4_000, part=500).collect()
    assert sorted((str(r["doc_id"]), round(r["score"], 5)) for r in found) == sorted((str(d), round(s, 5)) for (d, _), s in zip(few, want, strict=True))


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last if x == y else 1 + min(row[j], row[j - 1])
    return row[-1]


def test_fingerprints(docs, odd):
    for df in (docs, odd):
        rows = [(r["doc_id"], r["text"] or "") for r in df.collect()]
        found = piecewise_hash.fingerprints(df, 4).collect()
        assert len(found) == len(rows)
        prints = defaultdict(set)
        for r in found:
            assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
            prints[r["doc_id"]].add(r["fingerprint"])
        assert all(piecewise_hash.fingerprint(t) in prints[d] for d, t in rows)
        if df is docs:
            rows.sort()
            by = {r["doc_id"]: r for r in found}
            for (d, t), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
                k = len(t) // 2
                new = t[: len(t) - k] + after[:k]
                r = by[d]
                assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
                assert r["edited_fingerprint"] == piecewise_hash.fingerprint(new)
                assert r["near_next"] == piecewise_hash.likeness(r["fingerprint"], piecewise_hash.fingerprint(after))
        else:
            assert {r["n_chars"] for r in found if r["doc_id"] in (2, 3)} == {0}


def plain_print(text):
    """A fingerprint by its definition: a hash of each window of bytes, piece by piece."""
    import zlib

    data = text.encode()

    def rolled(i):
        h = 0
        for c in (b"\0" * 6 + data)[i : i + 7]:
            h = (h * 0x9E3779B1 + c + 1) & 0xFFFFFFFF
        return h ^ h >> 15

    hashes = [rolled(i) for i in range(len(data))]

    def signature(size):
        out, start = "", 0
        for i, h in enumerate(hashes):
            if h % size == size - 1:
                out, start = out + piecewise_hash.SIGNS[zlib.crc32(data[start : i + 1]) % 64], i + 1
        return out + (piecewise_hash.SIGNS[zlib.crc32(data[start:]) % 64] if start < len(data) else "")

    size = 3
    while size * 64 < len(data):
        size *= 2
    least = max(3, size // 4)
    while size > least and sum(h % size == size - 1 for h in hashes) < 32:
        size //= 2
    return f"{size}:{signature(size)}:{signature(2 * size)}"


def plain_likeness(a, b):
    if a == b:
        return 1.0

    def alike(x, y):
        if x == y:
            return 1.0
        run = min(5, (min(len(x), len(y)) + 1) // 2)
        if not x or not y or not any(x[i : i + run] in y for i in range(len(x) - run + 1)):
            return 0.0
        row = list(range(len(y) + 1))  # insertions and deletions; a replacement is one of each
        for i, c in enumerate(x, 1):
            last, row[0] = row[0], i
            for j, d in enumerate(y, 1):
                last, row[j] = row[j], last if c == d else 1 + min(row[j], row[j - 1])
        return 1 - row[-1] / (len(x) + len(y))

    (n, a1, a2), (m, b1, b2) = ((int(s), x, y) for s, x, y in (f.split(":") for f in (a, b)))
    return max([0.0] + [alike(x, y) for s, x in ((n, a1), (2 * n, a2)) for t, y in ((m, b1), (2 * m, b2)) if s == t])


def test_fingerprints_by_brute_force(spark, docs, odd):
    """The whole result: ties in id are told apart by a hash, so odd rows are compared by their own prints only."""
    few = sorted((r["doc_id"], (r["text"] or "")[:1500]) for r in docs.limit(40).collect())
    few += [(10_000 + i, t) for i, t in enumerate(["", None, "a", "漢字 \U0001f600", few[0][1], few[0][1][:-3]])]
    found = {r["doc_id"]: r for r in piecewise_hash.fingerprints(spark.createDataFrame(few, "doc_id long, text string"), 4).collect()}
    texts = [(d, t or "") for d, t in few]
    for (d, t), (_, after) in zip(texts, texts[1:] + texts[:1], strict=True):
        k = len(t) // 2
        new = t[: len(t) - k] + after[:k]
        r, own = found[d], plain_print(t)
        assert (r["n_chars"], r["fingerprint"], r["edited_fingerprint"], r["edited_sha256"]) == (len(t), own, plain_print(new), hashlib.sha256(new.encode()).hexdigest())
        assert r["near_edited"] == pytest.approx(plain_likeness(own, plain_print(new))) and r["near_next"] == pytest.approx(plain_likeness(own, plain_print(after)))
    prints = {(str(r["doc_id"]), r["fingerprint"]) for r in piecewise_hash.fingerprints(odd, 4).collect()}
    assert {(str(r["doc_id"]), plain_print((r["text"] or ""))) for r in odd.collect() if len(r["text"] or "") < 5000} <= prints


def test_likeness_is_edit_distance():
    a, b = "ABCDEFGHIJKLMNOP", "ABCDExGHIJKLyMNOP"
    assert piecewise_hash.likeness(f"3:{a}:abcdefgh", f"3:{b}:stuvwxyz") == pytest.approx(1 - edit_distance(a, b) / (len(a) + len(b)))
    assert piecewise_hash.likeness(f"3:{a}:{a}", f"6:{a}:{b}") == 1 and piecewise_hash.likeness(f"3:{a}:{a}", f"12:{a}:{a}") == 0


def test_toxicity_on_held_out_rows(spark, sf):
    more = sf.replace("sf0.001", "sf0.1")  # smaller tables have a handful of toxic held-out rows
    labels = spark.read.parquet(f"{more}/labels.parquet").filter("toxic is not null").select("doc_id", "toxic")
    rows = queries.QUERIES["op8_toxicity"](spark, more).filter("held_out").join(labels, "doc_id").collect()
    good, bad = ([r["score"] for r in rows if r["toxic"] == k] for k in (0, 1))
    assert good and bad
    auc = sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / len(good) / len(bad)
    assert auc >= 0.9
    assert all(r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_toxicity_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (3, None), (None, 1), (99, 0)], "doc_id long, toxic int")
    found = toxicity.toxicity(odd, labels).collect()
    assert len(found) == len(ODD) and all(0 <= r["score"] <= 1 for r in found)
    assert all(r["held_out"] == (brute.rest(r["doc_id"], 5) == 0) for r in found)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert all(r["score"] == 0 for r in toxicity.toxicity(odd, none).collect())


def test_toxicity_by_brute_force(spark, sf):
    """The query's scores and places from the fitted weights, by the definition of noisy-or."""
    more = sf.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{more}/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    found = {r["doc_id"]: r for r in queries.QUERIES["op8_toxicity"](spark, more).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(found) == len(rows)
    for doc_id, text in rows:
        clean, each = 1.0, []
        for sentence in re.split("[.!?\\n]+", (text or "").lower()):
            if seen := set(re.findall(r"\w+", sentence)):
                z = model.bias + sum(model.weights.get(f, 0.0) for w in seen for f in (("=" + w, w[:4], w[:5]) if len(w) > 4 else ("=" + w, w)))
                each.append(1 / (1 + math.exp(-max(-35, min(35, z)))))
                clean *= 1 - each[-1]
        r = found[doc_id]
        assert r["score"] == pytest.approx(1 - clean, abs=1e-6) and r["offending"] == [i for i, p in enumerate(each) if p >= 0.5]
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0 and toxicity.toxicity(docs.limit(3), labels.limit(0)).count() == 3


def test_offending_sentences_are_found():
    texts = [f"plain words here {i}. more of them." for i in range(40)] + [f"plain words here {i}. you vile wretch. more." for i in range(40)]
    model = toxicity.train(texts, [0] * 40 + [1] * 40)
    score, each = model.score("plain words. a vile wretch. more.", toxicity.Words(model.weights))
    assert score >= 0.5 and max(range(3), key=each.__getitem__) == 1
    assert model.score("plain words here. more.", toxicity.Words(model.weights))[0] < 0.5


def test_pipeline_of_odd_and_empty_tables(spark, odd, tmp_path):
    import corpus_pipeline as c

    bench = spark.createDataFrame([(1, "short item"), (None, None)], "item_id long, text string")
    for name, rows in (("odd", odd.select("doc_id", "text", "lang", "source", "score", "chunk")), ("empty", odd.limit(0))):
        rows.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        bench.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    found = c.run(spark, f"{tmp_path}/odd").collect()
    assert found and {r["doc_id"] for r in found} <= {1, None, 6, 7, 8} and all(r["text_crc32"] for r in found)
    assert c.run(spark, f"{tmp_path}/empty").count() == 0
    for name, stage in c.STAGES[:-1]:
        kept = stage(spark, odd, f"{tmp_path}/odd")
        assert kept.columns == odd.columns, name


def test_pipeline(spark, sf, docs):
    """Each stage over what its predecessor kept, against plain Python on the same rows."""
    import corpus_pipeline as c

    assert [n for n, _ in c.STAGES] == ["language_id", "simhash_near_dedup", "decontamination", "mixing", "sharding"]
    held, names = docs, docs.columns
    bench = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    for name, stage in c.STAGES:
        before = [r.asDict() for r in held.collect()]
        out = c.written(stage(spark, held, sf), name)
        after = out.collect()
        if name != "sharding":
            assert out.columns == names
        if name == "language_id":
            assert {r["doc_id"] for r in before} - {r["doc_id"] for r in after} <= {r["doc_id"] for r in before if sum(ch.isalpha() for ch in r["text"] or "") < 20}
        elif name == "simhash_near_dedup":
            of = brute.components([brute.simhash(r["text"]) for r in before])
            first = {}
            for r, o in zip(before, of, strict=True):
                first[o] = min(r["doc_id"], first.get(o, r["doc_id"]))
            assert sorted(r["doc_id"] for r in after) == sorted(first.values())
        elif name == "decontamination":
            assert sorted(r["doc_id"] for r in after) == sorted(r["doc_id"] for r in before if not brute.hit_words(r["text"], bench)[1])
        elif name == "mixing":
            sizes = Counter()
            for r in before:
                sizes[r["source"]] += len(brute.SPACE.findall(r["text"] or ""))
            taken = Counter()
            for r in after:
                taken[r["source"]] += len(brute.SPACE.findall(r["text"] or ""))
            longest = max(len(brute.SPACE.findall(r["text"] or "")) for r in before)
            assert all(abs(taken[s] - t) <= longest for s, t in brute.mix_targets(sizes).items())
        else:
            assert sorted(r["doc_id"] for r in after) == sorted(r["doc_id"] for r in before)
        held = out
    whole = c.run(spark, sf).collect()
    assert sorted(map(str, whole)) == sorted(str(r) for r in after) or sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in whole) == sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in after)
