"""Trees, graphs, selection, keyed sinks, quotes, tokens, the data source and the table function on cases whose results are known."""

import os
import random
import statistics

import pytest
from pyspark.sql import functions as F

from veredas.functions import scoring
from veredas.functions import text as X
from veredas.operators import aggregates, lexical, planning, selection, tree
from veredas.operators import windows as W
from veredas.sources import datasource, readers, sinks


def nodes(spark, parents, types=None):
    return spark.createDataFrame([(k, v, (types or {}).get(k, "X")) for k, v in parents.items()], "id string, parent string, type string")


def up(parents, node):
    path = [node]
    while parents.get(path[-1]) is not None and parents[path[-1]] not in path:
        path.append(parents[path[-1]])
    return path


def forest(rng, n=60):
    parents = {f"n{i}": (f"n{rng.randrange(i)}" if i and rng.random() < 0.9 else None) for i in range(n)}
    return parents | {"c0": "c2", "c1": "c0", "c2": "c1", "below": "c1", "lost": "absent", "self": "self"}


@pytest.mark.parametrize("seed", [1, 2])
def test_ancestors_and_intervals(spark, seed):
    parents = forest(random.Random(seed))
    df = nodes(spark, parents)
    wanted = {(k, a, i) for k in parents for i, a in enumerate(up(parents, k))}
    assert {tuple(r) for r in tree.ancestors(df).select("id", "ancestor", "depth").collect()} == wanted
    found = {r["id"]: r for r in tree.intervals(df).collect()}
    assert set(found) == set(parents) | {"absent"}
    endless = {"c0", "c1", "c2", "below", "self"}
    assert {k for k, r in found.items() if r["root"] is None} == endless
    for k in set(found) - endless:
        path = up(parents, k)
        assert (found[k]["root"], found[k]["depth"]) == (path[-1], len(path) - 1)
        below = {x for x in set(found) - endless if k in up(parents, x)}
        inside = {x for x in found if found[x]["root"] == found[k]["root"] and found[k]["root"] and found[k]["low"] <= found[x]["low"] <= found[k]["high"]}
        assert below == inside
    scopes = spark.createDataFrame([("n3", True), ("n5", False), ("c0", True), ("absent", True), ("nothing", True)], "id string, descendants boolean")
    wanted = {x for x in parents if {"n3", "c0", "absent"} & set(up(parents, x))} | {"n5"}
    assert {r["id"] for r in tree.expand(df, scopes).collect()} == wanted


def test_deep_tree_in_few_rounds(spark, monkeypatch):
    """A chain of 2,000 nodes beside a cycle: rounds in the logarithm of the depth."""
    rounds = []
    real = tree.written
    monkeypatch.setattr(tree, "written", lambda df, name: rounds.append(name) or real(df, name))
    parents = {f"{i:04d}": (f"{i - 1:04d}" if i else None) for i in range(2000)} | {"a": "b", "b": "a"}
    found = {r["id"]: r for r in tree.intervals(nodes(spark, parents)).collect()}
    assert all((found[f"{i:04d}"]["low"], found[f"{i:04d}"]["high"], found[f"{i:04d}"]["depth"]) == (i, 1999, i) for i in range(2000))
    assert found["a"]["root"] is None and len([r for r in rounds if r != "intervals"]) <= 16  # a start, 11 doublings, a start and 3 sums of 4
    rounds.clear()
    chain = {k: v for k, v in parents.items() if k < "0100"}
    assert len(tree.ancestors(nodes(spark, chain)).collect()) == 100 * 101 // 2 and len(rounds) <= 8


def graph(spark, edges):
    return spark.createDataFrame(edges, "a string, b string")


def closure(edges):
    out = {a: {b for x, b in edges if x == a} for a, _ in edges}
    while True:
        new = {a: s | {c for b in s for c in out.get(b, ())} for a, s in out.items()}
        if new == out:
            return {(a, b) for a, s in out.items() for b in s}
        out = new


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_cycles_and_reachability(spark, seed):
    rng = random.Random(seed)
    edges = sorted({(f"x{a}", f"x{b}") for a, b in ((rng.randrange(30), rng.randrange(30)) for _ in range(35)) if a < b or rng.random() < 0.15})
    reach = closure(edges)
    df = graph(spark, edges)
    assert {r["node"] for r in tree.on_cycles(df, "a", "b").collect()} == {a for a, b in reach if a == b}
    names = [f"x{i}" for i in range(31)]
    asked = [(rng.choice(names), rng.choice(names)) for _ in range(80)] + [(n, n) for n in names[:5]]
    found = {tuple(r) for r in tree.reaches(graph(spark, asked), df, "a", "b").collect()}
    assert found == set(asked) & reach


def test_levels_refuse(spark):
    edges = [("a", "b"), ("b", "c"), ("a", "c"), ("d", "c"), ("x", "y"), ("y", "x"), ("w", "x")]
    found = {r["node"]: r["level"] for r in tree.levels(graph(spark, edges), "a", "b").collect()}
    assert found == {"a": 2, "b": 1, "c": 0, "d": 1}
    assert tree.peeled(graph(spark, edges[:4]), "a", "b").isEmpty()


def test_wide_levels_without_closure(spark):
    """100,000 edges between twelve levels: no cycle, and the closure, some 40 million pairs, is never made."""
    n, depth = 8400, 12
    rows = spark.range(n * depth).selectExpr(f"id div {n} as l", f"id % {n} as i")
    edges = rows.selectExpr("concat(l, '-', i) as a", f"concat(l + 1, '-', (i * 31 + l * 7) % {n}) as b").unionAll(rows.selectExpr("concat(l, '-', i) as a", f"concat(l + 1, '-', (i * 17 + 5) % {n}) as b").limit(1000))
    assert edges.count() > 100_000 and tree.on_cycles(edges, "a", "b").isEmpty()


@pytest.mark.parametrize("most", [3, 50, 10_000])
def test_medians(spark, most):
    rng = random.Random(most)
    groups = {
        "skewed": [rng.expovariate(1) for _ in range(501)] + [1e12, -1e12], "ties": [rng.randrange(4) for _ in range(300)], "one": [7.5], "two": [1, 2.5], "none": [None, None],
        None: [rng.gauss(0, 1) for _ in range(200)], "halves": [0] * 50 + [10] * 50, "wide": [10.0**i for i in range(-30, 31)],
    }
    df = spark.createDataFrame([(k, None if v is None else float(v)) for k, vs in groups.items() for v in vs], "k string, v double")
    found = {r["k"]: r["median"] for r in selection.medians(df, "v", ["k"], most=most, ranges=8).collect()}
    assert found == {k: statistics.median(v) for k, v in groups.items() if v[0] is not None}
    every = [float(v) for vs in groups.values() for v in vs if v is not None]
    assert selection.medians(df, "v", most=most, ranges=8).first()["median"] == statistics.median(every)
    assert selection.medians(df.limit(0), "v", most=most).first()["median"] is None and selection.medians(df.limit(0), "v", ["k"], most=most).isEmpty()


def test_score_metrics_of_no_rows(spark):
    df = spark.createDataFrame([], "k string, v double, band string")
    row = aggregates.score_metrics(df, "v", "band").first()
    assert (row["n"], row["mean"], row["median"], row["deviation"]) == (0, 0.0, 0.0, 0.0)


def test_ranges_of_skewed_scores(spark):
    """One outlier of 1e12 leaves no range with more than twice the mean of the rows."""
    scores = [float(i) ** 3 for i in range(20_000)] + [1e12]
    counts = spark.createDataFrame([(s,) for s in scores], "v double").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    cuts = counts.agg(selection.splitters("v", 256).alias("cuts"))
    sizes = [r["count"] for r in counts.crossJoin(cuts).groupBy(selection.range_of(F.col("v"), F.col("cuts"))).count().collect()]
    assert len(sizes) > 200 and max(sizes) <= 2 * sum(sizes) / len(sizes)
    ranked = W.competition_rank(spark.createDataFrame([(s,) for s in [*scores, *scores[:50], None]], "v double"), "v", "rank").collect()
    above = sorted([*scores, *scores[:50]], reverse=True)
    first = {v: i + 1 for i, v in reversed(list(enumerate(above)))} | {None: len(above) + 1}
    assert all(r["rank"] == first[r["v"]] for r in ranked)


def test_upsert_rewrites_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = "id int, v string, at int"
    sinks.upsert(spark, path, spark.range(5000).selectExpr("cast(id as int) as id", "'old' as v", "1 as at"), ["id"], "at", parts=1000)
    files = lambda: {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}
    before = files()
    new = spark.createDataFrame([(i * 7, "new", 2) for i in range(10)] + [(7, "newest", 3), (None, "null", 1)], schema)
    assert sinks.upsert(spark, path, new, ["id"], "at", parts=1000) <= 11
    assert len(before.keys() - files().keys()) <= 11
    wanted = {i: "old" for i in range(5000)} | {i * 7: "new" for i in range(10)} | {7: "newest", None: "null"}
    rows = sorted(map(str, sinks.keyed(spark, path, schema).collect()))
    assert {r["id"]: r["v"] for r in sinks.keyed(spark, path, schema).collect()} == wanted and len(rows) == len(wanted)
    sinks.upsert(spark, path, new, ["id"], "at", parts=1000)
    assert sorted(map(str, sinks.keyed(spark, path, schema).collect())) == rows


def test_change_that_was_cut_off(spark, tmp_path, monkeypatch):
    """A driver lost before the partitions are staged changes nothing; one lost after it leaves a change that the next reader puts in place."""
    path, schema = str(tmp_path / "t"), "id int, v string, at int"
    row = lambda i, v: spark.createDataFrame([(i, v, 1)], schema)
    sinks.upsert(spark, path, row(1, "a"), ["id"], "at")
    real, calls = sinks.finish, []
    monkeypatch.setattr(sinks, "finish", lambda s, p: calls.append(1) or (real(s, p) if len(calls) % 2 else (_ for _ in ()).throw(RuntimeError("lost"))))
    with pytest.raises(RuntimeError):
        sinks.upsert(spark, path, row(1, "b"), ["id"], "at")
    monkeypatch.setattr(sinks, "finish", real)
    assert spark.read.parquet(path).first()["v"] == "a"
    assert [r["v"] for r in sinks.keyed(spark, path, schema).collect()] == ["b"]


def test_add_missing_never_twice(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k string, n int"
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), (None, 4)], schema)
    for _ in range(2):
        sinks.add_missing(spark, path, rows, ["k"])
    sinks.add_missing(spark, path, spark.createDataFrame([("a", 9), ("c", 5)], schema), ["k"])
    found = {r["k"]: r["n"] for r in sinks.keyed(spark, path, schema).collect()}
    assert set(found) == {"a", "b", "c", None} and found["a"] in (1, 3) and sinks.keyed(spark, path, schema).count() == 4
    assert sinks.keyed(spark, str(tmp_path / "none"), schema).isEmpty()


def said_span(text, start, end, quote, drift=400, least=12):
    """The place of a quote, plainly."""
    if not quote.split():
        return None
    raw = text[start:end]
    if raw == quote:
        return start, start + len(quote)
    if quote == quote.strip() and raw.strip() == quote:
        at = start + raw.find(quote)
        return at, at + len(quote)
    found = [(i, i + len(quote)) for i in range(len(text)) if text.startswith(quote, i)]
    size = len(quote.strip())
    if not found:
        size = len(" ".join(quote.split()))
        for i in range(len(text)):
            j, words = i, quote.split()
            for n, w in enumerate(words):
                if n:
                    k = j
                    while j < len(text) and text[j].isspace():
                        j += 1
                    if j == k:
                        break
                if not text.startswith(w, j):
                    break
                j += len(w)
            else:
                found.append((i, j))
    near = [s for s in found if abs(s[0] - start) <= drift]
    return near[0] if len(near) == 1 else found[0] if len(found) == 1 and size >= least else None


def test_quote_spans(spark):
    rng = random.Random(7)
    words = ["a", "b", "aa", "çé", "\U0001f600", "x.y", "$1", "\\E", "(z)"]
    cases = [
        ("a    b  c d", 0, 3, "b c"), ("aaa", 0, 2, "aa"), ("aXa", 0, 1, "aXa"), ("one two", 0, 7, "one two"), (" one ", 0, 5, "one"), ("one two one two", 0, 3, "two"), ("", 0, 0, "x"), ("x", 0, 1, ""), ("x y", 0, 3, " "),
        ("end.\n \nnext word goes", 0, 5, "end. next word goes"), ("é" * 500 + "the only long quote", 0, 3, "the only long quote"), ("é" * 500 + "short", 0, 3, "short"), ("ab\x1cab cd", 0, 1, "ab ab"),
        ("a b c", 0, 0, "a b"), ("q" * 1000, 500, 510, "q" * 12), ("a.b a+b", 4, 7, "a+b"), ("\\Ea\\Qb", 0, 2, "\\Ea\\Q"),
    ]
    for _ in range(150):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\n", "\n \n", "\t"]) for _ in range(rng.randrange(1, 25)))
        i = rng.randrange(len(text))
        quote = text[i : i + rng.randrange(1, 20)]
        quote = rng.choice([quote, " ".join(quote.split()), quote + "!", "  ".join(quote.split())])
        start = max(0, i + rng.choice([0, 0, 1, -2, 300, 450]))
        cases.append((text, start, start + rng.choice([len(quote), len(quote) + 1, 3]), quote))
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, text string, a int, b int, quote string")
    found = df.select("i", X.quote_span(F.col("text"), F.col("a"), F.col("b"), F.col("quote")).alias("s"), X.quote_offset(F.col("text"), F.col("quote")).alias("o")).collect()
    for r in found:
        assert (tuple(r["s"]) if r["s"] else None) == said_span(*cases[r["i"]]), cases[r["i"]]
    assert {r["i"]: r["o"] for r in found}[0] == 5  # the place in the text as it is


def test_painted_tokens(spark):
    rng = random.Random(9)
    cases = [[], [(0, 3, "abc")], [(4, 6, "xy"), (0, 2, "ab")], [(0, 5, "hello"), (2, 4, "XX")], [(2, 4, "XX"), (0, 5, "hello")], [(0, 2, "longer than its end")], [(3, 3, "")], [(0, 0, "a")], [(0, 2, "é\U0001f600"), (3, 4, "z")]]
    for _ in range(60):
        row = []
        for _ in range(rng.randrange(1, 8)):
            start, text = rng.randrange(20), "".join(rng.choice("abcdé ") for _ in range(rng.randrange(0, 7)))
            row.append((start, start + max(0, len(text) - rng.choice([0, 0, 1])), text))
        cases.append(row)

    def plain(tokens):
        size = max((t[1] for t in tokens), default=0)
        out = [" "] * size
        for start, _, text in tokens:
            for k, c in enumerate(text):
                if start + k < size:
                    out[start + k] = c
        return "".join(out).strip()

    df = spark.createDataFrame(list(enumerate(cases)) + [(999, None)], "i int, tokens array<struct<start: int, end: int, text: string>>")
    found = {r["i"]: r["t"] for r in df.select("i", X.painted(F.col("tokens")).alias("t")).collect()}
    assert found == {i: plain(c) for i, c in enumerate(cases)} | {999: ""}


def test_quota(spark):
    cases = [(3, [("EASY", 1), ("HARD", 2)], "VALID"), (3, [("EASY", 1)], "SUM_DIFFERS"), (0, [], "NEGATIVE"), (2, [("EASY", 3), ("HARD", -1)], "NEGATIVE"), (1, [("EXTREME", 1)], "UNKNOWN_LEVEL"), (51, [("EASY", 51)], "TOO_MANY")]
    df = spark.createDataFrame(cases, "n int, d array<struct<level: string, n: int>>, want string")
    assert all(r["want"] == r["got"] for r in df.withColumn("got", scoring.quota_verdict(F.col("n"), F.col("d"))).collect())


def test_minutes(spark):
    """Minutes by weight in whole numbers, what is left to the last; the weakest go where there isn't the least for each."""
    rows = [("a", "x", 3.0), ("a", "y", 2.0), ("a", "z", 1.0), ("b", "x", 1.0), ("c", "x", 1.0), ("c", "y", 0.05), ("c", "z", 0.04), *[("d", f"i{i}", 1.0 + i) for i in range(9)]]
    df = spark.createDataFrame(rows, "s string, c string, w double")
    found = {}
    for r in planning.allocate_minutes(df, "s", "c", "w", 60, 10).collect():
        found.setdefault(r["s"], {})[r["c"]] = r["minutes"]
    assert found["a"] == {"x": 30, "y": 20, "z": 10} and found["b"] == {"x": 60} and found["c"] == {"x": 55, "y": 10, "z": 0}
    assert found["d"] == {"i8": 14, "i7": 12, "i6": 11, "i5": 10, "i4": 10, "i3": 3}
    short = planning.allocate_minutes(df, "s", "c", "w", 5, 10).collect()  # less than the least of one: the first gets all
    assert {(r["s"], r["c"], r["minutes"]) for r in short} == {("a", "x", 5), ("b", "x", 5), ("c", "x", 5), ("d", "i8", 5)}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("files")
    for i in range(5):
        (d / f"doc{i}.docx").write_bytes(readers.docx_file([f"p{k} of {i}" for k in range(i)]))
    (d / "bad.docx").write_bytes(b"not a zip file")
    (d / "note.txt").write_text("one\n\ntwo, ação\n\n\nthree", encoding="utf-8")
    (d / "strange.xyz").write_text("?")
    (d / "_hidden.txt").write_text("no")
    (d / "lines.jsonl").write_text("".join(f'{{"id": {i}, "t": "é"}}\n' for i in range(1000)) + '{"id": 1000}', encoding="utf-8")
    return d


def wanted_parts(folder):
    out = {("bad.docx", None), ("strange.xyz", None), *((f"doc{i}.docx", f"p{k} of {i}") for i in range(5) for k in range(i)), ("note.txt", "one"), ("note.txt", "two, ação"), ("note.txt", "three")}
    return out | {("lines.jsonl", line) for line in (folder / "lines.jsonl").read_text(encoding="utf-8").split("\n")}


@pytest.mark.parametrize("task", [200, 5000, 32_000_000])
def test_files_as_a_data_source(spark, folder, task):
    datasource.register(spark)
    df = spark.read.format(datasource.NAME).option("path", str(folder)).option("taskBytes", task).load()
    rows = df.collect()
    assert sorted((os.path.basename(r["path"]), str(r["text"])) for r in rows) == sorted((p, str(t)) for p, t in wanted_parts(folder))
    assert {os.path.basename(r["path"]) for r in rows if r["error"]} == {"bad.docx", "strange.xyz"}
    narrow = spark.read.format(datasource.NAME).schema("path string, size long").option("path", str(folder)).load().collect()
    assert {os.path.basename(r["path"]): r["size"] for r in narrow} == {f.name: f.stat().st_size for f in folder.iterdir() if f.name[0] != "_"}
    only = spark.read.format(datasource.NAME).option("path", str(folder)).option("pattern", "*.txt").load()
    assert {r["text"] for r in only.collect()} == {"one", "two, ação", "three"}


def test_tasks_of_near_equal_bytes():
    files = [("big.docx", 10_000_000), *((f"s{i}.txt", 10_000) for i in range(1000)), ("long.jsonl", 25_000_000)]
    shares = [sum(p[3] - p[2] for p in s.pieces) for s in datasource.shares(files, 10_000_000)]
    assert sum(shares) == 45_000_000 and max(shares) <= 10_000_000 and min(shares) >= 4_000_000
    assert datasource.shares([], 10) == []


def test_files_as_a_stream(spark, folder, tmp_path):
    """The same rows as in batch; a restart reads no file twice, and files that come later once, whatever their time."""
    datasource.register(spark)
    src, seen = tmp_path / "in", []
    src.mkdir()

    def run():
        stream = spark.readStream.format(datasource.NAME).option("path", str(src)).option("log", str(tmp_path / "log")).option("taskBytes", 5000).load()
        stream.writeStream.foreachBatch(lambda df, _: seen.extend((os.path.basename(r["path"]), r["text"]) for r in df.collect())).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()

    names = sorted(f.name for f in folder.iterdir())
    for i, some in enumerate((names[:4], [], names[4:])):
        for name in some:
            (src / name).write_bytes((folder / name).read_bytes())
            os.utime(src / name, (1000 - i, 1000 - i))  # later ones look older
        run()
    assert sorted(map(str, seen)) == sorted(map(str, wanted_parts(folder)))


def test_parse_in_sql(spark, folder):
    datasource.register(spark)
    found = readers.files(spark, str(folder), "*.docx").filter("path not like '%bad%'")
    found.createOrReplaceTempView("found_files")
    rows = spark.sql("SELECT f.path, p.number, p.text FROM found_files f, LATERAL parse(f.path, f.content) p").collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, readers.parsed(found).select("path", "number", "text").collect())) and len(rows) == 10
    whole = spark.sql("SELECT f.path, p.parts, p.text FROM found_files f, LATERAL parse(f.path, f.content, 'whole') p").collect()
    assert {r["parts"] for r in whole} == {1, 2, 3, 4} and {r["text"] for r in whole if r["parts"] == 2} == {"p0 of 2\np1 of 2"}
    with pytest.raises(Exception, match="form"):
        spark.sql("SELECT * FROM found_files f, LATERAL parse(f.path, f.content, 'other') p").collect()


def test_best_nodes_by_bounds(spark):
    """The same five as by scoring every node, with a tenth of the terms scored; ties by path, general terms, texts of one and of no term."""
    rng = random.Random(4)
    words = [f"word{i}a" for i in range(12)]
    rows = [("R", None, "DISCIPLINE", "top", None), ("A", "R", "AREA", "word1a area", "quimica celular")]
    rows += [(f"C{i}", "A", "CONTENT", f"{words[i]} group", "quimica") for i in range(8)]
    rows += [(f"S{i:04d}", f"C{i % 8}", "SUBCONTENT", " ".join(rng.choices(words[:6], k=2)), rng.choice([None, words[7], "common thing"])) for i in range(1500)]
    nodes_ = spark.createDataFrame(rows, "id string, parent string, type string, name string, description string")
    texts = spark.createDataFrame([(" ".join(rng.choices([*words, "other", "common", "quimica"], k=rng.randrange(1, 6))),) for _ in range(60)] + [("nothing",), ("",), ("quimica",)], "t string")
    key = lambda df: sorted(tuple(r) for r in df.collect())
    every = lexical.candidates(texts, "t", nodes_).filter("rank <= 5")
    assert key(lexical.candidates(texts, "t", nodes_, best=5)) == key(every)
    postings, of, _ = lexical.classes(nodes_, 5)
    used = lexical._used(texts, "t")
    scored = lexical.matches(lexical.promising(used, "t", postings, of, 5), used, "t", postings).count()
    assert 10 * scored <= used.join(lexical.vocabulary(nodes_)[0], "term").count()
