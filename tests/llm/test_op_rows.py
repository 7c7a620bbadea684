"""Sharding, decontamination, mixing, SimHash and WARC against plain Python, with odd rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.compare import same_rows
from tests.llm import brute
from veredas.llm import decontamination, mixing, queries, sharding, simhash, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"
ODD = [
    (1, "a b c", "en", "x", 5), (1, "a b c", "en", "x", 5), (1, "another text of this id", "en", "x", 5), (2, None, None, None, None), (None, "no id", "en", "y", 5),
    (3, "", "en", "", 0), (4, " \t\n", "en", "y", 3), (5, "Word " * 30_000, "en", "x", 1), (6, "Ünïcode ß 漢字 \U0001f600", "de", "z", 9), (7, "a b c", "en", "z", 5),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def clashing(df):
    """Columns that an operator may use itself, one twice but for its case."""
    return df.withColumns({c: F.lit("?") for c in ("size", "bucket", "key", "text_key", "fp", "n", "hash", "skey", "copy", "at", "p")}).select("*", F.lit("!").alias("TEXT"))


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(name, spark, sf, duck):
    same_rows(queries.QUERIES[name](spark, sf), duck, queries.ORACLE[name])


@pytest.mark.parametrize("shards", [1, 24])
def test_sharding(docs, odd, shards):
    for df, rows in ((docs, docs.collect()), (odd, odd.collect()), (clashing(odd), odd.collect())):
        texts = defaultdict(list)
        for r in rows:
            texts[r["doc_id"]].append(r["text"] or "")
        found = sharding.shard(df, shards).collect()
        assert len(found) == sum(map(len, texts.values()))
        for r in found:
            assert (r["size"] - 8, r["text_crc32"]) in {(len(t.encode()), zlib.crc32(t.encode())) for t in texts[r["doc_id"]]}
            assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
        by = defaultdict(list)
        for r in found:
            by[r["shard"]].append(r["slot"])
        assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_shards_are_near_equal(docs):
    loads = [r[0] for r in sharding.shard(docs, 8).groupBy("shard").agg(F.sum("size")).collect()]
    assert len(loads) == 8 and max(loads) < 1.1 * sum(loads) / 8 + max(r[0] for r in docs.selectExpr("octet_length(text)").collect() if r[0])


def test_rebalancing_moves_few_slots():
    sizes = [(i * 7919) % 101 + 1 for i in range(1000)]
    old = sharding.SlotMap.first(1000, 10).rebalanced(sizes)
    new = old.rebalanced(sizes, 11)
    moved = sum(sizes[s] for s in range(1000) if old.shard[s] != new.shard[s])
    assert new.version == old.version + 1 and moved < 1.2 * sum(sizes) / 11
    assert max(new.loads(sizes)) - min(new.loads(sizes)) <= 101


def test_repeated_rows_are_spread(spark):
    """20,000 identical rows over 24 shards are within 1 % of each other's bytes, and every place is given once."""
    df = spark.range(20_000).selectExpr("cast(1 as long) as doc_id", "'the same text' as text")
    found = sharding.shard(df, 24).groupBy("shard").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.max("slot").alias("last"), F.count_distinct("slot").alias("slots")).collect()
    mean = sum(r["bytes"] for r in found) / 24
    assert len(found) == 24 and all(abs(r["bytes"] / mean - 1) <= 0.01 for r in found)
    assert sum(r["n"] for r in found) == 20_000 and all(r["n"] == r["slots"] == r["last"] + 1 for r in found)


def test_map_is_settled(spark, docs, tmp_path):
    """A second and a third run on the same rows write no version: nothing moves."""
    path = str(tmp_path / "map")
    sharding.shard(docs, 24, path=path)
    first = sharding.load_map(spark, path)
    for _ in range(2):
        sharding.shard(docs, 24, path=path)
    assert sharding.load_map(spark, path) == first


@pytest.mark.parametrize("seed", range(5))
def test_rebalancing_again_moves_nothing(seed):
    rng = random.Random(seed)
    sizes = [int(1000 * rng.paretovariate(1.5)) if rng.random() < 0.4 else 0 for _ in range(2000)]
    m = sharding.SlotMap.first(2000, 24).rebalanced(sizes)
    again = m.rebalanced(sizes)
    assert max(again.loads(sizes)) >= max(m.loads(sizes)) and max(m.loads(sizes)) <= max(1.02 * sum(sizes) / 24, max(sizes))


def test_slot_map_versions(spark, odd, tmp_path):
    """A second run on one path reads the map, a third edits it: records keep their slots, rows aren't multiplied."""
    path = str(tmp_path / "map")
    first = sharding.shard(odd, 4, slots=64, path=path).collect()
    known = sharding.load_map(spark, path, 64)
    assert known.version == 2 and sharding.load_map(spark, path, 64, 1).version == 1
    again = sharding.shard(odd, 4, slots=64, path=path).collect()
    assert sorted(map(str, again)) == sorted(map(str, first)) and sharding.load_map(spark, path, 64) == known
    grown = sharding.shard(odd, 5, slots=64, path=path).collect()
    new = sharding.load_map(spark, path, 64)
    assert new.version == 3 and new.shards == 5 and len(grown) == len(ODD) and {r["map_version"] for r in grown} == {3}
    slots = lambda rows: sorted((str(r["doc_id"]), r["text_crc32"], r["virtual_slot"]) for r in rows)
    assert slots(grown) == slots(first)
    assert all(r["shard"] == new.shard[r["virtual_slot"]] for r in grown)
    with pytest.raises(ValueError, match="slots"):
        sharding.load_map(spark, path, 32)


def test_unfinished_map_version_is_passed_over(spark, tmp_path):
    path, m = str(tmp_path / "map"), sharding.SlotMap.first(8, 2)
    sharding.save_map(spark, path, m, [1] * 8)
    spark.createDataFrame([(2, 2, 0, 1, 1)], sharding.SCHEMA).write.parquet(f"{path}/v00000002")
    assert sharding.load_map(spark, path, 8) == m


def test_shards_by_brute_force(spark, docs, odd):
    """Slots are recomputed in plain Python from the map that was saved, and the bytes of each shard are near equal."""
    import xxhash

    for df in (docs, odd):
        rows = df.select("doc_id", "text").collect()
        found = sharding.shard(df, 4)
        got = sorted((str(r["doc_id"]), r["size"], r["text_crc32"], r["virtual_slot"]) for r in found.collect())
        want = []
        for doc_id, text in rows:
            data = (text or "").encode()
            crc = zlib.crc32(data)
            h = xxhash.xxh64_intdigest(crc.to_bytes(8, "little"), xxhash.xxh64_intdigest(("" if doc_id is None else str(doc_id)).encode(), 42))
            want.append((str(doc_id), len(data) + 8, crc, h % sharding.SLOTS if h < 1 << 63 else (h - (1 << 64)) % sharding.SLOTS))
        assert got == sorted(want)
        of = {}
        for r in found.collect():
            assert of.setdefault(r["virtual_slot"], r["shard"]) == r["shard"]
        loads = [0] * 4
        for r in found.collect():
            loads[r["shard"]] += r["size"]
        assert max(loads) - sum(loads) / 4 <= max(w[1] for w in want)


def test_map_moves_little_for_little_growth():
    sizes = [(i * 7919) % 101 + 1 for i in range(1000)]
    old = sharding.SlotMap.first(1000, 10).rebalanced(sizes)
    sizes[3] += 700  # one shard outgrows the mean
    new = old.rebalanced(sizes, slack=0.01)
    moved = [s for s in range(1000) if old.shard[s] != new.shard[s]]
    assert 0 < len(moved) < 60 and {old.shard[s] for s in moved} == {old.shard[3]}
    assert max(new.loads(sizes)) <= 1.02 * sum(sizes) / 10


BENCH = [(1, "one two three four five six seven eight nine ten eleven"), (2, "Short item"), (None, "no id here"), (4, None), (5, "..."), (6, "short ITEM")]
DIRTY = [
    (1, "x ONE, two three four five six seven eight nine ten eleven y"), (2, "one two three four five six seven eight nine"), (3, "a short item, a short item"),
    (4, None), (5, ""), (None, "no id here"), (6, "w " * 50_000 + "short item"), (7, "two three four five six seven eight nine ten eleven"), (7, "clean"), (7, "clean"),
]


@pytest.mark.parametrize("most", [decontamination.MOST_BROADCAST, 0])
def test_decontamination(spark, most):
    docs, bench = spark.createDataFrame(DIRTY, "doc_id long, text string"), spark.createDataFrame(BENCH, "item_id long, text string")
    want = []
    for doc_id, text in DIRTY:
        n, hit, items = brute.hit_words(text, BENCH)
        want.append((str(doc_id), n, hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), hit > 0))
    for df in (docs, clashing(docs)):
        found = decontamination.contamination(df, bench, most_broadcast=most).collect()
        assert sorted((str(r["doc_id"]), *r[1:6]) for r in found) == sorted(want)
        kept = decontamination.decontaminated(df, bench, most_broadcast=most)
        assert kept.columns == df.columns
        assert sorted(str(r[0]) for r in kept.collect()) == sorted(w[0] for w in want if not w[5])
    parts = {(r["doc_id"], tuple(r["parts"])) for r in decontamination.without_spans(docs, bench, most_broadcast=most).collect()}
    assert (1, ("x", "y")) in parts and (3, ("a", "a")) in parts and (7, ()) in parts and (7, ("clean",)) in parts


@pytest.mark.parametrize("most", [decontamination.MOST_BROADCAST, 0])
def test_spans_are_a_texts_own(spark, most):
    """Rows of one id with as many words each: only the hit words of a row's own text go."""
    bench = spark.createDataFrame([(2, "short item")], "item_id long, text string")
    rows = [(7, "short item red blue"), (7, "red blue green gold"), (8, "a short item"), (8, "short item b"), (None, "x short item"), (None, "y z w"), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((str(r["doc_id"]), tuple(r["parts"])) for r in decontamination.without_spans(docs, bench, most_broadcast=most).collect())
    assert found == sorted([("7", ("red blue",)), ("7", ("red blue green gold",)), ("8", ("a",)), ("8", ("b",)), ("None", ("x",)), ("None", ("y z w",)), ("9", ("",))])
    assert decontamination.decontaminated(docs.limit(0), bench).count() == 0 == decontamination.without_spans(docs.limit(0), bench).count()


def test_mixing(docs, odd):
    for df, rows in ((docs, docs.collect()), (odd, odd.collect()), (clashing(odd), odd.collect())):
        rows = [(r["doc_id"], r["text"], r["source"]) for r in rows]
        sizes = defaultdict(int)
        for _, text, source in rows:
            sizes[source] += len(brute.SPACE.findall(text or ""))
        target = brute.mix_targets(sizes)
        found = mixing.mix(df).collect()
        assert len(found) == len(rows)
        taken = defaultdict(int)
        for r in found:
            assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
            assert 0 <= r["taken"] <= 2 * r["size"]
            taken[r["source"]] += r["taken"]
        assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)
        again = mixing.mix(df).collect()
        assert sorted(map(str, found)) == sorted(map(str, again))


def test_mixed_documents_follow_the_mix(docs):
    taken = {r["doc_id"]: (r["taken"], r["size"]) for r in mixing.mix(docs).collect()}
    copies = {r["doc_id"]: r["count"] for r in mixing.mixed(docs).groupBy("doc_id").count().collect()}
    assert all(abs(copies.get(d, 0) * size - took) <= size / 2 + 1 for d, (took, size) in taken.items())


@pytest.mark.parametrize("crowd", [128, 0])
def test_simhash(docs, odd, crowd):
    for df in (docs, odd):
        rows = [(r["doc_id"], r["text"]) for r in df.collect()]
        fps = [brute.simhash(t) for _, t in rows]
        of = brute.components(fps)
        first = {c: min((d for (d, _), o in zip(rows, of) if o == c and d is not None), default=None) for c in set(of)}
        want = sorted(str((d, f"{f:016x}", first[c])) for (d, _), f, c in zip(rows, fps, of))
        assert sorted(str(tuple(r)) for r in simhash.near_duplicates(df, crowd).collect()) == want
        kept = simhash.deduplicated(clashing(df), crowd)
        assert kept.count() == len(set(of)) and kept.columns == clashing(df).columns


def test_simhash_links_are_exact(spark):
    import random

    draw = random.Random(1)
    base = [draw.getrandbits(64) for _ in range(20)]
    fps = sorted({b ^ sum(1 << k for k in draw.sample(range(64), n)) for b in base for n in (0, 1, 2, 3, 4) for _ in range(6)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    want = {(min(a, b), max(a, b)) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    for crowd in (128, 0):
        assert {tuple(r) for r in simhash.links(df, crowd).collect()} == want


def test_simhash_variants_are_never_broadcast(spark):
    fps = spark.range(50).select(F.xxhash64("id").alias("fp"))
    plan = simhash.links(fps)._jdf.queryExecution().sparkPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and "Inner" in line]
    assert len(joins) == 2 and all("SortMergeJoin" in line for line in joins)


BIG = "línea <p>\r\n\r\nWARC/1.1\r\n</p>" * 100
PAGES = [(1, "http://a", BIG), (2, "http://b", BIG), (3, "http://c\r\nX: y", "small"), (4, None, "small"), (5, "u", None), (6, "u", ""), (7, "u", "é\U0001f600" * 500), (8, "u", BIG[:-1]), (8, "u", BIG[:-1]), (None, "u", "n" * 999), (9, "u", "\r\n\r\n")]


@pytest.mark.parametrize("chunk", [warc.CHUNK, 100])
def test_warc(spark, chunk):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    largest = {}
    for p, _, html in PAGES:
        if len((html or "").encode()) >= 1000 and p is not None:
            largest[html] = max(p, largest.get(html, p))
    want = []
    for p, _, html in PAGES:
        data, keep = (html or "").encode(), largest.get(html)
        revisit = keep is not None and keep != p
        want.append(str((p, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", keep if revisit else None)))
    assert sorted(str(tuple(r)) for r in warc.round_trip(pages, chunk=chunk).collect()) == sorted(want)


def test_warc_bodies_come_back(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", BIG)], "page_id long, url string, html string")
    at = warc.write(pages, str(tmp_path / "w"), chunk=64)
    found = warc.records(spark, str(tmp_path / "w"), at).collect()
    assert "".join(r["body"] for r in sorted(found, key=lambda r: int(r["segment"]))) == BIG


def expected_pages(pages):
    largest = {}
    for p, _, html in pages:
        if len((html or "").encode()) >= 1000 and p is not None:
            largest[html] = max(p, largest.get(html, p))
    out = []
    for p, _, html in pages:
        data, keep = (html or "").encode(), largest.get(html)
        revisit = keep is not None and keep != p
        out.append(tuple(map(str, (p, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", keep if revisit else None))))
    return sorted(out)


def as_text(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


def test_warc_of_many_chunks(spark):
    """Over 100 chunks a payload, in files that cut records apart; revisits met by a shuffle too; clashing columns; ids of text."""
    import random

    draw = random.Random(3)
    long = ["".join(draw.choice("abé漢\r\n ") for _ in range(k)) for k in (7000, 6400, 6401, 63, 64, 65)]
    pages = [(p, f"u{p}", long[p % 6]) for p in range(24)] + [(None, None, long[0]), (3, "again", long[3])]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    odd = df.withColumns({c: F.lit("?") for c in ("record", "body", "size", "digest", "keep", "last", "value", "segment", "parted")}).select("*", F.lit("!").alias("HTML"))
    for most in (warc.MOST_BROADCAST, 0):
        path = warc.scratch_path(spark, "warc-test")
        at = warc.write(odd, path, chunk=64, records=30, most_broadcast=most)
        assert as_text(warc.read(spark, path, at)) == expected_pages(pages)
    named = df.select(F.col("page_id").cast("string").alias("page_id"), "url", "html")
    assert len(warc.round_trip(named, chunk=500).collect()) == len(pages)


def test_warc_shared_records_found_small_at_run_time(spark):
    """The records that files share are planned for a sort-merge join, as in large archives, and turn out small enough to be broadcast."""
    pages = [(p, "u", f"{p} " * 1000) for p in range(24)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    path = warc.scratch_path(spark, "warc-test")
    at = warc.write(df, path, chunk=64, records=30)
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        assert as_text(warc.read(spark, path, at)) == expected_pages(pages)
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_chunks_carry_running_digests(spark):
    rows = warc.chunks(spark.createDataFrame([(1, "u", BIG), (2, "u", None)], "page_id long, url string, html string"), 64).orderBy("page_id", "chunk_no").collect()
    big = [r for r in rows if r["page_id"] == 1]
    assert len(big) == -(-len(BIG) // 64) and [r["last"] for r in big] == [False] * (len(big) - 1) + [True]
    for k, r in enumerate(big, 1):
        so_far = BIG[: 64 * k].encode()
        assert (r["chunk_no"], r["size"], r["digest"]) == (k, len(so_far), hashlib.sha1(so_far).hexdigest())
    (empty,) = (r for r in rows if r["page_id"] == 2)
    assert empty["last"] and empty["body"] == "" and empty["digest"] == hashlib.sha1(b"").hexdigest()


@pytest.mark.parametrize("spoil", [lambda v: v.replace("aaaa", "aaab", 1), lambda v: v.replace("sha1:", "sha1:0", 1)])
def test_damage_is_an_error(spark, tmp_path, spoil):
    path = str(tmp_path / "w")
    at = warc.write(spark.createDataFrame([(1, "u", "a" * 2000)], "page_id long, url string, html string"), path, chunk=600)
    lines = [r[0] for r in warc._lines(spark, path, at).collect()]
    assert list(warc._streamed(iter([pd.DataFrame({"value": lines})])))[0].loc[0, "payload_bytes"] == 2000
    lines[2] = spoil(lines[2])
    with pytest.raises(ValueError, match="damaged"):
        list(warc._streamed(iter([pd.DataFrame({"value": lines})])))


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    bench = spark.createDataFrame([], "item_id long, text string")
    assert sharding.shard(none).count() == mixing.mix(none).count() == simhash.near_duplicates(none).count() == 0
    assert decontamination.contamination(none, bench).count() == 0
    assert not [r for r in decontamination.contamination(spark.createDataFrame(DIRTY, "doc_id long, text string"), bench).collect() if r["contaminated"]]
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert mixing.mixed(none).columns == none.columns and simhash.deduplicated(none).count() == 0
