"""Repeated rows and ids, ties, hot groups, very long texts, empty tables and clashing columns, by operator."""

import collections
import hashlib
import random
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F
from test_operators import brute_components, brute_cut, docs_of, sentence

import corpus_pipeline
from nodeloom.llm import chat, decontamination, mixing, near_dedup, suffix_dedup, warc
from nodeloom.llm.common import materialize


def test_chat_ties_repeats_and_long_conversations(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, "assistant", "b")] + [(2, k, "user" if k % 2 == 0 else "assistant", f"t{k}" * 20) for k in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r["conv_id"]: r for r in chat.format_digests(df).collect()}
    again = {r["conv_id"]: r for r in chat.format_digests(df.repartition(5)).collect()}
    assert out == again and out[2]["n_turns"] == 3000
    told = "".join(f"{r}\n{t}\n" for _, _, r, t in rows[3:])
    assert out[2]["turns_sha256"] == hashlib.sha256(told.encode()).hexdigest()


def test_near_duplicates_of_a_hot_group_and_a_long_text(spark):
    """Most rows are edits of one text, near the threshold to it and to each other; texts repeat and one is very long."""
    rng = random.Random(77)
    base = sentence(rng, 60).split()
    texts = []
    for i in range(260):
        copy = list(base)
        for _ in range(rng.choice([1, 2, 3, 3, 4, 4, 5, 8])):
            copy[rng.randrange(len(copy))] = rng.choice(["red", "blue", "gold", "pink"]) + str(rng.randrange(6))
        texts.append((i, " ".join(copy)))
    long = sentence(rng, 60_000)
    texts += [(300, long), (301, long + " one more"), (302, texts[0][1]), (303, "")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs_of(spark, texts + texts[:5]), size=2).collect()}
    assert got == brute_components(texts, 2)
    left = near_dedup.deduplicate(docs_of(spark, texts), size=2)
    assert left.columns == docs_of(spark, texts).columns
    assert {r["doc_id"] for r in left.collect()} == {i for i, (_, c) in got.items() if i == c}


def test_near_duplicates_of_the_test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs, size=2).collect()}
    assert got == brute_components(texts, 2)


def test_mixing_of_repeated_rows_and_extreme_weights(spark):
    rng = random.Random(3)
    texts = [(i, sentence(rng, rng.randrange(1, 30))) for i in range(200)] + [(7, "same words here")] * 90 + [(None, "x y")] * 40 + [(None, None)] * 3
    df = docs_of(spark, texts, {i: f"s{(i or 0) % 2}" for i, _ in texts})
    for quality in (None, F.lit(1e6), F.when(F.col("doc_id") < 20, 1e9).otherwise(1e-6)):
        rows = mixing.mix_sources(df, quality=quality).collect()
        assert len(rows) == len(texts)
        taken, target = collections.defaultdict(int), {}
        for r in rows:
            assert 0 <= r["taken"] <= 2 * r["size"]
            taken[r["skey"]] += r["taken"]
            target[r["skey"]] = r["target"]
        assert all(abs(taken[k] - target[k]) <= 120 for k in target)  # one text, or a word for each of the rows that share the cut
    clash = df.withColumn("size", F.lit("own")).withColumn("taken", F.lit(0)).withColumn("skey", F.lit("s")).withColumn("mix_row", F.lit(1)).withColumn("key", F.lit(2))
    out = mixing.take(clash)
    assert sorted(out.columns) == sorted({*clash.columns, *mixing.ADDED}) and out.where("taken <= 0 OR skey <> 's' OR mix_row <> 1").count() == 0
    whole = collections.Counter((r["doc_id"], r["taken"]) for r in mixing.mix_sources(clash).where("taken > 0").collect())
    assert collections.Counter((r["doc_id"], r["taken"]) for r in out.collect()) == whole


def test_long_and_repeated_benchmark_items(spark):
    rng = random.Random(40)
    words = lambda n: " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(4000)}" for _ in range(n))
    items = [(0, words(1500)), (1, words(3000)), (2, words(40)), (3, None)]
    items += [(2, items[2][1]), (4, items[2][1])]
    texts = [(0, words(200) + " " + items[0][1] + " " + words(200)), (1, items[1][1]), (2, words(3000)), (3, words(30) + " " + items[2][1]), (4, None), (3, items[2][1]), (5, words(500) + items[0][1][: len(items[0][1]) // 3])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = collections.Counter((r["doc_id"], r["item_id"]) for r in decontamination.find_leaks(docs_of(spark, texts), bench).collect())
    assert {(0, 0), (1, 1), (3, 2), (3, 4)} == set(found)
    small = docs_of(spark, texts[:1])
    assert [r["item_id"] for r in decontamination.find_leaks(small, bench).collect()] == [0]
    clean = decontamination.decontaminate(docs_of(spark, texts), bench)
    assert sorted(r["doc_id"] for r in clean.collect()) == [2, 4, 5]


def test_suffix_dedup_of_null_and_shared_ids(spark):
    rng = random.Random(50)
    passage = sentence(rng, 20)
    texts = [(5, passage + " five"), (5, "again " + passage), (3, "first " + passage + " end"), (None, passage), (None, "and " + passage), (9, None), (8, "short")]
    rows = suffix_dedup.cut_repeats(docs_of(spark, texts)).collect()
    assert len(rows) == len(texts)
    kept = collections.Counter((r["doc_id"], bytes(r["kept"]).decode()) for r in rows)
    b = {i: t or "" for i, t in texts if i in (3, 8, 9)}
    assert all(kept[i, t] == 1 for i, t in b.items())
    lost = [k for k in kept if k[0] in (5, None) and passage in k[1]]
    assert not lost and sum(n for (i, _), n in kept.items() if i is None) == 2


def test_pipeline_of_odd_rows(spark, tmp_path):
    rng = random.Random(61)
    text = lambda n: " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(900)}" for _ in range(n))
    rows = [(i, text(rng.randrange(30, 60)), None if i % 7 == 0 else "en", f"s{i % 3}" if i % 5 else None, 1, "own", "d") for i in range(60)]
    rows += [rows[0], rows[0], (1, rows[1][1].replace(" ", "  "), "en", "s1", 1, "own", "d"), (2, text(50), "en", "s1", 1, "own", "d"), (None, text(40), "en", "s1", 1, "own", "d"), (None, None, None, None, None, None, None), (90, "", "en", "s0", 0, "own", "d"), (91, "word " * 50_000, "en", "s0", 0, "own", "d")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, size string, dropped string"
    docs = spark.createDataFrame(rows, schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, 1), (3, None), (3, 5)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, None), (1, rows[9][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        got = materialize(stage(spark, got, str(tmp_path)), name)
        left[name] = collections.Counter((r["doc_id"], r["text"]) for r in got.collect())
        assert k == len(corpus_pipeline.STAGES) - 1 or got.columns == docs.columns
    whole = collections.Counter((r[0], r[1]) for r in rows)
    assert left["toxicity"] == whole  # nothing was learned
    spaced = rows[1][1].replace(" ", "  ")
    empty = {(None, None), (90, "")}
    assert set(whole) - set(left["exact_dedup"]) in ({(1, rows[1][1]), e} for e in empty) and set(left["exact_dedup"].values()) == {1}
    assert (1, spaced) in left["exact_dedup"] and (2, rows[2][1]) in left["exact_dedup"]
    assert left["near_dedup"] == left["exact_dedup"]
    assert set(left["near_dedup"]) - set(left["decontamination"]) == {(9, rows[9][1])}
    assert {"size", "source_size", "target", "taken", "dropped"} <= set(got.columns) and got.where("taken > 2 * size").count() == 0
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name


def test_suffix_dedup_of_a_test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert {r["doc_id"]: (bytes(r["kept"]), len(r["starts"])) for r in suffix_dedup.cut_repeats(docs).collect()} == brute_cut(texts)


def test_fingerprints_are_of_the_bytes():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 3000).astype(np.uint8)
    begin = rng.integers(0, 2900, 400)
    end = begin + rng.integers(0, 69, 400)
    got = suffix_dedup.fingerprints(data, begin, end)
    moved = np.concatenate([rng.integers(0, 256, 77).astype(np.uint8), data])
    assert (suffix_dedup.fingerprints(moved, begin + 77, end + 77) == got).all()
    assert len(np.unique(got)) == len({data[a:b].tobytes() for a, b in zip(begin, end, strict=True)})
    for k in np.flatnonzero(end > begin)[:50]:
        other = data.copy()
        other[end[k] - 1] ^= 1
        assert suffix_dedup.fingerprints(other, begin[k : k + 1], end[k : k + 1])[0] != got[k]


def test_suffix_dedup_shuffles_little(spark):
    """Texts, k-grams and contexts are sent once each and packed: less than 2.5 x the table's files, however it grows."""
    store, gateway = spark._jsc.sc().statusStore(), spark.sparkContext._gateway
    stages = lambda: {s.stageId(): s.shuffleWriteBytes() for s in (found.apply(k) for found in [store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())] for k in range(found.size()))}
    before = stages()
    path = Path("/root/testdata/sf0.01/documents.parquet")
    suffix_dedup.cut_digests(spark.read.parquet(str(path))).write.format("noop").mode("overwrite").save()
    spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    sent = sum(n for k, n in stages().items() if k not in before)
    files = sum(p.stat().st_size for p in ([path] if path.is_file() else path.rglob("*.parquet")))
    assert 0 < sent < 2.5 * files


def test_suffix_dedup_packs_what_it_sends():
    rng = np.random.default_rng(2)
    for n in (0, 1, 5, 700, 9000, 40_000):
        keys = np.unique(rng.integers(0, 1 << 32, n).astype(np.uint32))
        assert (suffix_dedup._unpack_keys(suffix_dedup._pack_keys(keys)) == keys).all()
        assert n < 700 or len(suffix_dedup._pack_keys(keys)) < 3.3 * len(keys)
    ids = np.sort(np.append(rng.integers(-(1 << 62), 1 << 62, 90), [np.iinfo(np.int64).min, np.iinfo(np.int64).max]))
    assert (suffix_dedup._from_planes(suffix_dedup._planes(ids), len(ids)) == ids).all()


def test_blocks_of_an_archive_stay_where_they_are_read(spark):
    """Digests of captures need the payloads' sizes and hashes only: no join or exchange carries the blocks."""
    pages = spark.createDataFrame([(1, "u", "<p>\r\n\r\nx</p>"), (2, "u", ""), (3, "v", "<p>\r\n\r\nx</p>"), (4, "w", None)], "page_id long, url string, html string")
    got = warc.capture_digests(warc.round_trip(pages))
    plan = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    carried = [x for x in plan if "Project [" in x and "kind#" in x.split("]")[0] and "record_id#" in x]
    assert any("Join LeftOuter" in x for x in plan) and carried and not any("block#" in x.split("]")[0] for x in carried)
    rows = {r["page_id"]: r for r in got.collect()}
    assert [rows[k]["payload_bytes"] for k in (1, 2, 3, 4)] == [12, 0, 12, 0]
    assert rows[3]["record_type"] == "revisit" and rows[3]["refers_to"] == 1 and rows[3]["payload_digest"] == rows[1]["payload_digest"]
    whole = warc.round_trip(pages).where("record_id LIKE '%:1:%'").first()
    assert bytes(whole["response"]["block"]).endswith(b"\r\n\r\n<p>\r\n\r\nx</p>") and whole["response"]["payload_bytes"] == 12


def test_suffix_dedup_sends_copies_once(spark, tmp_path):
    """Whole copies go by their digests: their k-grams and contexts are not sent, within a task or across tasks."""
    one = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    for k in range(6):
        one.selectExpr(f"doc_id + {1_000_000 * k} as doc_id", "text").coalesce(1).write.mode("append").parquet(f"{tmp_path}/six")
    store, gateway = spark._jsc.sc().statusStore(), spark.sparkContext._gateway
    stages = lambda: {s.stageId(): s.shuffleWriteBytes() for s in (found.apply(k) for found in [store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())] for k in range(found.size()))}

    def run(docs):
        before = stages()
        rows = suffix_dedup.cut_repeats(docs).collect()
        spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        return rows, sum(n for k, n in stages().items() if k not in before)

    texts = {r["doc_id"]: r["text"] or "" for r in one.collect()}
    (alone, little), (rows, much) = run(one), run(spark.read.parquet(f"{tmp_path}/six"))
    single = {r["doc_id"]: (r["starts"], r["ends"], bytes(r["kept"])) for r in alone}
    assert len(rows) == 6 * len(alone)
    for r in rows:
        whole = texts[r["doc_id"] % 1_000_000].encode()
        want = single[r["doc_id"]] if r["doc_id"] < 1_000_000 else ([0], [len(whole)], b"") if len(whole) >= 50 else ([], [], whole)
        assert (r["starts"], r["ends"], bytes(r["kept"])) == want and r["n_bytes"] == len(whole)
    assert 0 < much < 3 * little
