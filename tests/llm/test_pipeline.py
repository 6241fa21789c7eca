"""The pipeline's stages on a small corpus: what must go goes, what is clean stays."""

import collections
import hashlib
import math
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa

import corpus_pipeline
from nodeloom.llm import common, decontamination, near_dedup, ngrams
from nodeloom.llm.common import materialize, texts_of

WORDS = "the of and stone river cloud lamp green paper winter table anchor violin meadow copper signal harbor puzzle candle forest".split()


def test_pipeline(spark, tmp_path):
    rng = random.Random(12)
    text = lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(n))
    rows, labels = [], []
    for i in range(300):
        words = text(rng.randrange(40, 120)).split()
        if i % 6 == 0:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["vileword", "nastyterm", "grimslur"]))
        rows.append([i, " ".join(words)])
        labels.append((i, int(i % 6 == 0)))
    item = text(40)
    rows[1][1] += " " + item
    rows.append([301, rows[2][1].replace(" ", "\n")])
    near = rows[3][1].split()
    near[5] = "changed"
    rows.append([302, " ".join(near)])
    spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, left = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, str(tmp_path)), name)
        left[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name != "mixing":
            assert docs.columns == columns
    toxic = {i for i, t in labels if t}
    assert len(left["toxicity"] & toxic) <= 2
    assert len({i for i, _ in rows} - toxic - left["toxicity"]) <= 2
    assert len({2, 301} & left["exact_dedup"]) == 1
    assert len({3, 302} & left["near_dedup"]) == 1
    assert left["near_dedup"] - left["decontamination"] == {1}
    assert {"size", "taken", "target"} <= set(docs.columns)
    assert docs.where("taken <= 0 OR taken > 2 * size").count() == 0


def test_stages_bound_arrow_batches(spark, tmp_path):
    """What a kernel gets at once must not grow with the length of 10,000 texts, or an executor's memory does."""
    texts = " ".join(WORDS[k % 20] + str(k) for k in range(6000))
    docs = spark.range(0, 300, 1, 1).selectExpr("id AS doc_id", f"concat(id, ' {texts} ', id) AS text", "'en' AS lang", "'s' AS source", "1L AS n_chars")
    spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, "no such words anywhere")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    try:
        for _, stage in corpus_pipeline.STAGES[:4]:
            spark.conf.unset(name)
            stage(spark, docs.limit(3), str(tmp_path))
            found = [r["n"] for r in docs.mapInArrow(sizes, "n long").collect()]
            assert sum(found) > 300 * len(texts)
            assert max(found) < (4 << 20) + 2 * len(texts)
        spark.conf.set(name, "1m")  # a lower bound of the session's own stays
        corpus_pipeline.drop_exact_copies(spark, docs.limit(3), str(tmp_path))
        assert spark.conf.get(name) == "1m"
    finally:
        spark.conf.unset(name)


def test_kernels_hold_little_beside_the_text(monkeypatch):
    """Words, shingles and n-grams of 4 MB of text, with the tables of the hashes."""
    text = " ".join(WORDS[k * k % 20] + str(k) for k in range(4000))
    column = pa.array([text] * (4_000_000 // len(text)), pa.large_string())
    table = np.ones((1, (1 << 18) + 1), np.float32)
    kernels = [
        lambda: [None for _ in near_dedup._per_document(column, 5)],
        lambda: [None for _ in decontamination._word_lists(column)],
        lambda: ngrams.sums(*texts_of(column), (3, 4, 5, 6), 18, table),
    ]
    for kernel in kernels:
        monkeypatch.setattr(common, "_powers", [np.ones(1, np.uint64), np.ones(1, np.uint64)])
        tracemalloc.start()
        kernel()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 24_000_000


def test_powers_of_long_texts(monkeypatch):
    monkeypatch.setattr(common, "_powers", [np.ones(1, np.uint64), np.ones(1, np.uint64)])
    for n in (10, 300_000, 1_500_000, 7):
        up, down = common.powers(n)
        assert len(up) == len(down) == n
        assert (up * down == 1).all()
        assert int(up[n - 1]) == pow(common._BASE, n - 1, 1 << 64)


TABLES = "/root/testdata/sf0.001"


def plain_mix(docs):
    """(doc_id -> taken) by the definition: whole epochs, then documents in key order up to the nearest word."""
    size = {d: len(re.findall("[^ \t\n\x0b\x0c\r]+", t or "")) for d, t, _ in docs}
    by = collections.defaultdict(list)
    for d, _, s in docs:
        by[s].append(d)
    order = sorted(s for s in by if s is not None) + ([None] if None in by else [])
    total, weight = {s: sum(size[d] for d in by[s]) for s in by}, {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, open_ = {}, set(order)
    while open_:
        left = 1.5 * sum(total.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * total[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * total[s]
            open_.discard(s)

    def key(d):
        u = (int(hashlib.md5(f"7:{d}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
        return -math.log(u) / (1 + min(size[d], 1000) / 1000), str(d)

    taken = {}
    for s in by:
        epochs = int(target[s] // total[s]) if total[s] else 0
        rest, at = target[s] - epochs * total[s], 0
        for d in sorted(by[s], key=key):
            at += size[d]
            taken[d] = epochs * size[d] + (size[d] if at - size[d] / 2 <= rest else 0)
    return taken


def test_pipeline_against_brute_force(spark):
    """All of a test table; only what is toxic is asked of the operator, whose scores have tests of their own."""
    from test_operators import brute_components, brute_leaks

    from nodeloom.llm import toxicity

    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    scores = toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{TABLES}/labels.parquet")))
    bad = {r["doc_id"] for r in scores.where("predicted = 1").collect()}
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.select("doc_id", "text", "source").collect()]
    left = [r for r in rows if r[0] not in bad]
    groups = collections.defaultdict(list)
    for d, t, s in left:
        groups[re.sub("[ \t\n\x0b\x0c\r]", "", t or "")].append((-len(t or ""), d))
    keep = {min(g)[1] for g in groups.values()}
    left = [r for r in left if r[0] in keep]
    found = brute_components([(d, t) for d, t, _ in left], 5)
    left = [r for r in left if found[r[0]][1] == r[0]]
    items = [r["text"] for r in spark.read.parquet(f"{TABLES}/benchmark.parquet").orderBy("item_id").collect()]
    leaks = {k for k, _ in brute_leaks([t or "" for _, t, _ in left], items)}
    left = [r for k, r in enumerate(left) if k not in leaks]
    want = {d: n for d, n in plain_mix(left).items() if n > 0}
    got = {r["doc_id"]: r["taken"] for r in corpus_pipeline.run(spark, TABLES).collect()}
    assert got == want
