"""Toxicity and language ID: exported weights against a plain scorer, held-out measures on the test tables, edge cases."""

import math
import random
import zlib

import pytest

from nodeloom.llm import language_id, toxicity

TABLES = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, score double, toxic int, id long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, 0.5, 7, -1) for i, t, lang in rows], DOCS)


def plain_slots(text, sizes, bits):
    """Every n-gram of the folded text, hashed character by character."""
    folded = " "
    for c in text:
        low = c.lower()
        folded += (low if len(low) == 1 and ord(c) < 0x3000 else c) if c.isalpha() else " "
    out = []
    for size in sizes:
        for k in range(len(folded) - size + 1):
            h = size * 0x2545F491 & 0xFFFFFFFF
            for c in folded[k : k + size]:
                h = ((h ^ ord(c)) * 0x9E3779B1) & 0xFFFFFFFF
            h ^= h >> 15
            out.append(((h * 0x85EBCA6B) & 0xFFFFFFFF) >> (32 - bits))
    return out, len(folded)


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{TABLES}/documents.parquet"), spark.read.parquet(f"{TABLES}/labels.parquet")


def test_toxicity_scores_are_those_of_its_weights(spark, tables):
    docs, labels = tables
    model = toxicity.fit(docs, labels)
    weight = dict(zip(model.slots.tolist(), model.weights.tolist(), strict=True))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(got) == set(texts)
    for i in random.Random(1).sample(sorted(texts), 60):
        slots, length = plain_slots(texts[i], toxicity.SIZES, toxicity.BITS)
        z = sum(weight.get(s, 0.0) for s in slots) / math.sqrt(length) + model.intercept
        assert math.isclose(got[i], 1 / (1 + math.exp(-max(-30, min(30, z)))), rel_tol=1e-3, abs_tol=1e-4)
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect() if r["doc_id"] in got and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0}
    up, down = ([got[i] for i, t in truth.items() if t == k] for k in (1, 0))
    auc = sum((a > b) + 0.5 * (a == b) for a in up for b in down) / (len(up) * len(down))
    assert auc >= 0.9, (auc, len(up), len(down))


def test_toxicity_of_repeated_rows(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["calm", "river", "stone", "vile" if i % 3 == 0 else "mild"]) for _ in range(30)), "en") for i in range(120)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)] * 2, "doc_id long, toxic int")
    rows += [rows[0]] * 50 + [rows[1]] * 50 + [(2, f"copy {k} of an id", "en") for k in range(50)]
    model = toxicity.fit(docs_of(spark, rows), labels, per_class=40)
    got = [(r["doc_id"], r["score"], r["predicted"]) for r in toxicity.score(docs_of(spark, rows), model).collect()]
    assert len(got) == len(rows) and len({g for g in got if g[0] == 0}) == 1
    assert sum(p == (i % 3 == 0) for i, _, p in got if i > 2) >= 0.95 * 117
    assert toxicity.fit(docs_of(spark, rows).limit(0), labels).weights.size == 0


def test_language_is_that_of_its_machines(spark, tables):
    docs, _ = tables
    model = language_id.fit(docs)
    rows = {r["doc_id"]: r for r in language_id.identify(docs, model).collect()}
    facts = {r["doc_id"]: (r["text"], r["lang"]) for r in docs.collect()}
    heads = len(model.families) if len(model.families) > 2 else len(model.families) - 1

    def plain(text):
        slots, length = plain_slots(text, language_id.SIZES, language_id.BITS)
        margin = [sum(float(t[s]) for s in slots) / length + b for t, b in zip(model.tables, model.offsets, strict=True)]
        first = margin[:heads] if heads != 1 else [margin[0], -margin[0]]
        family = model.families[max(range(len(first)), key=lambda k: first[k])] if first else model.families[0]
        votes = {k: 0.0 for k, f in enumerate(model.family) if f == family}
        total = dict.fromkeys(votes, 0.0)
        for (a, b), m in zip(model.pairs, margin[heads:], strict=True):
            if a in votes:
                votes[a if m > 0 else b] += 1
                total[a] += m
                total[b] -= m
        return model.languages[max(votes, key=lambda k: (votes[k], total[k]))]

    for i in random.Random(2).sample(sorted(facts), 60):
        assert rows[i]["lang_pred"] == (plain(facts[i][0]) if any(c.isalpha() for c in facts[i][0]) else "und")
    held = [i for i in facts if rows[i]["held_out"] and rows[i]["lang_pred"] != "und"]
    share = sum(rows[i]["lang_pred"] == facts[i][1] for i in held) / len(held)
    assert share >= 0.95, share


def test_language_of_nothing_and_of_repeated_rows(spark):
    rows = [(i, "der ung schlich" if i % 2 else "the with shore", "de" if i % 2 else "en") for i in range(40)]
    df = docs_of(spark, rows + [rows[0]] * 60 + [(50, "the " * 100_000, None), (51, None, "de")])
    model = language_id.fit(df, per_language=10)
    got = [(r["doc_id"], r["lang_pred"]) for r in language_id.identify(df, model).collect()]
    assert len(got) == 102 and all(p == ("de" if i % 2 else "en") for i, p in got if i < 51)
    assert dict(got)[51] == "und"
    assert language_id.identify(df.limit(0), model).count() == 0
    assert language_id.fit(df.limit(0)).languages == []
