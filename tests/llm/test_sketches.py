import hashlib
import random
import re

import numpy as np
import pytest

from tests.llm.data import awkward, empty
from tillroll.llm import sketches
from tillroll.llm.queries import QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size=5):
    found = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(found[k : k + size]) for k in range(max(len(found) - size + 1, 1))} if found else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def plain_edited(rows):
    """doc_id, n_chars, digest, and the three texts, by a plain sort."""
    texts = sorted(((i is None, -(i or 0), (t or "").encode(), i) for i, t in rows))
    out = []
    for k, (_, _, raw, i) in enumerate(texts):
        own, after = raw.decode(), texts[(k + 1) % len(texts)][2].decode()
        half = len(own) // 2
        new = own[: len(own) - half] + after[:half]
        out.append((i, len(own), hashlib.sha256(new.encode()).hexdigest(), own, new, after))
    return out


def texts(n, seed=3):
    rng = random.Random(seed)
    return [" ".join(rng.choice(["The", "é", "to", "BE", "or", "漢字", "x\ny"]) for _ in range(rng.randint(0, 90))) for _ in range(n)]


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_edited_against_a_plain_sort(spark, parts):
    rows = [(rng_id, t) for rng_id, t in zip(random.Random(1).sample(range(-50, 1000), 80), texts(80))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in sketches.edited(docs, k=4096, parts=parts).collect()}
    expected = plain_edited(rows)
    assert len(got) == len(expected)
    for i, n, digest, own, new, after in expected:
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (n, digest)
        assert r.near_edited == pytest.approx(jaccard(shingles(own), shingles(new)))
        assert r.near_next == pytest.approx(jaccard(shingles(own), shingles(after)))
        assert len(r.fingerprint) == 16 * len(shingles(own)) and r.n_shingles == len(shingles(own))


def test_repeated_and_null_ids(spark):
    rows = [(7, t) for t in texts(60, 4)] + [(None, t) for t in texts(30, 5)] + [(k, "same") for k in (1, 9, 9, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sketches.edited(docs, parts=6).select("doc_id", "n_chars").collect()
    assert sorted(map(str, got)) == sorted(str(r) for r in spark.createDataFrame(
        [(i, len(t)) for i, t in rows], "doc_id long, n_chars long").collect())


def test_ties_follow_a_total_order(spark):
    """Ids that repeat too rarely for parts of their own are ordered by text."""
    rows = [(k // 2, t) for k, t in enumerate(texts(60, 6))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sketches.edited(docs, parts=4).select("doc_id", "n_chars", "edited_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(r[:3] for r in plain_edited(rows))


def test_sketch_estimates(spark):
    rng = random.Random(8)
    pool = [f"w{k}" for k in range(5000)]
    a = " ".join(rng.choice(pool) for _ in range(20000))
    b = a[: len(a) // 2] + " " + " ".join(rng.choice(pool) for _ in range(5000))
    docs = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    s = {r.doc_id: r.sketch for r in sketches.fingerprints(docs, ["doc_id"], 512).collect()}
    pair = spark.createDataFrame([(s[1], s[2])], "a array<long>, b array<long>")
    r = pair.select(
        sketches.resemblance("a", "b", 512).alias("j"), sketches.containment("b", "a", 512).alias("c"),
        sketches.distinct_shingles("a", 512).alias("n"),
    ).first()
    x, y = shingles(a), shingles(b)
    assert r.j == pytest.approx(jaccard(x, y), abs=0.08)
    assert r.c == pytest.approx(len(x & y) / len(y), abs=0.1)
    assert r.n == pytest.approx(len(x), rel=0.15)


def test_columns_and_tasks_estimate_alike(spark):
    docs = spark.createDataFrame(list(enumerate([*texts(40, 12), "", "a b"])), "doc_id long, text string")
    k = 16
    own = {r.doc_id: r.sketch for r in sketches.fingerprints(docs, ["doc_id"], k).collect()}
    pairs = [(own[a], own[b]) for a in range(42) for b in (a, (a * 7 + 1) % 42)]
    rows = spark.createDataFrame(pairs, "a array<long>, b array<long>").select(
        "a", "b", sketches.resemblance("a", "b", k).alias("r"), sketches.containment("a", "b", k).alias("c")
    )
    for row in rows.collect():
        assert (row.r, row.c) == pytest.approx(sketches.likeness(np.array(row.a, np.int64), np.array(row.b, np.int64), k))
    found = sketches.edited(docs, k).select("doc_id", sketches.from_hex("fingerprint").alias("s"))
    assert {r.doc_id: r.s for r in found.collect()} == own


def test_merge_equals_the_sketch_of_the_whole(spark):
    rows = [(k % 4 if k % 5 else None, t) for k, t in enumerate(texts(200, 9))]
    docs = spark.createDataFrame(rows, "part long, text string").repartition(7)
    parts = sketches.fingerprints(docs, ["part"], 64)
    got = {r.part: r.sketch for r in sketches.merge(parts, ["part"], 64).collect()}
    hashes = {}
    for r in sketches.fingerprints(docs, ["part"], 10**6).collect():
        hashes.setdefault(r.part, set()).update(r.sketch)
    assert got == {key: sorted(found)[:64] for key, found in hashes.items()}
    whole = sketches.merge(parts, [], 64).first().sketch
    assert whole == sorted(set().union(*hashes.values()))[:64]


def test_awkward_rows(spark):
    got = sketches.edited(awkward(spark, ["one two", "ONE  two"])).collect()
    assert len(got) == 10
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by_id[2].fingerprint == by_id[3].fingerprint == "" and by_id[2].n_chars == 0
    assert by_id[100].fingerprint == by_id[101].fingerprint != ""
    assert len(by_id[4].fingerprint) == 16 * sketches.K
    assert sketches.edited(empty(spark)).count() == 0
    assert sketches.fingerprints(awkward(spark), ["doc_id", "score"]).columns == ["doc_id", "score", "sketch"]
    assert sketches.merge(sketches.fingerprints(empty(spark), ["doc_id"]), ["doc_id"]).count() == 0
    alone = sketches.edited(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).first()
    assert alone.edited_sha256 == hashlib.sha256(b"abab").hexdigest()


def test_query(spark, tmp_path):
    rows = [(k, " ".join(t.split(" ")[:40])) for k, t in enumerate(texts(30, 11))]  # no sketch is full
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op11_bottom_k_sketches"](spark, str(tmp_path)).collect()}
    for i, n, digest, own, new, after in plain_edited(rows):
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (n, digest)
        assert r.near_edited == pytest.approx(jaccard(shingles(own), shingles(new)))
        assert r.near_next == pytest.approx(jaccard(shingles(own), shingles(after)))
        assert r.n_shingles == len(shingles(own)) and len(r.fingerprint) == 16 * len(shingles(own))
        assert r.kept_in_edited == pytest.approx(len(shingles(own) & shingles(new)) / len(shingles(own)) if shingles(own) else 1.0)
