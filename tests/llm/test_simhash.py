import random
import re

import numpy as np
import xxhash

from tests.llm.data import awkward, empty
from tillroll.llm import simhash
from tillroll.llm.components import components, spanning

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(max(len(words) - 3, 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(fps, radius):
    root = {k: k for k in fps}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    ids = sorted(fps)
    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in ids}


def test_fingerprint():
    rng = random.Random(1)
    for n in (0, 1, 3, 4, 5, 254, 255, 256, 258, 259, 700):
        text = " ".join(rng.choice(["The", "é", "ÀB", "x y", "Z\x85"]) + "\n" * rng.randint(0, 1) for _ in range(n))
        assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


def test_classes_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 20)  # large buckets take several blocks
    monkeypatch.setattr(simhash, "TILE", 7)
    rng = random.Random(2)
    fps = {}
    for k in range(400):
        if k % 3 and fps:
            value = fps[rng.choice(list(fps))]
            for b in rng.sample(range(64), rng.randint(0, 6)):
                value ^= 1 << b
        else:
            value = rng.getrandbits(64)
        fps[k] = value
    rows = [(k, int(np.uint64(v).astype(np.int64))) for k, v in fps.items()]
    prints = spark.createDataFrame(rows, "doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in simhash.classes(prints).collect()}
    assert got == plain_classes(fps, 4)


def test_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(200, 100), (100, 300)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {**{k: 0 for k in range(1, 61)}, 200: 100, 300: 100}


def test_spanning():
    i, j = spanning(np.array([3, 1, 7]), np.array([1, 0, 8]), 10)
    assert sorted(zip(i.tolist(), j.tolist())) == [(0, 1), (0, 3), (7, 8)]


def test_awkward_rows(spark):
    texts = ["one two three four five six", "ONE two  three\nfour five six", "something else altogether, quite another text"]
    docs = awkward(spark, texts)
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].component_id == by_id[2].component_id == by_id[3].component_id == 1
    assert by_id[1].fingerprint == "0" * 16 and by_id[100].fingerprint == by_id[101].fingerprint
    assert all(r.component_id is None for r in rows if r.doc_id is None)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 4, 5, 100, 102]
    assert kept.filter("doc_id IS NULL").count() == 2
    assert simhash.near_duplicates(empty(spark)).count() == simhash.keep_one(empty(spark)).count() == 0


def test_repeated_ids_go_only_with_a_copy_that_stays(spark):
    a, b = "one two three four five six", "something else altogether, quite another text"
    rows = [(1, a), (2, a), (2, b), (3, b), (4, "a third text of its own here"), (4, "and the fourth is not like it")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept)) == sorted([rows[0], rows[2], rows[4], rows[5]])
