import random
import re

from tests.llm.data import awkward, empty
from tillroll.llm import containment

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def runs(text, size):
    w = words(text)
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}


def plain(docs, items, threshold=0.8):
    found = set()
    for i, text in items:
        size = min(5, len(words(text)))
        mine = runs(text, size) if size else set()
        for d, doc in docs:
            shared = len(mine & runs(doc, size)) if mine else 0
            if mine and shared >= threshold * len(mine):
                found.add((d, i, shared, len(mine)))
    return found


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(7)
    vocabulary = [f"w{k}" for k in range(400)] + ["é", "Ünd"]
    sentence = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, sentence(rng.choice([1, 2, 4, 5, 6, 9, 17, 30, 70, 140]))) for k in range(60)]
    docs = []
    for k in range(150):
        text = sentence(rng.choice([0, 3, 10, 200, 1500]))
        for _ in range(rng.randint(0, 2)):
            passage = list(rng.choice(items)[1])
            if rng.random() < 0.5 and len(passage) > 10:
                passage[rng.randrange(len(passage))] = "changed"
            at = rng.randint(0, len(text))
            text[at:at] = passage
        docs.append((k, ", ".join(text).upper() if k % 2 else "\n".join(text)))
    items = [(k, " ".join(w)) for k, w in items] + [(90, ""), (91, None), (92, " - ")]
    doc_frame = spark.createDataFrame(docs, "doc_id long, text string")
    item_frame = spark.createDataFrame(items, "item_id long, text string")
    expected = plain(docs, items)
    assert len(expected) > 100
    for size in (containment.BLOCK_BYTES, 2000):  # one block of items, several
        monkeypatch.setattr(containment, "BLOCK_BYTES", size)
        rows = containment.contained_items(doc_frame, item_frame).collect()
        assert {(r.doc_id, r.item_id, r.n_shared, r.n_shingles) for r in rows} == expected and len(rows) == len(expected)
        clean = {r.doc_id for r in containment.decontaminate(doc_frame, item_frame).collect()}
        assert clean == {k for k, _ in docs} - {d for d, *_ in expected}


def test_item_in_a_very_long_text(spark):
    passage = "the quick brown fox jumps over the lazy dog and runs away"
    docs = awkward(spark, [" ".join(f"filler{k}" for k in range(50000)) + f" {passage} end"])
    items = spark.createDataFrame([(1, passage), (1, "another item with the same id")], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.containment) for r in containment.contained_items(docs, items).collect()] == [(100, 1, 1.0)]
    clean = containment.decontaminate(docs, items)
    assert clean.columns == docs.columns and clean.count() == docs.count() - 1


def test_empty_tables(spark):
    items = spark.createDataFrame([], "item_id long, text string")
    docs = awkward(spark)
    assert containment.contained_items(docs, items).count() == 0
    assert containment.decontaminate(docs, items).count() == docs.count()
    assert containment.contained_items(empty(spark), items).count() == 0


def test_one_row_per_document_over_several_blocks(spark, monkeypatch):
    rng = random.Random(17)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    passage = lambda n: " ".join(rng.choices(words, k=n))
    items = [(k, passage(rng.randint(1, 40))) for k in range(200)] + [(7, passage(12)), (None, passage(9)), (900, None), (901, "")]
    texts = [f"{passage(50)} {items[k][1]} {passage(30)} {items[k + 1][1]}" for k in range(0, 200, 8)]
    docs = awkward(spark, texts)
    frame = spark.createDataFrame(items, "item_id long, text string")
    whole = containment.find_items(docs, frame, ["doc_id", "text", "score"]).collect()
    monkeypatch.setattr(containment, "BLOCK_BYTES", 64 << 10)
    assert len(list(containment.blocks(frame))) > 3
    parts = containment.find_items(docs, frame, ["doc_id", "text", "score"])
    assert parts.columns == ["doc_id", "text", "score", "matches"]
    key = lambda r: (str(r.doc_id), str(r.text), sorted(map(str, r.matches)))
    assert sorted(map(key, parts.collect())) == sorted(map(key, whole)) and len(whole) == docs.count()
    assert sum(len(r.matches) > 1 for r in whole) >= 20
    clean = containment.decontaminate(docs, frame)
    assert clean.count() == sum(not r.matches for r in whole)


def test_blocks_are_as_large_as_their_index():
    rng = random.Random(18)
    items = [(k, " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(12)).encode()) for k in range(20000)]
    index = containment.Index(items)
    taken = sum(g.minima.nbytes + g.owners.nbytes + g.table.nbytes for g in index.groups) + sum(map(len, index.lines))
    assert taken <= sum(len(t) + containment.ITEM_BYTES for _, t in items)
    assert index.candidates([items[5][1], b"", items[19999][1]]) >= {(0, 5), (2, 19999)}
