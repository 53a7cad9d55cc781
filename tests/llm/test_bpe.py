import json
import random
import time

import numpy as np
import pytest
from tokenizers import Tokenizer

from tests.llm.data import awkward, empty
from tillroll.llm import bpe
from tillroll.llm.queries import BPE_VOCABULARY


@pytest.fixture(scope="module")
def tool():
    return bpe.Encoder(bpe.read_definition(BPE_VOCABULARY))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BPE_VOCABULARY)


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_against_the_library(tool, library):
    rng = random.Random(8)
    texts = ["", " ", "a\r\n\t b  ", "don't''S we'll 'VE", "<|endoftext|>", "x<|endoftext|> <|endoftext|", "\x85\x1c\x1f​　 z", "aaaaaaa" * 20, "²½Ⅷ१२ 漢字かな"]
    for k in range(3000):
        kinds = [
            lambda: "".join(rng.choice("ab") for _ in range(rng.randint(1, 20))),
            lambda: "".join(rng.choice("etaoinshrdlu .-=") for _ in range(rng.randint(1, 40))),
            lambda: "".join(chr(rng.choice([rng.randint(1, 0x24F), rng.randint(0x250, 0x2FFF), rng.randint(0x1F300, 0x1F6FF)])) for _ in range(rng.randint(1, 20))),
            lambda: "".join(tool.texts[rng.randrange(50256)].decode("utf-8", "replace") for _ in range(rng.randint(1, 5))),
        ]
        texts.append(kinds[k % 4]())
    for text, made in zip(texts, tool.encode(texts)):
        expected = library.encode(text, add_special_tokens=False).ids
        assert ids(made) == expected, text
        assert tool.decode(made) == library.decode(expected, skip_special_tokens=False) == text


def test_pairs_against_merging(tool):
    rng = random.Random(9)
    a, b = (np.array([rng.randrange(50256) for _ in range(20000)]) for _ in range(2))
    good = tool.compatible(a, b)
    merged = bpe.cut_up(*tool.merge([tool.texts[x] + tool.texts[y] for x, y in zip(a, b)]))
    assert good.tolist() == [ids(m) == [x, y] for m, x, y in zip(merged, a.tolist(), b.tolist())]
    assert 0 < good.sum() < len(good)


def test_only_failing_words_are_merged(tool):
    tool.known.clear()
    before = tool.failed
    tool.learn([" the", " house"])
    assert tool.failed == before


def test_tiny_vocabulary():
    spec = {"added_tokens": [], "model": {"vocab": {"a": 0, "b": 1, "ab": 2}, "merges": ["a b"]}}
    tool = bpe.Encoder(json.dumps(spec))
    assert ids(tool.encode(["abacab"])[0]) == [2, 0, 0, 1][:2] + [2]  # the byte of c has no token


def test_awkward_rows(spark, library):
    docs = awkward(spark, ["one <|endoftext|> two"])
    rows = {r.doc_id: r for r in bpe.digests(docs, BPE_VOCABULARY, ["doc_id"]).collect()}
    assert rows[1].n_tokens == rows[2].n_tokens == 0 and rows[100].n_tokens == 4
    done = bpe.tokenise(docs.withColumnRenamed("source", "token_ids"), BPE_VOCABULARY)
    made = {r.doc_id: r for r in done.collect()}
    assert made[100].token_ids == library.encode("one <|endoftext|> two").ids and all(r.round_trip for r in made.values())
    back = bpe.decode_documents(done, BPE_VOCABULARY, ["doc_id"])
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.text == (texts[r.doc_id] or "") for r in back.collect() if r.doc_id is not None)
    assert bpe.digests(empty(spark), BPE_VOCABULARY, ["doc_id"]).count() == bpe.tokenise(empty(spark), BPE_VOCABULARY).count() == 0


def test_long_words_against_the_library(tool, library):
    rng = random.Random(12)
    kinds = ["etaoinshrdluc", "ACGT", "a", "ab", "0123456789", "一二三四五的是了", "=-_", "éaü", "\U0001f600\U0001f601", " "]
    texts = ["".join(rng.choices(k, k=rng.choice([bpe.LONG - 1, bpe.LONG, bpe.LONG + 1, 3000]))) + tail for k in kinds for tail in ("", " end")]
    texts += ["x".join(texts[:6]), "".join(tool.texts[rng.randrange(50256)].decode("utf-8", "replace").strip() for _ in range(2000))]
    for text, made in zip(texts, tool.encode(texts)):
        assert ids(made) == library.encode(text, add_special_tokens=False).ids
    assert all(len(w) <= bpe.LONG for w in tool.known)


def test_long_words_by_heap_and_by_table(tool):
    rng = random.Random(13)
    for k in range(200):
        word = "".join(rng.choices("etaoinsé" if k % 2 else "ab", k=rng.randint(0, 60))).encode()
        assert tool._merge_long(word).tolist() == tool.merge([word])[0].tolist()
        assert (tool._follow(np.frombuffer(word, np.uint8)).tolist() if word else []) == tool.propose([word])[0].tolist()


def test_time_of_unbroken_runs(tool, library):
    rng = random.Random(14)
    for letters in ("abcdefghijklmnopqrstuvwxyz", "0123456789abcdef", "ACGT", "一二三四五六七八九十"):
        text = "".join(rng.choices(letters, k=1_000_000 // len(letters[0].encode())))
        begin = time.monotonic()
        made = tool.encode([text])[0]
        assert time.monotonic() - begin < 20, letters
        assert ids(made) == library.encode(text, add_special_tokens=False).ids
