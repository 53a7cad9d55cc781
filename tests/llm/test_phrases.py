import random
import re
from collections import Counter

import pytest

from tests.llm.data import awkward, empty
from tillroll.llm import phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, max_words, min_count, top, within):
    counts, longest = {}, {}
    for lang, text in rows:
        mine = counts.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            found = re.findall(r"[^\x20\x09]+", piece)
            for size in range(1, max_words + 1):
                mine.update(tuple(found[k : k + size]) for k in range(len(found) - size + 1))
    out = []
    for lang, mine in counts.items():
        n = sum(c for p, c in mine.items() if len(p) == 1)
        candidates = {p: c for p, c in mine.items() if len(p) > 1 and c >= min_count}
        longest = {}
        for p, c in candidates.items():
            for size in range(2, len(p)):
                for k in range(len(p) - size + 1):
                    longest[p[k : k + size]] = max(longest.get(p[k : k + size], 0), c)
        kept = []
        for p, a in candidates.items():
            if p in longest and 100 * longest[p] >= within * a:
                continue
            cuts = []
            for k in range(1, len(p)):
                left, right = mine[p[:k]], mine[p[k:]]
                cuts.append((1000000 * a * a // (left * right), k, left, right))
            score, _, left, right = min(cuts)
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, text, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, text.decode(), -a, left, right, n, -score))
    return sorted(out)


def run(df, **options):
    return sorted(map(tuple, phrases.collocations(df, **options).collect()))


@pytest.mark.parametrize("max_words, min_count, top, within", [(3, 10, 2000, 50), (4, 3, 2000, 30), (2, 5, 7, 50), (5, 2, 50, 90)])
def test_against_plain_counts(spark, monkeypatch, max_words, min_count, top, within):
    rng = random.Random(max_words)
    words = ["The", "of", "é", "ÉT", "\x00z", "\xa0", "x-y", "a"]
    marks = [" ", " ", " ", "\t", "  ", ". ", ", ", "\n", "\x0b", "!?"]
    rows = []
    for _ in range(250):
        text = "".join(rng.choice(words) + rng.choice(marks) for _ in range(rng.randint(0, 40)))
        rows.append((rng.choice(["en", "fr", None, "und", ""]), text))
    df = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    monkeypatch.setattr(phrases.occurrences, "__defaults__", (300,))  # many chunks
    expected = plain(rows, max_words, min_count, top, within)
    assert expected and run(df, max_words=max_words, min_count=min_count, top=top, within=within) == expected


def test_exact_beyond_64_bits(spark):
    big = 3_000_000_000
    one = spark.createDataFrame([([1], big + 7), ([2], big + 1)], "phrase array<long>, f long")
    two = spark.createDataFrame([("en", "a b", [1, 2], big)], "lang string, text string, phrase array<long>, f long")
    row = phrases.scored([one, two]).first()
    assert (row.score, row.l, row.r) == (1000000 * big * big // ((big + 7) * (big + 1)), big + 7, big + 1)


def test_weakest_cut_and_ties(spark):
    rows = [("en", "a b c")] * 10 + [("en", "a b")] * 5 + [("en", "c")] * 5
    assert run(spark.createDataFrame(rows, "lang string, text string")) == plain(rows, 3, 10, 2000, 50)


def test_awkward_rows(spark):
    assert run(empty(spark)) == []
    docs = awkward(spark, ["again and again"] * 12 + [". , ;", "\n\n"])
    rows = [(r.lang, r.text) for r in docs.collect()]
    assert run(docs) == plain(rows, 3, 10, 2000, 50)
    with pytest.raises(ValueError):
        phrases.collocations(docs, max_words=1)


def test_read_words():
    vocabulary, counts, places = phrases.read_words([b"B a.b", b"", b"a  b"])
    assert vocabulary.to_pylist() == ["b", "a"] and counts.tolist() == [3, 2] and places.tolist() == [0, 1, -1, 0, -1, 1, 0]
    assert phrases.read_words([b"", b" .,"])[2].tolist() == []
