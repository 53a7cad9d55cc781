import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tillroll.llm import chat

SCHEMA = "conv_id long, turn int, role string, text string, start long, segment string"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 7, "clash") for r in rows], SCHEMA)


def plain(rows):
    """Per conversation: turns in order, and the digests."""
    result = {}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=key)]
        loss = "".join(t for r, t in turns if r == "assistant")
        digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        result[conv] = (len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return result


def test_round_trip(spark):
    rng = random.Random(1)
    bits = ["<|im_end|>", "<|im_start|>assistant", "<\\|", "<\\\\|", "<|", "|>", "\\", "\n", "é", "word ", "<", "$1"]
    text = lambda: None if rng.random() < 0.1 else "".join(rng.choice(bits) for _ in range(rng.randint(0, 8)))
    roles = ["user", "assistant", "system", None, "odd\nrole", "x\\n<|y", "assistant "]
    rows = [(rng.randint(0, 12), rng.choice([None, *range(6)]), rng.choice(roles), text()) for _ in range(300)]
    rows += [(None, 0, "user", "a"), (None, 1, "assistant", "b")] + [(50, 1, "assistant", "twice")] * 2
    formatted = chat.format_turns(conversations(spark, rows))
    assert not [r for r in formatted.collect() if "<|" in r.segment[2:].replace(chat.END, "")]
    got = {r.conv_id: tuple(r)[1:5] for r in chat.digests(formatted).collect()}
    assert got == plain(rows)


def test_examples(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "hi"), (1, 2, "assistant", "<|im_end|>"), (1, 3, "user", "so"), (1, 4, "assistant", "ok"), (2, 0, "user", "alone")]
    formatted = chat.format_turns(conversations(spark, rows))
    found = chat.examples(formatted)
    shown = {r.turn: r for r in chat.render(formatted, found).collect()}
    assert sorted(shown) == [2, 4]
    for turn, reply in ((2, "<\\|im_end|>"), (4, "ok")):
        row = shown[turn]
        assert row.example.endswith(row.target) and len(row.example) == row.context_chars + len(row.target)
        assert row.example[row.loss_start : row.loss_end] == reply
    assert shown[4].example.startswith(shown[2].example) and shown[4].example.count("<|im_start|>") == 5
    digest = {r.conv_id: r for r in chat.digests(formatted).collect()}
    assert digest[1].n_examples == 2 and digest[1].example_chars == sum(len(r.example) for r in shown.values())
    assert digest[1].formatted_chars == len(shown[4].example) and digest[2].n_examples == 0


def test_empty_table(spark):
    formatted = chat.format_turns(conversations(spark, []))
    assert chat.digests(formatted).count() == chat.examples(formatted).count() == 0


def test_one_long_conversation_is_streamed(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", f"turn {k}") for k in range(5000)]
    row = chat.digests(chat.format_turns(conversations(spark, rows))).first()
    assert tuple(row)[1:5] == plain(rows)[1] and row.n_examples == 2500


def test_digests_are_taken_from_example_rows(spark, monkeypatch):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "<| first"), (1, 2, "user", "so"), (1, 3, "assistant", "second")]
    formatted = chat.format_turns(conversations(spark, rows))
    right, make = chat.digests(formatted).first(), chat.examples
    assert right.loss_chars == len("<| firstsecond")

    def changed(change):
        monkeypatch.setattr(chat, "examples", lambda *args, **kwargs: change(make(*args, **kwargs)))
        return chat.digests(formatted).first()

    lost = changed(lambda e: e.filter("target IS NULL OR turn <> 3"))
    assert (lost.n_turns, lost.turns_sha256, lost.formatted_chars) == (4, right.turns_sha256, right.formatted_chars)
    assert lost.n_examples == 1 and lost.example_chars < right.example_chars
    assert lost.loss_sha256 == hashlib.sha256(b"<| first").hexdigest()
    masked = changed(lambda e: e.withColumn("loss_end", F.col("loss_end") - 1))
    assert masked.n_examples == 2 and masked.loss_chars == right.loss_chars - 2
    assert masked.loss_sha256 == hashlib.sha256(b"<| firssecon").hexdigest()


def test_examples_are_written_out_and_read(spark, monkeypatch):
    rows = [(c, k, "assistant" if k % 2 else "user", f"<| {c} é {k}" * (k + 1)) for c in (None, 1, 2) for k in range(9)]
    rows += [(1, 3, "assistant", None), (1, None, "assistant", "first"), (3, 0, "assistant", "alone"), (4, 0, "user", "none")]
    formatted = chat.format_turns(conversations(spark, rows))
    monkeypatch.setattr(chat, "CHUNK", 100)  # several batches from one
    stream = {}
    for r in formatted.collect():
        stream.setdefault(r.conv_id, []).append(r)
    expected = sorted(
        (str(c), r.start, "".join(x.segment for x in turns if x.start <= r.start))
        for c, turns in stream.items() for r in turns if r.segment.startswith("<|im_start|>assistant\n")
    )
    written = chat.write_out(chat.examples(formatted, with_turns=True)).collect()
    assert sorted((str(r.conv_id), r.context_chars, r.example) for r in written if r.segment is None) == expected
    assert all(r.example is None for r in written if r.segment is not None) and len(written) == len(rows) + len(expected)
    right, make = {r.conv_id: r for r in chat.digests(formatted).collect()}, chat.write_out
    assert sum(r.example_chars for r in right.values()) == sum(len(text) for _, _, text in expected)
    assert {c: r.n_turns for c, r in right.items()} == {None: 9, 1: 11, 2: 9, 3: 1, 4: 1}

    for change in ("translate(example, 'é', 'e')", "substr(example, 2)", "concat(example, ' ')"):
        monkeypatch.setattr(chat, "write_out", lambda e, c=change: make(e).withColumn("example", F.expr(c)))
        with pytest.raises(Exception, match="does not go on from the stream"):
            chat.digests(formatted).collect()


def test_context_without_its_turns_is_refused(spark):
    formatted = chat.format_turns(conversations(spark, [(1, 0, "user", "a"), (1, 1, "assistant", "b")]))
    with pytest.raises(Exception, match="code points in a stream of"):
        chat.write_out(chat.examples(formatted, with_turns=True).filter("turn > 0")).collect()
