"""Chat formatting with prefix-target expansion.

A conversation is written once, as a stream of marked turns.  Every assistant turn is an example of its
own: its context is the stream up to the turn, its target the turn, and only the reply inside the
markers is trainable.  An example first names its context by length; `write_out` then writes every
example whole, its context included, and `digests` reads these texts.  The contexts of a conversation of
n turns add up to n² / 2 turns: they are written row by row, and neither kept nor shuffled.  `render`
writes out chosen examples only.

Control strings inside texts are escaped by a backslash after `<`, reversibly.  Rows of equal turn are
ordered by role and text; repeated rows are turns of their own.  Null texts and roles are empty; null
turns come first; rows with a null id form a conversation.
"""

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.text import CHUNK

START, END = "<|im_start|>", "<|im_end|>\n"
TARGET_ROLE = "assistant"


def escape(text: Column) -> Column:
    """Afterwards `<|` occurs nowhere."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: Column) -> Column:
    """Roles end at a line break, so theirs are written as backslash and n."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(\\|n)", lambda m: "\n" if m[1] == "n" else "\\", unescape(role))


def format_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, `segment` (the marked turn) and `start`, its place in the conversation's stream.

    Shuffles by conversation once; each is sorted (spilling) and streamed, never held whole.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = conversations.select("conv_id", "turn", empty("role").alias("role"), empty("text").alias("text"))
    segment = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"), escape(F.col("text")), F.lit(END))
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    ordered = ordered.select("conv_id", "turn", segment.alias("segment"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, end = (None,), 0
        for batch in batches:
            starts = []
            for conv, text in zip(batch.column("conv_id").to_pylist(), batch.column("segment").to_pylist()):
                if (conv,) != current:
                    current, end = (conv,), 0
                starts.append(end)
                end += len(text)
            yield batch.append_column("start", pa.array(starts, pa.int64()))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ordered.schema)
    return ordered.mapInArrow(place, f"{schema}, start bigint")


EXAMPLE = ("context_chars", "target", "loss_start", "loss_end")


def examples(formatted: DataFrame, with_turns: bool = False) -> DataFrame:
    """One row per assistant turn: `context_chars` of the stream come first, then `target`.

    Loss counts on the code points [loss_start, loss_end) of the whole example.  `with_turns` keeps the
    rows of all turns, in order, each before its example; `segment` is null in examples, theirs in turns.
    """
    head = f"{START}{TARGET_ROLE}\n"
    nothing = lambda name, kind: F.lit(None).cast(kind).alias(name)
    turn = F.struct(
        "segment", nothing("context_chars", "bigint"), nothing("target", "string"),
        nothing("loss_start", "bigint"), nothing("loss_end", "bigint"),
    )
    example = F.struct(
        nothing("segment", "string"),
        F.col("start").alias("context_chars"),
        F.col("segment").alias("target"),
        (F.col("start") + len(head)).alias("loss_start"),
        (F.col("start") + F.length("segment") - len(END)).alias("loss_end"),
    )
    is_example = F.col("segment").startswith(head)
    if not with_turns:
        return formatted.filter(is_example).select("conv_id", "turn", example.alias("row")).select("conv_id", "turn", *(f"row.{c}" for c in EXAMPLE))
    rows = F.when(is_example, F.array(turn, example)).otherwise(F.array(turn))
    return formatted.select("conv_id", "turn", F.explode(rows).alias("row")).select("conv_id", "turn", "row.*")


def write_out(rows: DataFrame) -> DataFrame:
    """`examples` with their turns, and `example`: the whole text, context and then target; null in turns.

    Rows are taken in order and nothing is shuffled.  A task holds the stream of one conversation and about
    `CHUNK` of its examples, so memory depends on the longest conversation.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, stream = (None,), [""]
        for batch in batches:
            first, size, texts = 0, 0, []
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "segment", "context_chars", "target"))
            for k, (conv, segment, context_chars, target) in enumerate(zip(*columns)):
                if (conv,) != current:
                    current, stream = (conv,), [""]
                if segment is not None:
                    stream.append(segment)
                    texts.append(None)
                    continue
                stream = ["".join(stream)]
                if context_chars + len(target) > len(stream[0]):
                    raise ValueError(f"an example of {context_chars} and {len(target)} code points in a stream of {len(stream[0])}")
                texts.append(stream[0][:context_chars] + target)
                size += len(texts[-1])
                if size >= CHUNK:
                    yield part(batch, first, texts)
                    first, size, texts = k + 1, 0, []
            yield part(batch, first, texts)

    def part(batch, first, texts):
        return batch.slice(first, len(texts)).append_column("example", pa.array(texts, pa.string()))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(write, f"{schema}, example string")


def render(formatted: DataFrame, chosen: DataFrame) -> DataFrame:
    """`chosen` examples with their whole text.  Each repeats its context: the output is as large as that."""
    before = formatted.select(F.col("conv_id").alias("__conv"), F.col("start").alias("__at"), "segment")
    joined = chosen.join(before, F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("__at") <= F.col("context_chars")))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("__at", "segment"))), lambda s: s.segment)
    return joined.groupBy(*chosen.columns).agg(F.array_join(parts, "").alias("example"))


DIGEST = (
    "n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint,"
    " n_examples bigint, example_chars bigint"
)


class _Reader:
    """Reads the stream of one conversation and its written examples back, row by row; keeps digests only."""

    def __init__(self, conv):
        self.conv = conv
        self.turns = self.loss_chars = self.chars = self.examples = self.example_chars = 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()
        self.before, self.stream = hashlib.sha256(), hashlib.sha256()

    def turn(self, segment: str):
        role, _, text = segment.removeprefix(START).removesuffix(END).partition("\n")
        self.turns += 1
        self.chars += len(segment)
        self.all.update(f"{unescape_role(role)}\n{unescape(text)}\n".encode())
        self.before = self.stream.copy()
        self.stream.update(segment.encode())

    def example(self, context_chars: int, target: str, loss_start: int, loss_end: int, example: str):
        """What the mask covers of the written example is all that counts as trainable.

        Refused are masks that reach out of the target, and examples that are not the stream before their turn
        and then the target.
        """
        if not context_chars <= loss_start <= loss_end <= context_chars + len(target):
            raise ValueError(f"loss [{loss_start}, {loss_end}) outside the target at {context_chars}")
        context = hashlib.sha256(example[:context_chars].encode())
        if context.digest() != self.before.digest() or example[context_chars:] != target:
            raise ValueError(f"the example at {context_chars} does not go on from the stream before it")
        text = unescape(example[loss_start:loss_end])
        self.loss.update(text.encode())
        self.loss_chars += len(text)
        self.examples += 1
        self.example_chars += len(example)

    def row(self):
        return [self.conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.examples, self.example_chars]


def digests(formatted: DataFrame) -> DataFrame:
    """One row per conversation, read back from the output of `format_turns` and its written `examples`, in order.

    Turns tell the stream; number, length and trainable text of the examples come from their own texts.
    """
    rows = write_out(examples(formatted, with_turns=True))
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, names = None, ["conv_id", *(c.split()[0] for c in DIGEST.split(", "))]
        for batch in batches:
            done = []
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "segment", *EXAMPLE))
            for conv, segment, *example, text in zip(*columns, batch.column("example")):  # one whole text at a time
                if reader is None or reader.conv != conv:
                    done += [reader.row()] if reader else []
                    reader = _Reader(conv)
                if segment is not None:
                    reader.turn(segment)
                else:
                    reader.example(*example, text.as_py())
            if done:
                yield table(done, names, batch.schema.field("conv_id").type)
        if reader:
            yield table([reader.row()], names, conv_type)

    from pyspark.sql.pandas.types import to_arrow_type

    conv_type = to_arrow_type(formatted.schema["conv_id"].dataType)

    def table(rows, names, conv_kind):
        kinds = [conv_kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return rows.mapInArrow(read, f"conv_id {kind}, {DIGEST}")
