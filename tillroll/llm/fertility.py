"""Quality rules with tokeniser fertility.

A public vocabulary with byte fallback encodes every word; a text is measured by characters per token,
the share of byte-fallback tokens and the entropy of its tokens.  A second vocabulary, made from other languages,
gives characters per token too, and the better of both rates counts: a language that one of them has hardly seen may
be plain to the other, while noise is foreign to both.  Each script has bands; a text outside them, or one that fails
the length and repetition rules, is rejected.

Words lie between ASCII white space and are encoded one by one, so a word seen before is looked up.
Null and empty texts have no words; they fail the length rule, and their measures are null.
"""

import base64
import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from tillroll.llm.text import chunks, map_texts

SYMBOLS = b"#*$%&|<>"
NOT_SYMBOLS = bytes(b for b in range(256) if b not in SYMBOLS)
MIN_WORDS = 50
MAX_REPEATED = 50  # percent of words in repeated windows
WINDOW = 3
CACHED_WORDS = 400_000
PIECE = 1000  # code points; longer words are cut for the second vocabulary, whose merging is not linear in a word


@dataclass(frozen=True)
class Band:
    """What a text of a script must have to be kept."""

    min_chars_per_token: float
    max_chars_per_token: float
    max_byte_share: float
    min_entropy: float  # bits per token


# Scripts by the lead byte of their letters in UTF-8; others share the last entry.
SCRIPTS = {
    "latin": (*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC3, 0xCA)),
    "greek": (0xCE, 0xCF),
    "cyrillic": range(0xD0, 0xD4),
    "semitic": range(0xD6, 0xDC),
    "indic": (0xE0,),
    "cjk": range(0xE3, 0xEE),
}
BANDS = {
    # Random lower-case words reach 1.57 in one vocabulary and 1.48 in the other, texts marked good have 1.81 or more.
    "latin": Band(1.65, 12.0, 0.10, 4.0),
    "greek": Band(0.9, 8.0, 0.30, 2.5),
    "cyrillic": Band(1.3, 12.0, 0.15, 2.5),
    "semitic": Band(0.6, 8.0, 0.60, 2.5),
    "indic": Band(0.3, 8.0, 0.95, 2.0),
    "cjk": Band(0.3, 4.0, 0.70, 3.0),
    "other": Band(0.25, 12.0, 0.98, 2.0),
}
_NAMES = list(BANDS)
_SCRIPT = np.full(256, 255, np.uint8)
_SCRIPT[0xC2:0xF8] = len(_NAMES) - 1
for _name, _leads in SCRIPTS.items():
    _SCRIPT[list(_leads)] = _NAMES.index(_name)
_SCRIPT_TABLE = _SCRIPT.tobytes()


def script_of(text: bytes) -> str:
    """The script of most letters; ties go to the first of the table, texts without letters to the last."""
    kinds = text.translate(_SCRIPT_TABLE)
    counts = [kinds.count(k) for k in range(len(_NAMES))]
    return _NAMES[int(np.argmax(counts))] if any(counts) else _NAMES[-1]


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of words found twice or more."""
    n = len(words)
    if n <= window:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    code = ids[: n - window + 1]
    for k in range(1, window):
        code = code * len(number) + ids[k : n - window + 1 + k]
        if len(number) > 1 << 20:
            code = np.unique(code, return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    same = code[order][1:] == code[order][:-1]
    hit = np.zeros(n + 1, np.int64)
    twice = np.zeros(len(code), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    at = np.flatnonzero(twice)
    np.add.at(hit, at, 1)
    np.add.at(hit, at + window, -1)
    return int((np.cumsum(hit)[:n] > 0).sum())


def duplicate_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


class Meter:
    def __init__(self, model: bytes):
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = self.pieces.get_piece_size()
        self.is_byte = np.array([self.pieces.is_byte(k) for k in range(size)], bool)
        self.known: dict[bytes, bytes] = {}

    def tokens(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """Token ids of texts given as words."""
        known = self.known
        if len(known) > CACHED_WORDS:
            known.clear()
        new = [w for w in set().union(*texts) if w not in known]
        made = self.pieces.encode([w.decode("utf-8", "replace") for w in new], num_threads=1)
        known.update((w, np.array(ids, "<u2").tobytes()) for w, ids in zip(new, made))
        return [np.frombuffer(b"".join(map(known.__getitem__, words)), "<u2") for words in texts]


class Counter:
    """Numbers of tokens in a byte-level vocabulary of ranks."""

    def __init__(self, ranks: bytes, pattern: str):
        import tiktoken

        pairs = (line.split() for line in ranks.splitlines() if line.strip())
        table = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.known: dict[bytes, int] = {}

    def count(self, words: list[bytes]) -> int:
        """Tokens of the words, each after a blank."""
        known = self.known
        if len(known) > CACHED_WORDS:
            known.clear()
        for word in set(words):
            if word not in known:
                text = " " + word.decode("utf-8", "replace")
                known[word] = sum(len(self.encode(text[k : k + PIECE])) for k in range(0, len(text), PIECE))
        return sum(map(known.__getitem__, words))


@functools.lru_cache(maxsize=2)
def counter(ranks: bytes, pattern: str) -> Counter:
    return Counter(ranks, pattern)


@functools.lru_cache(maxsize=2)
def meter(model: bytes) -> Meter:
    return Meter(model)


def entropy(tokens: np.ndarray) -> float:
    counts = np.unique(tokens, return_counts=True)[1]
    return float(np.log2(len(tokens)) - (counts * np.log2(counts)).sum() / len(tokens))


def within(band: Band, chars_per_token: float, byte_share: float, bits: float) -> bool:
    return (
        band.min_chars_per_token <= chars_per_token <= band.max_chars_per_token
        and byte_share <= band.max_byte_share
        and bits >= band.min_entropy
    )


COLUMNS = [
    ("n_words", "bigint"), ("word_chars", "bigint"), ("n_symbols", "bigint"), ("n_dup_lines", "bigint"),
    ("n_repeat_words", "bigint"), ("base_failed", "boolean"), ("kept", "boolean"), ("script", "string"),
    ("n_tokens", "bigint"), ("chars_per_token", "double"), ("byte_share", "double"), ("token_entropy", "double"),
    ("second_chars_per_token", "double"),
]


def measure(
    docs: DataFrame,
    model_path: str,
    keep: list[Column | str],
    bands: dict[str, Band] = BANDS,
    second: tuple[str, str] | None = None,
) -> DataFrame:
    """Adds the measures and the verdict `kept` to the columns `keep`; one pass, no shuffle.

    `second` is a file of token ranks and the pattern that splits words for it; without it the first vocabulary
    judges alone and the second rate is null.  The vocabularies, about a megabyte, are read by the driver and broadcast.
    """
    context = docs.sparkSession.sparkContext

    def shared(path):
        with open(path, "rb") as file:
            return context.broadcast(file.read())

    model = shared(model_path)
    ranks, pattern = (shared(second[0]), second[1]) if second else (None, "")

    def one(text, words, tokens, is_byte, count):
        n, chars = len(words), sum(text.count(b) for b in b" \t\n\v\f\r")
        chars = len(text.decode("utf-8", "replace")) - chars
        repeated = repeated_words(words)
        failed = n < MIN_WORDS or 100 * repeated > MAX_REPEATED * n
        script = script_of(text)
        row = [n, chars, len(text.translate(None, NOT_SYMBOLS)), duplicate_lines(text), repeated, failed]
        if not len(tokens):
            return [*row, False, script, 0, None, None, None, None]
        rate, share, bits = chars / len(tokens), float(is_byte[tokens].mean()), entropy(tokens)
        other = chars / count(words) if count else None
        kept = not failed and within(bands[script], max(rate, other or 0.0), share, bits)
        return [*row, kept, script, len(tokens), rate, share, bits, other]

    def work(texts):
        tool, rows = meter(model.value), []
        count = counter(ranks.value, pattern).count if ranks else None
        for a, b in chunks(texts):
            words = [t.split() for t in texts[a:b]]
            rows += [one(t, w, i, tool.is_byte, count) for t, w, i in zip(texts[a:b], words, tool.tokens(words))]
        kinds = {"bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "double": pa.float64()}
        columns = zip(*rows) if rows else [()] * len(COLUMNS)
        return [pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, COLUMNS)]

    return map_texts(docs, keep, COLUMNS, work)
