"""Byte-level BPE by speculation: greedy proposals, pairwise verification, exact merging for the rest.

A word is cut by longest vocabulary match.  A sequence of tokens is what merging would have made
exactly if every two neighbours, merged on their own, stay the two tokens they are.  That test needs
only the two merge trees, so it runs on arrays of all new pairs at once.  Words with a failing pair
are merged step by step: short ones together in tables, those above `LONG` bytes each by a heap of its
pairs, so that the time of an unbroken run of n bytes grows with n log n.

Texts: null counts as empty, an empty text has no tokens, texts of any length are encoded whole.
"""

import functools
import hashlib
import heapq
import json
import re
from collections import deque

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame

from tillroll.llm.text import chunks, map_texts

# The split pattern of the byte-level vocabulary, and the printable stand-ins of bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"
SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PRINTABLE = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]

NEVER = np.int64(1) << 40
UNMERGED = (int(NEVER), -1)
CACHED_WORDS = 300_000
MERGE_CELLS = 1 << 21
LONG = 512
PLACES = 1 << 18  # bytes of a long word looked up at once


def byte_of_char() -> dict[str, int]:
    table = {chr(b): b for b in PRINTABLE}
    others = (b for b in range(256) if b not in PRINTABLE)
    return table | {chr(256 + k): b for k, b in enumerate(others)}


WIDE = regex.compile(PATTERN.format(L=r"\p{L}", N=r"\p{N}", S=SPACES))


NARROW = 0x250


def _narrow() -> re.Pattern:
    """The same split for texts of code points below `NARROW`, with the standard library, which is faster there."""
    few = "".join(map(chr, range(NARROW)))
    ranges = {k: "".join(f"{r[0]}-{r[-1]}" for r in regex.findall(rf"\p{{{k}}}+", few)) for k in "LN"}
    letters = " ?[{L}]+"  # tried first: no other alternative matches where this one does
    return re.compile(f"{letters}|{PATTERN}".format(**ranges, S=SPACES))


NARROW_SPLIT = _narrow()
BEYOND = re.compile(f"[^\x00-{chr(NARROW - 1)}]")


def split(text: str) -> list[str]:
    return (WIDE if BEYOND.search(text) else NARROW_SPLIT).findall(text)


class Known(dict):
    """Token ids by word; a word asked for in vain is noted once."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str):
        self[word] = None
        self.new.append(word)

    def taken(self) -> list[str]:
        new, self.new = self.new, []
        return new


def gathered(found: list[tuple[np.ndarray, np.ndarray]], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens listed as (row, token), in order within each row, as one array and where each row begins."""
    row = np.concatenate([r for r, _ in found] or [np.empty(0, np.int64)])
    token = np.concatenate([t for _, t in found] or [np.empty(0, np.int64)])
    cuts = np.zeros(rows + 1, np.int64)
    np.cumsum(np.bincount(row, minlength=rows), out=cuts[1:])
    return token[np.argsort(row, kind="stable")], cuts


def cut_up(flat: np.ndarray, cuts: np.ndarray) -> list[bytes]:
    """The tokens of each row as little-endian unsigned 32-bit numbers."""
    raw, edges = flat.astype("<u4").tobytes(), (4 * cuts).tolist()
    return [raw[a:b] for a, b in zip(edges, edges[1:])]


class Encoder:
    """A vocabulary file of the tokenizers library, byte-level BPE with its `added_tokens`.

    The file is a few MB and is sent to the tasks as text; words seen before are remembered, up to
    `CACHED_WORDS` of them per Python worker.
    """

    def __init__(self, definition: str):
        spec = json.loads(definition)
        alphabet = byte_of_char()
        raw = lambda token: bytes(alphabet[c] for c in token)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = spec["model"]["vocab"]
        self.ids = {raw(token): i for token, i in vocab.items() if token not in special}
        self.texts: list[bytes] = [b""] * (max([*vocab.values(), *special.values()], default=-1) + 1)
        for token, i in self.ids.items():
            self.texts[i] = token
        for token, i in special.items():
            self.texts[i] = token.encode()
        self.text_bytes = np.frombuffer(b"".join(self.texts), np.uint8)
        self.text_sizes = np.fromiter(map(len, self.texts), np.int64, len(self.texts))
        self.text_starts = np.cumsum(self.text_sizes) - self.text_sizes
        self.special = {token: np.uint32(i).tobytes() for token, i in special.items()}
        self.byte_ids = np.array([self.ids.get(bytes([b]), -1) for b in range(256)], np.int64)
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.ranks = {(raw(a), raw(b)): k for k, (a, b) in enumerate(pairs)}
        self._trees()
        self._trie()
        self.derivable = np.zeros(len(self.texts), bool)  # tokens that their own bytes merge into
        own = list(self.ids.values())
        for i, ids in zip(own, cut_up(*self.merge([self.texts[i] for i in own]))):
            self.derivable[i] = ids == np.uint32(i).tobytes()
        names = sorted(special, key=len, reverse=True)
        self.control = re.compile(f"({'|'.join(map(re.escape, names))})") if names else None
        self.known = Known()
        self.failed = 0

    def _trees(self):
        """Of every token: its last merge (rank, left, right), and the merge table as sorted arrays."""
        size = len(self.texts)
        self.rank = np.full(size, -1, np.int64)
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        keys, ranks, wholes = [], [], []
        for (a, b), k in self.ranks.items():
            whole = self.ids[a + b]
            if self.rank[whole] < 0:
                self.rank[whole], self.left[whole], self.right[whole] = k, self.ids[a], self.ids[b]
            keys.append(self.ids[a] << 20 | self.ids[b])
            ranks.append(k)
            wholes.append(whole)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = np.array(keys, np.int64)[order], np.array(ranks, np.int64)[order]
        self.pair_wholes = np.array(wholes, np.int64)[order]
        self.pair_table = dict(zip(keys, zip(ranks, wholes)))

    def _trie(self):
        """The vocabulary as a tree: edges (node, byte) in order, the node of edge k being k + 1."""
        prefixes = {b""} | {t[:n] for t in self.ids for n in range(1, len(t) + 1)}
        by_size = sorted(prefixes, key=lambda p: (len(p), p))
        # Nodes in breadth-first order have their edges in ascending order of (parent, byte).
        number = {p: k for k, p in enumerate(by_size)}
        self.trie_keys = np.array([number[p[:-1]] << 8 | p[-1] for p in by_size[1:]] or [-1], np.int64)
        self.trie_tokens = np.array([self.ids.get(p, -1) for p in by_size] + [-1], np.int64)

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The token that two mergeable tokens make."""
        return self.pair_wholes[np.searchsorted(self.pair_keys, a << 20 | b)]

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of two tokens, `NEVER` if there is none."""
        if not len(self.pair_keys):
            return np.full(len(a), NEVER)
        keys = np.where(b < 0, -1, a << 20 | b)
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the bytes of both tokens together gives the two tokens again.

        Walks back in time from the finished tokens along the two edges that touch.  At every moment
        the touching pieces must not merge with each other before one of them merges into its
        finished token; of equal ranks the merge further left comes first.
        """
        good = np.ones(len(a), bool)
        at = np.arange(len(a))
        x, y = a.astype(np.int64), b.astype(np.int64)
        next_x, next_y = np.full(len(a), NEVER), np.full(len(a), NEVER)
        while len(at):
            cross = self.pair_rank(x, y)
            bad = (cross < next_x) & (cross <= next_y) & (cross < NEVER)
            good[at[bad]] = False
            rank_x, rank_y = self.rank[x], self.rank[y]
            go = ~bad & ((rank_x >= 0) | (rank_y >= 0))
            at, x, y, next_x, next_y, rank_x, rank_y = (v[go] for v in (at, x, y, next_x, next_y, rank_x, rank_y))
            # Undo the later merge.  Of equal ranks the right one was made last.
            undo_x = rank_x > rank_y
            next_x, next_y = np.where(undo_x, rank_x, next_x), np.where(undo_x, next_y, rank_y)
            x, y = np.where(undo_x, self.right[x], x), np.where(undo_x, y, self.left[y])
        return good

    def longest(self, data: np.ndarray, at: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Longest token at each place that ends by its limit, and its length; -1 and 1 where there is none."""
        best, length = np.full(len(at), -1, np.int64), np.ones(len(at), np.int64)
        live, node, depth = np.arange(len(at)), np.zeros(len(at), np.int64), 0
        while len(live):
            key = node << 8 | data[at[live] + depth]
            place = np.minimum(np.searchsorted(self.trie_keys, key), len(self.trie_keys) - 1)
            hit = self.trie_keys[place] == key
            live, node = live[hit], place[hit] + 1
            depth += 1
            token = self.trie_tokens[node]
            whole = token >= 0
            best[live[whole]], length[live[whole]] = token[whole], depth
            more = at[live] + depth < limit[live]
            live, node = live[more], node[more]
        return best, length

    def propose(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Longest matches from the left, all words at once: tokens, and where each word's begin.

        A byte without a token becomes -1.  A long word is looked up at all its places, then followed.
        """
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        data = np.frombuffer(b"".join(words), np.uint8)
        found = []
        for k in np.flatnonzero(sizes > LONG).tolist():
            tokens = self._follow(data[ends[k] - sizes[k] : ends[k]])
            found.append((np.full(len(tokens), k), tokens))
        row = np.flatnonzero((sizes > 0) & (sizes <= LONG))
        at = (ends - sizes)[row]
        while len(row):
            limit = ends[row]
            best, length = self.longest(data, at, limit)
            found.append((row, best))
            at = at + length
            left = at < limit
            row, at = row[left], at[left]
        return gathered(found, len(words))

    def _follow(self, word: np.ndarray) -> np.ndarray:
        """Longest matches of one word from the left."""
        found, next_at = [], 0
        for first in range(0, len(word), PLACES):
            places = np.arange(first, min(first + PLACES, len(word)))
            best, length = self.longest(word, places, np.full(len(places), len(word)))
            steps, at, taken = length.tolist(), next_at - first, []
            while at < len(steps):
                taken.append(at)
                at += steps[at]
            next_at = first + at
            found.append(best[taken])
        return np.concatenate(found)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging, lowest rank first, leftmost of equals: tokens, and where each word's begin.

        Bytes without a token are left out.  Short words take a step at once: each merges its best pair,
        and only the ranks next to it change.  Words of about one length share a table.
        """
        order = sorted((k for k in range(len(words)) if len(words[k]) <= LONG), key=lambda k: len(words[k]))
        first, found = 0, []
        for k in range(len(words)):
            if len(words[k]) > LONG:
                tokens = self._merge_long(words[k])
                found.append((np.full(len(tokens), k), tokens))
        while first < len(order):
            width = max(8, len(words[order[first]]) * 5 // 4)
            last = first + 1
            while last < len(order) and len(words[order[last]]) <= width and (last - first) * width < MERGE_CELLS:
                last += 1
            rows = np.array(order[first:last])
            found += [(rows[row], token) for row, token in self._merge_table([words[k] for k in rows])]
            first = last
        return gathered(found, len(words))

    def _merge_long(self, word: bytes) -> np.ndarray:
        """One word by a heap of its pairs; each merge touches its two neighbours only."""
        tokens = self.byte_ids[np.frombuffer(word, np.uint8)]
        tokens = tokens[tokens >= 0]
        ranks = self.pair_rank(tokens[:-1], tokens[1:])
        size, token = len(tokens), tokens.tolist()
        # Entries are rank, place of the left token; one is stale once the pair at its place has another rank.
        rank = [*ranks.tolist(), int(NEVER)]
        heap = [(r, k) for k, r in enumerate(rank) if r < NEVER]
        heapq.heapify(heap)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        table = self.pair_table
        while heap:
            r, k = heapq.heappop(heap)
            if rank[k] != r:
                continue
            gone = after[k]
            token[k] = table[token[k] << 20 | token[gone]][1]
            rank[gone], token[gone] = -1, -1
            after[k] = following = after[gone]
            if following < size:
                before[following] = k
                rank[k] = table.get(token[k] << 20 | token[following], UNMERGED)[0]
            else:
                rank[k] = UNMERGED[0]
            if rank[k] < NEVER:
                heapq.heappush(heap, (rank[k], k))
            left = before[k]
            if left >= 0:
                rank[left] = table.get(token[left] << 20 | token[k], UNMERGED)[0]
                if rank[left] < NEVER:
                    heapq.heappush(heap, (rank[left], left))
        made = np.array(token, np.int64)
        return made[made >= 0]

    def _merge_table(self, words: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        raw = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        row = np.repeat(np.arange(len(words)), sizes)[raw >= 0]
        raw = raw[raw >= 0]
        counts = np.bincount(row, minlength=len(words))
        width = int(counts.max(initial=0)) + 1
        tokens = np.full((len(words), width), -1, np.int64)
        tokens[row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)] = raw
        ranks = np.full((len(words), width), NEVER)
        at_row, at_col = np.nonzero(tokens[:, 1:] >= 0)
        ranks[at_row, at_col] = self.pair_rank(tokens[at_row, at_col], tokens[at_row, at_col + 1])
        alive, done = np.arange(len(words)), []
        while len(alive):
            best = ranks.argmin(axis=1)
            more = ranks[np.arange(len(alive)), best] < NEVER
            rest = ~more
            at_row, at_col = np.nonzero(tokens[rest] >= 0)
            done.append((alive[rest][at_row], tokens[rest][at_row, at_col]))
            alive, tokens, ranks, best = alive[more], tokens[more], ranks[more], best[more]
            line = np.arange(len(alive))
            tokens[line, best] = self.merged(tokens[line, best], tokens[line, best + 1])
            behind = np.arange(width)[None, :] > best[:, None]
            tokens[:, :-1] = np.where(behind[:, :-1], tokens[:, 1:], tokens[:, :-1])
            ranks[:, :-1] = np.where(behind[:, :-1], ranks[:, 1:], ranks[:, :-1])
            tokens[:, -1], ranks[:, -1] = -1, NEVER
            ranks[line, best] = self.pair_rank(tokens[line, best], tokens[line, np.minimum(best + 1, width - 1)])
            before = np.flatnonzero(best > 0)
            ranks[before, best[before] - 1] = self.pair_rank(tokens[before, best[before] - 1], tokens[before, best[before]])
        return done

    def learn(self, words: list[str]) -> None:
        """Encodes words not seen before: proposals, one check of all pairs, merging of what fails."""
        raw = [w.encode() for w in words]
        flat, cuts = self.propose(raw)
        wrong = (flat < 0) | ~self.derivable[flat]
        inner = np.ones(max(len(flat) - 1, 0), bool)
        inner[cuts[1:-1][(cuts[1:-1] > 0) & (cuts[1:-1] < len(flat))] - 1] = False
        inner = np.flatnonzero(inner)
        inner = inner[(flat[inner] >= 0) & (flat[inner + 1] >= 0)]
        pairs, which = np.unique(flat[inner] << 20 | flat[inner + 1], return_inverse=True)
        wrong[inner[~self.compatible(pairs >> 20, pairs & 0xFFFFF)[which]]] = True
        failing = np.unique(np.searchsorted(cuts, np.flatnonzero(wrong), side="right") - 1).tolist()
        self.known.update(zip(words, cut_up(flat, cuts)))
        self.known.update(zip([words[k] for k in failing], cut_up(*self.merge([raw[k] for k in failing]))))
        self.failed += len(failing)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Token ids of whole texts, as little-endian unsigned 32-bit numbers."""
        result = []
        for first, last in chunks(texts):
            result.extend(self._encode(texts[first:last]))
        return result

    def _encode(self, texts: list[str]) -> list[bytes]:
        known = self.known
        if len(known) > CACHED_WORDS:
            known.clear()
        cut = [self.control.split(t) if self.control else [t] for t in texts]  # every second piece is a control token
        words = [split(part) for parts in cut for part in parts[::2]]
        for part in words:
            deque(map(known.__getitem__, part), 0)  # notes words without ids
        new = known.taken()
        self.learn(new)
        plain = map(b"".join, (map(known.__getitem__, part) for part in words))
        result = [b"".join(self.special[p] if k % 2 else next(plain) for k, p in enumerate(parts)) for parts in cut]
        for word in new:
            if len(word) > LONG:  # remembered words stay small
                del known[word]
        return result

    def decode(self, ids: bytes) -> str:
        """The text of token ids, control tokens included; broken characters become U+FFFD."""
        tokens = np.frombuffer(ids, "<u4")
        sizes = self.text_sizes[tokens]
        ends = np.cumsum(sizes)
        at = np.repeat(self.text_starts[tokens] - (ends - sizes), sizes) + np.arange(int(sizes.sum()))
        return self.text_bytes[at].tobytes().decode("utf-8", "replace")


@functools.lru_cache(maxsize=4)
def encoder(definition: str) -> Encoder:
    return Encoder(definition)


def read_definition(path: str) -> str:
    """The vocabulary file, read once by the driver; its size does not depend on the corpus."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def decode_documents(encoded: DataFrame, path: str, keep: list[str]) -> DataFrame:
    """Adds `text` decoded from `token_ids` to the columns `keep`."""
    definition = encoded.sparkSession.sparkContext.broadcast(read_definition(path))
    kinds = ", ".join(f"`{n}` {encoded.schema[n].dataType.simpleString()}" for n in keep)

    def run(batches):
        for batch in batches:
            ids = batch.column("token_ids").to_pylist()
            texts = [encoder(definition.value).decode(np.array(i or [], "<u4").tobytes()) for i in ids]
            columns = [*(batch.column(n) for n in keep), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "text"])

    return encoded.select(*keep, "token_ids").mapInArrow(run, f"{kinds}, text string")


def tokenise(docs: DataFrame, path: str) -> DataFrame:
    """All columns, `token_ids`, and `round_trip`: whether decoding them gives the text again.

    Columns of these two names are replaced.
    """
    definition = docs.sparkSession.sparkContext.broadcast(read_definition(path))
    docs = docs.drop("token_ids", "round_trip")

    def work(texts):
        tool = encoder(definition.value)
        texts = [t.decode("utf-8", "replace") for t in texts]
        made = tool.encode(texts)
        ids = pa.array([np.frombuffer(i, "<i4") for i in made], pa.list_(pa.int32()))
        return [ids, pa.array([tool.decode(i) == t for i, t in zip(made, texts)], pa.bool_())]

    keep = [c if c == "text" else docs[f"`{c}`"] for c in docs.columns]
    return map_texts(docs, keep, [("token_ids", "array<int>"), ("round_trip", "boolean")], work)


def digests(docs: DataFrame, path: str, keep: list[Column | str]) -> DataFrame:
    """Number of tokens, and digests of the ids and of the text decoded from them again."""
    definition = docs.sparkSession.sparkContext.broadcast(read_definition(path))

    def work(texts):
        tool = encoder(definition.value)
        counts, ids, back = [], [], []
        for a, b in chunks(texts):
            for made in tool.encode([t.decode("utf-8", "replace") for t in texts[a:b]]):
                counts.append(len(made) // 4)
                ids.append(hashlib.sha256(made).hexdigest())
                back.append(hashlib.sha256(tool.decode(made).encode()).hexdigest())
        return [pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())]

    return map_texts(docs, keep, [("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")], work)
