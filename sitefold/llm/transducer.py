"""Token counts from a tokenizer compiled into a deterministic finite-state transducer.

States are pairs of what the word pattern still has to know (kind of the current word, a white-space character or contraction not
yet assigned, bytes of an unfinished character) and what byte-pair merging still has to know: for each place in the last bytes
of the word where a vocabulary piece may have begun, the last token of the encoding up to there and its token count relative to
now. That is enough because a token sequence is the encoding of its bytes exactly if each two neighbours are. The next state and the
change of the token count are written on the transition, so a text's token count is a sum along its path. States and
transitions are compiled when first met; the table is dropped and begun anew when it reaches its bound.

Texts are cut into chunks that advance in lockstep, one table lookup a byte for all of them. A chunk's map from entry state to exit
state and count is constant from its first synchronising place (white space after another character, where every state falls into
one) on; so the map is (bytes before that place, count from there, bytes since the last such place), or only bytes where there is no
such place. Maps compose associatively; a segmented prefix scan over the chunks joins each open end with the heads that follow it.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np

CHUNK = 1024
LOCKSTEP_BYTES = 16 << 20  # text advanced together
MAX_STATES = 150_000
BASE = 64  # what is added to a count change to keep it positive beside the state number
START, LETTERS, NUMBERS, OTHERS, SPACE = range(5)  # kinds of words


class Merger:
    """Byte-pair merging of a vocabulary, as steps between states that are tuples of (bytes back, last token there, count relative to now)."""

    def __init__(self, said: str):
        from sitefold.llm.bpe import pieces

        j = json.loads(said)
        table, vocab = pieces(said).to_pylist(), j["model"]["vocab"]
        self.bytes_of = table
        self.id_of = {table[i]: i for i in vocab.values()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in j["model"]["merges"]]
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.alive = {p[:n] for p in self.id_of for n in range(1, len(p))}
        self._fits: dict[tuple[int, int], bool] = {}

    def encode(self, data: bytes) -> list[int]:
        ids = [self.id_of[data[i:i + 1]] for i in range(len(data))]
        while len(ids) > 1:
            best = min(((self.merges[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in self.merges), default=None)
            if best is None:
                break
            i = best[1]
            ids[i:i + 2] = [self.merges[ids[i], ids[i + 1]][1]]
        return ids

    def fits(self, a: int, b: int) -> bool:
        if (known := self._fits.get((a, b))) is None:
            known = self._fits[a, b] = self.encode(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    # A state is (tail, ((n, token, count), ...)): the bytes since the furthest open place, and each open place n bytes back.
    FRESH = (b"", ((0, -1, 0),))

    def step(self, state, byte: int):
        """The next state and the change of the number of tokens."""
        tail, places = state
        tail += bytes([byte])
        token, count = -1, 0
        for n, last, c in places:
            t = self.id_of.get(tail[len(tail) - n - 1:])
            if t is not None and (last < 0 or self.fits(last, t)):
                token, count = t, c + 1
                break
        if token < 0:
            raise ValueError("a byte without a token")
        places = [(n + 1, last, c - count) for n, last, c in places if tail[len(tail) - n - 1:] in self.alive]
        places.append((0, token, 0))
        return (tail[len(tail) - places[0][0]:], tuple(places)), count


CONTRACTIONS = {b"'s", b"'t", b"'re", b"'ve", b"'m", b"'ll", b"'d"}  # fixed values of the word pattern
OPEN_CONTRACTIONS = {c[:n] for c in CONTRACTIONS for n in range(1, len(c))}


class Transducer:
    """The compiled table: `next[state, byte]` holds the next state * 128 + count change + BASE, or -1 where not yet compiled.

    A state's key is (kind of word, held bytes, unfinished character's bytes, merging state). Held bytes are the last white-space
    character of a run, or the beginning of what may be a contraction."""

    def __init__(self, said: str, max_states: int = MAX_STATES):
        from sitefold.llm.bpe import library

        self.merger, self.pre, self.max_states = Merger(said), library(said).pre_tokenizer, max_states
        self.kinds: dict[bytes, int] = {}
        self.reset()

    def reset(self) -> None:
        self.keys = [(START, b"", b"", Merger.FRESH)]
        self.number = {self.keys[0]: 0}
        self.next = np.full((1024, 256), -1, np.int32)

    def kind(self, char: bytes) -> int:
        """The class the library's own word pattern puts a character in."""
        if (k := self.kinds.get(char)) is None:
            c = char.decode()
            pieces = lambda s: len(self.pre.pre_tokenize_str(s))
            k = self.kinds[char] = LETTERS if pieces("a" + c) == 1 else NUMBERS if pieces("1" + c) == 1 else OTHERS if pieces("!" + c) == 1 else SPACE
        return k

    def _feed(self, merging, data: bytes):
        total = 0
        for b in data:
            merging, change = self.merger.step(merging, b)
            total += change
        return merging, total

    def _word(self, kind: int, data: bytes):
        merging, n = self._feed(Merger.FRESH, data)
        return kind, b"", merging, n

    def _begin(self, char: bytes, kind: int):
        """State and count after the first character of a word that has no space before it."""
        if kind == SPACE or char == b"'":
            return (SPACE if kind == SPACE else START), char, Merger.FRESH, 0
        return self._word(kind, char)

    def _char(self, kind: int, held: bytes, merging, char: bytes):
        """(kind, held, merging, count change) after a whole character."""
        new = self.kind(char)
        if kind == SPACE:
            if new == SPACE:
                merging, n = self._feed(merging, held)
                return SPACE, char, merging, n
            if held == b" ":
                return self._word(new, held + char)
            n = self._feed(Merger.FRESH, held)[1]
            k, h, m, more = self._begin(char, new)
            return k, h, m, n + more
        if held:
            if held + char in CONTRACTIONS:
                return START, b"", Merger.FRESH, self._feed(Merger.FRESH, held + char)[1]
            if held + char in OPEN_CONTRACTIONS:
                return START, held + char, Merger.FRESH, 0
            if len(held) == 1 and new == OTHERS:
                return self._word(OTHERS, held + char)
            n = self._feed(Merger.FRESH, held[:1])[1]
            k, h, m = START, b"", Merger.FRESH
            if held[1:]:
                k, h, m, more = self._word(LETTERS, held[1:])
                n += more
            k, h, m, more = self._char(k, h, m, char)
            return k, h, m, n + more
        if kind == new:
            merging, n = self._feed(merging, char)
            return kind, b"", merging, n
        return self._begin(char, new)

    def _close(self, key) -> int:
        """Tokens of what a state still holds when the text ends there."""
        kind, held, rest, merging = key
        if rest:
            raise ValueError("not UTF-8")
        if not held:
            return 0
        if kind == SPACE:
            return self._feed(merging, held)[1]
        return sum(self._feed(Merger.FRESH, part)[1] for part in (held[:1], held[1:]))

    def compile(self, state: int, byte: int) -> None:
        kind, held, rest, merging = self.keys[state]
        rest += bytes([byte])
        lead, n = rest[0], 0
        if len(rest) == (1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4):
            kind, held, merging, n = self._char(kind, held, merging, rest)
            rest = b""
        key = (kind, held, rest, merging)
        if (to := self.number.get(key)) is None:
            to = self.number[key] = len(self.keys)
            self.keys.append(key)
            if to >= len(self.next):
                self.next = np.concatenate([self.next, np.full_like(self.next, -1)])
        if not -BASE <= n < BASE:
            raise ValueError("a count change out of range")
        self.next[state, byte] = to * 128 + n + BASE

    def run(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of the slices data[start:start+size], each from the initial state and in lockstep: of tokens whose end is certain, and
        of all if the text ended there."""
        order = np.argsort(-size, kind="stable")
        start, size = start[order], size[order]
        state, count = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        longest = int(size[0]) if len(size) else 0
        live = np.searchsorted(-size, -np.arange(1, longest + 1), side="right")  # how many slices have more than t bytes
        for t in range(longest):
            n = int(live[t])
            if len(self.keys) > self.max_states:
                seen, at = np.unique(state, return_inverse=True)
                kept = [self.keys[i] for i in seen]
                self.reset()
                for key in kept:
                    if key not in self.number:
                        self.number[key] = len(self.keys)
                        self.keys.append(key)
                while len(self.keys) > len(self.next):
                    self.next = np.concatenate([self.next, np.full_like(self.next, -1)])
                state = np.array([self.number[k] for k in kept], np.int64)[at]
            byte = data[start[:n] + t]
            go = self.next[state[:n], byte]
            if len(lost := np.flatnonzero(go < 0)):
                for pair in np.unique(state[lost] * 256 + byte[lost]):
                    self.compile(int(pair) >> 8, int(pair) & 255)
                go = self.next[state[:n], byte]
            state[:n] = go >> 7
            count[:n] += (go & 127) - BASE
        seen, at = np.unique(state, return_inverse=True)
        closing = np.array([self._close(self.keys[i]) for i in seen], np.int64)[at] if len(seen) else count
        sure, whole = np.empty_like(count), np.empty_like(count)
        sure[order], whole[order] = count, count + closing
        return sure, whole

    def count(self, texts: list[bytes]) -> np.ndarray:
        """Tokens of each text."""
        sizes = np.array([len(t) for t in texts], np.int64)
        if not sizes.sum():
            return np.zeros(len(texts), np.int64)
        data = np.frombuffer(b"".join(texts), np.uint8)
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        # synchronising places: ASCII white space after a byte of another character; a text's begin is one as well
        white = (data == 32) | ((data >= 9) & (data <= 13))
        sync = np.zeros(len(data), bool)
        # a byte above 0x7F may end a white-space character, so only ASCII before counts
        sync[1:] = white[1:] & ~white[:-1] & (data[:-1] < 0x80)
        full = sizes > 0
        sync[begin[full]] = True
        per = -(-sizes // CHUNK)
        owner = np.repeat(np.arange(len(texts)), per)
        nth = np.arange(len(owner)) - np.repeat(np.concatenate([[0], np.cumsum(per)[:-1]]), per)
        a = begin[owner] + nth * CHUNK
        z = np.minimum(a + CHUNK, (begin + sizes)[owner])
        places = np.append(np.flatnonzero(sync), len(data))
        first = places[np.searchsorted(places, a)]           # first synchronising place at or after the chunk's begin
        last = places[np.searchsorted(places, z) - 1]        # last one before its end
        has = first < z
        # the constant part of each map: from the first to the last synchronising place
        certain = np.zeros(len(owner), np.int64)
        certain[has] = self.run(data, first[has], (last - first)[has])[1]
        # prefix scan: every open end runs to the first synchronising place of the next chunk that has one, or to the text's end
        segment = np.cumsum(has) - 1
        firsts = np.append(first[has], len(data))
        open_from = last[has]
        open_to = np.minimum(firsts[segment[has] + 1], (begin + sizes)[owner[has]])
        bridge = self.run(data, open_from, open_to - open_from)[1]
        certain[has] += bridge
        return np.bincount(owner, certain, len(texts)).astype(np.int64)


@lru_cache(maxsize=1)
def compiled(said: str) -> Transducer:
    return Transducer(said)


def count_tokens(docs, tokenizer_path: str, text_col: str = "text", tokens_col: str = "n_tokens", bytes_col: str = "n_bytes", limit: int = 1024, over_col: str = "over_limit"):
    """`docs` with each text's UTF-8 bytes, its tokens, and whether these are over `limit`.

    Defined results: a null or empty text has 0 of both; a special string inside a text is its one token. Rows are independent, so
    repeated rows and null ids change nothing; other columns pass through, except those named like an output."""
    import re

    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark.sql import types as T

    from sitefold.llm import bpe
    from sitefold.llm.common import map_columns

    said = bpe.read_tokenizer(tokenizer_path)
    special = sorted(bpe.special_tokens(said), key=len, reverse=True)
    cut = re.compile(b"|".join(re.escape(s.encode()) for s in special)).split if special else lambda t: [t]

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        machine = compiled(said)
        column = pc.fill_null(batch.column(text_col).cast(pa.binary()), b"")
        sizes = pc.binary_length(column).to_numpy().astype(np.int64)
        tokens = np.zeros(len(column), np.int64)
        edges = np.concatenate([[0], np.cumsum(sizes)])
        at = 0
        while at < len(column):
            to = max(at + 1, int(np.searchsorted(edges, edges[at] + LOCKSTEP_BYTES, side="right")) - 1)
            parts = [cut(t) for t in column.slice(at, to - at).to_pylist()]
            each = np.array([len(p) for p in parts], np.int64)
            counted = machine.count([s for p in parts for s in p])
            tokens[at:to] = np.add.reduceat(counted, np.concatenate([[0], np.cumsum(each)[:-1]])) + each - 1
            at = to
        return {tokens_col: pa.array(tokens), bytes_col: pa.array(sizes), over_col: pa.array(tokens > limit)}

    return map_columns(docs, run, [T.StructField(bytes_col, T.LongType()), T.StructField(tokens_col, T.LongType()), T.StructField(over_col, T.BooleanType())])
