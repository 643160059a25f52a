"""Token counts by finite-state compilation of a byte-level BPE tokenizer.

Two transducers in series, both deterministic.  The first (``pretoken``) marks where pre-tokens
begin and is run over whole texts by a parallel prefix scan of chunk state maps.  The second reads a
pre-token byte by byte; each of its transitions is annotated with how many tokens the encoding grows
by (it may shrink), so a path's sum is the count.

A state of the second is what the bytes read so far leave open: for each place from which a
vocabulary token may still go on, the trie node reached, the last token before that place, and the
count there relative to now.  The last token of the encoding of a prefix is the one token that ends
there and whose predecessor, in the encoding of what precedes it, is compatible with it: the pair
encodes to itself.  So the next state follows from the state and the byte alone.  States are
determinised when first reached and forgotten together when there are too many.

A pre-token is cut into pieces at any bytes.  A piece's state map gives for a state before it the state
after it and the tokens counted between; it has too many states to list, so it begins with the one that the
bytes just before the piece lead to from the start, found for every piece apart from the others.  A prefix
scan composes the maps in log2(pieces) steps; a map that lacks a state which the composition asks for gets
it then.  Pieces of equal bytes share a map.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import pretoken, ragged
from .bpe import vocabulary

#: Transitions, and counted pre-tokens, that a worker keeps, and the bytes of the longest of these.
MOST, SHORT = 600_000, 64
#: Bytes of a piece, bytes before it that its state is guessed from, and pieces of one scan.
PIECE, BEFORE, PIECES = 64, 16, 1024

Step = tuple[int, int]  # the state after, and the tokens counted


class CountingTransducer:
    def __init__(self, path: str):
        self.bpe = bpe = vocabulary(path)
        self.trie: dict[int, int] = {}
        self.accepts = [-1]
        for i, token in enumerate(bpe.tokens):
            if token and token not in bpe.preset and list(bpe.merge(token)) == [i]:
                node = 0
                for b in token:
                    key = node << 8 | b
                    node = self.trie.get(key, 0)
                    if not node:
                        node = self.trie[key] = len(self.accepts)
                        self.accepts.append(-1)
                self.accepts[node] = i
        self.pairs: dict[tuple[int, int], bool] = {}
        self.known: dict[bytes, int] = {}
        self.forget()

    def forget(self) -> None:
        first = ((0, -1, 0),)
        self.states: dict[tuple, int] = {first: 0}
        self.open = [first]
        self.moves: dict[int, Step] = {}
        self.maps: dict[bytes, dict[int, Step]] = {}

    def compatible(self, a: int, b: int) -> bool:
        if a < 0:
            return True
        ok = self.pairs.get((a, b))
        if ok is None:
            if len(self.pairs) > MOST:
                self.pairs.clear()
            ok = self.pairs[a, b] = list(self.bpe.merge(self.bpe.tokens[a] + self.bpe.tokens[b])) == [a, b]
        return ok

    def move(self, state: int, byte: int) -> tuple[int, int]:
        """Compile one transition: the next state and the change of the count."""
        live, last, grow = [], -1, 0
        for node, before, count in self.open[state]:
            to = self.trie.get(node << 8 | byte)
            if to:
                live.append((to, before, count))
                token = self.accepts[to]
                if last < 0 and token >= 0 and self.compatible(before, token):
                    last, grow = token, count + 1
        key = (*((n, b, c - grow) for n, b, c in live), (0, last, 0))
        out = self.moves[state << 8 | byte] = self.state(key), grow
        return out

    def state(self, key: tuple) -> int:
        to = self.states.get(key)
        if to is None:
            to = self.states[key] = len(self.open)
            self.open.append(key)
        return to

    def run(self, piece: bytes, state: int = 0) -> Step:
        total = 0
        get = self.moves.get
        for b in piece:
            step = get(state << 8 | b)
            if step is None:
                step = self.move(state, b)
            state, n = step
            total += n
        return state, total

    def through(self, pieces: list[bytes], state: int) -> Step:
        """A value of the map of consecutive pieces."""
        total = 0
        for piece in pieces:
            known = self.maps.setdefault(piece, {})
            step = known.get(state)
            if step is None:
                step = known[state] = self.run(piece, state)
            state, n = step
            total += n
        return state, total

    def scan(self, pieces: list[bytes], state: int) -> Step:
        """The state and count after consecutive pieces, by composing their maps."""
        maps = [{state: self.through(pieces[:1], state)}]
        for before, piece in zip(pieces, pieces[1:]):
            guess = self.run(before[-BEFORE:])[0]
            maps.append({guess: self.through([piece], guess)})
        step = 1
        while step < len(maps):  # the i-th map becomes that of the pieces from i - 2 * step + 1 to i
            after = maps[:step]
            for i in range(step, len(maps)):
                out = {}
                for entry, (middle, n) in maps[i - step].items():
                    if middle not in maps[i]:
                        maps[i][middle] = self.through(pieces[max(0, i - step + 1) : i + 1], middle)
                    end, m = maps[i][middle]
                    out[entry] = end, n + m
                after.append(out)
            maps, step = after, 2 * step
        return maps[-1][state]

    def count(self, word: bytes) -> int:
        """Tokens of one pre-token."""
        if len(word) <= PIECE:
            if len(self.moves) > MOST:
                self.forget()
            return self.run(word)[1]
        total, state = 0, 0
        for a in range(0, len(word), PIECE * PIECES):
            if len(self.moves) > MOST or len(self.maps) > MOST // 8:
                here = self.open[state]
                self.forget()
                state = self.state(here)
            state, n = self.scan([word[i : i + PIECE] for i in range(a, min(a + PIECE * PIECES, len(word)), PIECE)], state)
            total += n
        return total

    def counts(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Tokens of each text."""
        start, end, by_text = pretoken.spans(data, off, self.bpe.preset)
        which, inverse = ragged.distinct(data, start, end)
        if len(self.known) > MOST:
            self.known.clear()
        known, preset, out = self.known, self.bpe.preset, []
        for s in ragged.strings(data, start[which], end[which]):
            n = known.get(s)
            if n is None:
                n = len(preset[s]) if s in preset else self.count(s)
                if len(s) <= SHORT:
                    known[s] = n
            out.append(n)
        run = np.concatenate([[0], np.cumsum(np.array(out, np.int64)[inverse])]) if out else np.zeros(1, np.int64)
        return run[by_text[1:]] - run[by_text[:-1]]


@functools.cache
def transducer(path: str) -> CountingTransducer:
    return CountingTransducer(path)


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """One row per document: UTF-8 bytes, tokens, and whether there are more tokens than ``limit``.

    A null or empty text has no bytes and no tokens.  Strings of special tokens inside a text count as
    one token, as the library has it by default.  Repeated rows each give a row, other columns are
    ignored, and texts are counted whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for batch in ragged.slices(batches):
            data, off = ragged.texts(batch.column("text"))
            n = machine.counts(data, off)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(np.diff(off), pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
