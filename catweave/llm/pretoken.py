"""Byte-level pre-tokenization as a deterministic transducer run by a parallel prefix scan.

The pattern cuts a text into contractions, letter runs, number runs, other runs (each with one
optional leading space) and white space.  Compiled by hand into a transducer over character
classes, it marks on each transition whether a token begins at this character, at the one before,
or at both (the look-ahead of white space and of three-letter contractions is one character, so
marks come at most one late).

A batch of texts is one symbol string with an end mark after each text.  It is cut into equal
chunks; every chunk is run from all states at once, the chunks' state maps are composed by a
prefix scan in log2(chunks) steps, and a second run from the then known states emits the marks.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Collection

import numpy as np
import regex
import tokenizers

# Character classes.
LETTER, SHORT, LONG, ELL, EE, NUMBER, SPACE, WHITE, QUOTE, OTHER, STOP = range(11)
# States: what the text so far ends in.
START, IN_L, IN_N, IN_O, SP1, SPN, WS1, WSN, APOS, WAIT_E, WAIT_L = range(11)
HERE, BEFORE = 1, 2
CHUNK = 384


def _compile() -> tuple[np.ndarray, np.ndarray]:
    """Next state and mark for each (state, class)."""
    run = {LETTER: IN_L, SHORT: IN_L, LONG: IN_L, ELL: IN_L, EE: IN_L, NUMBER: IN_N, OTHER: IN_O}
    to = np.zeros((11, 11), np.uint8)
    mark = np.zeros((11, 11), np.uint8)

    def opens(c: int) -> int:
        return {SPACE: SP1, WHITE: WS1, QUOTE: APOS, STOP: START}.get(c, run.get(c, START))

    for s in range(11):
        for c in range(11):
            nxt, out = opens(c), 0 if c == STOP else HERE
            if s in (IN_L, IN_N) and run.get(c) == s:
                out = 0
            elif s == IN_O and c in (OTHER, QUOTE):
                nxt, out = IN_O, 0
            elif s == APOS:
                if c in (OTHER, QUOTE):
                    nxt, out = IN_O, 0
                elif c == SHORT:
                    nxt, out = START, 0
                elif c == LONG:
                    nxt, out = WAIT_E, 0
                elif c == ELL:
                    nxt, out = WAIT_L, 0
            elif s in (WAIT_E, WAIT_L):
                if c == (EE if s == WAIT_E else ELL):
                    nxt, out = START, 0
                elif run.get(c) == IN_L:
                    nxt, out = IN_L, BEFORE
                else:
                    out |= BEFORE
            elif s in (SP1, SPN, WS1, WSN):
                many = BEFORE if s in (SPN, WSN) else 0
                if c in (SPACE, WHITE):
                    nxt, out = (SPN if c == SPACE else WSN), 0
                elif c == STOP:
                    out = 0
                elif s in (SP1, SPN):
                    nxt, out = (IN_O if c == QUOTE else nxt), many
                else:
                    out |= many
            to[s, c], mark[s, c] = nxt, out
    return to, mark


_TO, _MARK = _compile()


@functools.cache
def classes() -> np.ndarray:
    """The class of every code point."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.full(0x110000, OTHER, np.uint8)
    for pattern, c in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", WHITE)):
        for m in regex.finditer(pattern, every):
            a, b = ord(m[0][0]), ord(m[0][-1])
            out[a : b + 1] = c
    out[0xD800:0xE000] = OTHER
    _as_library(out)
    for chars, c in (("stmd", SHORT), ("rv", LONG), ("l", ELL), ("e", EE), (" ", SPACE), ("'", QUOTE)):
        out[[ord(x) for x in chars]] = c
    return out


def _as_library(kind: np.ndarray) -> None:
    """Correct the classes where the tokenizers library was built for another Unicode version.

    All characters of one class, end to end, should be one pre-token; each piece the library cuts off
    is probed with neighbours of known classes.
    """
    cut = tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    for c in (LETTER, NUMBER, WHITE, OTHER):
        points = np.flatnonzero(kind == c)
        points = points[(points < 0xD800) | (points > 0xDFFF)]
        every = "".join(map(chr, points.tolist()))
        for _, (a, b) in cut(every):
            probe = next((k for k, x in ((LETTER, "g"), (NUMBER, "1"), (OTHER, "!")) if len(cut(x + every[a])) == 1), WHITE)
            kind[points[a:b]] = probe


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each character of UTF-8 bytes starts, and its code point."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at]
    cp = lead.astype(np.int32)
    for low, size, keep in ((0xC0, 2, 0x1F), (0xE0, 3, 0x0F), (0xF0, 4, 0x07)):
        k = np.flatnonzero((lead >= low) & (lead < (0xE0 if size == 2 else 0xF0 if size == 3 else 0xF8)))
        x = lead[k].astype(np.int32) & keep
        for j in range(1, size):
            x = (x << 6) | (data[at[k] + j] & 0x3F)
        cp[k] = x
    return at, cp


def scan(symbols: np.ndarray) -> np.ndarray:
    """The transducer's mark at each symbol, from the start state."""
    n = len(symbols)
    lanes = max(1, -(-n // CHUNK))
    steps = -(-n // lanes)
    padded = np.full(lanes * steps, STOP, np.uint8)
    padded[:n] = symbols
    table = np.ascontiguousarray(padded.reshape(lanes, steps).T)
    to = (_TO.astype(np.uint8) * 11).ravel()  # states are kept as row starts
    state = np.repeat(np.arange(0, 121, 11, dtype=np.uint8)[:, None], lanes, 1)
    if lanes > 1:
        for row in table:
            state = to[state + row]
        maps = state // 11
        step = 1
        while step < lanes:  # maps[:, i] becomes the composition of chunks 0..i
            maps[:, step:] = np.take_along_axis(maps[:, step:], maps[:, :-step], 0)
            step *= 2
        state = np.concatenate([[0], maps[START, :-1] * 11]).astype(np.uint8)
    else:
        state = state[0]
    marks = np.empty((steps, lanes), np.uint8)
    flat = _MARK.ravel()
    for i, row in enumerate(table):
        at = state + row
        marks[i] = flat[at]
        state = to[at]
    return marks.T.reshape(-1)[:n]


def spans(data: np.ndarray, off: np.ndarray, special: Collection[bytes] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each pre-token in UTF-8 ``data``, and pre-token offsets by text.

    A string of ``special`` inside a text is a pre-token of its own, and the text goes on anew after it.
    """
    at, cp = code_points(data)
    kind = classes()[cp]
    inside = [tuple(np.searchsorted(at, (i, i + size)).tolist()) for i, size in occurrences(data, off, special)]
    for i, j in inside:
        kind[i:j] = STOP
    text = np.searchsorted(at, off)  # texts by character
    n = len(off) - 1
    symbols = np.empty(len(at) + n, np.uint8)
    stops = text[1:] + np.arange(n)
    keep = np.ones(len(symbols), bool)
    keep[stops] = False
    symbols[stops] = STOP
    symbols[keep] = kind
    marks = scan(symbols)
    here = (marks & HERE) > 0
    here[:-1] |= (marks[1:] & BEFORE) > 0
    begin = here[keep]
    for i, j in inside:
        begin[i:j] = False
        begin[i] = True
    start = at[begin]
    end = np.append(start[1:], len(data))
    return start, end, np.searchsorted(start, off)


def occurrences(data: np.ndarray, off: np.ndarray, special: Collection[bytes]) -> list[tuple[int, int]]:
    """Where the strings stand in the texts, and their sizes: leftmost first, the longest of those that begin together."""
    out: list[tuple[int, int]] = []
    if not special:
        return out
    pattern, raw, i = re.compile(b"|".join(re.escape(w) for w in sorted(special, key=len, reverse=True))), data.tobytes(), 0
    while m := pattern.search(raw, i):
        text = int(np.searchsorted(off, m.start(), "right")) - 1
        if m.end() <= off[text + 1]:
            out.append((m.start(), m.end() - m.start()))
            i = m.end()
        else:
            i = m.start() + 1
    return out
