"""Byte-pair merges compiled into a deterministic transducer that emits token counts.

A word is read symbol by symbol, its last symbol being another than the same one
within a word. For every prefix of a word its merges end in one token, the only
one among the tokens which the prefix ends in that goes with what the rest ends
in; two tokens go together if no merge reaches over their border while both of
its sides stand. So the last tokens and the numbers of tokens of all prefixes
follow from left to right, and only those prefixes matter for what is to come
from whose end on some token may still grow. These, with their last tokens and
their numbers relative to the newest prefix, are a state; a transition emits by
how many tokens the newest prefix has more, or fewer, than the one before.

States are made as words need them and shared by all words, seen and unseen. A
full table costs time, never counts: a word that leaves it is read on without
keeping its states, and the table begins anew.
"""

from __future__ import annotations

import json

import numpy as np

#: Fixed value: what marks the last symbol of a word in the vocabulary's merges.
END = "</w>"
START = -1
#: Bounds of the kept tables.
STATES, SYMBOLS = 1 << 17, 112
#: A move and a number of tokens that are not compiled yet.
UNKNOWN, UNSAID = -1, -128
#: Bytes of the longest word that goes in step with others.
LONGEST = 64


def byte_signs() -> list[str]:
    """The sign that stands for each byte in byte-level vocabularies: itself where it prints, else the next free code point from 256 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = [""] * 256
    for b in prints:
        out[b] = chr(b)
    for k, b in enumerate(b for b in range(256) if not out[b]):
        out[b] = chr(256 + k)
    return out


class Merges:
    """The merge tree of every token, the trie of all tokens, and which tokens go together."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte_of = {sign: b for b, sign in enumerate(byte_signs())}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        number = {name: k for k, name in enumerate(model["vocab"])}
        self.rank: dict[tuple[int, int], int] = {}
        self.sides: dict[int, tuple[int, int, int]] = {}  # of a token: left and right part, rank of the merge
        for k, (a, b) in enumerate(merges):
            self.rank[number[a], number[b]] = k
            self.sides[number[a + b]] = (number[a], number[b], k)
        # trie over symbols: bytes, and 256 more for those that end a word
        self.step: dict[int, int] = {}  # node * 512 + symbol -> node
        self.token: list[int] = [START]  # of a node
        self.grows: list[bool] = [False]
        for name, k in number.items():
            signs = name[: -len(END)] if name.endswith(END) else name
            if not signs or any(c not in byte_of for c in signs) or len(signs) > 1 and k not in self.sides:
                continue  # a token that no merge makes
            symbols = [byte_of[c] for c in signs]
            if name.endswith(END):
                symbols[-1] += 256
            node = 0
            for s in symbols:
                self.grows[node] = True
                key = node * 512 + s
                if key not in self.step:
                    self.step[key] = len(self.token)
                    self.token.append(START)
                    self.grows.append(False)
                node = self.step[key]
            self.token[node] = k
        self._spines: tuple[dict, dict] = ({}, {})
        self._fits: dict[int, bool] = {}

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens that stand at one end of a token while it is merged, each with the rank of the merge that ends it."""
        kept = self._spines[side]
        if token not in kept:
            out, until, at = [], 1 << 60, token
            while True:
                out.append((at, until))
                if at not in self.sides:
                    break
                until, at = self.sides[at][2], self.sides[at][1 - side]
            kept[token] = out
        return kept[token]

    def fits(self, a: int, b: int) -> bool:
        """Whether no merge reaches over the border of two tokens: none that comes before both of its sides are merged away."""
        key = a << 32 | b
        found = self._fits.get(key)
        if found is None:
            # of equal merges the left one comes first: one that would end x stands at its left, one that would end y at its right
            found = not any((r := self.rank.get((x, y))) is not None and r < x_ends and r <= y_ends for x, x_ends in self._spine(a, 0) for y, y_ends in self._spine(b, 1))
            if len(self._fits) >= 1 << 18:
                self._fits.clear()
            self._fits[key] = found
        return found

    def follow(self, state: tuple, symbol: int) -> tuple[tuple, int]:
        """The state after a symbol, and by how many tokens the prefix has more.

        A state is (node, last token, number) of each prefix that counts, the
        number relative to the newest prefix.
        """
        moved, last, more = [], START, 0
        for node, before, number in state:
            there = self.step.get(node * 512 + symbol)
            if there is None:
                continue
            token = self.token[there]
            if token >= 0 and last < 0 and (before < 0 or self.fits(before, token)):
                last, more = token, number + 1
            if self.grows[there]:
                moved.append((there, before, number))
        return (*((node, before, number - more) for node, before, number in moved), (0, last, 0)), more

    def count(self, word: bytes) -> int:
        """Tokens of a word, without any table."""
        state, n = FIRST, 0
        for b in word[:-1]:
            state, more = self.follow(state, b)
            n += more
        return n + self.follow(state, word[-1] + 256)[1]


FIRST = ((0, START, 0),)


class Transducer:
    """The compiled part: dense tables over states and symbols, filled as words need them."""

    def __init__(self, merges: Merges, states: int = STATES, symbols: int = SYMBOLS):
        self.merges, self.symbols = merges, symbols
        self.symbol = np.zeros(256, np.int32)  # 0: none yet
        self.known = 1
        self.move = np.empty((states, symbols), np.int32)
        self.more = np.zeros((states, symbols), np.int8)
        self.last = np.empty((states, symbols), np.int8)  # tokens more if the symbol ends the word
        self.clear()

    def clear(self) -> None:
        self.move.fill(UNKNOWN)
        self.last.fill(UNSAID)
        self.number: dict[tuple, int] = {FIRST: 0}
        self.state: list[tuple] = [FIRST]

    def count(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each word raw[start:end]."""
        if len(self.state) == len(self.move):
            self.clear()
        out = self.run(raw, starts, ends)
        lacking = np.flatnonzero(out < 0)
        if len(lacking):
            words = [raw[a:b].tobytes() for a, b in zip(starts[lacking].tolist(), ends[lacking].tolist(), strict=True)]
            found = {w: self.compile(w) for w in dict.fromkeys(words)}
            out[lacking] = [found[w] for w in words]
        return out

    def run(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each word, -1 where a transition is not compiled or the word is long. All words go in step."""
        size = ends - starts
        order = np.argsort(-size, kind="stable")
        order = order[int(np.searchsorted(-size[order], -LONGEST, side="left")) :]
        at, size = starts[order], size[order]
        state, n = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        move, more, last = self.move.ravel(), self.more.ravel(), self.last.ravel()
        steps = np.arange(1, (int(size[0]) if len(size) else 0) + 1)
        inner = np.searchsorted(-size, -steps, side="left").tolist()  # words longer than each step
        alive = np.searchsorted(-size, -steps, side="right").tolist()
        for step, (k, m) in enumerate(zip(inner, alive, strict=True)):
            symbol = self.symbol[raw[at[:m] + step]]
            place = state[:m] * self.symbols + symbol
            lost = (symbol == 0) | (state[:m] < 0)
            if k < m:  # words that end here
                found = last[place[k:]].astype(np.int64)
                n[k:m] = np.where(lost[k:] | (found == UNSAID), -1, n[k:m] + found)
            if k:
                n[:k] += more[place[:k]]
                state[:k] = np.where(lost[:k], UNKNOWN, move[place[:k]])
        out = np.full(len(starts), -1, np.int64)
        out[order] = n
        return out

    def _symbol(self, byte: int) -> int:
        if not self.symbol[byte] and self.known < self.symbols:
            self.symbol[byte] = self.known
            self.known += 1
        return int(self.symbol[byte])

    def compile(self, word: bytes) -> int:
        """Tokens of a word; the states and transitions that it needs are kept while there is room."""
        here, state, n = 0, FIRST, 0  # here: the number of the state, UNKNOWN if it isn't kept
        for b in word[:-1]:
            s = self._symbol(b)
            if here >= 0 and s and self.move[here, s] != UNKNOWN:
                n += int(self.more[here, s])
                here = int(self.move[here, s])
                state = self.state[here]
                continue
            state, more = self.merges.follow(state, b)
            n += more
            there = self.number.get(state, UNKNOWN)
            if there < 0 and len(self.state) < len(self.move):
                there = self.number[state] = len(self.state)
                self.state.append(state)
            if here >= 0 and s and there >= 0:
                self.move[here, s], self.more[here, s] = there, more
            here = there
        more = self.merges.follow(state, word[-1] + 256)[1]
        s = self._symbol(word[-1])
        if here >= 0 and s:
            self.last[here, s] = more
        return n + more
