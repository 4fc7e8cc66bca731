"""Exact byte-pair encoding by dynamic programming over prefixes.

Tokens are ranked; BPE joins the lowest-ranked neighbours first. Every prefix of a piece has exactly one encoding, so it
is enough to know its last token: a token that ends the prefix is the last one if the prefix before it ends in a token
that may stand before it. Which tokens end a prefix, all suffixes of it that are tokens, is told by an automaton over all tokens (Aho-Corasick); whether two tokens may
stand side by side is told by undoing their merges. Back-pointers from the end of the piece give the ids. The cost is
linear in the length of a piece.
"""

from __future__ import annotations

import base64
import functools

import ahocorasick
import regex

#: Splits a text into pieces that are encoded apart (the public pattern of this vocabulary).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries kept of the memory of pieces; it is emptied when full, so long runs of new words cost no memory.
MEMORY = 200_000


def read_ranks(data: bytes) -> dict[bytes, int]:
    """The ranks of a ``.tiktoken`` file."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line.strip())}


class Encoder:
    """Encodes texts with one vocabulary. ``ranks``: bytes of each token to its id, which is its rank."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PIECES) -> None:
        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.length = {i: len(t) for t, i in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token, i in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.inner = bytearray(1 << 16)  # whether some token has these two bytes side by side
        for token in ranks:
            for k in range(len(token) - 1):
                self.inner[token[k] << 8 | token[k + 1]] = 1
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self._undo_merges()
        self.compatible = functools.lru_cache(MEMORY)(self._compatible)
        self.pieces: dict[str, list[int]] = {}
        self.runs: dict[str, list[int]] = {}
        self.signs: dict[str, tuple[int, int, list[int]]] = {}

    def _undo_merges(self) -> None:
        """For each token of several bytes the two tokens it was merged from: its encoding by lower ranks only."""
        for token, rank in sorted(self.ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                left, right = self._merge_below(token, rank)
                self.halves[rank] = (left, right)
                self.joined[left, right] = rank

    def _merge_below(self, token: bytes, rank: int) -> list[int]:
        parts = [self.ranks[token[k : k + 1]] for k in range(len(token))]
        while len(parts) > 2:
            best = min((self.joined.get(pair, rank), k) for k, pair in enumerate(zip(parts, parts[1:])))
            if best[0] >= rank:
                raise ValueError(f"token {rank} isn't made of lower tokens")
            parts[best[1] : best[1] + 2] = [best[0]]
        return parts

    def _compatible(self, left: int, right: int) -> bool:
        """Whether BPE of the two tokens' bytes gives just these two tokens.

        Undo merges, the later one first, and look at the tokens then adjacent over the seam: had they a merge that comes
        before the one undone, BPE would have made it and torn the token up.
        """
        bound = 1 << 62
        while True:
            over = self.joined.get((left, right))
            if over is not None and over < bound:
                return False
            undo_left = left in self.halves and (left > right or right not in self.halves)
            if undo_left:
                bound, left = left, self.halves[left][1]
            elif right in self.halves:
                # a merge over the seam with the same rank would stand further left, so it comes first
                bound, right = right + 1, self.halves[right][0]
            else:
                return True

    def _by_prefixes(self, data: bytes) -> list[int]:
        n = len(data)
        last = [-1] * (n + 1)
        length, compatible = self.length, self.compatible
        for end, token in self.automaton.iter(data.decode("latin-1")):
            end += 1
            if last[end] < 0:
                start = end - length[token]
                if start == 0 or (last[start] >= 0 and compatible(last[start], token)):
                    last[end] = token
        out = []
        while n:
            out.append(last[n])
            n -= length[last[n]]
        return out[::-1]

    def _sign(self, char: str) -> tuple[int, int, list[int]]:
        """First byte, last byte and ids of a character."""
        data = char.encode("utf-8", "replace")
        found = self.signs[char] = (data[0], data[-1] << 8, self._by_prefixes(data))
        return found

    def _piece(self, piece: str) -> list[int]:
        """Cuts where no token has the two bytes side by side are safe; most Chinese characters stand alone."""
        if len(piece) < 3 or piece.isascii():
            return self._by_prefixes(piece.encode("utf-8", "replace"))
        out: list[int] = []
        start, before, alone = 0, 0, []
        inner, signs = self.inner, self.signs
        for k, char in enumerate(piece):
            sign = signs.get(char) or self._sign(char)
            if k and not inner[before | sign[0]]:
                out += alone if k - start == 1 else self._run(piece[start:k])
                start = k
            before, alone = sign[1], sign[2]
        out += alone if len(piece) - start == 1 else self._run(piece[start:])
        return out

    def _run(self, run: str) -> list[int]:
        ids = self.runs.get(run)
        if ids is None:
            if len(self.runs) >= MEMORY:
                self.runs.clear()
            ids = self._by_prefixes(run.encode("utf-8", "replace"))
            if len(run) <= 40:
                self.runs[run] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; of an empty or NULL text an empty list. Markup in the text is ordinary text."""
        out: list[int] = []
        pieces = self.pieces
        for piece in self.find(text or ""):
            ids = pieces.get(piece)
            if ids is None:
                ids = self._piece(piece)
                if len(piece) <= 40:
                    if len(pieces) >= MEMORY:
                        pieces.clear()
                    pieces[piece] = ids
            out += ids
        return out
