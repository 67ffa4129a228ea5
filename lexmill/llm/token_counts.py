"""Word-piece token counts by a linear longest-match automaton.

The vocabulary is a trie with two roots: pieces that may start a word (with the start marker in front), and pieces
that continue one. Every node has a failure link: where to go on once no child fits, and how many tokens are popped
on the way. Both are worked out when the automaton is built, so a word is counted in one pass over its bytes, with no
piece ever built. Greedy longest match from the left is what is counted; a word that cannot be covered is one unknown
token.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

#: Words kept in a worker's memory of counts, and the longest word kept.
MEMO_WORDS, MEMO_BYTES = 400_000, 48
DEAD = -1


class PieceAutomaton:
    """``initial``: pieces at a word's start, each beginning with ``marker``; ``continuing``: pieces further on."""

    def __init__(self, initial: Iterable[bytes], continuing: Iterable[bytes], marker: bytes = b""):
        self.marker = marker
        self.edge: dict[int, int] = {}
        self.start, self.rest = 0, 1
        depth, ends, parent = [0, 0], [False, False], [(DEAD, 0), (DEAD, 0)]
        for root, pieces in ((self.start, initial), (self.rest, continuing)):
            for piece in pieces:
                u = root
                for c in piece:
                    v = self.edge.get(u << 8 | c)
                    if v is None:
                        v = self.edge[u << 8 | c] = len(depth)
                        depth.append(depth[u] + 1)
                        ends.append(False)
                        parent.append((u, c))
                    u = v
                ends[u] = u > 1
        self.fail, self.popped = [DEAD] * len(depth), [0] * len(depth)
        for v in sorted(range(2, len(depth)), key=depth.__getitem__):
            u, c = parent[v]
            if ends[v]:
                self.fail[v], self.popped[v] = self.rest, 1
                continue
            z, n = self.fail[u], self.popped[u]
            while z != DEAD and (z << 8 | c) not in self.edge:
                n += self.popped[z]
                z = self.fail[z]
            if z != DEAD:
                self.fail[v], self.popped[v] = self.edge[z << 8 | c], n

    def count(self, word: bytes) -> int:
        """Tokens of a word: 0 for the empty one, 1 (unknown) for one that the pieces do not cover."""
        if not word:
            return 0
        edge, fail, popped = self.edge, self.fail, self.popped
        u, n = self.start, 0
        for c in self.marker + word:
            while (v := edge.get(u << 8 | c)) is None:
                if fail[u] == DEAD:
                    return 1
                n += popped[u]
                u = fail[u]
            u = v
        while u != self.rest:
            if fail[u] == DEAD:
                return 1
            n += popped[u]
            u = fail[u]
        return n


def rank_file_pieces(path: str) -> tuple[list[bytes], list[bytes]]:
    """Initial pieces (those after a space) and continuing ones of a byte-level rank file."""
    with open(path, "rb") as lines:
        pieces = [base64.b64decode(line.split()[0]) for line in lines if line.strip()]
    return [p for p in pieces if p[:1] == b" "], [p for p in pieces if p[:1] != b" "]


class Counts(dict):
    """Counts by word, worked out when first asked for; forgets all when full. Travels to the workers empty."""

    def __init__(self, automaton: PieceAutomaton):
        self.automaton = automaton

    def __reduce__(self):
        return Counts, (self.automaton,)

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(word)
        if len(word) <= MEMO_BYTES:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[word] = n
        return n


def _columns(counts: Counts, ids: list, texts: list[bytes | None]) -> dict[str, list]:
    words = [(t or b"").split() for t in texts]
    return {
        "doc_id": ids,
        "n_words": [len(w) for w in words],
        "n_pieces": [sum(map(counts.__getitem__, w)) for w in words],
        "n_bytes": [len(t or b"") for t in texts],
    }


def token_counts(docs: DataFrame, automaton: PieceAutomaton, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, n_words, n_pieces, n_bytes (UTF-8).

    Words are runs of bytes other than space and \\t..\\r. A null or empty text has counts of 0; a null id is kept;
    repeated rows give repeated rows; an empty table gives an empty one; other columns are not read. A text of any
    length is counted whole in one pass. No shuffle; the automaton is broadcast (its size is that of the vocabulary).
    """
    shared = docs.sparkSession.sparkContext.broadcast(Counts(automaton))  # a worker keeps its own from task to task

    def rows(batch: dict[str, list]) -> dict[str, list]:
        return _columns(shared.value, batch["id"], batch["text"])

    wanted = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return map_arrow(wanted, rows, "doc_id long, n_words long, n_pieces long, n_bytes long")
