"""Token counts under a unigram model, by dynamic programming over a trie that pre-tokens share.

A node of the trie is a prefix of one or more pre-tokens. It stores the prefix's forward score, the best sum of the log
probabilities of pieces that it splits into, and the number of pieces of that split. Both follow from shorter prefixes, so
each shared prefix is computed once; the count at a pre-token's last node is the pre-token's.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seaweft.llm.common import bound_batches, rows_of, text_list

#: Nodes of a worker's trie, and terminal counts it remembers; beyond that they are begun anew. Mark before a word.
NODES, TERMINALS, MARK = 250_000, 400_000, "▁"
#: Shift of the Zipf-Mandelbrot law that turns a piece's rank into a probability, and log probability of a fallback byte
#: below that of the rarest piece.
SHIFT, BYTE_GAP = 2.7, 10.0


def zipf_scores(pieces: list[str], shift: float = SHIFT) -> dict[str, float]:
    """Log probabilities of pieces in the order of their ranks."""
    total = sum(1 / (r + shift) for r in range(1, len(pieces) + 1))
    return {p: -math.log((r + shift) * total) for r, p in enumerate(pieces, 1)}


def read_pieces(path: str) -> list[str]:
    """The ordinary pieces of a sentencepiece vocabulary, in the order of their ids."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]


class Trie:
    """Counts pieces of pre-tokens. A node is [children, score, count]."""

    def __init__(self, scores: dict[str, float], most_nodes: int = NODES):
        self.scores, self.most = scores, most_nodes
        self.byte = min(scores.values(), default=0.0) - BYTE_GAP
        # pieces by their characters from the last to the first; "" holds the score of the piece that ends the walk
        self.ends: dict = {}
        for piece, s in scores.items():
            at = self.ends
            for c in reversed(piece):
                at = at.setdefault(c, {})
            at[""] = s
        self.clear()

    def clear(self) -> None:
        self.root: list = [{}, 0.0, 0]
        self.nodes = 1

    def count(self, pre: str) -> int:
        """Pieces of one pre-token; of equal scores the split with fewer pieces counts."""
        if self.nodes > self.most:
            self.clear()
        keep = len(pre) <= 64  # the path of a very long pre-token isn't kept
        node = self.root
        path = [node]
        for d, c in enumerate(pre):
            below = node[0].get(c) if keep else None
            if below is None:
                below = self._extend(pre, d, path)
                if keep:
                    node[0][c] = below
                    self.nodes += 1
            node = below
            path.append(node)
        return node[2]

    def _extend(self, pre: str, d: int, path: list) -> list:
        """The node of pre[: d + 1], from the nodes of its shorter prefixes."""
        best, count = -math.inf, 0
        at, i = self.ends, d
        while i >= 0:
            at = at.get(pre[i])
            if at is None:
                break
            s = at.get("")
            if s is not None:
                before = path[i]
                score = before[1] + s
                if score > best or score == best and before[2] + 1 < count:
                    best, count = score, before[2] + 1
            i -= 1
        if pre[d] not in self.ends or "" not in self.ends[pre[d]]:  # a character without a piece falls back to its bytes
            n = len(pre[d].encode())
            score = path[d][1] + n * self.byte
            if score > best:
                best, count = score, path[d][2] + n
        return [{}, best, count]


def count_tokens(docs: DataFrame, pieces: list[str], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_distinct, n_tokens), all long, of every text; words are split at ASCII white space.

    The pieces are broadcast; their number is the vocabulary's. There is no shuffle. A null or empty text has no words and
    no tokens; repeated rows are counted each; a null id stays null; other columns aren't read.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(zipf_scores(pieces))
    cache: dict[str, Trie] = {}
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "trie" not in cache:
            cache["trie"] = Trie(shared.value)
            cache["terminals"] = {}
        count, terminals = cache["trie"].count, cache["terminals"]
        for b in rows_of(batches):
            out = []
            for text in text_list(b.column(1)):
                words = Counter(text.encode().split())
                tokens = 0
                for w, n in words.items():
                    c = terminals.get(w)
                    if c is None:
                        c = count(MARK + w.decode())
                        if len(w) <= 64:
                            terminals[w] = c
                    tokens += n * c
                out.append((sum(words.values()), len(words), tokens))
            if len(terminals) > TERMINALS:
                terminals.clear()
            cols = [pa.array(c, pa.int64()) for c in zip(*out)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", "n_words", "n_distinct", "n_tokens"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_words bigint, n_distinct bigint, n_tokens bigint")
