"""Token counts by a linear longest-match automaton (Song et al., "Fast WordPiece Tokenization", 2021).

A trie of the vocabulary with failure links: where no edge fits, the link leads to the state after the longest matches that
are already certain, and the count of tokens popped on the way is stored with it. One pass over a word gives the number of
its greedy longest-match pieces; the pieces are never built. A character without a piece counts as its UTF-8 bytes.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices

#: Bytes of the words whose counts a task keeps, and of the longest of them.
CACHE, LONGEST = 8_000_000, 64


class Automaton:
    """The trie of pieces with its links. Without pieces every character counts as its bytes; empty and repeated pieces have
    no effect; an empty word with an empty mark has no pieces."""

    def __init__(self, pieces, mark: str = ""):
        self.mark = mark
        self.edges: list[dict] = [{}]
        final = [0]
        chars = set().union(*pieces) if pieces else set()
        weights = {c: len(c.encode()) for c in chars} | dict.fromkeys(pieces, 1)
        weights.pop("", None)
        order = []
        for piece, weight in weights.items():
            u = 0
            for c in piece:
                v = self.edges[u].get(c)
                if v is None:
                    v = self.edges[u][c] = len(self.edges)
                    self.edges.append({})
                    final.append(0)
                u = v
            final[u] = weight
        self.link, self.pops = [-1] * len(self.edges), [0] * len(self.edges)
        order, at = [0], 0
        while at < len(order):  # breadth first: links lead to shorter strings
            u = order[at]
            at += 1
            for c, v in self.edges[u].items():
                order.append(v)
                if final[v]:
                    self.link[v], self.pops[v] = 0, final[v]
                    continue
                z, popped = self.link[u], self.pops[u]
                while c not in self.edges[z]:  # every character of the trie is a piece, so the root has an edge
                    popped += self.pops[z]
                    z = self.link[z]
                self.link[v], self.pops[v] = self.edges[z][c], popped

    def count(self, word: str) -> int:
        """Pieces of mark + word under greedy longest matching."""
        edges, link, pops, u, n = self.edges, self.link, self.pops, 0, 0
        for c in self.mark + word:
            v = edges[u].get(c)
            while v is None:
                if not u:
                    n += len(c.encode("utf-8", "surrogatepass"))
                    v = 0
                    break
                n += pops[u]
                u = link[u]
                v = edges[u].get(c)
            u = v
        while u:
            n += pops[u]
            u = link[u]
        return n


class Counts(dict):
    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton, self.held = automaton, 0

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(word.decode())
        if len(word) <= LONGEST:
            if self.held >= CACHE:
                self.clear()
                self.held = 0
            self[word] = n
            self.held += len(word)
        return n


def sentencepiece_vocabulary(path: str) -> list[str]:
    """The ordinary pieces of a SentencePiece model; their mark of a word's start is U+2581."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]


_COUNTS: dict[str, Counts] = {}


def counts(path: str) -> Counts:
    if path not in _COUNTS:
        _COUNTS[path] = Counts(Automaton(sentencepiece_vocabulary(path), "▁"))
    return _COUNTS[path]


def token_counts(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens, longest_word_tokens) of each row; words are runs of other than ASCII white space.

    Null, empty or wordless text: all 0. Words may be of any length. Rows are treated one by one: repeated rows give
    repeated results; other columns, whatever their names, are ignored; an empty table gives an empty result."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")

    def run(batches):
        known = counts(path)
        for batch in batches:
            words, tokens, most = [], [], []
            for a, b, data, offsets in text_slices(batch.column(1)):
                raw = data.tobytes()
                for k in range(b - a):
                    own = raw[offsets[k] : offsets[k + 1]].split()
                    got = list(map(known.__getitem__, own))
                    words.append(len(own))
                    tokens.append(sum(got))
                    most.append(max(got, default=0))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (words, tokens, most))], ["doc_id", "n_words", "n_tokens", "longest_word_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_words long, n_tokens long, longest_word_tokens long")
