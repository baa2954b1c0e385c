"""Byte-pair encoding of texts over a trie of their distinct words.

The merges of a word need not be replayed one by one: in a byte-pair code the tokens of a prefix
are fixed by the prefix's *last token*, and a token may follow another exactly when the two, put
side by side, encode to themselves. So distinct words go into a trie, and a depth-first walk
gives each node the last token of the prefix it stands for; words with a common prefix share its
nodes, and their encodings are read off by stepping back token by token.

The work is narrow: each batch of texts inserts only the words that its worker has not met yet.
A worker keeps the words met last.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from textrisk.llm.common import Remembered, field_type, map_batches, small_batches, texts_of
from textrisk.llm.pretokens import WORD_VOCABULARY, PreTokenizer, vocabulary_path

_NEVER = 1 << 60


class TrieEncoder:
    """Encodes spelled words; ``</w>`` on the last symbol where the vocabulary marks word ends.

    Merges apply in the order of their rank, and a merge ranks after those that form its parts.
    So along the seam between two tokens, each side shows one symbol after the other: the *edge*
    of a token lists them with the rank at which each is merged further inside its token. The
    seam holds exactly when no pair of edge symbols has a merge that comes before both go.
    """

    def __init__(self, name_or_path: str):
        with open(vocabulary_path(name_or_path), encoding="utf-8") as source:
            model = json.load(source)["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self._made_of: dict[str, list[tuple[str, str]]] = {}
        for left, right in merges:
            self._made_of.setdefault(left + right, []).append((left, right))
        self._reach: dict[str, int] = {}  # the last two symbols of tokens: most symbols of one
        for token in self.ids:
            size = self._size(token)
            tail = token[-2 - len(self.end) * self._ends(token) :]
            self._reach[tail] = max(size, self._reach.get(tail, 0))
        self._edges: dict[str, tuple[list, list] | None] = {}
        self._whole = {token for token in self.ids if self.edges(token)}
        self._follows: dict[tuple[str, str], bool] = {}

    def _ends(self, token: str) -> bool:
        return bool(self.end) and token.endswith(self.end) and token != self.end

    def _size(self, token: str) -> int:
        return len(token) - len(self.end) * self._ends(token)

    def _clashes(self, left: list, right: list) -> bool:
        """Whether a merge across the seam comes before its two symbols are merged inside.

        Of equal ranks the leftmost place is merged first.
        """
        rank = self.rank
        for a, a_goes in left:
            for b, b_goes in right:
                crossing = rank.get((a, b), _NEVER)
                if crossing < a_goes and crossing <= b_goes and crossing != _NEVER:
                    return True
        return False

    def edges(self, token: str) -> tuple[list, list] | None:
        """The left and right edge of a token, each from the smallest symbol on; None if the
        token's own text is encoded otherwise."""
        if token in self._edges:
            return self._edges[token]
        found = None
        if self._size(token) == 1:
            found = [(token, _NEVER)], [(token, _NEVER)]
        for left, right in self._made_of.get(token, ()):
            l_edges, r_edges = self.edges(left), self.edges(right)
            if l_edges is None or r_edges is None:
                continue
            at = self.rank[left, right]
            # Inside the token the two parts go at its own merge.
            inner, outer = [*l_edges[1][:-1], (left, at)], [*r_edges[0][:-1], (right, at)]
            if not self._clashes(inner[:-1], outer) and not self._clashes(inner[-1:], outer[:-1]):
                found = (
                    [*l_edges[0][:-1], (left, at), (token, _NEVER)],
                    [*r_edges[1][:-1], (right, at), (token, _NEVER)],
                )
                break
        self._edges[token] = found
        return found

    def _may_follow(self, left: str, right: str) -> bool:
        if len(self._follows) > 1_000_000:
            self._follows.clear()
        known = self._follows[left, right] = not self._clashes(self.edges(left)[1], self.edges(right)[0])
        return known

    def encode(self, words: Iterable[str]) -> dict[str, list[str]]:
        """The tokens of each distinct non-empty word, as vocabulary strings.

        The trie is held as its depth-first order: sorted words, each of which shares with the
        one before it the path up to their longest common prefix.
        """
        out: dict[str, list[str]] = {}
        last: list[tuple[str, int]] = []  # of each prefix on the path: last token, its symbols
        path = ""
        for word in sorted(words):
            shared, most = 0, min(len(path), len(word) - 1)
            while shared < most and path[shared] == word[shared]:
                shared += 1
            del last[shared:]
            for depth in range(shared + 1, len(word)):
                last.append(self._last_token(word[:depth], depth, last))
            token, size = self._last_token(word + self.end, len(word), last)
            tokens, at = [token], len(word) - size
            while at:
                token, size = last[at - 1]
                tokens.append(token)
                at -= size
            out[word] = tokens[::-1]
            path = word[:-1]
        return out

    def _last_token(self, prefix: str, depth: int, last: list[tuple[str, int]]) -> tuple[str, int]:
        """The last token of a prefix of ``depth`` symbols, from those of the shorter prefixes."""
        whole, follows = self._whole, self._follows
        for size in range(min(self._reach.get(prefix[max(0, depth - 2) :], 1), depth), 0, -1):
            token = prefix[depth - size :]
            if token in whole:
                if size == depth:
                    return token, size
                before = last[depth - size - 1][0]
                fits = follows.get((before, token))
                if self._may_follow(before, token) if fits is None else fits:
                    return token, size
        raise ValueError(f"a symbol outside the vocabulary: {prefix[-1]!r}")


class TextEncoder:
    """Ids and decoded text of whole texts, from the words met so far."""

    def __init__(self, name_or_path: str):
        self.pretokens = PreTokenizer(name_or_path)
        self.trie = TrieEncoder(name_or_path)
        self.known = Remembered(self._learn)

    def _learn(self, new: list[str]) -> dict[str, tuple[bytes, str]]:
        special, ids = self.pretokens.special, self.trie.ids
        spelled = {word: self.pretokens.spell(word) for word in new if word not in special}
        tokens_of = self.trie.encode(set(spelled.values()))
        out = {word: (struct.pack("<I", special[word]), word[2:]) for word in new if word in special}
        for word, letters in spelled.items():
            tokens = tokens_of[letters]
            out[word] = struct.pack(f"<{len(tokens)}I", *[ids[t] for t in tokens]), " ".join(tokens)
        return out

    def encode(self, texts: list[str]) -> tuple[tuple[bytes, ...], tuple[str, ...]]:
        """Of the texts: ids as little-endian 32-bit integers, and decoded texts."""
        split = [self.pretokens.split(text) for text in texts]
        found = self.known.lookup(set().union(*split))
        pairs = ([found[word] for word in words] for words in split)
        return tuple(zip(*[(b"".join([p[0] for p in ps]), " ".join([p[1] for p in ps])) for ps in pairs], strict=True))


@lru_cache(maxsize=2)
def text_encoder(name_or_path: str) -> TextEncoder:
    return TextEncoder(name_or_path)


def bpe_round_trip(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = WORD_VOCABULARY
) -> DataFrame:
    """One row per input row: the id, ``ids`` (little-endian unsigned 32-bit integers, as binary),
    ``n_tokens`` and ``decoded``.

    Encoding adds no special tokens; special strings inside a text become their own ids. Decoding
    keeps special tokens; the vocabulary has no decoder, so tokens are joined by blanks. Null and
    empty texts have no ids and decode to the empty string. Repeated rows and ids stay; other
    columns are dropped.
    """
    small_batches(docs.sparkSession)
    schema = T.StructType(
        [
            T.StructField("id", field_type(docs, id_col)),
            T.StructField("ids", T.BinaryType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("decoded", T.StringType()),
        ]
    )

    def rows_of(batch: pa.RecordBatch):
        ids, decoded = text_encoder(vocabulary).encode(texts_of(batch.column(1)))
        yield [batch.column(0), ids, [len(packed) // 4 for packed in ids], decoded]

    return map_batches(docs.select(id_col, text_col), rows_of, schema).withColumnRenamed("id", id_col)
