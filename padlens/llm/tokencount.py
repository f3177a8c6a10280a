"""Token counts by rank-synchronous merging of ragged symbol arrays."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from padlens.llm.common import slices, texts_of

#: Distinct words whose counts a Python worker keeps.
KEPT_WORDS = 1_000_000
_LAST = np.int64(1) << np.int64(40)


class Merger:
    """The merges of a byte-fallback BPE vocabulary as arrays.

    A pair of pieces merges if their joined text is a piece; the better its score, the lower the pair's rank.
    """

    def __init__(self, model: str):
        import public_tokenizers
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model))
        plain = [i for i in range(lib.vocab_size()) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        pieces = {lib.id_to_piece(i): i for i in plain}
        self.char = {p: i for p, i in pieces.items() if len(p) == 1}
        keys, ranks, merged = [], [], []
        order = {i: r for r, i in enumerate(sorted(plain, key=lambda i: (-lib.get_score(i), i)))}
        for piece, i in pieces.items():
            for k in range(1, len(piece)):
                a, b = pieces.get(piece[:k]), pieces.get(piece[k:])
                if a is not None and b is not None:
                    keys.append(a << 20 | b)
                    ranks.append(order[i])
                    merged.append(i)
        by = np.argsort(keys)
        self.keys, self.ranks, self.merged = (np.array(x, np.int64)[by] for x in (keys, ranks, merged))
        # Pieces after whose making no better pair can arise: all pairs with them rank behind.
        least = np.full(lib.vocab_size(), _LAST)
        np.minimum.at(least, self.keys >> 20, self.ranks)
        np.minimum.at(least, self.keys & 0xFFFFF, self.ranks)
        rank_of = np.full(lib.vocab_size(), -1, np.int64)
        rank_of[list(order)] = list(order.values())
        self.calm = least > rank_of
        #: Characters that may meet within a piece; words are cut between all others.
        self.meet = {p[k : k + 2] for p in pieces for k in range(len(p) - 1)}
        self.missing = lib.vocab_size()
        self.normalize = lib.normalize
        self.counts: dict[str, int] = {}
        bits = np.zeros(1 << 22, bool)
        bits[self._slot(self.keys)] = True
        self.bits = bits

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys * np.int64(0x2545F4914F6CDD1D)) >> np.int64(42)) & np.int64((1 << 22) - 1)

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (_LAST: none) and what it makes."""
        rank, to = np.full(len(left), _LAST), np.zeros(len(left), np.int64)
        keys = left << 20 | right
        maybe = np.flatnonzero(self.bits[self._slot(keys)])
        at = np.minimum(np.searchsorted(self.keys, keys[maybe]), len(self.keys) - 1)
        same = self.keys[at] == keys[maybe]
        rank[maybe[same]], to[maybe[same]] = self.ranks[at[same]], self.merged[at[same]]
        return rank, to

    def merge(self, words: list[str]) -> np.ndarray:
        """Symbols that survive in each word.

        All words stand in one array with the word of each symbol beside it. Every round finds each word's lowest
        rank and applies it: at all its places from the left without overlap if no better pair can arise from that,
        else at the leftmost place. Words without a pair leave the array.
        """
        left = np.zeros(len(words), np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        char, missing = self.char, self.missing
        symbol = np.array([char.get(c, missing) for w in words for c in w], np.int64)
        text = "".join(words)
        # A character that the vocabulary lacks becomes its bytes, which never merge.
        absent = np.flatnonzero(symbol == missing)
        extra = np.zeros(len(words), np.int64)
        word = np.repeat(np.arange(len(words)), size)
        if len(absent):
            np.add.at(extra, word[absent], [len(text[i].encode("utf-8", "surrogatepass")) - 1 for i in absent.tolist()])
        rank, to = self._lookup(symbol[:-1], symbol[1:])
        rank[word[:-1] != word[1:]] = _LAST
        while len(symbol):
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            padded = np.concatenate([rank, [_LAST]])
            least = np.minimum.reduceat(padded, starts)
            length = np.diff(np.append(starts, len(symbol)))
            over = least == _LAST
            if over.any():
                left[word[starts[over]]] = length[over]
                keep = np.repeat(~over, length)
                symbol, word, padded = symbol[keep], word[keep], padded[keep]
                to = np.concatenate([to, [0]])[keep]
                if not len(symbol):
                    break
                rank, to = padded[:-1], to[:-1]
                least, length = least[~over], length[~over]
                starts = np.concatenate([[0], np.cumsum(length)[:-1]])
            hit = np.concatenate([rank, [_LAST]]) == np.repeat(least, length)
            place = np.flatnonzero(hit)
            # From each run of neighbouring places of one word every second one, from the left.
            run = np.concatenate([[True], np.diff(place) != 1])
            begin = np.maximum.accumulate(np.where(run, np.arange(len(place)), 0))
            place = place[(np.arange(len(place)) - begin) % 2 == 0]
            first = np.concatenate([[True], word[place[1:]] != word[place[:-1]]])
            place = place[first | self.calm[to[place]]]
            symbol[place] = to[place]
            keep = np.ones(len(symbol), bool)
            keep[place + 1] = False
            now = np.cumsum(keep) - 1
            rank, to = np.concatenate([rank, [_LAST]])[keep][:-1], np.concatenate([to, [0]])[keep][:-1]
            symbol, word = symbol[keep], word[keep]
            fresh = now[place]
            fresh = np.unique(np.concatenate([fresh, fresh - 1]))
            fresh = fresh[(fresh >= 0) & (fresh < len(symbol) - 1)]
            r, t = self._lookup(symbol[fresh], symbol[fresh + 1])
            r[word[fresh] != word[fresh + 1]] = _LAST
            rank[fresh], to[fresh] = r, t
        return left + extra

    def _cut(self, word: str) -> list[str]:
        """Parts that no piece joins."""
        out, a = [], 0
        for k in range(1, len(word)):
            if word[k - 1 : k + 1] not in self.meet:
                out.append(word[a:k])
                a = k
        return [*out, word[a:]]

    def learn(self, words: set[str]) -> dict[str, int]:
        """Counts of words, merged in one batch."""
        words = list(words)
        parts = [self._cut(w) for w in words]
        size = [len(p) for p in parts]
        counted = self.merge([x for p in parts for x in p])
        starts = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
        return dict(zip(words, np.add.reduceat(counted, starts).tolist())) if words else {}

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text. Pre-tokens are the normalised text's parts from one word start to the next; a run of
        spaces stays with the word after it, as pieces of several spaces exist."""
        split = []
        for text in texts:
            text = self.normalize(text) if text else ""
            split.append(_WORDS(text))
        known = self.counts
        new = set().union(*split) - known.keys() if split else set()
        fresh = self.learn(new)
        if len(known) + len(fresh) <= KEPT_WORDS:
            known.update(fresh)
            return [sum(map(known.__getitem__, ws)) for ws in split]
        return [sum(known.get(w) or fresh[w] for w in ws) for ws in split]


_WORDS = re.compile("▁*[^▁]+|▁+").findall


@lru_cache(2)
def merger(model: str) -> Merger:
    """One for each Python worker."""
    return Merger(model)


def count_tokens(docs: DataFrame, model: str = "piece_bpe_32k.model", limit: int = 4096) -> DataFrame:
    """`doc_id, n_bytes, n_tokens, over_limit` for each row of docs(doc_id, text).

    A null or empty text has no bytes and no tokens. Repeated rows are counted each; no rows give no rows; a null
    doc_id stays null; other columns are ignored. No shuffle; a task holds about 4 MB of text or one longer text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = texts_of(batch)
            n = np.array(merger(model).count(texts), np.int64)
            size = pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), size, pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
