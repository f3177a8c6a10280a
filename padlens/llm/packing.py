"""Packing of documents into fixed windows by the sum-of-squares rule."""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from padlens.llm.common import slices, texts_of

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


#: The vocabulary's pre-token pattern without its look-ahead, which matters only between white space characters.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"


def packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class TextIds:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    A text without two white space characters in a row splits into the same pre-tokens without the look-ahead, and
    its merges come from the vocabulary's rank file. Any other text, or one that spells a special token, goes to
    the tokenizer itself.
    """

    def __init__(self, vocabulary: str, ranks: str):
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        with open(public_tokenizers.path(ranks), "rb") as lines:
            merge = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.plain = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=merge, special_tokens={}).encode_ordinary
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.double = re.compile(r"\s\s").search

    def encode(self, text: str) -> bytes:
        if self.double(text) or any(s in text for s in self.special):
            return packed(self.whole.encode(text, add_special_tokens=False).ids)
        return packed(self.plain(text))


@lru_cache(2)
def text_ids(vocabulary: str, ranks: str) -> TextIds:
    """One for each Python worker, which Spark uses again for later tasks."""
    return TextIds(vocabulary, ranks)


class LevelPacker:
    """Online packing into windows: `count[h]` is the number of open windows filled up to h.

    A document's remainder of s ids goes to the level h, or to a new window, for which the sum of squared counts
    is least afterwards; full windows and the empty one don't count. Ties go to the fuller window.
    """

    def __init__(self, window: int):
        self.window = window
        self.count = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[list]] = {}
        self.closed: list[list] = []

    def level(self, s: int) -> int:
        w = self.window
        cost = 2 * (self.count[s:] - self.count[: w + 1 - s]) + 2
        cost[0] -= 1
        cost[-1] -= 1
        cost[1:][self.count[1 : w + 1 - s] == 0] = np.iinfo(np.int64).max
        return w - s - int(np.argmin(cost[::-1]))

    def add(self, doc: tuple, ids: np.ndarray) -> None:
        full = len(ids) // self.window * self.window
        for a in range(0, full, self.window):
            self.closed.append([(doc, a, ids[a : a + self.window])])
        rest = ids[full:]
        if not len(rest):
            return
        h = self.level(len(rest))
        window = self.open[h].pop() if h else []
        window.append((doc, full, rest))
        if h:
            self.count[h] -= 1
        if (h := h + len(rest)) == self.window:
            self.closed.append(window)
            return
        self.open.setdefault(h, []).append(window)
        self.count[h] += 1

    def settle(self) -> None:
        """Close every open window without padding: the emptiest are cut up to fill the fullest, and what is left at
        last goes to windows of powers of two."""
        left = [[h, x] for h in sorted(self.open) for x in self.open[h]]
        i, j = 0, len(left) - 1
        while i < j:
            gap = self.window - left[j][0]
            while gap and i < j:
                doc, start, ids = left[i][1].pop()
                take = min(gap, len(ids))
                left[j][1].append((doc, start, ids[:take]))
                if take < len(ids):
                    left[i][1].append((doc, start + take, ids[take:]))
                left[i][0] -= take
                left[j][0] += take
                gap -= take
                if not left[i][0]:
                    i += 1
            if not gap:
                self.closed.append(left[j][1])
                j -= 1
        if left and i == j:
            size, pieces = left[i][0], left[i][1][::-1]
            for bit in range(size.bit_length() - 1, -1, -1):
                if size >> bit & 1:
                    room, out = 1 << bit, []
                    while room:
                        doc, start, ids = pieces.pop()
                        out.append((doc, start, ids[:room]))
                        if room < len(ids):
                            pieces.append((doc, start + room, ids[room:]))
                        room -= len(out[-1][2])
                    self.closed.append(out)
        self.open = {}
        self.count[:] = 0

    def take(self) -> list[list]:
        out, self.closed = self.closed, []
        return out


def pack(
    docs: DataFrame, window: int = 1024, end_id: int = 0, vocabulary: str = "byte_bpe_50k.json", ranks: str = "byte_bpe_50k.tiktoken"
) -> DataFrame:
    """Pack `docs(doc_id, text)` into sequences of at most `window` ids; one row for each piece.

    A null or empty text is `end_id` alone. Repeated rows are packed each. No rows give no rows. Other columns are
    ignored. A null doc_id stays null. Texts of any length are packed whole. Every task packs its own input split, so
    there is no shuffle; a task holds its open windows, which are fewer than the split's documents and, as the rule
    keeps fill levels balanced, far fewer. Sequence ids are the partition number times 2^33 plus a running number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = text_ids(vocabulary, ranks), LevelPacker(window)
        number = TaskContext.get().partitionId() << 33
        end = np.array([end_id], "<u4").tobytes()

        def rows(done: list[list]) -> pa.RecordBatch:
            nonlocal number
            out: list[list] = [[] for _ in range(7)]
            for pieces in done:
                offset = 0
                for (doc, n), start, ids in pieces:
                    for to, x in zip(out, (doc, start, len(ids), zlib.crc32(ids), n, number, offset)):
                        to.append(x)
                    offset += len(ids)
                number += 1
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names)

        for batch in slices(batches):
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
                ids = np.frombuffer(encoder.encode(text) + end, "<u4")
                packer.add((doc, len(ids)), ids)
            yield rows(packer.take())
        packer.settle()
        yield rows(packer.take())

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
