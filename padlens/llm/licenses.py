"""Licence recognition: normalised sentences become identifiers, identifier sequences match ordered rules."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from padlens.llm.common import slices, texts_of
from padlens.llm.licence_texts import RULES, SENTENCES

#: Unknown sentences that may stand between two sentences of a rule.
GAP = 3

_MARK = re.compile(r"[^0-9a-z]+")
_END = re.compile(r"(?<=[.:;!?])\s+|\n+")


def normalise(sentence: str) -> str:
    """Lower case, letters and digits, single spaces."""
    return _MARK.sub(" ", sentence.lower()).strip()


def sentences(text: str) -> list[tuple[int, int]]:
    """Start and end of each sentence: line ends and marks before white space end one."""
    out, a = [], 0
    for m in _END.finditer(text):
        out.append((a, m.start()))
        a = m.end()
    return [*out, (a, len(text))]


class Rules:
    """Known sentences by normal form, and the ordered rules, longer first."""

    def __init__(self, known: dict[str, list[str]], rules: list[tuple[str, tuple[str, ...]]], gap: int):
        self.ids: dict[tuple[str, ...], str] = {}
        for name, forms in known.items():
            for form in forms:
                # A known sentence can itself hold marks that end one: it is then a sequence of parts.
                self.ids[tuple(normalise(form[a:b]) for a, b in sentences(form) if normalise(form[a:b]))] = name
        self.first: dict[str, list[tuple[str, tuple[str, ...], str]]] = {}
        for parts, name in self.ids.items():
            self.first.setdefault(parts[0].split()[0], []).append((" ".join(parts), parts, name))
        for found in self.first.values():
            found.sort(key=lambda x: -len(x[0]))
        self.rules = sorted(rules, key=lambda r: -len(r[1]))
        self.gap = gap
        # Every known sentence's first part holds one of these words, so texts without them needn't be cut.
        self.anchor = re.compile("|".join(sorted({max(p[0].split(), key=len) for p in self.ids})), re.IGNORECASE)

    def recognise(self, text: str) -> list[tuple[int, int, int, str]]:
        """(sentence number, start, end, identifier) of the known sentences of a text.

        A known sentence is one part or several in a row: single line ends in it count as spaces, blank lines (also
        such with signs of comments alone) end it. Lines without a mark at their end are of one sentence with the next.
        """
        if not self.anchor.search(text):
            return []
        spans = [(a, b, n) for a, b in sentences(text) if (n := normalise(text[a:b]))]
        blank = [True, *[text.count("\n", x[1], y[0]) > 1 for x, y in zip(spans, spans[1:])]]
        number = [0] * len(spans)
        for i in range(1, len(spans)):
            wrapped = not blank[i] and not text[spans[i - 1][1] - 1] in ".:;!?"
            number[i] = number[i - 1] + (not wrapped)
        out, i = [], 0
        while i < len(spans):
            step = 1
            for joined, parts, name in self.first.get(spans[i][2].split(" ", 1)[0], ()):
                j, so_far = i + 1, spans[i][2]
                while j < len(spans) and len(so_far) < len(joined) and joined.startswith(so_far + " "):
                    so_far += " " + spans[j][2]
                    j += 1
                if so_far == joined and (not any(blank[i + 1 : j]) or tuple(s[2] for s in spans[i:j]) == parts):
                    step = j - i
                    out.append((number[i], spans[i][0], spans[j - 1][1], name))
                    break
            i += step
        return out

    def match(self, text: str) -> list[tuple[str, int, int]]:
        """(licence, start, end), longest rules first at each place, without overlap."""
        known, out, i = self.recognise(text), [], 0
        while i < len(known):
            step = 1
            for licence, names in self.rules:
                part = known[i : i + len(names)]
                near = all(b[0] - a[0] <= self.gap + 1 for a, b in zip(part, part[1:]))
                if tuple(p[3] for p in part) == names and near:
                    out.append((licence, part[0][1], part[-1][2]))
                    step = len(names)
                    break
            i += step
        return out


def scan(docs: DataFrame, known: dict[str, list[str]] = SENTENCES, rules: list[tuple[str, tuple[str, ...]]] = RULES, gap: int = GAP) -> DataFrame:
    """`doc_id, licenses, n_matches, first_start, first_end` for each row of docs(doc_id, text).

    licenses joins the distinct SPDX names in order of their names by commas; without a match it is empty and the
    offsets (in characters) are null. Null and empty texts have no match. Repeated rows come back each; no rows
    give no rows; a null doc_id stays null; other columns are ignored. One narrow pass, no shuffle.
    """
    table = Rules(known, rules, gap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [table.match(t) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array([",".join(sorted({m[0] for m in f})) for f in found], pa.string()),
                    pa.array(np.array([len(f) for f in found], np.int32)),
                    pa.array([f[0][1] if f else None for f in found], pa.int64()),
                    pa.array([f[0][2] if f else None for f in found], pa.int64()),
                ],
                ["doc_id", "licenses", "n_matches", "first_start", "first_end"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, licenses string, n_matches int, first_start long, first_end long")
