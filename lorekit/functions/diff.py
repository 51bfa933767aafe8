"""Line diffs and a text editing buffer."""

from __future__ import annotations

import bisect
import difflib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Rows that exist as Python objects at a time.
ROWS_AT_ONCE = 200
#: A line with its end.
_LINE = re.compile(r"[^\n]*\n|[^\n]+")


def unified(path: str, original: str, proposed: str) -> str:
    """Every line of both texts with its sign under two header lines; '' for two empty texts."""
    a, b = _LINE.findall(original), _LINE.findall(proposed)
    out: list[str] = []
    for kind, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if kind == "equal":
            out += [" " + x for x in a[i:j]]
        else:
            out += ["-" + x for x in a[i:j]] + ["+" + x for x in b[k:m]]
    body = "".join(x if x.endswith("\n") else x + "\n" for x in out)
    return f"--- a/{path}\n+++ b/{path}\n{body}" if body else ""


def apply(patch: str) -> tuple[str, str]:
    """Both texts of a patch, with a line end after each line."""
    body = patch.split("\n")[2:]
    body = body[:-1] if body and body[-1] == "" else body
    side = lambda signs: "".join(x[1:] + "\n" for x in body if x[:1] in signs)
    return side(" -"), side(" +")


def with_diff(df: DataFrame, path: str, original: str, proposed: str) -> DataFrame:
    """(path, patch, changed) of each row; null texts count as empty."""

    kind = df.schema[path].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(i, ROWS_AT_ONCE) for whole in batches for i in range(0, len(whole), ROWS_AT_ONCE)):
            rows = [(str(p), x or "", y or "") for p, x, y in zip(*[c.to_pylist() for c in b.columns], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([unified(*r) for r in rows], pa.string()), pa.array([x != y for _, x, y in rows], pa.bool_())], names=[path, "patch", "changed"])

    return df.select(path, original, proposed).mapInArrow(run, f"{path} {kind}, patch string, changed boolean")


def edit(text, offset, length, replacement):
    """Column: text with ``length`` characters from ``offset`` on (from 0) replaced; length 0 inserts."""
    return F.overlay(text, replacement, offset + 1, length)


@dataclass
class Buffer:
    """A text under edits: the original and an append-only log, and the pieces of both that make up the text."""

    original: str
    added: str = ""
    pieces: list[tuple[bool, int, int]] = field(default_factory=list)  # (from the log, start, length)

    def __post_init__(self) -> None:
        if self.original:
            self.pieces = [(False, 0, len(self.original))]

    def __len__(self) -> int:
        return sum(n for _, _, n in self.pieces)

    def _split(self, offset: int) -> int:
        """Index of the piece that starts at an offset, which is split if it lies inside one."""
        ends = []
        total = 0
        for _, _, n in self.pieces:
            total += n
            ends.append(total)
        i = bisect.bisect_right(ends, offset)
        if i < len(self.pieces):
            log, start, n = self.pieces[i]
            inside = offset - (ends[i] - n)
            if inside:
                self.pieces[i : i + 1] = [(log, start, inside), (log, start + inside, n - inside)]
                i += 1
        return i

    def insert(self, offset: int, text: str) -> None:
        if text:
            i = self._split(min(max(offset, 0), len(self)))
            self.pieces.insert(i, (True, len(self.added), len(text)))
            self.added += text

    def delete(self, offset: int, length: int) -> None:
        if length > 0 and offset < len(self):
            i = self._split(offset)
            j = self._split(min(offset + length, len(self)))
            del self.pieces[i:j]

    def text(self) -> str:
        return "".join((self.added if log else self.original)[a : a + n] for log, a, n in self.pieces)
