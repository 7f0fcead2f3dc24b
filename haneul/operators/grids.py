"""Tables of printed pages from placed words, upright or turned by a quarter, with headers of several rows.

A page's words (text and box, y downwards) come together in one call of a partitioned table
function. Boxes that are higher than wide say that the page is turned; of the two ways to turn it
back, that one is taken in which more rows begin with a label. Rows are runs of words whose
middles follow each other closely; the rows before the first one with a figure that isn't a year
are the header. Columns are runs of overlapping figures of the other rows. What stands left of them
is a row's label, and each row of the header names a column by its nearest word, so that a word
over several columns names them all.

Figures may have thousands' commas, a sign or △ for minus. Words that are no figures, and figures
of blank cells, give no cell. Pages without a figure have no table. Null texts are left out; null boxes
aren't placed and are left out too. One page is one group, bounded by what fits on paper.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql.functions import udtf
from pyspark.sql.types import Row

CELLS = "page string, row int, label string, col int, headers array<string>, value double"
WORDS = ("page", "text", "x0", "top", "x1", "bottom")
#: Fixed value: how a minus may be printed before a figure.
MINUS = "-−–△▲"
_FIGURE = re.compile(rf"^[{MINUS}]?\d[\d,]*(?:\.\d+)?%?$")
_YEAR = re.compile(r"^(?:19|20)\d\d$")


def figure(text: str) -> float | None:
    """'1,234.5', '△3.2' and the like as a number; None for anything else."""
    if not _FIGURE.match(text):
        return None
    value = float(text.lstrip(MINUS).replace(",", "").rstrip("%"))
    return -value if text[0] in MINUS else value


Word = tuple[str, float, float, float, float]


def _runs(items: list, start, end, gap: float) -> list[list]:
    """Items in order of their start, cut where one begins more than a gap after all before it have ended."""
    runs: list[list] = []
    until = 0.0
    for x in sorted(items, key=start):
        if not runs or start(x) > until + gap:
            runs.append([])
            until = end(x)
        runs[-1].append(x)
        until = max(until, end(x))
    return runs


def _rows(words: list[Word]) -> list[list[Word]]:
    """Rows of words from left to right: a row's middles lie within half of a usual word's height of the last one."""
    usual = sorted(b - t for _, _, t, _, b in words)[len(words) // 2]
    middle = lambda w: (w[2] + w[4]) / 2
    return [sorted(row, key=lambda w: w[1]) for row in _runs(words, middle, middle, usual / 2)]


def _turned(words: list[Word], left: bool) -> list[Word]:
    """Words of a page turned by a quarter, turned back; left: its text ran upwards."""
    return [(s, -b, x0, -t, x1) if left else (s, t, -x1, b, -x0) for s, x0, t, x1, b in words]


def _labelled(words: list[Word]) -> float:
    """The part of rows with figures that begin with something else; a table's header comes first."""
    rows = [r for r in _rows(words) if any(figure(w[0]) is not None and not _YEAR.match(w[0]) for w in r)]
    return sum(figure(r[0][0]) is None for r in rows) / len(rows) if rows else 0.0


def upright(words: list[Word]) -> list[Word]:
    long = [w for w in words if len(w[0]) > 2]
    if sum(w[4] - w[2] > w[3] - w[1] for w in long) * 2 <= len(long):
        return words
    return max((_turned(words, True), _turned(words, False)), key=_labelled)


def cells(words: list[Word]) -> Iterator[tuple[int, str, int, list[str], float]]:
    """(row, label, column, header words from the top, value) of a page's table."""
    if not words:
        return
    rows = _rows(upright(words))
    is_body = [any(figure(w[0]) is not None and not _YEAR.match(w[0]) for w in row) for row in rows]
    if True not in is_body:
        return
    head, body = rows[: is_body.index(True)], rows[is_body.index(True) :]
    columns = _runs([w for row in body for w in row if figure(w[0]) is not None], lambda w: w[1], lambda w: w[3], 0.0)
    edges = [(min(w[1] for w in c), max(w[3] for w in c)) for c in columns]
    center = lambda w: (w[1] + w[3]) / 2
    over = [[w for w in row if center(w) > edges[0][0] - (edges[0][1] - edges[0][0])] for row in head]
    names = [[min(row, key=lambda w: abs(center(w) - (a + b) / 2))[0] for row in over if row] for a, b in edges]
    for i, row in enumerate(body):
        label = " ".join(w[0] for w in row if w[3] <= edges[0][0])
        for w in row:
            value = figure(w[0])
            at = next((k for k, (a, b) in enumerate(edges) if a <= center(w) <= b), None)
            if value is not None and at is not None:
                yield i, label, at, names[at], value


@udtf(returnType=CELLS)
class Grid:
    """Words of one page in, its cells out."""

    def __init__(self) -> None:
        self.page, self.words = None, []

    def eval(self, row: Row) -> None:
        self.page = row["page"]
        box = [row[c] for c in WORDS[2:]]
        if row["text"] and None not in box:
            x0, top, x1, bottom = map(float, box)
            self.words.append((row["text"], x0, top, x1, bottom))

    def terminate(self) -> Iterator[tuple]:
        for i, label, col, headers, value in cells(self.words):
            yield self.page, i, label, col, headers, value


def recovered(words: DataFrame) -> DataFrame:
    """Words (page string, text, x0, top, x1, bottom) as the cells of each page's table."""
    return Grid(words.select(*WORDS).asTable().partitionBy("page"))
