"""Tables in text: HTML and pipe tables rewritten as one sentence per row."""

from __future__ import annotations

import itertools
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions.formula import mask, unmask

# How tables are recognised.
HTML_TABLE = re.compile(r"<table.*?>.*?</table>", re.IGNORECASE | re.DOTALL)
PIPE_TABLE = re.compile(
    r"((?:^[ \t]*\|.*\|[ \t]*\n)"
    r"(?:^[ \t]*\|[ \t]*[-:]+[-| :]*\|[ \t]*\n)"
    r"(?:^[ \t]*\|.*\|[ \t]*(?:\n|$))*)",
    re.MULTILINE,
)
PIPE_RULE = re.compile(r"^[ \t]*\|[ \t\-|:]+\|[ \t]*$")
# Wording of the sentences and cells that say nothing.
NO_KEY, NO_VALUE, NO_SUBJECT = "未知属性", "无", "未知项目"
EMPTY_CELLS = ("-", "/", "\\", "无")


def _span(given: str | None) -> int:
    """The number at the head of a span attribute; 1 if there is none."""
    number = re.match(r"\s*([0-9]{1,4})", given or "")
    return max(1, int(number[1])) if number else 1


class _Cells(HTMLParser):
    """Cells of one table with their spans; a new cell or row closes the open one."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list[tuple[list[str], int, int]]] = []
        self.headed = False
        self.tables = 0
        self._open = False

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables += 1
        elif tag == "tr":
            self.rows.append([])
            self._open = False
        elif tag in ("td", "th"):
            self.headed |= tag == "th"
            if self.rows:
                given = dict(attrs)
                self.rows[-1].append(([], _span(given.get("rowspan")), _span(given.get("colspan"))))
                self._open = True

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr"):
            self._open = False

    def handle_data(self, data):
        if self._open and data.strip():
            self.rows[-1][-1][0].append(data.strip())


def _html_table(html: str) -> str:
    reader = _Cells()
    reader.feed(html)
    reader.close()
    if not reader.tables or not reader.rows:
        return html
    filled: dict[tuple[int, int], str] = {}
    for r, row in enumerate(reader.rows):
        c = 0
        for texts, down, across in row:
            while (r, c) in filled:
                c += 1
            # A span reaches over rows that the table has, not beyond them.
            below, aside = range(r, min(r + down, len(reader.rows))), range(c, c + across)
            filled |= dict.fromkeys(itertools.product(below, aside), " ".join(texts))
            c += across
    if not any(r == 0 for r, _ in filled):
        return ""
    height = max(len(reader.rows), 1 + max(r for r, _ in filled))
    width = 1 + max(c for _, c in filled)
    grid = [[filled.get((r, c), "") for c in range(width)] for r in range(height)]
    return _sentences(grid, headed=reader.headed)


def _pipe_table(text: str) -> str:
    lines = filter(lambda line: not PIPE_RULE.match(line), text.strip().split("\n"))
    columns = itertools.zip_longest(*(map(str.strip, line.strip("|").split("|")) for line in lines), fillvalue="")
    # zip_longest turned rows into columns once, filled up; turned twice they are rows again.
    turned = list(itertools.zip_longest(*columns, fillvalue=""))
    return _sentences([list(row) for row in turned], headed=True)


def _pair_line(row: list[str]) -> str:
    """A row of a list of keys and values."""
    key, value = row
    return f"- 【{key or NO_KEY}】：{value or NO_VALUE}。" if any(row) else ""


def _record_line(names: list[str], row: list[str]) -> str:
    """A row under a header: its subject and what the header calls its cells."""
    told = [f"{n}为{c}" for n, c in list(zip(names, row))[1:] if c not in EMPTY_CELLS and c]
    about = f"(对应{names[0]})" if names[0] else ""
    if told:
        return f"- 【{row[0] or NO_SUBJECT}】{about}：{'，'.join(told)}。"
    return f"- 【{row[0]}】" if row[0] not in ("", NO_SUBJECT) else ""


def _sentences(grid: list[list[str]], headed: bool) -> str:
    """A sentence for each row. Two columns without any header are keys and values."""
    if not grid or not grid[0]:
        return ""
    if len(grid[0]) == 2 and grid[0][0] and not headed:
        lines = map(_pair_line, grid)
    else:
        first = grid[0][:1] + [name or f"属性{i}" for i, name in enumerate(grid[0][1:], 1)]
        lines = (_record_line(first, row) for row in grid[1:])
    return "\n\n" + "\n".join(filter(None, lines)) + "\n\n"


def linearize(text: str) -> str:
    """HTML tables first, then pipe tables; formulas are left untouched."""
    masked, formulas = mask(text)
    if "<table" in masked.lower():
        masked = HTML_TABLE.sub(lambda m: _html_table(m.group()), masked)
    if "|" in masked:
        masked = PIPE_TABLE.sub(lambda m: _pipe_table(m.group()), masked)
    return unmask(masked, formulas)


@F.pandas_udf(T.StringType())
def _linearized(texts: pd.Series) -> pd.Series:
    return texts.map(lambda text: None if text is None else linearize(text))


def tables_as_sentences(col: Column) -> Column:
    """Only texts that can hold a table are sent to the helper."""
    candidate = col.contains("|") | col.rlike("(?i)<table")
    return F.when(candidate, _linearized(F.when(candidate, col))).otherwise(col)
