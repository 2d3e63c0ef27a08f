"""Lines of delimited text: those that parse are loaded, the others come out with the reason.

A line is read by a minimum-cost parse. It is a dynamic program over the line's tokens (quote, delimiter, run of other
characters) whose cells are the states of a reader of quoted fields (at a field's start, in a plain field, inside quotes,
behind a quote that may close the field) by the number of fields closed so far. Reading a token as the format has it
costs nothing. Four edits have a cost: inserting or deleting a quote, and inserting a delimiter (an empty field) or
deleting one (two fields become one). The parse ends with exactly the feed's number of fields. Quote edits weigh more
than any number of delimiter edits, and delimiters are only edited between whole fields, so that neither kind can stand
in for the other. A line of cost zero with valid values is loaded; of the others the edits are the reason: quote edits
mean `quoting`, delimiter edits alone `column_count`; without edits a value is at fault (`invalid_value`).

In a line without a quote no quote edit can lower the cost, so its cheapest parse is the difference between its number of
fields and the feed's, which is computed in the JVM. Only lines that hold a quote go to Python, where the program runs
over all lines of a batch at once; values are checked in the JVM.

Lines are taken without the carriage returns and line feeds at their end. A null line has no field, an empty line one.
A feed that isn't known (or null) has no columns: its lines fail by column_count (unless by quoting).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

_SPACE = r"\s\x{1c}-\x{1f}\x{85}\p{Z}"


def valid_loc(value: Column) -> Column:
    port = F.regexp_extract(value, r"(?i)^https?://[a-z0-9.\-]+:0*([0-9]*)", 1)
    shape = rf"\A(?i:https?://[a-z0-9.\-]+)(?::[0-9]+)?(?:[/?#][^{_SPACE}]*)?\z"
    return value.rlike(shape) & ((F.length(port) <= 4) | ((F.length(port) == 5) & (port <= "65535")))


def valid_pattern(value: Column) -> Column:
    return F.instr(value, "$").isin(0) | (F.instr(value, "$") == F.length(value))


def valid_delay(value: Column) -> Column:
    number = F.when(value.rlike(r"\A[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"), value.try_cast("double"))
    return (value == "") | F.coalesce((number >= 0) & (number < float("inf")), F.lit(False))


#: feed -> its columns, and the checks of some of them.
FEEDS = {
    "entry": (["loc", "lastmod", "priority", "changefreq"], {"loc": valid_loc}),
    "rule": (["robots_id", "agent", "pattern", "allow"], {"pattern": valid_pattern}),
    "delay": (["robots_id", "agent", "crawl_delay"], {"crawl_delay": valid_delay}),
}

_CELL = r'(?:"[^"]*(?:""[^"]*)*"|[^",]*)'
_CLEAN = re.compile(rf"{_CELL}(?:,{_CELL})*")
_FIELD = re.compile(rf",({_CELL})")
_START, _PLAIN, _INSIDE, _BEHIND = range(4)
_QUOTE, _COMMA, _OTHER, _NONE = range(4)
_WEIGHT, _FAR = 1 << 24, 1 << 50  # a quote edit against a delimiter edit; what can't be reached
_CELLS = 8_000_000  # of the table of one block of lines


def _tokens(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kinds of all tokens, the character each begins at, and where each line's tokens begin (and the last end)."""
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(x) for x in lines], np.int64)
    ends = np.cumsum(sizes)
    kinds = np.full(len(codes), _OTHER, np.int8)
    kinds[codes == ord('"')], kinds[codes == ord(",")] = _QUOTE, _COMMA
    opens = np.ones(len(codes), bool)
    opens[1:] = (kinds[1:] != _OTHER) | (kinds[:-1] != _OTHER)
    opens[ends[sizes > 0] - sizes[sizes > 0]] = True
    at = np.flatnonzero(opens)
    begins = np.append(np.searchsorted(at, ends - sizes), len(at))
    return kinds[at], at - np.repeat(ends - sizes, np.diff(begins)), begins


class _Table:
    """The cheapest way into each cell (line, state, fields closed), and for each step the way it came."""

    _STEPS = ["", "insert quote", "delete quote", "insert delimiter", "delete delimiter"]

    def __init__(self, n: int, columns: int):
        self.cost = np.full((n, 4, columns), _FAR, np.int64)
        self.cost[:, _START, 0] = 0
        self.came: list[tuple[np.ndarray, int]] = []  # per step: (from state * columns + fields) * 8 + edit; the token, or -1 between tokens
        self.columns = columns

    def own(self) -> np.ndarray:
        return np.broadcast_to((np.arange(4 * self.columns, dtype=np.int32).reshape(4, self.columns) * 8)[None], self.cost.shape).copy()

    def between(self) -> None:
        """Edits that read no token: an empty field at a field's start, quotes. Two rounds reach all that pays."""
        for _ in range(2):
            came, new = self.own(), self.cost.copy()
            for a, b in ((_START, _INSIDE), (_INSIDE, _BEHIND), (_BEHIND, _INSIDE)):
                self._offer(new, came, a, b, 0, _WEIGHT, 1)
            self._close(came, new)
        for _ in range(self.columns - 1):
            came, new = self.own(), self.cost.copy()
            self._offer(new, came, _START, _START, 1, 1, 3)
            if not (new < self.cost).any():
                break
            self._close(came, new)

    def _close(self, came: np.ndarray, new: np.ndarray) -> None:
        self.cost = new
        self.came.append((came, -1))

    def _offer(self, new, came, a: int, b: int, more: int, price: int, edit: int, rows=None) -> None:
        c = self.columns
        old = self.cost[:, a, : c - more] if more else self.cost[:, a]
        to = new[:, b, more:]
        better = old + price < to
        if rows is not None:
            better &= rows[:, None]
        if better.any():
            np.copyto(to, old + price, where=better)
            np.copyto(came[:, b, more:], ((a * c + np.arange(c - more, dtype=np.int32)) * 8 + edit)[None], where=better)

    def read(self, kinds: np.ndarray, token: int) -> None:
        new, came = np.full_like(self.cost, _FAR), self.own()
        none = kinds == _NONE  # the line has ended
        new[none] = self.cost[none]
        quote, comma, other = kinds == _QUOTE, kinds == _COMMA, kinds == _OTHER
        for a, b in ((_START, _INSIDE), (_INSIDE, _BEHIND), (_BEHIND, _INSIDE)):
            self._offer(new, came, a, b, 0, 0, 0, quote)
        for a in range(4):
            self._offer(new, came, a, a, 0, _WEIGHT, 2, quote)
        for a in (_START, _PLAIN, _BEHIND):
            self._offer(new, came, a, _START, 1, 0, 0, comma)
            self._offer(new, came, a, _START, 0, 1, 4, comma)
        self._offer(new, came, _START, _PLAIN, 0, 0, 0, other)
        self._offer(new, came, _PLAIN, _PLAIN, 0, 0, 0, other)
        self._offer(new, came, _INSIDE, _INSIDE, 0, 0, 0, comma | other)
        self.cost = new
        self.came.append((came, token))

    def operations(self, line: int, state: int, fields: int, places: np.ndarray, length: int) -> list[str]:
        cell, out, token = state * self.columns + fields, [], len(places)
        for came, read in reversed(self.came):
            if read >= 0:
                token = read
            way = int(came[line].reshape(-1)[cell])
            cell, edit = way >> 3, way & 7
            if edit:
                out.append(f"{self._STEPS[edit]} at {places[token] if token < len(places) else length}")
        return out[::-1]


def cheapest_parses(lines: list[str], columns: int) -> Iterator[tuple[int, int, list[str]]]:
    """Quote edits, delimiter edits and the edit operations of the cheapest reading of each line as so many columns (1 or more)."""
    kinds, places, begins = _tokens(lines)
    counts = np.diff(begins)
    order = np.argsort(counts, kind="stable")
    result: list = [None] * len(lines)
    first = 0
    while first < len(lines):  # lines of like length together; a line that is longer than a block is a block of its own
        last = first + 1
        while last < len(lines) and (last + 1 - first) * (int(counts[order[last]]) + 1) * 4 * columns * 3 <= _CELLS:
            last += 1
        block = order[first:last]
        table, most = _Table(len(block), columns), int(counts[block[-1]])
        for t in range(most):
            table.between()
            now = np.full(len(block), _NONE, np.int8)
            live = counts[block] > t
            now[live] = kinds[begins[:-1][block[live]] + t]
            table.read(now, t)
        table.between()
        ends = table.cost[:, :, columns - 1].copy()
        ends[:, _INSIDE] = _FAR
        state = ends.argmin(1)
        cost = ends[np.arange(len(block)), state]
        # fields that are missing at the end, behind a plain or quoted field: they are empty ones after a delimiter
        for short in range(1, columns):
            less = table.cost[:, :, columns - 1 - short].copy() + short
            less[:, _INSIDE] = _FAR
            best = less.argmin(1)
            better = less[np.arange(len(block)), best] <= cost  # rather at the end
            cost = np.where(better, less[np.arange(len(block)), best], cost)
            state = np.where(better, best + 4 * short, state)
        for k, i in enumerate(block):
            if cost[k] == 0:
                result[i] = (0, 0, [])
                continue
            short, at = divmod(int(state[k]), 4)
            operations = table.operations(k, at, columns - 1 - short, places[begins[i] : begins[i + 1]], len(lines[i]))
            result[i] = (int(cost[k] // _WEIGHT), int(cost[k] % _WEIGHT), operations + [f"insert delimiter at {len(lines[i])}"] * short)
        first = last
    yield from result


def cheapest_parse(line: str, columns: int) -> tuple[int, int, list[str]]:
    return next(cheapest_parses([line], columns))


def fields_of(line: str) -> list[str] | None:
    """The fields of a line that needs no quote edit (such a line has one reading only); None if it needs one."""
    if _CLEAN.fullmatch(line) is None:
        return None
    return [f[1:-1].replace('""', '"') if f.startswith('"') else f for f in _FIELD.findall("," + line)]


_PARSE = StructType().add("quotes", IntegerType()).add("delimiters", IntegerType()).add("detail", StringType()).add("fields", ArrayType(StringType()))


@F.pandas_udf(_PARSE)
def _parsed(lines: pd.Series, columns: pd.Series) -> pd.DataFrame:
    """Null lines (those the JVM reads itself) are left alone. A line of no cost loads; the program prices all others."""
    n = len(lines)
    quotes, delimiters = pd.array([pd.NA] * n, "Int32"), pd.array([pd.NA] * n, "Int32")
    detail, fields = np.full(n, None, object), np.full(n, None, object)
    there = np.flatnonzero(lines.notna().to_numpy())
    text, width = lines.to_numpy(object), columns.to_numpy()
    for i in there:
        found = fields_of(text[i])
        if found is not None and len(found) == width[i]:
            quotes[i], delimiters[i], fields[i] = 0, 0, found  # a parse of cost zero
    rest = there[[fields[i] is None for i in there]]
    for c in np.unique(width[rest]):
        rows = rest[width[rest] == c]
        for i, (q, d, operations) in zip(rows, cheapest_parses(list(text[rows]), int(c)), strict=True):
            quotes[i], delimiters[i], detail[i] = q, d, "; ".join(operations)
    return pd.DataFrame({"quotes": quotes, "delimiters": delimiters, "detail": detail, "fields": fields})


_parsed = _parsed.asNondeterministic()  # so that a filter on the result doesn't repeat it


def _read(df: DataFrame, feed: str, line: str) -> DataFrame:
    """df with _fields (null where edits are needed), _reason and _detail."""
    width = F.lit(0)
    for name, (columns, _) in FEEDS.items():
        width = F.when(F.col(feed) == name, len(columns)).otherwise(width)
    text = F.regexp_replace(line, r"[\r\n]+\z", "")
    rows = df.withColumns({"_text": text, "_width": width})
    quoted = F.contains("_text", F.lit('"'))
    rows = rows.withColumn("_parsed", _parsed(F.when(quoted, F.col("_text")), F.greatest("_width", F.lit(1))))
    plain = F.when(~quoted, F.split("_text", ",", -1))
    gap = F.size(plain) - F.col("_width")
    counted = F.concat(F.when(gap > 0, "delete ").otherwise("insert "), F.abs(gap).cast("string"), F.when(F.abs(gap) > 1, " delimiters").otherwise(" delimiter"))
    rows = rows.withColumn("_fields", F.when(F.col("_width") == 0, None).when(quoted, F.col("_parsed.fields")).otherwise(F.when(gap == 0, plain)))
    fault = F.lit(None).cast("string")
    for name, (columns, checks) in FEEDS.items():
        for column, check in checks.items():
            fault = F.when((F.col(feed) == name) & ~check(F.get("_fields", F.lit(columns.index(column)))), column).otherwise(fault)
    reason = F.when(F.col("_parsed.quotes") > 0, "quoting").when(F.col("_fields").isNull(), "column_count").when(F.col("_fault").isNotNull(), "invalid_value")
    edits = F.when(F.col("_text").isNull(), "no line").when(F.col("_width") == 0, F.coalesce("_parsed.detail", F.lit("no such feed"))).when(quoted, F.col("_parsed.detail")).otherwise(counted)
    rows = rows.withColumn("_fault", fault)
    return rows.withColumns({"_reason": reason, "_detail": F.when(F.col("_fields").isNull(), edits).otherwise(F.col("_fault"))})


def failed_lines(df: DataFrame, feed: str = "feed", line: str = "line") -> DataFrame:
    """The rows of df whose line fails, with reason and detail (the edit operations, or the column at fault).

    Columns of df called reason or detail are replaced; names that begin with an underscore are reserved."""
    rest = [c for c in df.columns if c not in ("reason", "detail")]
    return _read(df, feed, line).where("_reason is not null").select(*rest, F.col("_reason").alias("reason"), F.col("_detail").alias("detail"))


def loaded_lines(df: DataFrame, name: str, id_col: str = "line_id", feed: str = "feed", line: str = "line", keep: tuple[str, ...] = ()) -> DataFrame:
    """id_col, the columns to keep and those of the feed `name` of each of its lines that parses and is valid. Values are text."""
    rows = _read(df.where(F.col(feed) == name).select(id_col, feed, line, *keep), feed, line).where("_reason is null")
    return rows.select(id_col, *keep, *[F.element_at("_fields", i).alias(c) for i, c in enumerate(FEEDS[name][0], 1)])
