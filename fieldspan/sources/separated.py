"""Separated values as records of cells, with quotes as spreadsheets write and read them.

A quote opens a cell only at the cell's start; elsewhere it is a character like any other, so a note of
5" is no harm. Inside a quoted cell a doubled quote is one, separators and line ends are text, and what
follows the closing quote is added to the cell. A quote that is never closed takes the rest of the file.

Whether a line begins inside a quoted cell depends on all lines before it. Each line by itself is a map of that one
question to its answer for the next line: it keeps the answer, turns it round, or fixes it. The maps compose
by running sums and last values, so lines are rows from the start and no task walks through a file.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Separators that are tried.
SEPARATORS = (",", ";", "\t", "|")
#: Lines by which a file's separator is told.
LOOKED_AT = 50
#: Where a character stands: at a cell's start, in a plain cell, in a quoted one, after a quote in one.
START, PLAIN, QUOTED, QUOTE = range(4)
#: Stands between cells once quotes are read; the control character is not expected in a cell.
_CUT = "\x01"


def separator(lines: Column) -> Column:
    """The separator that most of the first lines have as often as the first one; of equal ones the one it has more of."""
    sample = F.slice(F.filter(lines, lambda x: F.trim(x) != ""), 1, LOOKED_AT)

    def one(i: int, s: str) -> Column:
        times = F.transform(sample, lambda x: F.length(x) - F.length(F.replace(x, F.lit(s), F.lit(""))))
        head = F.coalesce(F.get(times, F.lit(0)), F.lit(0))
        alike = F.when(head > 0, F.size(F.filter(times, lambda n: n == head))).otherwise(0)
        return F.struct(alike.alias("alike"), head.alias("head"), F.lit(-i).alias("i"), F.lit(s).alias("sep"))

    return F.greatest(*(one(i, s) for i, s in enumerate(SEPARATORS)))["sep"]


def _after_text(state: Column, text: Column, sep: Column) -> Column:
    return F.when((text == "") | (state == QUOTED), state).when(F.endswith(text, sep), F.lit(START)).otherwise(F.lit(PLAIN))


def _after_quote(state: Column) -> Column:
    return F.when(state == START, QUOTED).when(state == QUOTED, QUOTE).when(state == QUOTE, QUOTED).otherwise(state)


def _ends_quoted(line: Column, sep: Column, begins_quoted: bool) -> Column:
    """Whether the end of ``line`` lies in a quoted cell."""
    pieces = F.split(line, '"', -1)  # quotes stand between them
    first = _after_text(F.lit(QUOTED if begins_quoted else START), F.get(pieces, F.lit(0)), sep)
    last = F.aggregate(F.slice(pieces, F.lit(2), F.size(pieces)), first, lambda state, text: _after_text(_after_quote(state), text, sep))
    return F.when(F.contains(line, F.lit('"')), last == QUOTED).otherwise(F.lit(begins_quoted))


def _unquoted(record: Column, sep: Column) -> Column:
    """The cells of a record that has quotes."""
    pieces = F.split(record, '"', -1)
    shown = lambda state, text: F.when(state == QUOTED, text).otherwise(F.replace(text, sep, F.lit(_CUT)))

    def step(a: Column, text: Column) -> Column:
        state = _after_quote(a["state"])
        sign = F.when(a["state"].isin(PLAIN, QUOTE), F.lit('"')).otherwise(F.lit(""))  # a plain character, or a doubled quote
        return F.struct(_after_text(state, text, sep).alias("state"), F.concat(a["out"], sign, shown(state, text)).alias("out"))

    head = F.get(pieces, F.lit(0))
    begin = F.struct(_after_text(F.lit(START), head, sep).alias("state"), shown(F.lit(START), head).alias("out"))
    return F.split(F.aggregate(F.slice(pieces, F.lit(2), F.size(pieces)), begin, step, lambda a: a["out"]), _CUT, -1)


def records(files: DataFrame, about: Callable[[Column], Column] | None = None) -> DataFrame:
    """path, n (from 0: the header), cells (array of string): the records of each file (path, content) that are no blank lines.

    ``about``: adds a column ``at``, what it makes of the header's cells. A file without a quote has a record a line, so its
    lines need not meet again: only files with quotes are gone through by windows.
    """
    lines = F.split("content", "\r\n|\r|\n", -1)
    split = files.select("path", lines.alias("lines"), F.contains("content", F.lit('"')).alias("has_quotes")).withColumn("sep", separator(F.col("lines")))
    return _plain(split.where("not has_quotes"), about).union(_quoted(split.where("has_quotes"), about))


def _plain(split: DataFrame, about: Callable[[Column], Column] | None) -> DataFrame:
    """The records of files (path, lines, sep) without quotes."""
    cells = lambda line: F.split(F.replace(line, F.col("sep"), F.lit(_CUT)), _CUT, -1)
    filled = split.select("path", "sep", F.filter("lines", lambda x: F.trim(x) != "").alias("lines"))
    at = [about(cells(F.get("lines", F.lit(0)))).alias("at")] if about else []
    each = filled.select("path", "sep", "lines", *at).select("path", "sep", *(["at"] if about else []), F.posexplode("lines").alias("n", "line"))
    return each.select("path", "n", cells(F.col("line")).alias("cells"), *(["at"] if about else []))


def _quoted(split: DataFrame, about: Callable[[Column], Column] | None) -> DataFrame:
    """The records of any files (path, lines, sep)."""
    each = split.select("path", "sep", F.posexplode("lines").alias("i", "line"))
    line, sep = F.col("line"), F.col("sep")
    each = each.withColumns({"plain": _ends_quoted(line, sep, False), "quoted": _ends_quoted(line, sep, True)})

    order = Window.partitionBy("path").orderBy("i")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    fixes, turns = F.col("plain") == F.col("quoted"), F.col("plain") & ~F.col("quoted")
    each = each.withColumn("turned", F.sum(turns.cast("int")).over(order))
    since = F.last(F.when(fixes, F.struct("plain", "turned")), ignorenulls=True).over(before)
    each = each.withColumns({"fixed": since, "all_turned": F.lag("turned").over(order)})
    begun = F.coalesce(F.col("fixed.plain").cast("int"), F.lit(0)) + F.coalesce("all_turned", F.lit(0)) - F.coalesce("fixed.turned", F.lit(0))
    each = each.withColumn("begins", (F.pmod(begun, F.lit(2)) == 0).cast("int")).withColumn("record", F.sum("begins").over(order))

    whole = each.groupBy("path", "sep", "record").agg(F.sort_array(F.collect_list(F.struct("i", "line"))).alias("ls"))
    text = whole.select("path", "sep", "record", F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("text")).where(F.trim("text") != "")
    cells = F.when(F.contains("text", F.lit('"')), _unquoted(F.col("text"), sep)).otherwise(F.split(F.replace("text", sep, F.lit(_CUT)), _CUT, -1))
    out = text.select("path", (F.row_number().over(Window.partitionBy("path").orderBy("record")) - 1).alias("n"), cells.alias("cells"))
    if about is None:
        return out
    return out.withColumn("at", F.first(F.when(F.col("n") == 0, about(F.col("cells")))).over(Window.partitionBy("path").orderBy("n")))
