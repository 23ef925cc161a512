"""Lines of a page from positioned words, and their texts and bounds.

A page's words are folded in reading order; everything is keyed by (file_id, page), so a huge statement
is spread over its pages. line_no orders a file's lines.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reconcilia.functions.text import word_text

#: line_no = page * LINES + place on the page.
LINES = 100_000
LEAST_TOLERANCE = 3.5
HEIGHT_SHARE = 0.45
ANCHOR_TOLERANCE = 3.0


def number(column: str, default: float = 0.0) -> Column:
    """A coordinate that may come as a text, be missing or be no number."""
    return F.coalesce(F.nanvl(F.col(column).try_cast("double"), F.lit(None).cast("double")), F.lit(default))


def far_edge(column: str, near: str) -> Column:
    """A right or lower edge; where it is missing, the other one."""
    return F.when(F.col(column).isNull(), number(near)).otherwise(number(column))


def right() -> Column:
    return far_edge("x1", "x0")


def bottom() -> Column:
    return far_edge("bottom", "top")


def center_x() -> Column:
    return (number("x0") + right()) / 2


def center_y() -> Column:
    return (number("top") + bottom()) / 2


def height() -> Column:
    return F.abs(bottom() - number("top"))


def line_tolerance(words: DataFrame) -> DataFrame:
    """file_id, tolerance: from the upper median of the heights above 0 in the whole document.

    Words are counted by height first; a document has few heights, however many words it has.
    """
    counted = words.groupBy("file_id", height().alias("_h")).agg(F.count("*").alias("_n"))
    file = Window.partitionBy("file_id")
    above = F.when(F.col("_h") > 0, F.col("_n")).otherwise(0)
    counted = counted.withColumns({"_upto": F.sum(above).over(file.orderBy("_h")), "_all": F.sum(above).over(file)})
    median = F.min(F.when((F.col("_h") > 0) & (F.col("_upto") > F.floor(F.col("_all") / 2)), F.col("_h")))
    return counted.groupBy("file_id").agg(F.greatest(F.lit(LEAST_TOLERANCE), HEIGHT_SHARE * F.coalesce(median, F.lit(0.0))).alias("tolerance"))


def line_starts(page: np.ndarray, y: np.ndarray, tolerance: np.ndarray, running_mean: bool) -> np.ndarray:
    """Which of the ordered words start a line; ``page`` marks each page's first word.

    A gap above the tolerance always starts a line where ``y`` rises. What lies between two gaps is one
    line if it is no wider than the tolerance; only wider stretches are gone through word by word.
    """
    before = np.append(y[:1], y[:-1])
    falls = ~page & (y < before)
    whole = np.maximum.reduceat(falls, np.flatnonzero(page)) if len(y) else falls
    unordered = np.repeat(whole, np.diff(np.append(np.flatnonzero(page), len(y))))
    starts = page | (~unordered & (y - before > tolerance))
    first = np.flatnonzero(starts)
    size = np.diff(np.append(first, len(y)))
    wide = (y - np.repeat(y[first], size) > tolerance - 1e-9) | unordered
    for k in np.flatnonzero(np.maximum.reduceat(wide, first)) if len(first) else ():
        total, n, level = 0.0, 0, 0.0
        for i in range(first[k], first[k] + size[k]):
            if n and abs(y[i] - level) > tolerance[i]:
                starts[i], total, n = True, 0.0, 0
            total, n = total + y[i], n + 1
            level = total / n if running_mean or n == 1 else level
    return starts


def numbers_of(values: pa.Array) -> np.ndarray:
    """Nulls are NaN."""
    return values.to_numpy(zero_copy_only=False)


def sizes(lists: pa.Array) -> np.ndarray:
    return numbers_of(lists.value_lengths().fill_null(0)).astype(np.int64)


def _places(size: np.ndarray, y: np.ndarray, tolerance: pa.Array, running_mean: pa.Array) -> np.ndarray:
    """The line (1, 2, ...) within its page of each word; pages of ``size`` words follow each other, their words in order."""
    limit, mean = np.repeat(numbers_of(tolerance), size), np.repeat(numbers_of(running_mean), size)
    first = np.zeros(len(y), bool)
    first[(np.cumsum(size) - size)[size > 0]] = True
    starts = np.zeros(len(y), bool)
    for rule in (False, True):
        mine = mean == rule
        if mine.any():
            starts[mine] = line_starts(first[mine], y[mine], limit[mine], rule)
    place = np.cumsum(starts)
    if len(y):
        place -= np.repeat(place[first] - 1, size[size > 0])
    return place.astype(np.int32)


def listed(size: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.array(values))


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def line_places(y: pa.Array, tolerance: pa.Array, running_mean: pa.Array) -> pa.Array:
    """For each page the line (1, 2, ...) of each of its ordered words. Only numbers come to Python; texts stay where they are."""
    size = sizes(y)
    return listed(size, _places(size, numbers_of(y.flatten()), tolerance, running_mean))


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def word_places(order: pa.Array, top: pa.Array, bottom: pa.Array, tolerance: pa.Array, running_mean: pa.Array) -> pa.Array:
    """The same for words in order of x0, as page rows have them: they are put in ``order`` here, and the line of each is given at its own place."""
    size, y = sizes(top), (numbers_of(top.flatten()) + numbers_of(bottom.flatten())) / 2
    by = np.lexsort((numbers_of(order.flatten()), np.repeat(np.arange(len(size)), size)))
    place = np.empty(len(y), np.int32)
    place[by] = _places(size, y[by], tolerance, running_mean)
    return listed(size, place)


def page_rows(words: DataFrame, *constants: str, clean: Column | None = None, marks: Column | None = None) -> DataFrame:
    """file_id, page, words, and columns that are constant on a page: the one exchange of all words that lines need.

    The words of a page are an array of (x0, seq, text, x1, top, bottom, doctop, clean text) in order of x0, with defaults for coordinates
    that are missing or no numbers; every line rule, column and cut works inside such a row from then on. ``marks``: what is known of a word
    by its text, as a number, found once while words are rows; ``clean`` where it isn't the text without odd white space.
    """
    said = word_text(F.col("text")) if clean is None else clean
    word = F.struct(number("x0").alias("x0"), "seq", "text", right().alias("x1"), number("top").alias("top"), bottom().alias("bottom"), number("doctop").alias("doctop"), said.alias("clean"), *([] if marks is None else [marks.alias("marks")]))
    # made before the grouping, which would make it by interpreted expressions
    return words.select("file_id", "page", *constants, word.alias("_w")).groupBy("file_id", "page").agg(F.sort_array(F.collect_list("_w")).alias("words"), *(F.first(c).alias(c) for c in constants))


def middle(word: Column) -> Column:
    return (word["top"] + word["bottom"]) / 2


def line_rows(pages: DataFrame, order: Callable[[Column], Column], level: Callable[[Column], Column], tolerance: Column, running_mean: Column) -> DataFrame:
    """A row for each line: file_id, page, line_no, words by x0, and the pages' other columns.

    A page's words go by ``order``, then x0 and seq; ``level`` is what the rule compares.
    """
    others = [c for c in pages.columns if c != "words"]
    ordered = F.transform(F.sort_array(F.transform("words", lambda w: F.struct(order(w).alias("k"), w.alias("w")))), lambda x: x["w"])
    placed = pages.withColumn("words", ordered).withColumn("_p", line_places(F.transform("words", level), tolerance.cast("double"), running_mean))
    firsts = F.filter(F.transform("_p", lambda p, i: F.when((i == 0) | (p != F.get("_p", i - 1)), i)), lambda i: i.isNotNull())
    cut = placed.withColumn("_f", firsts)
    pieces = F.transform("_f", lambda a, i: F.sort_array(F.slice("words", a + 1, F.coalesce(F.get("_f", i + 1), F.size("words")) - a)))
    rows = cut.select(*others, F.posexplode(pieces).alias("_i", "words"))
    return rows.withColumn("line_no", F.col("page").cast("long") * LINES + F.col("_i") + 1).drop("_i")


def numbered(words: DataFrame, by: Column, tolerance: Column, running_mean: bool, order: list[Column] | None = None) -> DataFrame:
    """``words`` with line_no. A word starts a line if its ``by`` is further than ``tolerance`` from the line's.

    The line's value is that of its first word or, with ``running_mean``, the mean of its words so far. That fold has no
    built-in form; it runs over the numbers of whole pages, and each page is put together by one exchange.
    """
    keys, columns = order or [by, number("x0")], words.columns
    row = F.struct(*(k.alias(f"_k{i}") for i, k in enumerate(keys)), F.col("seq").alias("_s"), by.alias("_y"), F.struct(*columns).alias("_w"))
    made = words.select("file_id", "page", row.alias("_r"), tolerance.cast("double").alias("_t"))  # before the grouping, as there
    pages = made.groupBy("file_id", "page").agg(F.sort_array(F.collect_list("_r")).alias("_r"), F.max("_t").alias("_t"))
    placed = pages.withColumn("_p", line_places(F.transform("_r", lambda r: r["_y"]), F.col("_t"), F.lit(running_mean)))
    # file_id and page stay the columns that words were grouped by, so what groups lines next needs no other exchange
    each = placed.select("file_id", "page", F.explode(F.arrays_zip(F.transform("_r", lambda r: r["_w"]).alias("w"), F.col("_p").alias("p"))).alias("x"))
    return each.select(*(c if c in ("file_id", "page") else f"x.w.{c}" for c in columns), (F.col("page").cast("long") * LINES + F.col("x.p")).alias("line_no"))


def texts(words: Column, where: Callable[[Column], Column] | None = None, separator: str = " ") -> Column:
    """Texts of an array of words in its order, joined; none of them may be empty."""
    some = F.filter(words, where) if where else words
    return F.array_join(F.transform(some, lambda w: w["text"]), separator)


def page_tolerance(pages: DataFrame) -> DataFrame:
    """``line_tolerance`` from page rows."""
    return line_tolerance(pages.select("file_id", F.inline(F.arrays_zip(F.col("words.top").alias("top"), F.col("words.bottom").alias("bottom")))))


def anchored_lines(words: DataFrame, tolerance: float = ANCHOR_TOLERANCE) -> DataFrame:
    """Against the top of the line's first word."""
    return numbered(words, number("top"), F.lit(tolerance), False)


def mean_lines(words: DataFrame, tolerance: DataFrame | None = None) -> DataFrame:
    """Against the mean centre of the line, with a tolerance by the document's median word height (or as given by file_id)."""
    with_limit = words.join(line_tolerance(words) if tolerance is None else tolerance, "file_id")
    return numbered(with_limit, center_y(), F.col("tolerance"), True).drop("tolerance")


def fixed_mean_lines(words: DataFrame, by_doctop: bool = False, tolerance: float = LEAST_TOLERANCE) -> DataFrame:
    """The running mean with a fixed tolerance, in order of centre or, ``by_doctop``, of place in the document."""
    order = [number("doctop"), number("x0")] if by_doctop else None
    return numbered(words, center_y(), F.lit(tolerance), True, order)


def joined_texts(where: Column | None = None, text: Column | None = None, keys: tuple[str, ...] = ("x0", "seq"), separator: str = " ") -> Column:
    """Aggregate: non-empty texts by ``keys``, joined; only rows ``where`` holds."""
    value = word_text(F.col("text")) if text is None else text
    ok = (value != "") if where is None else where & (value != "")
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.when(ok, F.struct(*keys, value.alias("_v"))))), lambda x: x["_v"]), separator)


def line_texts(words: DataFrame) -> DataFrame:
    """file_id, page, line_no, text with the line's bounds."""
    return words.groupBy("file_id", "page", "line_no").agg(
        joined_texts().alias("text"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("top").alias("top"), F.max("bottom").alias("bottom"),
        F.min("doctop").alias("doctop"), F.max("doctop").alias("doctop_max"), F.count("*").alias("n_words"),
    ).withColumns({"width": F.col("x1") - F.col("x0"), "center_x": center_x()})


def page_bounds(words: DataFrame) -> DataFrame:
    return words.groupBy("file_id", "page").agg(F.min("x0").alias("page_xmin"), F.max("x1").alias("page_xmax"))
