"""Movements of all banks in one plan: trimmed page rows, lines, column texts, segmentation by start lines, amounts and enrichment.

What differs between banks is in the rows of ``rules`` and ``columns`` (see ``sources.layouts``). Words meet once by page; lines are
cut, and their columns read, for a batch of page rows at once. Blocks are numbered in two levels: within a page, and by what the pages before hold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reconcilia.functions import concepts
from reconcilia.functions import money as m
from reconcilia.functions.dates import PREFIX, date_prefix, is_day_month, without_date_prefix
from reconcilia.functions.text import found, word_text, word_upper
from reconcilia.operators import trimming
from reconcilia.operators.lines import ANCHOR_TOLERANCE, LINES, listed, numbers_of, sizes, center_x, middle, number, page_rows, page_tolerance, word_places
from reconcilia.sources.layouts import BUILT_IN, ROLES, Layouts
from reconcilia.storage import saved

# Tolerance of the second layout's columns, and the titles of its table.
BANAMEX_SLACK = 6.0
HEADER_NAMES = ["FECHA", "CONCEPTO", "RETIROS", "DEPOSITOS", "SALDO"]
MOVEMENT = [
    "fecha_operacion", "fecha_liquidacion", "concepto", "tipo_operacion", "cargo", "abono", "saldo_operacion", "saldo_liquidacion", "referencia",
    "autorizacion", "beneficiario", "cuenta_beneficiario", "clabe_beneficiario", "rfc", "sucursal", "caja", "hora_operacion", "concepto_original",
]
MONEY_ROLES = ["cargo", "abono", "saldo_operacion", "saldo_liquidacion"]
#: Pages whose counts are summed before the sums of the chunks are.
CHUNK = 1024


def in_column(name: str, slack: float = 0.0) -> Column:
    """Centre within a column's bounds."""
    return center_x().between(F.col(f"{name}.xmin") - slack, F.col(f"{name}.xmax") + slack)


def overlaps(name: str) -> Column:
    return F.least("x1", F.col(f"{name}.xmax")) > F.greatest("x0", F.col(f"{name}.xmin"))


def right_edge_in(name: str) -> Column:
    return F.col("x1").between(F.col(f"{name}.xmin"), F.col(f"{name}.xmax"))


# --- numbering over pages ---------------------------------------------------------------------------


def page_offsets(counts: DataFrame) -> DataFrame:
    """file_id, page, _before: the sum of n over the file's earlier pages, from file_id, page, n.

    Pages are summed in chunks, and chunks over the file, so that not even a file of very many pages meets in one task.
    """
    chunked = counts.withColumn("_chunk", F.floor(F.col("page") / CHUNK))
    earlier = lambda *by: Window.partitionBy("file_id", *by).rowsBetween(Window.unboundedPreceding, -1)
    sums = chunked.groupBy("file_id", "_chunk").agg(F.sum("n").alias("_n"))
    sums = sums.select("file_id", "_chunk", F.coalesce(F.sum("_n").over(earlier().orderBy("_chunk")), F.lit(0)).alias("_upto"))
    inside = chunked.withColumn("_inside", F.coalesce(F.sum("n").over(earlier("_chunk").orderBy("page")), F.lit(0)))
    return inside.join(sums, ["file_id", "_chunk"]).select("file_id", "page", (F.col("_upto") + F.col("_inside")).alias("_before"))


def counted_on(rows: DataFrame, flag: Column, order: str, name: str) -> DataFrame:
    """``rows`` (a saved table) with the running count of flagged rows of their file: within the page, and on from the pages before."""
    counts = rows.groupBy("file_id", "page").agg(F.count_if(flag).alias("n"))
    inside = rows.withColumn(name, F.sum(flag.cast("long")).over(Window.partitionBy("file_id", "page").orderBy(order)))
    return inside.join(page_offsets(counts), ["file_id", "page"]).withColumn(name, F.col(name) + F.col("_before")).drop("_before")


def blocks(lines: DataFrame, is_start: Column) -> DataFrame:
    """``lines`` (a saved table) with block_id: a block starts at each start line; lines before the first go."""
    return counted_on(lines, F.coalesce(is_start, F.lit(False)), "line_no", "block_id").where("block_id > 0")


# --- page rows --------------------------------------------------------------------------------------


def ruled(df: DataFrame, known: Layouts) -> DataFrame:
    """``df`` (with bank_key) with its bank's rules as the struct r."""
    rules = known.frame(df.sparkSession, "rules")
    return df.join(F.broadcast(rules.select("bank_key", F.struct(*(c for c in rules.columns if c != "bank_key")).alias("r"))), "bank_key")


def trimmed_words(words: DataFrame, known: Layouts) -> DataFrame:
    """Words of all banks without what their rules take out by marker words, then by place; with the rules as r."""
    special = {"end_marker": trimming.trimmed_bbva, "chart": trimming.without_chart}
    named = {kind: known.banks_where(trim=kind) for kind in special}
    of = lambda banks: words.where(F.col("bank_key").isin(*banks))
    others = [b["bank_key"] for b in known.rows["rules"] if b["trim"] not in special]
    parts = ([of(others)] if others else []) + [special[kind](of(banks)) for kind, banks in named.items() if banks]
    kept, top = ruled(reduce(DataFrame.unionByName, parts), known), number("top")
    gone = top.between(F.col("r.drop_from"), F.col("r.drop_to")) | (top >= F.col("r.below"))
    return kept.where(~F.coalesce(gone, F.lit(False)))


#: What columns need to know of a word's text, in its marks behind the bits of ``trimming``: a date's start, an amount, the place of a title among the
#: rules' (from bit 8) and of a column's name (from bit 20).
PREFIXED, MONEY = 32, 64
TITLE, HEAD = 2**8, 2**20


def marked_words(words: DataFrame, known: Layouts) -> DataFrame:
    """``words`` with the text that their rules read, its clean form where cuts need it, and marks: each pattern meets a word once, while it is a row."""
    rules, r = known.rows["rules"], "r.trim"
    clean, sectioned = word_text(F.col("text")), F.coalesce(F.col(r) == "last_section", F.lit(False))
    said = words.withColumn("_clean", clean).withColumn("text", F.when(F.col("r.text_rule") == "trim", F.coalesce(F.trim("text"), F.lit(""))).otherwise(F.col("_clean")))
    text = F.col("text")
    parts = [F.when((F.col("r.start") == "prefix") & text.rlike(PREFIX), PREFIXED).otherwise(0), F.when(matches(rules, "money", text), MONEY).otherwise(0)]
    if known.banks_where(trim="last_section"):
        parts.append(F.when(sectioned, trimming.word_marks(F.col("_clean"))).otherwise(0))
    if any(x["titles_least"] for x in rules):
        parts.append(F.when(F.col("r.titles_least") > 0, F.array_position(lists("r.titles"), F.upper(text))).otherwise(0).cast("int") * TITLE)
    if known.banks_where(titles_columns=True):
        parts.append(F.when(F.col("r.titles_columns"), F.array_position(F.array(*map(F.lit, HEADER_NAMES)), F.upper("_clean"))).otherwise(0).cast("int") * HEAD)
    marked = said.withColumn("marks", reduce(add, (F.coalesce(x, F.lit(0)) for x in parts)))
    return marked.withColumn("clean", F.when(sectioned, F.col("_clean"))).drop("_clean", "r")


def trimmed_pages(words: DataFrame, known: Layouts) -> DataFrame:
    """Page rows of all banks, written once; a last section is cut off inside them."""
    marked = marked_words(trimmed_words(words, known), known)
    pages = saved(page_rows(marked, "bank_key", clean=F.col("clean"), marks=F.col("marks")))
    sectioned = known.banks_where(trim="last_section")
    if not sectioned:
        return pages
    cut = trimming.cut_pages(pages.where(F.col("bank_key").isin(*sectioned)))
    return cut if len(sectioned) == len(known.rows["rules"]) else pages.where(~F.col("bank_key").isin(*sectioned)).unionByName(cut)


def variants(words: DataFrame, known: Layouts) -> DataFrame:
    """file_id, variant by the first word in reading order on page 1 that a variant's row names; files without one have no row."""
    v = F.broadcast(known.frame(words.sparkSession, "variants").select(F.col("bank_key").alias("_bank"), "variant", "word", "xmin", "xmax"))
    met = words.where("page = 1").join(v, (F.col("bank_key") == F.col("_bank")) & (F.upper(F.trim("text")) == F.col("word")) & F.col("x0").between(F.col("xmin"), F.col("xmax")))
    return met.groupBy("file_id").agg(F.min_by("variant", "seq").alias("variant"))


# --- columns ----------------------------------------------------------------------------------------


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def titled_bounds(place: pa.Array, x0: pa.Array, x1: pa.Array, marks: pa.Array, titled: pa.Array, bounds: pa.Array) -> pa.Array:
    """For each page its bounds (least and greatest x of each role). Where its rules say so they come from the page's last line with four names of columns.

    A name stands where its first word in the line does; borders lie midway between names, and what has no name keeps the layout's own. Only numbers come to Python.
    """
    size, out = sizes(place), numbers_of(bounds.flatten()).reshape(-1, 2 * len(ROLES)).copy()
    head = numbers_of(marks.flatten()) // HEAD
    at = np.flatnonzero((head > 0) & np.repeat(numbers_of(titled).astype(bool), size))
    page, line, name = np.repeat(np.arange(len(size)), size)[at], numbers_of(place.flatten())[at], head[at] - 1
    # the first word of each name in each line; a line with four or more of them counts, the last one of its page
    _, first = np.unique(np.stack([page, line, name]), axis=1, return_index=True)
    lines, which, n = np.unique(np.stack([page, line])[:, first], axis=1, return_inverse=True, return_counts=True)
    full = np.flatnonzero(n >= 4)
    last = full[np.append(np.diff(lines[0, full]) > 0, True)] if len(full) else full
    left, right = (np.full((lines.shape[1], len(HEADER_NAMES)), np.nan) for _ in range(2))
    left[which.ravel(), name[first]], right[which.ravel(), name[first]] = numbers_of(x0.flatten())[at][first], numbers_of(x1.flatten())[at][first]
    left, right, pages = left[last], right[last], lines[0, last]
    of = {n: i for i, n in enumerate(HEADER_NAMES)}
    role = lambda name, side: 2 * ROLES.index(name) + side
    middle = lambda name: (left[:, of[name]] + right[:, of[name]]) / 2
    low, high = (middle("RETIROS") + middle("DEPOSITOS")) / 2, (middle("DEPOSITOS") + middle("SALDO")) / 2
    new = {("concepto", 0): right[:, of["FECHA"]] + 5.0, ("concepto", 1): left[:, of["RETIROS"]] - 5.0}
    every = ~np.isnan(low) & ~np.isnan(high)
    new["concepto", 0], new["concepto", 1] = (np.where(np.isnan(new["concepto", 1 - side]), np.nan, v) for (_, side), v in list(new.items()))
    new |= {k: np.where(every, v, np.nan) for k, v in {("cargo", 1): low, ("abono", 0): low, ("abono", 1): high, ("saldo_operacion", 0): high}.items()}
    for (name, side), v in new.items():
        out[pages, role(name, side)] = np.where(np.isnan(v), out[pages, role(name, side)], v)
    return listed(np.full(len(size), 2 * len(ROLES)), out.ravel())


def placed_pages(pages: DataFrame, words: DataFrame, known: Layouts) -> DataFrame:
    """Page rows with r, the rules, ``place``, the line of each word by its bank's rule, and ``bounds`` of each role: by bank and variant, or by the page's own titles where the rules say so.

    Tolerances come from the page rows' heights.
    """
    spark = pages.sparkSession
    measured = known.banks_where(line_rule="mean")
    rows = ruled(pages, known)
    rows = rows.join(page_tolerance(pages.where(F.col("bank_key").isin(*measured))), "file_id", "left") if measured else rows.withColumn("tolerance", F.lit(None).cast("double"))
    rows = rows.join(variants(words, known), "file_id", "left") if known.rows["variants"] else rows.withColumn("variant", F.lit(None).cast("string"))
    default = F.coalesce(*(F.when(F.col("bank_key") == b, v) for b, v in known.default_variants().items()))
    bounds = known.bounds(spark).select("bank_key", "variant", F.array(*(F.col(f"{role}.{side}").cast("double") for role in ROLES for side in ("xmin", "xmax"))).alias("bounds"))
    rows = rows.withColumn("variant", F.coalesce("variant", default)).join(F.broadcast(bounds), ["bank_key", "variant"]).drop("variant")
    mean, top = F.col("r.line_rule") == "mean", F.col("words.top")
    bottom = F.when(mean, F.col("words.bottom")).otherwise(top)
    order = F.when(mean, F.transform("words", middle)).otherwise(top)
    rows = rows.withColumn("place", word_places(order, top, bottom, F.when(mean, F.col("tolerance")).otherwise(ANCHOR_TOLERANCE), mean)).drop("tolerance")
    if known.banks_where(titles_columns=True):
        rows = rows.withColumn("bounds", titled_bounds("place", F.col("words.x0"), F.col("words.x1"), F.col("words.marks"), F.coalesce("r.titles_columns", F.lit(False)), "bounds"))
    return rows


def page_bounds(placed: DataFrame) -> DataFrame:
    """file_id, page and the bounds (xmin, xmax) of each role."""
    pair = lambda i: F.struct(F.get("bounds", 2 * i).alias("xmin"), F.get("bounds", 2 * i + 1).alias("xmax"))
    return placed.select("file_id", "page", *(pair(i).alias(role) for i, role in enumerate(ROLES)))


def lists(text: str) -> Column:
    return F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\|"), lambda x: x != "")


def matches(rules: list[dict], name: str, text: Column) -> Column:
    """Whether a text has the pattern that its bank's rules (r) name. Patterns stand in the plan as literals, so each is compiled once; false without one."""
    patterns = sorted({r[name] for r in rules if r[name]})
    return F.coalesce(*(F.when(F.col(f"r.{name}") == p, text.rlike(p)) for p in patterns), F.lit(False))


OPENING = ["fecha_operacion", "fecha_liquidacion", "concepto", "referencia_label", "referencia_value"]
LINE_TEXTS = ["line", "first_over", "rest_over", "dated", *(f"{c}_text" for c in OPENING), *MONEY_ROLES]
LINES_OF_PAGES = f"file_id string, bank_key string, page int, line_no long, titles int, overs int, {', '.join(f'{c} string' for c in LINE_TEXTS)}"


def cut_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each line of page rows: the texts of its columns, by words that are in their bounds. ``batches``: file_id, bank_key, page, place, bounds, slack, first_line, words (x0, x1, text, marks)."""
    for batch in batches:
        pages = {n: batch.column(n) for n in batch.schema.names}
        size, words = sizes(pages["place"]), pages["words"].flatten()
        owner, place = np.repeat(np.arange(len(size)), size), numbers_of(pages["place"].flatten())
        by = np.lexsort((place, owner))  # keeps the order of x0 within a line
        owner, place = owner[by], place[by]
        x0, x1, marks = (numbers_of(words.field(c))[by] for c in ("x0", "x1", "marks"))
        text = words.field("text").take(pa.array(by))
        filled = numbers_of(pc.not_equal(text, ""))
        new = np.append(True, (np.diff(owner) != 0) | (np.diff(place) != 0))[: len(owner)]
        first, line = np.flatnonzero(new), np.cumsum(new) - 1
        bounds = numbers_of(pages["bounds"].flatten()).reshape(-1, 2 * len(ROLES))[owner]
        low, high = ({role: bounds[:, 2 * i + side] for i, role in enumerate(ROLES)} for side in (0, 1))
        slack, mine = numbers_of(pages["slack"]).astype(float)[owner], numbers_of(pages["first_line"]).astype(bool)[owner]
        centre = (x0 + x1) / 2

        def joined(where: np.ndarray) -> pa.Array:
            n = np.bincount(line[where], minlength=len(first))  # noqa: B023
            return pc.binary_join(listed(n, text.filter(pa.array(where))), " ")  # noqa: B023

        def one(where: np.ndarray, last: bool = False) -> pa.Array:
            at, step = np.flatnonzero(where), 1 if last else -1
            found = np.full(len(first), -1)  # noqa: B023
            found[line[at[::step]]] = at[::step]  # of several the one that comes last stays  # noqa: B023
            return text.take(pa.array(found, mask=found < 0))  # noqa: B023

        inside = lambda role: filled & (centre >= low[role] - slack) & (centre <= high[role] + slack)  # noqa: B023, E731
        over = filled & (np.fmin(x1, high["concepto"]) > np.fmax(x0, low["concepto"]))
        nth = np.cumsum(over)
        rest = over & (nth - (nth[first] - over[first])[line] > 1)
        title = np.where(filled, marks // TITLE % (HEAD // TITLE), 0)
        titles = np.unique(np.stack([line, title])[:, title > 0], axis=1)[0]
        made = {"line": joined(filled), "first_over": one(over), "rest_over": joined(rest), "dated": one(filled & (marks & PREFIXED > 0))}
        made |= {f"{c}_text": joined(inside(c)) for c in OPENING}
        for role in MONEY_ROLES:
            edge = filled & (x1 >= low[role]) & (x1 <= high[role]) & (marks & MONEY > 0)
            made[role] = pc.if_else(pa.array(mine[first]), joined(inside(role) & mine), one(edge & ~mine, True))
        keys = {n: pages[n].take(pa.array(owner[first])) for n in ("file_id", "bank_key", "page")}
        numbers = {"line_no": numbers_of(keys["page"]).astype(np.int64) * LINES + place[first], "titles": np.bincount(titles, minlength=len(first)).astype(np.int32), "overs": np.bincount(line[over], minlength=len(first)).astype(np.int32)}
        columns = keys | {n: pa.array(v) for n, v in numbers.items()} | {n: made[n] for n in LINE_TEXTS}
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def column_texts(placed: DataFrame, known: Layouts) -> DataFrame:
    """What segmentation needs of each line: date, whether it starts a movement, concept, amounts, references. ``placed``: ``placed_pages``."""
    words = F.arrays_zip(*(F.col(f"words.{c}").alias(c) for c in ("x0", "x1", "text", "marks"))).alias("words")
    read = placed.where(F.col("page") >= F.col("r.first_page")).select("file_id", "bank_key", F.col("page").cast("int").alias("page"), "place", "bounds", F.col("r.slack").cast("double").alias("slack"), F.coalesce(F.col("r.amounts") == "first_line", F.lit(False)).alias("first_line"), words)
    lines = ruled(read.mapInArrow(cut_lines, LINES_OF_PAGES), known)
    rules = known.rows["rules"]
    prefixed = F.col("r.start") == "prefix"
    rows = lines.select(
        "file_id", "bank_key", "page", "line_no", "r", "line", "titles", "overs", "first_over", "rest_over", F.when(prefixed, date_prefix(F.col("dated"))).otherwise(F.col("fecha_operacion_text")).alias("fecha_operacion"),
        F.col("fecha_liquidacion_text").alias("fecha_liquidacion"), F.col("concepto_text").alias("opening_text"), F.col("referencia_label_text").alias("referencia_label"), F.col("referencia_value_text").alias("referencia_value"), *MONEY_ROLES,
    )
    date = F.col("fecha_operacion")
    starts = {"slash": (F.length(date) == 6) & F.contains(date, F.lit("/")), "day_month": is_day_month(date), "prefix": date.isNotNull()}
    rows = rows.withColumn("is_start", F.coalesce(*(F.when(F.col("r.start") == k, v) for k, v in starts.items()), F.lit(False)))
    undated = F.concat_ws(" ", F.nullif(without_date_prefix(F.col("first_over")), F.lit("")), "rest_over")
    whole = F.concat_ws(" ", "first_over", F.nullif("rest_over", F.lit("")))
    over_text = F.trim(F.when(F.col("overs") == 0, "").when(prefixed & F.col("is_start"), undated).otherwise(whole))
    rows = rows.withColumn("concepto", F.when(F.col("r.concept_by") == "overlap", over_text).otherwise(F.col("opening_text")))
    skipped = matches(rules, "skip", F.upper("line")) | ((F.col("r.titles_least") > 0) & (F.col("titles") >= F.col("r.titles_least")))
    return rows.where((F.col("line") != "") & ~skipped).drop("overs", "first_over", "rest_over", "titles", "line", "r")


# --- blocks to movements ----------------------------------------------------------------------------


def grouped_blocks(segmented: DataFrame) -> DataFrame:
    """A row for each block: first dates, first and last amounts as texts, concept (non-empty texts by newline), reference. A block's lines meet as one list."""
    labelled = F.contains(F.lower("referencia_label"), F.lit("referencia")) & (F.col("referencia_value") != "")
    columns = ["page", "fecha_operacion", "fecha_liquidacion", "opening_text", "concepto", *MONEY_ROLES]
    line = F.struct("line_no", *columns, F.when(labelled, F.col("referencia_value")).alias("labelled"), found("concepto", r"\*+\S+", 0).alias("starred"))
    keys = ["file_id", "bank_key", "block_id"]
    met = segmented.select(*keys, line.alias("_line")).groupBy(*keys).agg(F.sort_array(F.collect_list("_line")).alias("_lines"))
    each = lambda c: F.col(f"_lines.{c}")
    first = lambda c: F.get(each(c), 0)
    known = lambda c: F.array_compact(each(c))
    return met.select(
        *keys, F.array_min(each("page")).alias("page"), *(first(c).alias(c) for c in ("fecha_operacion", "fecha_liquidacion", "opening_text")), F.array_join(F.array_remove(each("concepto"), ""), "\n").alias("concepto"),
        *(first(c).alias(f"{c}_first") for c in MONEY_ROLES), *(F.try_element_at(known(c), F.lit(-1)).alias(f"{c}_last") for c in MONEY_ROLES),
        F.coalesce(F.get(known("labelled"), 0), F.get(known("starred"), 0)).alias("referencia"),
    )


#: Enrichment of concepts: what a row of ``rules`` may name.
FIELDS: dict[str, Callable[[Column], dict[str, Column]]] = {"bbva": lambda c: concepts.bbva_fields(c, F.col("_lines")), "banamex": concepts.banamex_fields, "banorte": lambda c: concepts.banorte_fields(c, F.col("_flat"), F.col("_lines"))}


def enriched(found: DataFrame, known: Layouts) -> DataFrame:
    """Amounts, kind and what the concept says; openings and empty movements go."""
    r = ruled(found, known)
    first_line = F.col("r.amounts") == "first_line"
    printed = lambda c: F.when(F.col(f"{c}_first") != "", m.plain(F.col(f"{c}_first"))).otherwise(m.zero())  # a cast that fails is dear
    amount = lambda c: F.when(first_line, printed(c)).otherwise(F.coalesce(m.bare_in_parentheses(F.col(f"_{c}")), m.zero()))
    # columns of their own, as each is read many times
    r = r.withColumns({f"_{c}": F.when(~first_line, m.bare(F.col(f"{c}_last"))) for c in MONEY_ROLES})
    r = r.withColumns({c: amount(c) for c in MONEY_ROLES})
    r = r.withColumn("saldo_liquidacion", F.when(F.col("r.value_balance") == "zero", m.zero()).otherwise(F.col("saldo_liquidacion")))
    words = lists("r.opening")
    opening = (F.size(words) > 0) & F.forall(words, lambda w: F.contains(F.upper("opening_text"), w))
    none = (F.col("cargo") == 0) & (F.col("abono") == 0) & (F.col("saldo_operacion") == 0)
    empty = F.when(F.col("r.drop_empty") == "amounts", none).when(F.col("r.drop_empty") == "amounts_and_concept", none & (F.col("concepto") == "")).otherwise(False)
    kept = r.where(~F.coalesce(opening, F.lit(False)) & ~empty)
    kept = kept.withColumn("_lines", F.when(F.col("r.fields").isin("bbva", "banorte"), concepts.lines_of(F.col("concepto"))))
    if known.banks_where(fields="banorte"):
        kept = kept.withColumn("_flat", F.when(F.col("r.fields") == "banorte", concepts.flat(F.col("concepto"), F.col("_lines"))))
    side = F.when(F.col("cargo") > 0, "CARGO").when(F.col("abono") > 0, "ABONO")
    kept = kept.withColumn("_upper", F.when((F.col("r.kind") == "words") & side.isNull(), word_upper(F.col("concepto"))))
    kind = F.when((F.col("r.kind") == "words") & side.isNull(), concepts.kind_said(F.col("_upper"))).otherwise(side)
    named = {r["fields"] for r in known.rows["rules"]}
    says = {n: f(F.col("concepto")) for n, f in FIELDS.items() if n in named}
    names = [c for c in MOVEMENT if any(c in v for v in says.values())]
    picks = {c: F.coalesce(*(F.when(F.col("r.fields") == n, v[c].cast("string")) for n, v in says.items() if c in v)) for c in names}
    if "referencia" in picks:
        picks["referencia"] = F.when(F.col("r.fields").isin(*(n for n, v in says.items() if "referencia" in v)), picks["referencia"]).otherwise(F.col("referencia"))
    made = kept.withColumns({"tipo_operacion": kind} | picks)
    have, blank = set(made.columns), F.nullif(F.col("fecha_liquidacion"), F.lit(""))
    made = made.withColumn("fecha_liquidacion", F.when(first_line, F.col("fecha_liquidacion")).otherwise(blank))
    pick = [(F.col(c) if c in have else F.lit(None)).cast(m.MONEY if c in MONEY_ROLES else "string").alias(c) for c in MOVEMENT]
    return made.select("file_id", "bank_key", "page", "block_id", *pick)


def read_once(known: Layouts) -> bool:
    """Whether words are read for page rows alone, as no marker words cut them and no variant is looked for."""
    return not known.rows["variants"] and all(r["trim"] not in ("end_marker", "chart") for r in known.rows["rules"])


def movements(words: DataFrame, known: Layouts = BUILT_IN) -> DataFrame:
    """file_id, numero_movimiento and the common model of all banks. ``words``, with bank_key: a table that can be read again, unless ``read_once``."""
    placed = placed_pages(trimmed_pages(words, known), words, known)
    segmented = blocks(saved(column_texts(placed, known)), F.col("is_start"))
    found = saved(enriched(grouped_blocks(segmented), known))
    numbered = counted_on(found, F.lit(True), "block_id", "numero_movimiento")
    return numbered.select("file_id", F.col("numero_movimiento").cast("int").alias("numero_movimiento"), *MOVEMENT)


def movements_of(words: DataFrame, bank: str, known: Layouts = BUILT_IN) -> DataFrame:
    """The movements of one bank's statements."""
    return movements(words.withColumn("bank_key", F.lit(bank)), known.only([bank]))
