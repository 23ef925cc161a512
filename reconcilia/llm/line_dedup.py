"""Near-duplicate lines by their deletion neighbourhood, in DataFrame functions throughout.

A line (text between \\n) that is not empty is a duplicate if an earlier line is the same, whatever its
length. One of at least ``min_words`` words, separated by single spaces, is also a duplicate if an earlier
such line is the same but for one word inserted, deleted or replaced. Earlier means: the smallest
(doc_id, line number) at which that line occurs comes first. Empty lines are left alone. Lines below
``min_words`` are counted in the output (n_short), as no variants of them are looked at.

1. Lines are grouped by a 128-bit hash and their length; each distinct line keeps its first place.
2. Lines of ``min_words`` and more are cut into two parts, or four if they are short. Two lines one edit
   apart agree in all parts but one, so a line that shares none of its rests (the line without one
   part) with another line needs no variants; this drops no pair.
3. The others emit every variant with one word deleted as a hashed key. A key is the sum of hashes
   of (word, place), so all variants of a line come from two running sums, whatever its length.
4. Equal (length, place, variant) means one word replaced; a variant equal to another whole line
   means one word inserted or deleted. In each such group only the earliest line is looked at, so a
   group of any size costs one row for each member.
5. The edit is verified on the words of both lines.

Groups of any size are counted with partial sums first; what is joined on a key are written tables, so
that a key with a large share of all rows can be split. Filters by bitmap only spare shuffles: they let
through all that may match.

Null texts have no lines; an empty text has one empty line. Repeated rows with one doc_id count as
one place: a line that one of them loses at a place, all lose there. A null doc_id comes first. Texts and
lines of any length are read whole. Empty tables give empty results. Input columns named as the four
counts are replaced by them; ``lines_left`` hands on every column as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reconcilia.llm.common import attach, columns_of, marked, maybe_among, saved

MIN_WORDS = 8
#: Bits of a word's hash in a variant's key: sums stay within a long for lines of up to 2^24 words.
BITS = 38


def words_of(line: Column) -> Column:
    return F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def line_rows(docs: DataFrame) -> DataFrame:
    """doc_id, place, line, words of every line."""
    parts = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("place", "line"))
    return parts.withColumn("words", words_of(F.col("line")))


#: Lines below this many words are cut into four parts, longer ones into two.
FOUR_PARTS = 16


def rest_keys(line: Column, words: Column, min_words: int) -> Column:
    """Hashes of a line without one of its parts, by the word counts of a pair's shorter line.

    A line of n words is the shorter or equal one of a pair at base n and the longer one at base n - 1.
    At base m part j lies between words m * j / parts and m * (j + 1) / parts, counted from the start on its left
    and from the end on its right, so that one word more, less or other in that part leaves the rest.
    """
    take = lambda count: F.call_function("substring_index", line, F.lit(" "), count)
    keys = []
    for base in (words, words - 1):
        parts = F.when(base < FOUR_PARTS, 4).otherwise(2)
        for j in range(4):
            before = F.floor(base * j / parts).cast("int")
            behind = (base - F.floor(base * (j + 1) / parts)).cast("int")
            keys.append(F.when((base >= min_words) & (parts > j), F.xxhash64(F.lit(j), base, take(before), take(-behind))))
    return F.array(*keys)


def near_owners(lines: DataFrame) -> DataFrame:
    """(h1, h2, first, owner): distinct lines that are one edit from an earlier line, and that line's place.

    ``lines``: h1, h2, first (doc_id, place), line, words of lines that share a rest with others.
    """
    word = Window.partitionBy("h1", "h2").orderBy("at")
    whole = Window.partitionBy("h1", "h2")
    bits = F.lit((1 << BITS) - 1)
    # dealt out as lines, so that their words need not be
    each = lines.repartition("h1", "h2").select("h1", "h2", "words", F.posexplode(F.split("line", " ", -1)).alias("at", "word"))
    variant, own = [], []
    for k in (0, 1):
        stay, move = (F.xxhash64(F.lit(k), "word", F.col("at") - back).bitwiseAND(bits) for back in (0, 1))
        each = each.withColumns({f"stay{k}": stay, f"move{k}": move})
        before = F.coalesce(F.sum(f"stay{k}").over(word.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        after = F.sum(f"move{k}").over(whole) - F.sum(f"move{k}").over(word.rowsBetween(Window.unboundedPreceding, 0))
        variant.append(before + after)
        own.append(F.sum(f"stay{k}").over(whole))
    # a line stands under its own key (at = -1), as the short partner of lines with one word more
    keys = F.array(F.struct("at", F.xxhash64(F.col("words") - 1, *variant).alias("key")), F.when(F.col("at") == 0, F.struct(F.lit(-1).alias("at"), F.xxhash64("words", *own).alias("key"))))
    every = each.select("h1", "h2", keys.alias("keys")).select("h1", "h2", F.explode(F.filter("keys", F.isnotnull)).alias("k")).select("h1", "h2", "k.at", "k.key")
    every = saved(every)
    met = saved(every.groupBy("key").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low != high").select("key"))
    rows = saved(maybe_among(every, "key", met).join(met, "key").join(lines.select("h1", "h2", "first"), ["h1", "h2"]))
    inner = rows.where("at >= 0")
    replaced = saved(inner.groupBy("key", "at").agg(F.min("first").alias("owner")))
    other = saved(rows.groupBy("key", (F.col("at") < 0).alias("whole")).agg(F.min("first").alias("owner")))
    found = (
        inner.join(replaced, ["key", "at"])
        .unionByName(inner.join(other.where("whole").drop("whole"), "key"))
        .unionByName(rows.where("at < 0").join(other.where("NOT whole").drop("whole"), "key"))
        .where("owner < first")
    )
    return found.select("h1", "h2", "first", "owner").distinct()


def within_one(a: Column, b: Column) -> Column:
    """Whether two word arrays are at most one insertion, deletion or replacement apart."""
    n, m = F.size(a), F.size(b)
    shorter = F.least(n, m)
    differ = lambda x, y: F.array_position(F.zip_with(x, y, lambda p, q: ~p.eqNullSafe(q)), F.lit(True))
    head = F.when(differ(a, b) == 0, shorter).otherwise(F.least(shorter, differ(a, b) - 1))
    ra, rb = F.reverse(a), F.reverse(b)
    tail = F.when(differ(ra, rb) == 0, shorter).otherwise(F.least(shorter, differ(ra, rb) - 1))
    return (F.abs(n - m) <= 1) & (head + tail >= F.greatest(n, m) - 1)


def duplicate_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, place, near) of every line to drop; near: not the same as an earlier line, but one edit from one."""
    line, ident = F.col("line"), ["h1", "h2", "bytes"]
    filled = line_rows(docs).where("line != ''").withColumns({"h1": F.xxhash64(line), "h2": F.xxhash64(F.lit(1), line)})
    keys = F.when(F.col("words") >= min_words, F.array_compact(rest_keys(line, F.col("words"), min_words)))
    occurrences = saved(filled.select("doc_id", "place", F.octet_length(line).alias("bytes"), "h1", "h2", keys.alias("keys")))
    rests = occurrences.select("h1", "h2", F.explode("keys").alias("key"))
    # the same line may stand there many times: only another line makes a rest shared
    shared = saved(rests.groupBy("key").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low != high").select("key"))
    some = saved(maybe_among(rests, "key", shared).join(shared, "key").select("h1", "h2").distinct())
    # lines that occur once and share no rest need nothing more
    distinct = occurrences.groupBy(*ident).agg(F.min(F.struct("doc_id", "place")).alias("first"), F.count("*").alias("times"))
    distinct = saved(marked(distinct, "h1", some.select("h1"), "some").where("times > 1 OR some").drop("some"))
    wanted = distinct.join(some, ["h1", "h2"], "left_semi").select("h1", "h2", "first")
    texts = maybe_among(filled.where(F.col("words") >= min_words).select("h1", "h2", "line"), "h1", some.select("h1")).groupBy("h1", "h2").agg(F.min("line").alias("line"))
    kept = saved(wanted.join(texts, ["h1", "h2"]).withColumn("words", words_of(line)))
    pairs = near_owners(kept)
    mine = kept.select("h1", "h2", F.col("line").alias("line_a"))
    theirs = kept.select(F.col("first").alias("owner"), F.col("line").alias("line_b"))
    checked = pairs.join(mine, ["h1", "h2"]).join(theirs, "owner").where(within_one(F.split("line_a", " ", -1), F.split("line_b", " ", -1)))
    near = checked.select("h1", "h2").distinct().withColumn("near", F.lit(True))
    groups = saved(distinct.join(near, ["h1", "h2"], "left").where("times > 1 OR near").select(*ident, "first", "times", F.coalesce("near", F.lit(False)).alias("near")))
    rows = maybe_among(occurrences.select("doc_id", "place", *ident), "h1", groups.select("h1"))
    again = ~F.struct("doc_id", "place").eqNullSafe(F.col("first"))
    return attach(rows, groups, ident, "times").where(F.col("near") | again).select("doc_id", "place", "near")


def cut_lines(docs: DataFrame, min_words: int) -> DataFrame:
    """A struct ``row`` of all columns of ``docs``, text without duplicate lines, n_lines, n_same, n_near, n_short."""
    needed = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    near, same = (F.sort_array(F.collect_set(F.when(c, F.col("place")))) for c in (F.col("near"), ~F.col("near")))
    drops = duplicate_lines(needed, min_words).groupBy(F.col("doc_id").alias("_doc")).agg(same.alias("same"), near.alias("near"))
    drops = drops.withColumn("places", F.sort_array(F.array_union("same", "near")))
    # a byte for each line up to the last one that goes: 1 for those that go
    marks = F.array_join(F.transform("places", lambda p, k: F.concat(F.repeat(F.lit("0"), p - 1 - F.when(k == 0, -1).otherwise(F.get("places", k - 1))), F.lit("1"))), "")
    drops = saved(drops.select("_doc", F.encode(marks, "utf-8").alias("mask"), F.size("same").cast("long").alias("n_same"), F.size("near").cast("long").alias("n_near")))
    rows = marked(docs.select("doc_id", F.struct(*columns_of(docs, *docs.columns)).alias("row"), F.col("text").cast("string").alias("text")), "doc_id", drops.select("_doc"), "some")
    some = F.col("some") | F.col("doc_id").isNull()
    # drops grow with the documents, so they are never broadcast: the same plan at every size
    met = rows.where(some).join(drops.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_doc")), "left").drop("_doc")
    none = rows.where(~some).withColumns({"mask": F.lit(None).cast("binary"), "n_same": F.lit(None).cast("long"), "n_near": F.lit(None).cast("long")})
    lines = F.split("text", "\n", -1)
    rest = F.array_join(F.filter(lines, lambda x, i: F.substring("mask", i + 1, F.lit(1)) != F.lit(b"1")), "\n")
    short = F.size(F.filter(lines, lambda x: (x != "") & (words_of(x) < min_words)))
    count = lambda c: F.when(F.col("text").isNull(), 0).otherwise(c)
    return met.unionByName(none).select(
        "row", F.when(F.col("mask").isNull(), F.col("text")).otherwise(rest).alias("text"), count(F.size(lines)).alias("n_lines"),
        F.coalesce("n_same", F.lit(0)).alias("n_same"), F.coalesce("n_near", F.lit(0)).alias("n_near"), count(short).cast("long").alias("n_short"),
    )


COUNTS = ["n_lines", "n_same", "n_near", "n_short"]


def without_duplicate_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with duplicate lines taken out of text, and n_lines, n_same, n_near (lines dropped), n_short (lines too short for variants)."""
    own = [F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns if c not in COUNTS]
    return cut_lines(docs, min_words).select(*own, *COUNTS)


def lines_left(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without duplicate lines, and without documents that lose all of their lines; n_chars, where there is one, follows the text."""
    own = {"text": F.col("text"), "n_chars": F.length("text").cast("long").alias("n_chars")}
    kept = cut_lines(docs, min_words).where("n_same + n_near < n_lines OR n_lines = 0")
    return kept.select(*(own.get(c, F.col("row").getField(c).alias(c)) for c in docs.columns))


#: The same by another way, in DuckDB: pairs that share a half, and common prefix plus common suffix.
LINE_SQL = """
WITH parts AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS place FROM documents WHERE text IS NOT NULL),
filled AS (SELECT doc_id, place, line, string_split(line, ' ') AS w, len(string_split(line, ' ')) AS n FROM parts WHERE line <> ''),
uniq AS (SELECT line, any_value(w) AS w, any_value(n) AS n, min({'d': doc_id, 'p': place}) AS first FROM filled GROUP BY line),
half AS (SELECT line, w, n, first, unnest([(n - 1) // 2, n // 2]) AS k FROM uniq WHERE n >= 8),
heads AS (
  SELECT DISTINCT line, w, n, first, 0 AS side, k, list_aggregate(w[1:k], 'string_agg', ' ') AS h FROM half
  UNION SELECT DISTINCT line, w, n, first, 1, k, list_aggregate(w[n - k + 1:n], 'string_agg', ' ') FROM half),
pairs AS (
  SELECT DISTINCT a.line, a.w AS aw, a.n AS an, b.line AS other, b.w AS bw, b.n AS bn
  FROM heads a JOIN heads b ON a.side = b.side AND a.k = b.k AND a.h = b.h AND b.first < a.first AND abs(a.n - b.n) <= 1),
near AS (
  SELECT DISTINCT line FROM (
    SELECT line, an, bn, least(an, bn) AS m,
      list_filter(range(1, least(an, bn) + 1), lambda i: aw[i] <> bw[i])[1] AS x,
      list_filter(range(0, least(an, bn)), lambda i: aw[an - i] <> bw[bn - i])[1] AS y FROM pairs)
  WHERE coalesce(x - 1, m) + coalesce(y, m) >= greatest(an, bn) - 1),
drops AS (
  SELECT l.doc_id, l.place, q.line IS NOT NULL AS near FROM filled l JOIN uniq u USING (line) LEFT JOIN near q ON q.line = l.line
  WHERE q.line IS NOT NULL OR u.first <> {'d': l.doc_id, 'p': l.place}),
kept AS (
  SELECT p.doc_id, string_agg(p.line, chr(10) ORDER BY p.place) FILTER (WHERE d.doc_id IS NULL) AS text, count(*) AS n_lines,
    count(*) FILTER (WHERE d.near = false) AS n_same, count(*) FILTER (WHERE d.near) AS n_near,
    count(*) FILTER (WHERE p.line <> '' AND len(string_split(p.line, ' ')) < 8) AS n_short
  FROM parts p LEFT JOIN drops d ON d.doc_id = p.doc_id AND d.place = p.place GROUP BY p.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
  coalesce(k.n_lines, 0)::INTEGER AS n_lines, coalesce(k.n_same, 0)::BIGINT AS n_same, coalesce(k.n_near, 0)::BIGINT AS n_near, coalesce(k.n_short, 0)::BIGINT AS n_short
FROM documents d LEFT JOIN kept k USING (doc_id)
"""
