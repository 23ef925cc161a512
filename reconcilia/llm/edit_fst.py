"""Spelling variants: near words by composing a vocabulary's acceptor with a one-edit transducer and the acceptor again.

Words are runs of Latin letters, lower-cased (A-Z only) and counted over the corpus; in ``noise`` of its occurrences, chosen by a CRC-32 of id and
run, a run loses a letter (the corpus as it would be with slips of the pen). The vocabulary is what occurs ``least`` times and has ``letters`` code
points. Two words are near if the composed machine A o E o A accepts them: they differ by exactly one inserted, deleted or replaced code point.

A path of the composed machine reads the same letters on both sides up to the edit, makes the edit, and then reads the same letters again. With
the edit at the first place where two words differ every pair has one path only. So the pairs whose edit lies behind a prefix are those of the machine that
starts in the prefix's state, and the work is dealt out by these initial states:

- States that more than ``PARTITION`` words pass through are split. What the split state itself accepts (an edit right there) has equal rests
  behind the edit on both sides, so it is found by grouping words by prefix and rest; such a group holds one word for each letter of the alphabet and one without,
  118 at most. States between branches accept nothing themselves and are passed over, so a split goes on at the next branch.
- Each state that is left over starts a partition: one task builds the minimised acceptor of its words' rests (incrementally, from sorted words) and enumerates the
  pairs of the composition. Pairs are folded into each word's count and best partner at once, never kept or emitted.

A word's form is its near word of largest count (ties: the smallest in code-point order) if that is at least ``factor`` times its own; following forms, whose
counts rise, leads to its root. Pointers are doubled in each round, so a chain takes a round for each power of two.

Nulls have no words; a null id counts as an empty one. Repeated rows count as often as they stand there. Words and texts of any length are read whole. Empty tables give an empty
result. Further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from reconcilia.llm.common import CRC_SQL, crc_sql, saved

RUN = "[A-Za-zÀ-ÿ]+"
#: One run in so many loses a letter.
NOISE = 97
LETTERS, LEAST, FACTOR = 5, 3, 2
#: Words of a partition.
PARTITION = 4000
#: Stands for the edited letter in a group's key; no word holds it.
GAP = "\0"


def vocabulary(docs: DataFrame, noise: int = NOISE, letters: int = LETTERS, least: int = LEAST, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """word, n. Only runs that can still have enough letters are counted, and counts are summed before they are shuffled."""
    runs = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col(f"`{text}`"), F.lit(f"({RUN})"))).alias("run"))
    size = F.length("run")
    plain = F.octet_length("run") == size
    words = runs.where(size >= letters).select("id", F.when(plain, F.lower("run")).otherwise(F.translate("run", ascii_uppercase, ascii_lowercase)).alias("word"), size.alias("size"))
    h = F.crc32(F.concat("id", F.lit(":"), "word"))
    at = (F.col("h") % F.col("size")).cast("int")
    slip = F.concat(F.left("word", at), F.substr("word", at + 2))
    words = words.withColumn("h", h).withColumn("word", F.when(F.col("h") % noise == 0, slip).otherwise(F.col("word")))
    return words.where(F.length("word") >= letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


class Acceptor:
    """The minimised acceptor of sorted distinct words: ``arcs`` and ``final`` of every state; ``root`` is the initial one."""

    def __init__(self, words: list[str]) -> None:
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        self._known: dict[tuple, int] = {}
        path: list[tuple[dict[str, int], list[bool]]] = [({}, [False])]
        before = ""
        for word in words:
            same = len(os.path.commonprefix([before, word]))
            self._settle(path, before, same)
            path += [({}, [False]) for _ in word[same:]]
            path[-1][1][0] = True
            before = word
        self._settle(path, before, 0)
        self.root = self._state(*path[0])

    def _state(self, arcs: dict[str, int], final: list[bool]) -> int:
        key = (final[0], *arcs.items())
        if key not in self._known:
            self._known[key] = len(self.arcs)
            self.arcs.append(arcs)
            self.final.append(final[0])
        return self._known[key]

    def _settle(self, path: list, word: str, depth: int) -> None:
        """States behind ``depth`` get no more arcs: each becomes the known state with the same future, or a new one."""
        while len(path) - 1 > depth:
            state = self._state(*path.pop())
            path[-1][0][word[len(path) - 1]] = state

    def common(self, p: int, q: int, but: str = "") -> Iterator[str]:
        """What both states accept, but for words that start with the letter ``but``."""
        if self.final[p] and self.final[q]:
            yield ""
        todo = [(self.arcs[p][s], self.arcs[q][s], s) for s in self.arcs[p].keys() & self.arcs[q].keys() if s != but]
        while todo:
            p, q, read = todo.pop()
            if self.final[p] and self.final[q]:
                yield read
            one, other = self.arcs[p], self.arcs[q]
            if len(one) > len(other):
                one, other = other, one
            todo += [(r, other[s], read + s) for s, r in one.items() if s in other]

    def edits(self, q: int) -> list[tuple[str, str]]:
        """Rests of pairs whose edit is made in state ``q``: a letter for another one, or a letter more."""
        arcs, out = list(self.arcs[q].items()), []
        for i, (a, p) in enumerate(arcs):
            for b, r in arcs[:i]:
                out += [(a + v, b + v) for v in self.common(p, r)]
            out += [(a + v, v) for v in self.common(p, q, but=a)]
        return out

    def pairs(self) -> Iterator[tuple[str, str]]:
        """Pairs that the composition accepts, each once."""
        known: dict[int, list[tuple[str, str]]] = {}
        todo = [(self.root, "")]
        while todo:
            q, read = todo.pop()
            if q not in known:
                known[q] = self.edits(q)
            for x, y in known[q]:
                yield read + x, read + y
            todo += [(r, read + s) for s, r in self.arcs[q].items()]


def _folded(words: list[str], counts: list[int], depth: int) -> Iterator[tuple[str, int, int, str]]:
    """word, number of near words, count and text of the best, for the sorted words of one partition."""
    n, head = dict(zip(words, counts, strict=True)), words[0][:depth]
    found: dict[str, tuple[int, int, str]] = {}
    for x, y in Acceptor([w[depth:] for w in words]).pairs():
        for one, other in ((head + x, head + y), (head + y, head + x)):
            near, least, best = found.get(one, (0, 1, ""))
            key = min((least, best), (-n[other], other))
            found[one] = (near + 1, *key)
    for word, (near, least, best) in found.items():
        yield word, near, -least, best


def _partitions(rows: DataFrame) -> DataFrame:
    """word, n_near, best_n, best from rows of prefix, depth, word, n whose prefixes are few enough for a task."""
    schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])

    def made(groups: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(groups)
        found = list(_folded(table["word"].to_pylist(), table["n"].to_pylist(), table["depth"][0].as_py()))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema) if found else pa.RecordBatch.from_pylist([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            names = batch.column(0).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1), len(batch)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if held and held[0]["prefix"][0].as_py() != names[a]:
                    yield made(held)
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield made(held)

    dealt = rows.select("prefix", "depth", "word", "n").repartition("prefix").sortWithinPartitions("prefix", "word")
    return dealt.mapInArrow(run, "word string, n_near long, best_n long, best string")


@F.arrow_udf(IntegerType())
def _shared(a: pa.Array, b: pa.Array) -> pa.Array:
    """Letters that two words share at their beginning."""
    return pa.array([len(os.path.commonprefix(two)) for two in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.int32())


def _split_state(rows: DataFrame) -> DataFrame:
    """The same from rows of word, n, at: near words whose edit is made at place ``at``, where many words pass."""
    at = F.col("at")
    cut = F.when(F.length("word") > at, F.struct(F.concat(F.left("word", at), F.lit(GAP), F.substr("word", at + 2)).alias("key"), F.substr("word", at + 1, F.lit(1)).alias("letter")))
    whole = F.struct(F.concat(F.left("word", at), F.lit(GAP), F.substr("word", at + 1)).alias("key"), F.lit("").alias("letter"))
    keyed = rows.select("n", F.explode(F.filter(F.array(cut, whole), lambda x: x.isNotNull())).alias("k")).select("k.*", "n")
    groups = keyed.groupBy("key").agg(F.collect_list(F.struct((-F.col("n")).alias("a"), "letter")).alias("members")).where(F.size("members") > 1)
    word = lambda m: F.replace(F.col("key"), F.lit(GAP), m["letter"])
    behind = F.substr("key", F.instr("key", GAP) + 1, F.lit(1))
    one_more = lambda x, y: (x["letter"] == "") & (y["letter"] == behind)  # noqa: E731 - such a pair differs further on
    each = groups.select("key", "members", F.explode("members").alias("m"))
    others = F.filter("members", lambda o: (o["letter"] != F.col("m")["letter"]) & ~one_more(o, F.col("m")) & ~one_more(F.col("m"), o))
    best = F.array_min(F.transform(others, lambda o: F.struct(o["a"].alias("a"), word(o).alias("w"))))
    found = each.select(word(F.col("m")).alias("word"), F.size(others).cast("long").alias("n_near"), best.alias("b")).where("n_near > 0")
    return found.select("word", "n_near", (-F.col("b.a")).alias("best_n"), F.col("b.w").alias("best"))


def near_words(words: DataFrame, partition: int = PARTITION) -> DataFrame:
    """word, n_near, best_n, best of all words with a near one. ``words``: word, n, saved, no word twice."""
    left = words.select("word", "n", F.lit("").alias("prefix"), F.lit(0).alias("depth"))
    parts: list[DataFrame] = []
    while True:
        sizes = left.groupBy("prefix").agg(F.count("*").alias("size"), F.min("word").alias("a"), F.max("word").alias("b")).where(F.col("size") > partition)
        hot = saved(sizes.select("prefix", _shared("a", "b").alias("at")))
        if hot.isEmpty():
            break
        parts.append(_partitions(left.join(hot, "prefix", "left_anti")))
        split = saved(left.join(hot, "prefix").select("word", "n", "at"))
        parts.append(_split_state(split))
        depth = F.col("at") + 1
        left = split.where(F.length("word") > F.col("at")).select("word", "n", F.left("word", depth).alias("prefix"), depth.alias("depth"))
    found = _partitions(left)
    for p in parts:
        found = found.unionByName(p)
    best = F.min(F.struct((-F.col("best_n")).alias("a"), "best")).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("b.a")).alias("best_n"), F.col("b.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root from word, form (saved, no nulls, no cycles): where following forms ends."""
    to = forms.select("word", F.col("form").alias("root"))
    while True:
        further = to.select(F.col("word").alias("root"), F.col("root").alias("_further"))
        if to.join(further, "root", "left_semi").isEmpty():
            return to
        to = saved(to.join(further, "root", "left").select("word", F.coalesce("_further", "root").alias("root")))


def variants(docs: DataFrame, factor: int = FACTOR, partition: int = PARTITION, **vocabulary_options) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of the vocabulary."""
    words = saved(vocabulary(docs, **vocabulary_options))
    found = words.join(near_words(words, partition), "word", "left")
    chosen: Column = F.col("best_n") >= factor * F.col("n")
    found = saved(found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(chosen, F.col("best")).alias("form"), F.when(chosen, F.col("best_n")).alias("form_n")))
    ends = roots(found.where("form IS NOT NULL").select("word", "form"))
    return found.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))


VARIANT_SQL = f"""
WITH RECURSIVE {CRC_SQL},
r AS (SELECT doc_id::VARCHAR AS id, translate(unnest(regexp_extract_all(coalesce(text, ''), '{RUN}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
c AS (SELECT id, w, count(*) AS k FROM r WHERE length(w) >= 5 GROUP BY ALL),
h AS (SELECT w, k, {crc_sql("(id || ':' || w)")} AS h FROM c, crc_table),
s AS (SELECT CASE WHEN h % 97 = 0 THEN left(w, (h % length(w))::INTEGER) || substr(w, (h % length(w))::INTEGER + 2) ELSE w END AS word, k FROM h),
v AS (SELECT word, sum(k)::BIGINT AS n FROM s WHERE length(word) >= 5 GROUP BY 1 HAVING sum(k) >= 3),
x AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v), del AS (SELECT word, n, left(word, i - 1) || substr(word, i + 1) AS d, i FROM x),
p AS (SELECT a.word AS a, b.word AS b, b.n AS n FROM del a JOIN del b ON a.d = b.d AND a.i = b.i AND a.word <> b.word AND length(a.word) = length(b.word) UNION SELECT d.word, v.word, v.n FROM del d JOIN v ON d.d = v.word UNION SELECT v.word, d.word, d.n FROM del d JOIN v ON d.d = v.word),
best AS (SELECT a, count(*) AS n_near, (list({{'n': -n, 'w': b}} ORDER BY n DESC, b))[1] AS best FROM p GROUP BY 1),
f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.n >= 2 * v.n THEN best.w END AS form, CASE WHEN -best.n >= 2 * v.n THEN -best.n END AS form_n FROM v LEFT JOIN best ON best.a = v.word),
walk AS (SELECT word, word AS at FROM f UNION ALL SELECT w.word, f.form FROM walk w JOIN f ON f.word = w.at WHERE f.form IS NOT NULL),
ends AS (SELECT w.word, w.at AS root FROM walk w JOIN f ON f.word = w.at WHERE f.form IS NULL)
SELECT f.word, f.form, root, f.n, n_near, form_n FROM f JOIN ends USING (word)
"""
