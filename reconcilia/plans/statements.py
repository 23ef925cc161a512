"""From words and pages of any number of statements to account, products, summary, movements, checks, rejects.

Every stage is keyed by file_id or (file_id, page), and takes the files of all banks at once; what differs
between banks is in the rows of ``known``. Before that each file's quality says whether
its words are used, without the leading empty pages, or those that OCR read.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reconcilia.operators import banks, fields, movements, quality, reconcile
from reconcilia.operators.banorte_summary import banorte_summary
from reconcilia.sources import readers
from reconcilia.sources.layouts import BUILT_IN, Layouts
from reconcilia.storage import saved


def summaries(read: DataFrame, words: DataFrame, known: Layouts = BUILT_IN) -> DataFrame:
    """The sixteen fields of every file: from boxes (``read``: all sections), or from labelled lines where the layout says so."""
    banks_ = known.banks_where(summary="labels")
    if not banks_:
        return fields.section(read, "resumen")
    labelled = F.col("bank_key").isin(*banks_)
    boxed = fields.section(read.where(~labelled), "resumen")
    return boxed.unionByName(banorte_summary(words.where(labelled), read.where(labelled).select("file_id")))


class Statements:
    """All outputs, each made when it is first asked for: fields take the pages that have any, and lines are cut for movements and checks only.

    Routes, banks, the words that are read, fields and movements are written once, as each is read several times.
    """

    def __init__(self, words: DataFrame, pages: DataFrame, ocr_tokens: DataFrame | None, known: Layouts) -> None:
        self._words, self._tokens = words, ocr_tokens
        stage = readers.text_stage(pages)
        self._route = route = saved(quality.routed(stage, words))
        heads = readers.head_text(readers.logical_pages(pages.join(route.where("word_source = 'words'").select("file_id"), "file_id", "left_semi"), stage))
        if ocr_tokens is not None:
            self._tokens = ocr_tokens.join(route.where("word_source = 'ocr'").select("file_id"), "file_id", "left_semi")
            heads = heads.unionByName(readers.head_text(readers.ocr_page_text(self._tokens)))
        self.identified = saved(banks.with_bank(route.select("file_id", "document_type", "word_source").join(heads, "file_id", "left"), known=known))
        self._files = self.identified.where(F.col("bank_key").isin(*known.known())).select("file_id", "bank_key")
        # plans hold nothing for banks that no file is of
        self._known = known.only(sorted(r["bank_key"] for r in self._files.select("bank_key").distinct().collect()) or known.known())

    def _chosen(self, words: DataFrame, tokens: DataFrame | None) -> DataFrame:
        read = words.limit(0) if tokens is None else readers.ocr_words(tokens)
        return quality.chosen_words(self._route, words, read).join(self._files, "file_id")

    def _saved(self, words: DataFrame) -> DataFrame:
        """In a folder for each bank, where there are several."""
        return saved(words, *(["bank_key"] if len(self._known.known()) > 1 else []))

    @cached_property
    def _front(self) -> DataFrame:
        """The words of pages with fields; pages of the input that come before them are as many as a file has empty ones."""
        last = max(self._known.last_pages().values())
        empty = self._route.agg(F.coalesce(F.max("initial_empty_pages"), F.lit(0))).first()[0]
        tokens = None if self._tokens is None else self._tokens.where(F.col("page") <= last)
        return self._saved(fields.front(self._chosen(self._words.where(F.col("page") <= last + empty), tokens), self._known))

    @cached_property
    def _found(self) -> DataFrame:
        return saved(fields.sections(self._front, self._files, self._known))

    @property
    def account(self) -> DataFrame:
        return fields.section(self._found, "datos")

    @property
    def products(self) -> DataFrame:
        return fields.section(self._found, "productos")

    @cached_property
    def summary(self) -> DataFrame:
        return summaries(self._found, self._front, self._known)

    @cached_property
    def movements(self) -> DataFrame:
        words = self._chosen(self._words, self._tokens)
        return saved(movements.movements(words if movements.read_once(self._known) else self._saved(words), self._known))

    @cached_property
    def validations(self) -> DataFrame:
        named = lambda df: df.withColumnRenamed("file_id", "statement_id")
        return reconcile.validations(named(self.movements), named(self.summary))

    @property
    def rejects(self) -> DataFrame:
        return banks.rejects(self.identified)


def process(words: DataFrame, pages: DataFrame, ocr_tokens: DataFrame | None = None, known: Layouts = BUILT_IN) -> Statements:
    """All outputs. ``words`` should be a table: fields and movements each read it.

    ``ocr_tokens`` are those of files whose text and words can't be used; without tokens such files are rejected.
    """
    return Statements(words, pages, ocr_tokens, known)


def of_bank(words: DataFrame, bank: str, known: Layouts = BUILT_IN) -> dict[str, DataFrame]:
    """Account, products and summary of one bank's words."""
    mine = words.withColumn("bank_key", F.lit(bank))
    found = saved(fields.sections(mine, mine.select("file_id", "bank_key").distinct(), known))
    return {"account": fields.section(found, "datos"), "products": fields.section(found, "productos"), "summary": summaries(found, mine, known)}
