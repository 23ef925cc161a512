"""Which bank issued a statement: account number, prefix, catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reconcilia.functions.clabe import clabe
from reconcilia.functions.text import canonical
from reconcilia.sources.layouts import BUILT_IN, Layouts, banks

UNKNOWN = "Desconocido"


def with_bank(docs: DataFrame, text: str = "text", known: Layouts = BUILT_IN) -> DataFrame:
    """``docs`` with clabe, prefix, bank_key, display_name, supported."""
    number = docs.withColumn("clabe", clabe(canonical(F.col(text)))).withColumn("prefix", F.substring("clabe", 1, 3))
    out = number.join(F.broadcast(banks(docs.sparkSession, known)), "prefix", "left")
    return out.withColumns({"display_name": F.coalesce("display_name", F.lit(UNKNOWN)), "supported": F.coalesce("supported", F.lit(False))})


def rejects(identified: DataFrame) -> DataFrame:
    """file_id, reason of files that no layout reads; the others go on."""
    reason = F.when(F.col("bank_key").isNull(), "bank_not_identified").otherwise("bank_not_supported")
    return identified.where("NOT supported").select("file_id", reason.alias("reason"))
