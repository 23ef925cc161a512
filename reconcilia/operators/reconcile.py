"""Checks of declared totals and balances against a statement's movements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reconcilia.functions.money import MONEY, zero

TOLERANCE = 0.01
CHECKS = ["Total depósitos / abonos", "Total retiros / cargos", "Saldo final", "Ecuación financiera"]

MESSAGES = ["Suma de movimientos vs resumen financiero", "Suma de movimientos vs resumen financiero", "Último movimiento vs saldo final", "Saldo anterior + abonos - cargos"]


def totals(movements: DataFrame) -> DataFrame:
    """statement_id with total_abonos, total_cargos, last_balance, n_movements. A zero balance counts as missing."""
    last = F.coalesce(F.nullif("saldo_liquidacion", zero()), F.nullif("saldo_operacion", zero()))
    return movements.groupBy("statement_id").agg(
        F.sum(F.coalesce("abono", zero())).cast(MONEY).alias("total_abonos"), F.sum(F.coalesce("cargo", zero())).cast(MONEY).alias("total_cargos"),
        F.max_by(last, "numero_movimiento").alias("last_balance"), F.count("*").alias("n_movements"),
    )


def _check(order: int, expected: Column, obtained: Column) -> Column:
    difference = (obtained - expected).cast(MONEY)
    passed = F.abs(difference) <= F.lit(TOLERANCE).cast(MONEY)
    return F.struct(F.lit(order).alias("orden"), F.lit(CHECKS[order - 1]).alias("nombre"), expected.cast(MONEY).alias("esperado"), obtained.cast(MONEY).alias("obtenido"), difference.alias("diferencia"), passed.alias("correcto"), F.lit(MESSAGES[order - 1]).alias("mensaje"))


def validations(movements: DataFrame, summaries: DataFrame) -> DataFrame:
    """A row for each check of every statement that has movements.

    Where a declared value or the last balance is missing, the row stays with a null difference.
    ``summaries``: statement_id, saldo_anterior, depositos_abonos, retiros_cargos, saldo_final.
    """
    both = totals(movements).join(summaries, "statement_id")
    equation = F.col("saldo_anterior") + F.col("depositos_abonos") - F.col("retiros_cargos")
    checks = [
        _check(1, F.col("depositos_abonos"), F.col("total_abonos")), _check(2, F.col("retiros_cargos"), F.col("total_cargos")),
        F.when(F.col("saldo_final").isNotNull(), _check(3, F.col("saldo_final"), F.col("last_balance"))), _check(4, F.col("saldo_final"), equation),
    ]
    return both.select("statement_id", F.explode(F.array_compact(F.array(*checks))).alias("c")).select("statement_id", "c.*")


def integrity(checks: DataFrame) -> DataFrame:
    """statement_id, n_checks, n_correct, score."""
    out = checks.groupBy("statement_id").agg(F.count("*").alias("n_checks"), F.count_if("correcto").alias("n_correct"))
    return out.withColumn("score", F.col("n_correct") / F.col("n_checks"))


def statement_count(movements: DataFrame) -> DataFrame:
    """n_statements, n_movements of a batch: statements that have movements, and all of these."""
    return movements.groupBy("statement_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("n_statements"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_movements"))


def balance_change(summaries: DataFrame) -> DataFrame:
    change = F.coalesce("saldo_final", zero()) - F.coalesce("saldo_anterior", zero())
    return summaries.select("statement_id", change.cast(MONEY).alias("variacion"))
