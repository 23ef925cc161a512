"""The four normalised tables, their versioned sink, and the ids of statements."""

from __future__ import annotations

import json
import re
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reconcilia.storage import saved

NAME_LIMIT = 31
# The column titles of the four tables.
KEYS = {"id_estado": "id_estado", "file_name": "Nombre del Archivo", "bank_key": "Banco"}
ACCOUNT = {
    "producto_principal": "Producto Principal", "periodo_inicio": "Periodo de Inicio", "periodo_fin": "Periodo de Fin", "fecha_corte": "Fecha de Corte", "numero_cuenta": "Número de Cuenta",
    "numero_cliente": "Número de Cliente", "clabe": "CLABE", "nombre_cliente": "Nombre del Cliente", "rfc": "RFC",
}
PRODUCT = {"contrato": "Contrato", "producto": "Producto", "tasa_interes_anual": "Tasa de Interes Anual", "gat_nominal_anual": "GAT Nominal Anual", "gat_real_anual": "GAT Real Anual", "total_comisiones": "Total de Comisiones"}
SUMMARY = {
    "saldo_promedio": "Saldo Promedio", "dias_periodo": "Días del Periodo ", "tasa_bruta_anual": "Tasa Bruta Anual", "saldo_promedio_gravable": "Saldo Promedio Gravable", "intereses_a_favor": "Intereses a Favor",
    "isr_retenido": "ISR Retenido", "cheques_pagados": "Cheques Pagados", "manejo_cuenta": "Manejo de Cuenta", "cargos_objetados": "Cargos Objetados", "abonos_objetados": "Abonos Objetados",
    "saldo_anterior": "Saldo Anterior", "depositos_abonos": "Depositos / Abonos (+)", "retiros_cargos": "Retiros / Cargos (-)", "saldo_final": "Saldo Final",
    "saldo_promedio_minimo_mensual": "Saldo Promedio Mínimo Mensual", "saldo_global": "Saldo Global",
}
MOVEMENTS = {
    "fecha_corte": "Fecha de Corte", "numero_cuenta": "Número de Cuenta", "numero_movimiento": "No. de Movimiento", "fecha_operacion": "Fecha de Operación", "fecha_liquidacion": "Fecha de Liquidación", "concepto": "Concepto",
    "tipo_operacion": "Tipo de Operación", "cargo": "Cargo", "abono": "Abono", "saldo_operacion": "Saldo de Operación", "saldo_liquidacion": "Saldo de liquidacion", "referencia": "Referencia", "autorizacion": "Autorizacion",
    "beneficiario": "Beneficiario", "cuenta_beneficiario": "Cuenta del Beneficiario", "clabe_beneficiario": "CLABE del Beneficiario", "rfc": "RFC", "sucursal": "Sucursal", "caja": "Caja", "hora_operacion": "Hora de Operación", "concepto_original": "Concepto Original",
}
NAMES = {"datos": "Datos de la Cuenta", "productos": "Otros Productos", "resumen": "Resumen Financiero", "movimientos": "Movimientos"}


def statement_keys(files: DataFrame) -> DataFrame:
    """``files`` (file_id, input_ord, parsed) with id_estado, the place in the input; places of files that were not parsed stay unused.

    Files are dealt out by ranges of input_ord, numbered within each range, and moved on by the counts of the
    ranges before: what meets in one task is a range, or one row for each of them.
    """
    part = Window.partitionBy("_part")
    dealt = saved(files.repartitionByRange("input_ord").withColumn("_part", F.spark_partition_id()))
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    placed = dealt.withColumn("_row", F.row_number().over(part.orderBy("input_ord"))).join(F.broadcast(before), "_part")
    return placed.withColumn("id_estado", (F.col("_before") + F.col("_row")).cast("int")).drop("_part", "_row", "_before").where("parsed")


def _pick(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.select(*(F.col(c).alias(n) for c, n in (KEYS | columns).items()))


def normalised(keys: DataFrame, account: DataFrame, products: DataFrame, summary: DataFrame, movements: DataFrame) -> dict[str, DataFrame]:
    """The four tables by name. ``keys``: file_id, id_estado, file_name, bank_key."""
    k = keys.select("file_id", *KEYS)
    head = account.select("file_id", "fecha_corte", "numero_cuenta")
    return {
        NAMES["datos"]: _pick(k.join(account, "file_id"), ACCOUNT), NAMES["productos"]: _pick(k.join(products, "file_id"), PRODUCT), NAMES["resumen"]: _pick(k.join(summary, "file_id"), SUMMARY),
        NAMES["movimientos"]: _pick(k.join(movements, "file_id").join(head, "file_id"), MOVEMENTS),
    }


def header_union(parts: list[DataFrame]) -> DataFrame:
    """Rows of all parts under the ordered union of their columns; missing values are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def stored_names(df: DataFrame) -> DataFrame:
    """``df`` with column names that Parquet may hold."""
    return df.toDF(*(re.sub(r"[ ,;{}()=\n\t]+", "_", c.strip()) for c in df.columns))


def write(tables: dict[str, DataFrame], path: str, form: str = "parquet") -> list[str]:
    """Each table in a folder under its name, cut to 31 characters; one after the other, with nothing that holds them together."""
    out = []
    for name, df in tables.items():
        out.append(f"{path}/{name[:NAME_LIMIT]}")
        (stored_names(df) if form == "parquet" else df).write.mode("overwrite").format(form).option("header", True).save(out[-1])
    return out


# --- versions ---------------------------------------------------------------------------------------


class Versions:
    """Tables that change together: a reader sees all of a version's tables or none.

    The tables of a version are written to a folder of its own. When all are there, a manifest that names them is moved to its
    place, under the next number; the move is the only step that a reader can see. A manifest is never written over: if
    another writer was first, the move fails and so does the commit. ``batch`` names what a version was made from, so that a batch that comes again is left out.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._paths = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._paths(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._paths(f"{self.path}/{name}")

    def numbers(self) -> list[int]:
        """Versions in their order."""
        folder = self._at("manifests")
        if not self._files.exists(folder):
            return []
        return sorted(int(f.getPath().getName()) for f in self._files.listStatus(folder) if f.getPath().getName().isdigit())

    def manifest(self, number: int | None = None) -> dict:
        """What a version holds (the last one without a number); empty if there is none."""
        known = self.numbers()
        if not known:
            return {"tables": {}, "batches": []}
        lines = self.spark.read.text(f"{self.path}/manifests/{(known[-1] if number is None else number):012d}", wholetext=True)
        return json.loads(lines.first()[0])

    def commit(self, tables: dict[str, DataFrame], batch: str | None = None, append: bool = False, form: str = "parquet") -> int | None:
        """The number of the new version; None if the batch is in one already. With ``append`` a table's earlier folders stay part of it."""
        last, before = (self.numbers() or [0])[-1], self.manifest()
        if batch is not None and batch in before["batches"]:
            return None
        folder, found = uuid.uuid4().hex, {n: dict(t) for n, t in before["tables"].items()} if append else {}
        for name, df in tables.items():
            place = f"data/{folder}/{name[:NAME_LIMIT]}"
            stored_names(df).write.format(form).save(f"{self.path}/{place}")
            earlier = found[name]["folders"] if name in found else []
            found[name] = {"folders": [*earlier, place], "columns": df.columns, "form": form}
        staged, target = self._at(f"staged/{folder}"), self._at(f"manifests/{last + 1:012d}")
        out = self._files.create(staged, False)
        out.write(bytearray(json.dumps({"tables": found, "batches": before["batches"] + ([batch] if batch is not None else [])}).encode()))
        out.close()
        self._files.mkdirs(target.getParent())
        if self._files.exists(target) or not self._files.rename(staged, target):
            raise RuntimeError(f"another writer committed version {last + 1} of {self.path}")
        return last + 1

    def tables(self, number: int | None = None) -> dict[str, DataFrame]:
        """A version's tables by name, under their own column names."""
        found = self.manifest(number)["tables"]
        return {n: self.spark.read.format(t["form"]).load([f"{self.path}/{f}" for f in t["folders"]]).toDF(*t["columns"]) for n, t in found.items()}

    def vacuum(self, keep: int = 2) -> int:
        """Removes manifests but the last ``keep``, and folders that no manifest names; how many folders went. Not while others write."""
        for number in self.numbers()[:-keep]:
            self._files.delete(self._at(f"manifests/{number:012d}"), False)
        named = {f.split("/")[1] for n in self.numbers() for t in self.manifest(n)["tables"].values() for f in t["folders"]}
        folder = self._at("data")
        gone = [f.getPath() for f in self._files.listStatus(folder) if f.getPath().getName() not in named] if self._files.exists(folder) else []
        for path in gone:
            self._files.delete(path, True)
        return len(gone)


class KeyDimension:
    """Statement ids over many batches: a file keeps its id for good, and new files go on after the last one.

    The dimension is a versioned table of file_id, file_key (a stable 64-bit hash) and id_estado. Places of files that were not parsed stay unused, as
    within one batch.
    """

    NAME = "keys"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.store = Versions(spark, path)
        self.spark = spark

    def known(self) -> DataFrame:
        return self.store.tables().get(self.NAME) or self.spark.createDataFrame([], "file_id string, file_key long, id_estado int")

    def assign(self, files: DataFrame, batch: str) -> DataFrame:
        """``files`` (file_id, input_ord, parsed; no file twice) with id_estado, those not parsed left out. A batch that comes again gets the ids that it has."""
        known = saved(self.known())
        new = saved(files.join(known.select("file_id"), "file_id", "left_anti"))
        last = known.agg(F.coalesce(F.max("id_estado"), F.lit(0))).first()[0]
        numbered = statement_keys(new.select("file_id", "input_ord", F.lit(True).alias("parsed")))
        made = saved(numbered.select("file_id", F.xxhash64("file_id").alias("file_key"), (F.col("id_estado") + last).alias("id_estado")))
        twice = known.unionByName(made).groupBy("file_key").agg(F.count_distinct("file_id").alias("n")).where("n > 1")
        if not twice.isEmpty():
            raise ValueError("two files have the same key")
        self.store.commit({self.NAME: made}, batch, append=True)
        return files.join(known.unionByName(made).select("file_id", "id_estado"), "file_id").where("parsed")
