"""Schemas of the engine's inputs."""

from __future__ import annotations

from pyspark.sql import types as T

KINDS = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType()}


def schema(columns: str) -> T.StructType:
    """A schema from ``name kind`` pairs; unlike a DDL string it needs no session."""
    return T.StructType([T.StructField(*(name, KINDS[kind])) for name, kind in (c.split() for c in columns.split(","))])


WORDS = schema(
    "file_id string, file_name string, seq long, page int, text string, x0 double, x1 double, top double, bottom double, "
    "doctop double, width double, height double, upright boolean, direction string, confidence double"
)
PAGES = schema("file_id string, file_name string, page int, text string, page_width double, page_height double")
OCR_TOKENS = schema(
    "file_id string, page int, block_num int, par_num int, line_num int, token_idx int, text string, left int, top int, "
    "width int, height int, conf string, image_width int, page_width double, page_height double"
)
