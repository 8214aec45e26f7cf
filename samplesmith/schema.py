"""Record shapes shared by sources, operators and plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE_FIELDS = ["instruction", "input", "output"]

SAMPLE = T.StructType([T.StructField(f, T.StringType(), True) for f in SAMPLE_FIELDS])

# Every key any raw source may carry; read with this schema, never inferred.
RAW_FIELDS = [
    "instruction", "input", "output", "prompt", "completion", "text", "code",
    "question", "solutions", "starter_code", "difficulty", "canonical_solution",
    "docstring", "english_documentation", "func_documentation_string", "func_code_string",
    "repository_name", "solution", "answer", "title", "body",
]
RAW = T.StructType([T.StructField(f, T.StringType(), True) for f in RAW_FIELDS])

# A generation record of the scoring input.
GENERATION = T.StructType([
    T.StructField("benchmark", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("task_id", T.LongType()),
    T.StructField("gen", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("passed", T.BooleanType()),
    T.StructField("error", T.StringType()),
])


def with_fields(df: DataFrame, fields: list[str]) -> DataFrame:
    """Add every missing field as a null string (a missing JSON key)."""
    missing = [f for f in fields if f not in df.columns]
    if not missing:
        return df
    return df.withColumns({f: F.lit(None).cast("string") for f in missing})
