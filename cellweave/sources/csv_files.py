"""CSV files as tables, with strict inference of types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
DATE = r"^\d{4}-\d{1,2}-\d{1,2}$"


def read_csv(spark: SparkSession, path: str, delimiter: str = ",", headers: bool = True, trim: bool = False, infer: str = "basic") -> DataFrame:
    """infer: "off" keeps text, "basic" finds numbers and TRUE/FALSE, "dates" finds ISO dates too.

    A column takes a type when every value that is not empty reads as it; one pass decides for all
    columns. Empty cells are blank.
    """
    if infer not in ("off", "basic", "dates"):
        raise ValueError("infer is off, basic or dates")
    df = spark.read.csv(path, sep=delimiter, header=headers, inferSchema=False, ignoreLeadingWhiteSpace=trim, ignoreTrailingWhiteSpace=trim, multiLine=True, escape='"', emptyValue="", nullValue="")
    if infer == "off":
        return df
    tests = {"double": lambda c: c.rlike(NUMBER), "boolean": lambda c: F.upper(c).isin("TRUE", "FALSE")}
    if infer == "dates":
        tests["date"] = lambda c: c.rlike(DATE) & c.try_cast("date").isNotNull()
    checks = [F.bool_and(test(F.trim(F.col(f"`{c}`")))).alias(f"{i}_{kind}") for i, c in enumerate(df.columns) for kind, test in tests.items()]
    row = df.agg(*checks).first()
    out = []
    for i, c in enumerate(df.columns):
        kind = next((k for k in tests if row[f"{i}_{k}"]), None)
        out.append(F.trim(F.col(f"`{c}`")).try_cast(kind).alias(c) if kind else F.col(f"`{c}`"))
    return df.select(*out)


def write_csv(df: DataFrame, path: str, delimiter: str = ",", headers: bool = True, quote: str = "necessary", arrays: str = "error") -> None:
    """quote: "necessary" or "always". arrays: "error", "json" or "first" for columns of arrays."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.dataType.typeName() == "array":
            if arrays == "error":
                raise ValueError(f"column {f.name} holds arrays")
            c = (F.to_json(c) if arrays == "json" else F.get(c, 0)).alias(f.name)
        elif f.dataType.typeName() == "boolean":
            c = F.upper(c.cast("string")).alias(f.name)
        out.append(c)
    df.select(*out).write.csv(path, sep=delimiter, header=headers, quoteAll=quote == "always", escape='"', emptyValue="", mode="overwrite")
