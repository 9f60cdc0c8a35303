"""Sinks: partitioned history, tab-separated text and JSON rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.schema import TidebookError, bucket

WIRE = ["timestamp_ns", "price", "quantity", "order_count", "side", "level"]


def write_history(flat: DataFrame, path: str) -> None:
    """Append level rows to history, partitioned by key and segment; rows of a segment lie in arrival order."""
    out = flat.withColumn("segment", bucket())
    keys = ["symbol", "exchange", "segment"]
    out.repartition(*keys).sortWithinPartitions(*keys, "arrival", "level").write.mode("append").partitionBy(*keys).parquet(path)


def tsv_lines(rows: DataFrame) -> DataFrame:
    """One column, line: the wire columns, tab-separated."""
    return rows.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in WIRE]).alias("line"))


def write_tsv(rows: DataFrame, path: str) -> None:
    rows.select(*WIRE).write.mode("overwrite").csv(path, sep="\t", header=True)


def response(rows: DataFrame) -> str:
    """The framed text of a (small) result: OK, header, rows, blank line."""
    lines = [r["line"] for r in tsv_lines(rows).toLocalIterator()]
    return "OK\n" + "\t".join(WIRE) + "\n" + "".join(x + "\n" for x in lines) + "\n"


def parse_response(text: str) -> list[dict[str, int]]:
    """Rows of a framed response; an ERR line raises."""
    lines = text.split("\n")
    if lines[0].startswith("ERR"):
        raise TidebookError("INTERNAL", lines[0][3:].strip())
    if lines[0] != "OK":
        raise TidebookError("PARSE", "a response begins with OK or ERR")
    names = lines[1].split("\t") if len(lines) > 1 and lines[1] else []
    return [dict(zip(names, map(int, x.split("\t")))) for x in lines[2:] if x]


def json_rows(rows: DataFrame) -> DataFrame:
    """One column, json: what a subscriber gets for each row."""
    names = {"timestamp_ns": "ts", "price": "price", "quantity": "qty", "order_count": "cnt", "side": "side", "level": "level"}
    return rows.select(F.to_json(F.struct(*[F.col(c).alias(n) for c, n in names.items()])).alias("json"))
