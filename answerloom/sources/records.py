"""Import files with (category, question, answer) records."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from itertools import groupby, islice
from urllib.parse import unquote

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from answerloom.functions import text as X
from answerloom.operators.ranking import running_total
from answerloom.operators.skew import lookup
from answerloom.session import as_rows, settings

FIELDS = ("category", "question", "answer")
ROWS_PER_BATCH = 10_000


def _plain(name: str) -> str:
    return name.strip().lower().lstrip("\ufeff")


def parse_qa_csv(files: DataFrame) -> DataFrame:
    """(source_file, row_no, category, question, answer, error) of (source_file, content) files, each by its own header.

    Header names are trimmed, lower-cased and freed of a byte-order mark; of
    columns of one name the last counts.  Missing columns, cells that a short row
    lacks, and empty values are null; surplus cells of a long row are passed
    over.  A file that cannot be decoded or parsed gives one more row with its
    error, after the records read before it.  A file is one task's work and is held
    as a whole; ``read_qa_csv`` reads files line by line.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        csv.field_size_limit(2**31 - 1)
        for batch in batches:
            for source, content in zip(batch["source_file"], batch["content"]):
                if content is None:
                    continue
                try:
                    text = bytes(content).decode("utf-8-sig")
                except UnicodeDecodeError as problem:
                    yield _records([(source, 1, None, None, None, str(problem))])
                else:
                    yield from _parsed(source, io.StringIO(text, newline=""))

    kind = files.schema["source_file"].dataType.simpleString()
    texts = ", ".join(f"{f} string" for f in (*FIELDS, "error"))
    return files.select("source_file", F.col("content").cast("binary").alias("content")).mapInPandas(run, f"source_file {kind}, row_no long, {texts}")


def _parsed(source: str, lines: Iterator[str]) -> Iterator[pd.DataFrame]:
    last = 0
    try:
        reader = csv.DictReader(lines)
        place = {_plain(n or ""): n for n in reader.fieldnames or ()}
        rows = enumerate(([row.get(place[f]) or None if f in place else None for f in FIELDS] for row in reader), 1)
        while part := list(islice(rows, ROWS_PER_BATCH)):
            last = part[-1][0]
            yield _records([(source, n, *values, None) for n, values in part])
    except csv.Error as problem:
        yield _records([(source, last + 1, None, None, None, str(problem))])


def _records(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["source_file", "row_no", *FIELDS, "error"])


def _parse_lines(lines: DataFrame) -> DataFrame:
    """As ``parse_qa_csv``, of (source_file, size, line, bad) with a file's lines one after another; no file is held as a whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(2**31 - 1)
        schema = pa.schema([("source_file", pa.string()), ("row_no", pa.int64()), *((f, pa.string()) for f in (*FIELDS, "error"))])
        rows = (row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(4))))
        for (source, size, bad), own in groupby(rows, key=lambda r: (r[0], r[1], r[3])):
            source, texts = unquote(source), _whole_lines((r[2] for r in own), size)
            found = [_undecoded(source, texts)] if bad else _parsed(source, (part for line in texts for part in _universal(line.decode("utf-8"))))
            for part in found:
                yield pa.RecordBatch.from_pandas(part, schema=schema, preserve_index=False)

    texts = ", ".join(f"{f} string" for f in (*FIELDS, "error"))
    return lines.select("source_file", "size", "line", "bad").mapInArrow(run, f"source_file string, row_no long, {texts}")


def _whole_lines(lines: Iterator[bytes], size: int) -> Iterator[bytes]:
    """Lines with their line breaks; the file's size (a mark at its start is not counted) tells whether the last has one."""
    held, passed = None, 0
    for line in lines:
        if held is not None:
            yield held + b"\n"
            passed += len(held) + 1
        held = line
    if held is not None:
        yield held + b"\n" if size - passed - len(held) in (1, 4) else held


def _universal(line: str) -> Iterator[str]:
    return io.StringIO(line, newline="") if "\r" in line else iter((line,))


def _undecoded(source: str, lines: Iterator[bytes]) -> pd.DataFrame:
    """The error of a file that cannot be decoded, with its place in the file."""
    passed = 0
    for line in lines:
        try:
            line.decode("utf-8")
        except UnicodeDecodeError as problem:
            low, high = problem.start + passed, problem.end + passed - 1
            what = f"byte 0x{line[problem.start]:02x} in position {low}" if low == high else f"bytes in position {low}-{high}"
            return _records([(source, 1, None, None, None, f"'utf-8' codec can't decode {what}: {problem.reason}")])
        passed += len(line)
    raise ValueError(f"{source} changed while it was read")


def read_qa_csv(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, row_no, category, question, answer) of the CSV files under a path that can be read."""
    return _parse_lines(_file_lines(spark, path)).filter("error IS NULL").drop("error")


def qa_csv_errors(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, row_no, error) of the CSV files under a path that cannot be read to their end."""
    return _parse_lines(_file_lines(spark, path)).filter("error IS NOT NULL").select("source_file", "row_no", "error")


def _file_lines(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, size, line, bad): the lines of the files under a path in their order, a partition for each file.

    ``bad`` marks the files with a line that is no UTF-8; only their names reach the driver.
    """
    read = spark.read.option("lineSep", "\n").text(path)
    name = F.col("_metadata.file_path").alias("source_file")
    broken = read.filter(~F.is_valid_utf8("value")).select(name).distinct().withColumn("bad", F.lit(True))
    # files are read unsplit, and none follows another in a partition
    with settings(spark, spark__sql__files__maxPartitionBytes=str(1 << 50), spark__sql__files__openCostInBytes=str(1 << 40)):
        lines = as_rows(read.select(name, F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("line")))
    return lines.join(F.broadcast(broken), "source_file", "left").select("source_file", "size", "line", F.coalesce("bad", F.lit(False)).alias("bad"))


def numbered(records: DataFrame) -> DataFrame:
    """Records of several files with ``row_no`` running over all of them, by file and row; ``file_row`` keeps the row in its file.

    Later steps order updates and ties by ``row_no`` alone, so an import of
    several files repeats only with numbers that are unique.
    """
    sizes = records.groupBy("source_file").agg(F.max("row_no").alias("_rows"))
    before = running_total(sizes, "source_file", F.col("_rows"), "_before").select("source_file", "_before")
    return lookup(records.withColumn("file_row", F.col("row_no")), before, ["source_file"], "inner").withColumn("row_no", F.col("_before") + F.col("row_no")).drop("_before")


def _field(record: Column, name: str) -> Column:
    entries = F.map_entries(F.from_json(record, "map<string,string>"))
    key = lambda e: F.regexp_replace(F.lower(X.strip(e["key"])), "\\A\ufeff+", "")
    return F.try_element_at(F.filter(entries, lambda e: key(e) == name), F.lit(-1))["value"]


def parse_records(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, errors) of (source_file, content) JSON arrays.

    Elements that are no objects become errors; ``row_no`` counts the records
    that remain.  Content that is no array raises an error row for the file.
    """
    text = F.regexp_replace("content", "\\A\ufeff", "")
    kind = F.coalesce(F.schema_of_variant(F.try_parse_json(text)), F.lit(""))
    bad = files.filter(~kind.startswith("ARRAY")).select(
        "source_file", F.when(kind == "", "Invalid JSON format").otherwise("JSON import must be an array of records").alias("error")
    )
    elements = files.filter(kind.startswith("ARRAY")).select(
        "source_file", F.posexplode(F.try_variant_get(F.try_parse_json(text), "$", "array<variant>")).alias("at", "value")
    )
    is_object = F.coalesce(F.schema_of_variant("value"), F.lit("")).startswith("OBJECT")
    wrong = elements.filter(~is_object).select(
        "source_file", F.concat(F.lit("Row "), (F.col("at") + 1).cast("string"), F.lit(": invalid record format (expected object)")).alias("error")
    )
    order = Window.partitionBy("source_file").orderBy("at")
    records = elements.filter(is_object).withColumn("element", F.to_json("value")).select(
        "source_file", F.row_number().over(order).cast("long").alias("row_no"), *[_field(F.col("element"), f).alias(f) for f in FIELDS]
    )
    return records, bad.unionByName(wrong)


def read_qa_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_file"), F.col("value").alias("content"))
    return parse_records(files)
