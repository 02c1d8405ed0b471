"""Delimited questionnaires: reading, filling and writing."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from answerloom.functions import text as X

DELIMITERS = ",;\t|"
ROWS_PER_BATCH = 10_000
#: Characters of cells after which a batch ends before it has that many rows.
BATCH_CHARS = 8 << 20
#: Longest text without its cells' characters whose dialect a worker keeps in mind.
SHAPE_CHARS = 1_000
_CELL = re.compile(f"[^\\n{re.escape(DELIMITERS)}]+")


def _read_dialect(text: str) -> tuple[str, str]:
    """(delimiter, quote): sniffed, comma and double quote when unclear."""
    if not text.strip():
        return ",", '"'
    if '"' not in text and "'" not in text:
        # without quotes only the delimiters of the lines count, and files of one layout agree in them
        text = _CELL.sub("x", text)
        if len(text) <= SHAPE_CHARS:
            return _sniffed_shape(text)
    return _sniffed(text)


def _sniffed(text: str) -> tuple[str, str]:
    try:
        found = csv.Sniffer().sniff(text, delimiters=DELIMITERS)
    except csv.Error:
        return ",", '"'
    return found.delimiter, found.quotechar or '"'


_sniffed_shape = lru_cache(maxsize=20_000)(_sniffed)


def parse(documents: DataFrame) -> DataFrame:
    """(doc_id, row_idx, cells, delimiter, quote, error) of (doc_id, content) files.

    ``content`` is text or UTF-8 bytes of one whole file; cells are stripped.  A
    file that cannot be read has one row with its error, a null file none.  Store
    the result to use ``cells_of`` and ``errors_of`` on one parse.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found, chars = batch.column(0), [], 0
            for at, content in enumerate(batch.column(1)):
                for row in _parsed(content.as_py()):
                    found.append((at, *row))
                    chars += sum(map(len, row[1] or ()))
                    if len(found) >= ROWS_PER_BATCH or chars >= BATCH_CHARS:
                        yield _batch(ids, found)
                        found, chars = [], 0
            if found:
                yield _batch(ids, found)

    kind = documents.schema["doc_id"].dataType.simpleString()
    # sniffing costs far more than its bytes suggest: spread the files evenly
    tasks = documents.sparkSession.sparkContext.defaultParallelism * 4
    return documents.select("doc_id", "content").repartition(tasks, "doc_id").mapInArrow(
        run, f"doc_id {kind}, row_idx long, cells array<string>, delimiter string, quote string, error string"
    )


def _parsed(content: str | bytes | None) -> list[tuple]:
    """(row_idx, cells, delimiter, quote, error) of one file."""
    if content is None:
        return []
    try:
        text = content.decode("utf-8-sig") if isinstance(content, (bytes, bytearray)) else content.removeprefix("\ufeff")
        delimiter, quote = _read_dialect(text)
        rows = [[cell.strip() for cell in row] for row in csv.reader(text.splitlines(), delimiter=delimiter, quotechar=quote)]
    except (UnicodeDecodeError, csv.Error) as problem:
        return [(0, None, None, None, str(problem))]
    return [(i, cells, delimiter, quote, None) for i, cells in enumerate(rows)]


def _batch(ids: pa.Array, found: list[tuple]) -> pa.RecordBatch:
    """Rows (place of the file in ``ids``, row_idx, cells, delimiter, quote, error) of any number of files."""
    at, row_idx, cells, *texts = zip(*found)
    arrays = [ids.take(pa.array(at, pa.int64())), pa.array(row_idx, pa.int64()), pa.array(cells, pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays(
        [*arrays, *(pa.array(t, pa.string()) for t in texts)], names=["doc_id", "row_idx", "cells", "delimiter", "quote", "error"]
    )


def cells_of(parsed: DataFrame) -> DataFrame:
    """Cells of the files that could be read."""
    return parsed.filter("error IS NULL").drop("error")


def errors_of(parsed: DataFrame) -> DataFrame:
    """(doc_id, error) of the files that could not."""
    return parsed.filter("error IS NOT NULL").select("doc_id", "error")


def parse_grids(documents: DataFrame) -> DataFrame:
    """(doc_id, row_idx, cells, delimiter, quote) of (doc_id, content) files.

    A file that cannot be read has no rows here and does not stop the others.
    """
    return cells_of(parse(documents))


def header_cells(documents: DataFrame) -> DataFrame:
    """(doc_id, row_idx, cells): the first record of each file, always split at commas.

    Layouts are known by it, whatever delimiter the file has.  An empty file has
    no cells; files that ``grid_errors`` lists for their bytes are left out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, heads = [], []
            for doc_id, content in zip(batch["doc_id"], batch["content"]):
                try:
                    text = content.decode("utf-8-sig") if isinstance(content, (bytes, bytearray)) else content.removeprefix("\ufeff")
                    head = next(csv.reader(io.StringIO(text, newline=None)), [])
                except (UnicodeDecodeError, csv.Error):
                    continue
                ids.append(doc_id)
                heads.append(head)
            if ids:
                yield pd.DataFrame({"doc_id": ids, "row_idx": 0, "cells": heads})

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "content").mapInPandas(run, f"doc_id {kind}, row_idx long, cells array<string>")


def grid_errors(documents: DataFrame) -> DataFrame:
    """(doc_id, error) of the files that ``parse_grids`` leaves out."""
    return errors_of(parse(documents))


def read_grids(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Cells of delimited files; the path is the document id, a file is one task's work."""
    files = spark.read.format("binaryFile").load(paths)
    return parse_grids(files.select(F.col("path").alias("doc_id"), "content"))


def text_lines(documents: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, line_idx, line): stripped lines of a text column."""
    return documents.select("doc_id", F.posexplode(F.split(F.col(text), "\n")).alias("line_idx", "line")).withColumn(
        "line", X.strip(F.col("line"))
    )


def _put(cells: Column, at: Column, value: Column) -> Column:
    """Cells with one value set; short rows are padded with empty cells."""
    width = F.greatest(F.size(cells), at + 1)
    padded = F.concat(cells, F.array_repeat(F.lit(""), width - F.size(cells)))
    return F.transform(padded, lambda c, i: F.when(i == at, value).otherwise(c))


def fill_grids(cells: DataFrame, answers: DataFrame) -> DataFrame:
    """Cells with the answer, or the review placeholder, of every extracted row.

    Answers are (doc_id, answer_row_idx, answer_col_idx, answer_text).
    """
    wanted = answers.select(
        "doc_id", F.col("answer_row_idx").alias("row_idx"), "answer_col_idx", X.or_placeholder(F.col("answer_text")).alias("_answer")
    )
    return cells.join(wanted, ["doc_id", "row_idx"], "left").withColumn(
        "cells",
        F.when(F.col("answer_col_idx").isNotNull(), _put(F.col("cells"), F.col("answer_col_idx"), F.col("_answer"))).otherwise(F.col("cells")),
    ).drop("answer_col_idx", "_answer")


def delimited_line(cells: Column, delimiter: Column, quote: Column) -> Column:
    """One line of delimited text; cells are quoted when they need it."""
    doubled = lambda c: F.concat(quote, F.replace(c, quote, F.concat(quote, quote)), quote)
    special = lambda c: F.contains(c, delimiter) | F.contains(c, quote) | c.rlike(r"[\r\n]")
    line = F.array_join(F.transform(cells, lambda c: F.when(special(c), doubled(c)).otherwise(c)), "\u0000")
    # a lone empty cell is written as a quoted empty string
    return F.when((F.size(cells) == 1) & (F.get(cells, F.lit(0)) == ""), F.concat(quote, quote)).otherwise(
        F.replace(line, F.lit("\u0000"), delimiter)
    )


def write_grids(filled: DataFrame, path: str) -> None:
    """Filled grids as text, one folder per document, part files in row order.

    Rows are spread by document and row, so a huge document is written by many
    tasks.
    """
    lines = filled.select(
        "doc_id", "row_idx", delimited_line(F.col("cells"), F.col("delimiter"), F.col("quote")).alias("value")
    )
    lines.repartitionByRange("doc_id", "row_idx").sortWithinPartitions("doc_id", "row_idx").select("doc_id", "value").write.mode(
        "overwrite"
    ).partitionBy("doc_id").text(path)


def answer_listing(items: DataFrame) -> DataFrame:
    """Numbered question and answer lines for sources that cannot be edited.

    Items are (doc_id, question_index, question_text, answer_text) with
    contiguous 0-based indexes.
    """
    return items.select(
        "doc_id", (F.col("question_index") + 1).alias("seq"),
        F.concat((F.col("question_index") + 1).cast("string"), F.lit(". "), "question_text").alias("question_line"),
        X.or_placeholder(F.col("answer_text")).alias("answer_line"),
        (F.coalesce("answer_text", F.lit("")) == "").alias("is_placeholder"),
    )
