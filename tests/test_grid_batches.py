"""Many small files share batches, and their dialects are those of the sniffer."""

from __future__ import annotations

import csv
import random

import pyarrow as pa
from conftest import rows
from pyspark.sql import functions as F

from answerloom.sources import grids


def test_rows_of_many_files_share_a_batch(spark, monkeypatch):
    made = []
    whole = grids._batch
    monkeypatch.setattr(grids, "_batch", lambda ids, found: made.append(len(found)) or whole(ids, found))
    contents = [(i, f"Question;Answer\nq{i};" if i % 5 else None if i % 2 else "") for i in range(50)]
    caught = {}

    class Files:  # the function that runs in a task, called here
        sparkSession = spark
        schema = spark.createDataFrame(contents, "doc_id long, content string").schema
        select = repartition = lambda self, *_: self
        mapInArrow = lambda self, run, kind: caught.update(run=run)

    grids.parse(Files())
    batch = pa.RecordBatch.from_pydict({"doc_id": [i for i, _ in contents], "content": [c for _, c in contents]})
    got = [r for out in caught["run"](iter([batch])) for r in out.to_pylist()]
    assert made == [80]  # one batch for fifty files, not one for each
    assert [(r["doc_id"], r["row_idx"], r["cells"]) for r in got if r["doc_id"] == 7] == [(7, 0, ["Question", "Answer"]), (7, 1, ["q7", ""])]
    monkeypatch.setattr(grids, "ROWS_PER_BATCH", 3)
    assert [r for out in caught["run"](iter([batch])) for r in out.to_pylist()] == got and max(made[1:]) == 3


def test_parsed_files_keep_null_ids_and_errors(spark):
    files = spark.createDataFrame([(None, b"a,b"), (1, b"\xff"), (2, b""), (3, None)], "doc_id long, content binary")
    got = rows(grids.parse(files).select("doc_id", "row_idx", "cells", "delimiter", F.col("error").isNotNull()))
    assert got == [(1, 0, None, None, True), (None, 0, ["a", "b"], ",", False)]


def test_dialects_are_those_of_the_sniffer():
    rng = random.Random(3)
    for n in range(2_000):
        text = "".join(rng.choice("ab ,;|\t\n\r'\"x\u00e9: .") for _ in range(rng.randrange(120)))
        text = text if n % 3 == 0 else text.replace('"', "").replace("'", "")
        try:
            found = csv.Sniffer().sniff(text, delimiters=grids.DELIMITERS)
            wanted = (found.delimiter, found.quotechar or '"')
        except csv.Error:
            wanted = (",", '"')
        assert grids._read_dialect(text) == (wanted if text.strip() else (",", '"'))
