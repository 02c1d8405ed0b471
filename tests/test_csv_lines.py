"""Import files are read line by line, with the records and errors of a parse of the whole file."""

from __future__ import annotations

from conftest import rows
from pyspark.sql import functions as F

from answerloom.sources import records as R

FILES = {
    "plain.csv": b"category,question,answer\na,b,c\nd,e,f\n",
    "no end.csv": b"question,answer\nb,c",
    "mark.csv": b"\xef\xbb\xbfQuestion , ANSWER\r\nb,c\r\n",
    "mark no end.csv": b"\xef\xbb\xbfquestion,answer\nb,\"c",
    "open quote.csv": b"question,answer\nb,\"c\n",
    "breaks.csv": b'question,answer\n"b\r\nb\n\nb",c\n\n"x ""y"" z",\rq,r\n',
    "empty.csv": b"", "blank.csv": b"\n\n", "header.csv": b"question",
    "bad.csv": b"question,answer\nb,c\nd,\xff\n", "bad end.csv": b"question,answer\nb,\xe2\x82", "bad line.csv": b"\xef\xbb\xbfquestion,answer\nb,\xe2\x82\nx,\xffy\n",
    "long.csv": b"category,question,answer\n" + b'x,"line\nbreak",y\n' * 25_000, "surplus.csv": b"question\nb,c,d\ne\n",
}


def test_lines_give_what_whole_files_give(spark, tmp_path, monkeypatch):
    for name, content in FILES.items():
        (tmp_path / name).write_bytes(content)
    path = f"file:{tmp_path}"
    whole = spark.read.format("binaryFile").load(path).select(F.col("path").alias("source_file"), "content")
    want = R.parse_qa_csv(whole)
    calls = []
    monkeypatch.setattr(R, "parse_qa_csv", lambda files: calls.append(files))
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in held:
            spark.conf.set(k, "4096")  # the long file has many splits
        assert rows(R.read_qa_csv(spark, path)) == rows(want.filter("error IS NULL").drop("error"))
        assert rows(R.qa_csv_errors(spark, path)) == rows(want.filter("error IS NOT NULL").select("source_file", "row_no", "error"))
        assert {k: spark.conf.get(k) for k in held} == dict.fromkeys(held, "4096")
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert calls == []  # before, every file was held as a whole
