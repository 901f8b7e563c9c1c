"""Files read as tables and tables written as files, one row for each file, line or document."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.sources import timelines as tl
from colloquy.sources import wav


def stem(path) -> F.Column:
    """The name of a file without folder and ending."""
    return F.regexp_replace(F.regexp_extract(path, "[^/]*$", 0), r"\.[^.]*$", "")


def read_wav(spark: SparkSession, path: str, rate: int | None = None) -> DataFrame:
    """path, rate, samples of each WAV file; with ``rate`` brought to that rate. A file that is no WAV of a known form has null for both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0), b.column(1)):  # one file at a time
                body = content.as_py()
                got = wav.decode(body)
                x = None if got is None else got[0] if rate is None else wav.prepare(body, rate)
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()]), pa.array([None if got is None else rate or got[1]], type=pa.int32()), pa.array([x], type=pa.list_(pa.float32()))], names=["path", "rate", "samples"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, rate int, samples array<float>")


def read_rttm(spark: SparkSession, path: str) -> DataFrame:
    """rec_id, idx, start, end, speaker of the turns of RTTM files; see ``timelines.read_rttm``."""
    return tl.read_rttm(spark.read.text(path), "value")


def write_rttm(t: DataFrame, path: str) -> None:
    """One folder for each recording, with the turns in time order."""
    lines = tl.rttm_lines(t).join(t.select("rec_id", "idx", "start"), ["rec_id", "idx"])
    lines.repartition("rec_id").sortWithinPartitions("rec_id", "start", "idx").select("rec_id", "line").write.partitionBy("rec_id").text(path)


def read_marks(spark: SparkSession, path: str) -> DataFrame:
    """rec_id (the file's stem), second, speaker of the marks of markdown files, in order of their seconds, then as they stand (place)."""
    files = spark.read.text(path, wholetext=True).select(stem(F.input_file_name()).alias("rec_id"), "value")
    return files.select("rec_id", F.posexplode(F.array_sort(tl.parse_marks(F.col("value")), lambda a, b: F.when(a["second"] < b["second"], -1).when(a["second"] > b["second"], 1).otherwise(0)))).select("rec_id", F.col("pos").alias("place"), "col.*")


def read_timelines(spark: SparkSession, path: str) -> DataFrame:
    """rec_id, start, end, speaker of the timelines of JSON files, one document to a file; rec_id is that of the folder as ``write_timelines`` names it, else the file's stem."""
    files = spark.read.text(path, wholetext=True)
    rec = F.col("rec_id").cast("string") if "rec_id" in files.columns else stem(F.input_file_name())
    return tl.parse_timeline_json(files.select(rec.alias("rec_id"), F.col("value").alias("document")))


def write_timelines(t: DataFrame, path: str) -> None:
    """One folder and file for each recording."""
    tl.timeline_json(t).write.partitionBy("rec_id").text(path)


def read_transcripts(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """path, payload, doc, raw, reject of each JSON file; see ``timelines.read_documents``."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("payload"))
    return tl.read_documents(files, "payload", tag)


def write_transcripts(docs: DataFrame, path: str, pretty: bool = False) -> None:
    """The documents from their variant, compact, one to a line, or with ``pretty`` indented, one after the other."""
    text = tl.write_documents(docs).select("payload")
    if pretty:
        text = text.select(_indented("payload").alias("payload"))
    text.write.text(path)


@F.pandas_udf("string")
def _indented(payload):
    import json

    return payload.map(lambda x: None if x is None else json.dumps(json.loads(x), indent=2, ensure_ascii=False))
