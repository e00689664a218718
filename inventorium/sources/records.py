"""Records of separated files that may hold line breaks, from many tasks for each file.

A file is read by lines in byte ranges. Whether a line begins inside a quoted field depends on the parity of the quotes before it, so
one pass counts the quotes of each range, a prefix sum over the ranges of a file gives the parity at the start of each, and
a second pass joins the lines of every record within its range. What a range boundary cuts comes out as fragments, two for each
range at most, which are put together by the place where their record began. No line is shuffled but those fragments.

A quote counts wherever it stands: fields that hold one are quoted, with the quote doubled, as writers do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_OUT = "file string, pos long, record string, part string"
#: Bits of a record's place in its range, below those of the range's rank.
_BITS = 33


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, value): lines in the order of the file within each byte range, which begins at ``start``."""
    read = spark.read.text(path, lineSep="\n")
    return read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def ranges(lines: DataFrame) -> DataFrame:
    """(file, start, rank, quoted): every byte range with lines, its rank over all files, and whether it begins inside quotes.
    A row for each range, which has about 128 MB."""
    own = lines.groupBy("file", "start").agg(F.sum(F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).alias("quotes"))
    before = F.coalesce(F.sum("quotes").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return own.select("file", "start", F.row_number().over(Window.orderBy("file", "start")).cast("long").alias("rank"), (before % 2 == 1).alias("quoted"))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of each range in order. ``part`` is null for a whole one; ``head`` for what belongs to the record of an earlier
    range, ``tail`` for the beginning of one that the range does not end, and ``through`` for a range inside one record."""
    range_, base, quoted, count, kept, headed = None, 0, False, 0, [], False

    def out(rows: list[tuple]) -> pa.RecordBatch:
        files, places, records, parts = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(places, pa.int64()), pa.array(records, pa.string()), pa.array(parts, pa.string())], ["file", "pos", "record", "part"])

    def closing() -> list[tuple]:
        """What is open at the end of a range."""
        return [(range_[0], base + (0 if headed else count), "\n".join(kept), "through" if headed else "tail")] if kept else []

    for batch in batches:
        keys = list(zip(batch.column("file").to_pylist(), batch.column("rank").to_pylist(), strict=True))
        odd = np.asarray(pc.bit_wise_and(pc.count_substring(batch.column("value"), '"'), 1)).astype(bool)
        values, begins = batch.column("value").to_pylist(), batch.column("quoted")
        rows: list[tuple] = []
        for k, key in enumerate(keys):
            if key != range_:
                rows += closing()
                range_, base, quoted, count, kept = key, key[1] << _BITS, begins[k].as_py(), 1, []
                headed = quoted
            kept.append(values[k])
            quoted ^= bool(odd[k])
            if not quoted:
                rows.append((key[0], base if headed else base + count, "\n".join(kept), "head" if headed else None))
                count, kept, headed = count + (not headed), [], False
        if rows:
            yield out(rows)
    if rows := closing():
        yield out(rows)


def in_file_order(raw: DataFrame) -> DataFrame:
    """``raw``, read from files by lines, with pos: by file name and place in the file. Spark deals several files out by size,
    so their rows are numbered after a sort by name; the rows of one file come in order."""
    from ..operators.explore import number_rows

    placed = raw.withColumns({"__file": F.input_file_name(), "pos": F.monotonically_increasing_id()})
    if len(raw.inputFiles()) < 2:
        return placed.drop("__file")
    return number_rows(placed.withColumnRenamed("pos", "__place"), ["__file", "__place"], "pos").drop("__file", "__place")


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, record): the records of a file, or of all files of a folder, with their line breaks; pos rises in the order
    of the files' names and of the records in each. Empty lines are left out."""
    lines = lines_of(spark, path)
    known = lines.join(F.broadcast(ranges(lines)), ["file", "start"], "left")
    # both passes see the same ranges unless the number of cores changed between them
    moved = F.raise_error(F.lit("the byte ranges have moved; set spark.sql.files.minPartitionNum")).cast("long")
    placed = known.select("file", F.coalesce("rank", moved).alias("rank"), "quoted", "value")
    found = placed.mapInArrow(_joined, _OUT)
    whole = found.where("part IS NULL").select("file", "pos", "record")
    # a record that goes over a boundary: its tail, then ranges within it, then a head
    cut = found.where("part IS NOT NULL")
    began = F.max(F.when(F.col("part") == "tail", F.col("pos"))).over(Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    pieces = cut.withColumn("began", F.coalesce(began, F.col("pos"))).groupBy("file", F.col("began").alias("pos")).agg(F.array_sort(F.collect_list(F.struct("pos", "record"))).alias("pieces"))
    mended = pieces.select("file", "pos", F.array_join(F.transform("pieces", lambda p: p["record"]), "\n").alias("record"))
    every = whole.unionByName(mended).withColumn("record", F.regexp_replace("record", r"\r$", ""))
    return every.where("record <> ''")


def read_csv(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """All columns as strings, named by the first record, and pos. The first record of each file is its header."""
    records = csv_records(spark, path)
    firsts = records.groupBy("file").agg(F.min("pos").alias("pos"), F.min_by("record", "pos").alias("header"))
    header = firsts.orderBy("file").select("header").first()
    if header is None:
        return spark.range(0).select(F.col("id").alias("pos"))
    options = {"sep": sep, "quote": '"', "escape": '"', "maxCharsPerColumn": "-1"}
    named = header.header.lstrip("﻿")
    width = len(spark.range(1).select(F.schema_of_csv(F.lit(named), options).alias("s")).first().s.split(", "))
    plain = ", ".join(f"c{k} string" for k in range(width))
    names = spark.range(1).select(F.from_csv(F.lit(named), plain, options).alias("r")).select("r.*").first()
    body = records.join(F.broadcast(firsts.select("file", "pos")), ["file", "pos"], "left_anti")  # a row for each file
    return body.select(F.from_csv("record", plain, options).alias("r"), "pos").select(*[F.col(f"r.c{k}").alias(n or f"_c{k}") for k, n in enumerate(names)], "pos")
