"""One large JSON array file read by many tasks.

Spark's text reader cuts a file into byte ranges at any record separator, so the file is read as records that end in
``}``. Whether such a brace ends an element depends on everything before it: on whether a string is open and how deep
the nesting is. A first pass sums up each range for both answers to "is a string open at its start" (depths relative
to the start); a scan over these summaries, one small row per range, gives the true state in front of every
range, and a second pass cuts the elements. Elements that lie across a border are put together from their pieces.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lectern.functions.text import WHITESPACE
from lectern.plans.scratch import settle

_MARK = re.compile(r'\\.|["{}\[\]]', re.DOTALL)


class Scanner:
    """Walks through the text of a range from a given state."""

    def __init__(self, quoted: bool, depth: int, cut: bool):
        self.quoted, self.depth, self.cut = quoted, depth, cut
        self.closings: dict[int, int] = {}  # by depth after a closing bracket
        self.open = [""] if cut and depth >= 2 else None  # text of the element that is open, if elements are cut
        self.done: list[str] = []  # one text for each element that ended in the range
        self.from_before = cut and depth >= 2

    def feed(self, text: str) -> None:
        start = 0
        for mark in _MARK.finditer(text):
            c = mark[0]
            if c == '"':
                self.quoted = not self.quoted
            elif self.quoted or c[0] == "\\":
                continue
            elif c in "{[":
                self.depth += 1
                if self.cut and self.depth == 2:
                    self.open, start = [], mark.start()
            else:
                self.depth -= 1
                self.closings[self.depth] = self.closings.get(self.depth, 0) + 1
                if self.cut and self.depth == 1:
                    self.done.append("".join([*(self.open or []), text[start:mark.end()]]))
                    self.open = None
        if self.open is not None:
            self.open.append(text[start:])


def _ranges(frames: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[str]]]:
    """The records of each range, one range after the other; a range's records follow each other."""
    rows = (row for batch in frames for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    held = next(rows, None)
    while held is not None:
        key = held[:2]

        def records() -> Iterator[str]:
            nonlocal held
            while held is not None and held[:2] == key:
                yield held[2] + "}"
                held = next(rows, None)

        yield key, records()
        while held is not None and held[:2] == key:
            held = next(rows, None)


def _summary(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (file, start), records in _ranges(frames):
        both, first = [Scanner(quoted, 0, False) for quoted in (False, True)], ""
        for text in records:
            first = first or text.strip(WHITESPACE)[:1]
            for scanner in both:
                scanner.feed(text)
        ends = [{"quoted": s.quoted, "depth": s.depth, "closings": s.closings} for s in both]
        yield pa.RecordBatch.from_pylist([{"file": file, "start": start, "first": first, "ends": json.dumps(ends)}])


def _states(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state in front of each range, from the summaries in order."""
    file, quoted, depth, closed = None, False, 0, 0
    for batch in frames:
        rows = []
        for name, start, first, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if name != file:
                file, quoted, depth, closed = name, False, 0, 0
                if first != "[":
                    raise ValueError(f"the document must be a JSON array: {name}")
            rows.append({"file": name, "start": start, "quoted": quoted, "depth": depth, "closed": closed})
            end = json.loads(ends)[int(quoted)]
            closed += end["closings"].get(str(1 - depth), 0)
            quoted, depth = end["quoted"], depth + end["depth"]
        if rows:
            yield pa.RecordBatch.from_pylist(rows)


def _elements(states: dict[tuple[str, int], tuple[bool, int, int]]):
    """Elements of each range: ``file, element, start, value, whole``."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, start), records in _ranges(frames):
            quoted, depth, closed = states[file, start]
            scanner = Scanner(quoted, depth, True)
            for text in records:
                scanner.feed(text)
                # elements that began here are given away at once
                if len(scanner.done) >= 1000:
                    yield out(file, start, closed, scanner.done, scanner.from_before)
                    closed, scanner.done, scanner.from_before = closed + len(scanner.done), [], False
            rest = [] if scanner.open is None else ["".join(scanner.open)]
            if scanner.done or rest:
                yield out(file, start, closed, scanner.done + rest, scanner.from_before, len(rest))

    def out(file: str, start: int, closed: int, values: list[str], from_before: bool, rest: int = 0) -> pa.RecordBatch:
        n = len(values)
        whole = [not (from_before and i == 0) and i < n - rest for i in range(n)]
        return pa.RecordBatch.from_pydict({"file": [file] * n, "element": list(range(closed, closed + n)), "start": [start] * n, "value": values, "whole": whole})

    return run


def array_elements(spark: SparkSession, path: str) -> DataFrame:
    """``file, element, value``: the objects and arrays of JSON array files as text, numbered in each file."""
    records = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    # one small row per range
    ranges = settle(records.mapInArrow(_summary, "file string, start bigint, first string, ends string"), "ranges")
    ordered = ranges.repartition("file").sortWithinPartitions("file", "start")
    states = settle(ordered.mapInArrow(_states, "file string, start bigint, quoted boolean, depth bigint, closed bigint"), "states")
    known = {(r.file, r.start): (r.quoted, r.depth, r.closed) for r in states.toLocalIterator()}
    found = records.mapInArrow(_elements(known), "file string, element bigint, start bigint, value string, whole boolean")
    found = settle(found, "elements")
    pieces = F.array_sort(F.collect_list(F.struct("start", "value")))
    joined = found.where("NOT whole").groupBy("file", "element").agg(pieces.alias("p"))
    joined = joined.select("file", "element", F.array_join(F.transform("p", lambda x: x["value"]), "").alias("value"))
    return found.where("whole").select("file", "element", "value").unionByName(joined)


def read_json_array(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON files that each hold one array of objects; other elements are dropped, another document is an error.

    A file is read in ranges of ``spark.sql.files.maxPartitionBytes`` by as many tasks. The state in front of
    each range (about thirty bytes of a range of megabytes) is all that the driver sees.
    """
    objects = array_elements(spark, path).where(F.col("value").startswith("{"))
    return objects.select(F.from_json("value", schema).alias("r")).select("r.*")
