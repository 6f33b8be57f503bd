"""Records of CSV files whose quoted cells hold line breaks, read in splits.

Whether a line break ends a record depends on all quotes before it, yet a large
file must not be one task.  At a line break the parser is in one of two states,
*outside* or *inside* a quoted cell, so a line, and so a whole split, is a map of
those two states onto themselves:

1. One scan folds the lines of each split into its map (``split_maps``), a row a
   split, and takes the first record of each file, its header.
2. A running composition over the splits of a file gives the state in which each
   split begins (``split_states``): the last constant map before it, turned by the
   swaps since.  Quotes that only stand around cells give no constants, so this is
   the parity of all quotes before.
3. A second scan cuts the lines of each split into records.  Only the records that
   cross a split leave their task, as fragments that are put together per file.

The table of states has a row for each split (some hundred bytes for 128 MB) and is
broadcast; no text is shuffled but the fragments.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinfold.operators.scratch import settle

#: The rest of a quoted cell with its closing quote; two quotes are one of the text.
_REST = re.compile(r'[^"]*+(?:""[^"]*+)*+"')
COMPLETE, TAIL, FRONT, MIDDLE = range(4)  # a whole record; ends one, begins one, is inside one


def ends_inside(line: str, inside: bool) -> bool:
    """The state behind a line, from that before it.  A cell is quoted if it
    begins with a quote; what follows the closing quote counts to the next comma."""
    at = 0
    if not inside and line.startswith('"'):
        at, inside = 1, True
    while True:
        if inside:
            found = _REST.match(line, at)
            if found is None:
                return True
            at, inside = found.end(), False
        opening = line.find(',"', at)
        if opening < 0:
            return False
        at, inside = opening + 2, True


def lines(spark: SparkSession, paths: list[str], **options) -> DataFrame:
    """(path, start, value): lines with their file and the start of their split,
    in order inside a task."""
    rows = spark.read.options(**options).text(paths, lineSep="\n")
    start, value = F.col("_metadata.file_block_start"), F.col("value")
    value = F.when((start == 0) & value.startswith("\ufeff"), F.substr(value, F.lit(2))).otherwise(value)  # a byte order mark
    return rows.select(F.col("_metadata.file_path").alias("path"), start.alias("start"), value.alias("value"))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """The lines of each split in a batch."""
    starts, files = batch.column("start").to_numpy(), batch.column("path").dictionary_encode().indices.to_numpy(zero_copy_only=False)
    edges = np.flatnonzero(np.diff(starts, prepend=-1) | np.diff(files, prepend=-1))
    for a, b in zip(edges, [*edges[1:], len(batch)], strict=True) if len(batch) else ():
        yield batch.column("path")[a].as_py(), int(starts[a]), batch.slice(a, b - a)


def _quoted(values: pa.Array) -> np.ndarray:
    """The lines that have a quote, and so may change the state."""
    return np.flatnonzero(pc.match_substring(values, '"').to_numpy(zero_copy_only=False))


_MAPS = pa.schema([("path", pa.string()), ("start", pa.int64()), ("from_outside", pa.bool_()), ("from_inside", pa.bool_()), ("header", pa.string()), ("header_place", pa.int64())])


def split_maps(rows: DataFrame, multiline: bool) -> DataFrame:
    """(path, start, from_outside, from_inside, header, header_place): whether a
    split ends inside a quoted cell, for both states it may begin in, and at the
    start of a file its first record that is not blank, with its place; settled."""

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, states, header, at, open_header = None, [False, True], [], 0, False

        def folded() -> pa.RecordBatch:
            row = [[key[0]], [key[1]], [states[0]], [states[1]], ["\n".join(header) if key[1] == 0 else None], [at]]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, _MAPS, strict=True)], schema=_MAPS)

        for batch in batches:
            for path, start, part in _runs(batch):
                if (path, start) != key:
                    if key is not None:
                        yield folded()
                    key, states, header, at, open_header = (path, start), [False, True], [], 0, start == 0
                values = part.column("value")
                for i in range(len(values) if open_header else 0):
                    line = values[i].as_py()
                    if not header and not line.strip(" \t\r"):
                        at += 1
                        continue
                    header.append(line)
                    if not (multiline and ends_inside("\n".join(header), False)):
                        open_header = False
                        break
                if not multiline:
                    states = [False, False]
                    continue
                for i in _quoted(values):
                    line = values[int(i)].as_py()
                    states = [ends_inside(line, s) for s in states] if states[0] != states[1] else [ends_inside(line, states[0])] * 2
        if key is not None:
            yield folded()

    return settle(rows.mapInArrow(maps, "path string, start long, from_outside boolean, from_inside boolean, header string, header_place long"), "split-maps")


def split_states(maps: DataFrame) -> DataFrame:
    """The maps with ``inside``, the state in which each split begins, and
    ``crossed``, whether a record crosses its begin or its end."""
    before = Window.partitionBy("path").orderBy("start")
    swap = (F.col("from_outside") & ~F.col("from_inside")).cast("long")
    constant = F.when(F.col("from_outside") == F.col("from_inside"), F.struct(F.col("from_outside").cast("long").alias("state"), F.col("_swaps").alias("swaps")))
    rows = maps.withColumn("_swaps", F.sum(swap).over(before)).withColumn("_constant", constant)
    earlier = before.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_last", F.last("_constant", ignorenulls=True).over(earlier)).withColumn("_done", F.coalesce(F.lag("_swaps").over(before), F.lit(0)))
    turned = F.coalesce(F.col("_last.state"), F.lit(0)) + F.col("_done") - F.coalesce(F.col("_last.swaps"), F.lit(0))
    rows = rows.withColumn("inside", turned % 2 == 1)
    crossed = F.col("inside") | F.when(F.col("inside"), F.col("from_inside")).otherwise(F.col("from_outside"))
    return rows.withColumn("crossed", crossed).drop("_swaps", "_constant", "_last", "_done")


def _record_cuts(inside: bool, values: pa.Array) -> np.ndarray:
    """Whether each line ends inside a quoted cell."""
    after, at = np.full(len(values), inside), 0
    for i in _quoted(values):
        after[at:i] = inside
        inside = ends_inside(values[int(i)].as_py(), inside)
        at = i
    after[at:] = inside
    return after


_CUT = pa.schema([("path", pa.string()), ("start", pa.int64()), ("place", pa.int64()), ("cut", pa.int32()), ("value", pa.string())])
_CUT_TYPE = "path string, start long, place long, cut int, value string"


def _cut_records(rows: DataFrame, multiline: bool) -> DataFrame:
    """(path, start, place, cut, value): records of each split, from its lines with
    ``inside``; ``cut`` tells which cross its begin or end."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, inside, fresh, place, waiting = None, False, True, 0, []

        def made(values: pa.Array, kinds: np.ndarray) -> pa.RecordBatch:
            n = len(values)
            columns = [pa.array([key[0]] * n, pa.string()), pa.array(np.full(n, key[1])), pa.array(np.arange(place, place + n)), pa.array(kinds.astype("i4")), values]
            return pa.RecordBatch.from_arrays(columns, schema=_CUT)

        def left() -> Iterator[pa.RecordBatch]:
            if waiting:
                yield made(pa.array(["\n".join(waiting)]), np.array([MIDDLE if fresh and begun else FRONT]))

        for batch in batches:
            for path, start, part in _runs(batch):
                if (path, start) != key:
                    yield from left()
                    begun = multiline and bool(part.column("inside")[0].as_py())
                    key, inside, fresh, place, waiting = (path, start), begun, True, 0, []
                values = part.column("value")
                after = _record_cuts(inside, values) if multiline else np.zeros(len(values), bool)
                inside = bool(after[-1])
                ends = np.flatnonzero(~after) + 1
                if len(ends):
                    listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), values.slice(0, int(ends[-1])))
                    records = pc.binary_join(listed, "\n")
                    if waiting:
                        first = pa.array(["\n".join([*waiting, records[0].as_py()])])
                        records, waiting = pa.concat_arrays([first, records.slice(1)]), []
                    kinds = np.full(len(records), COMPLETE)
                    if fresh and begun:
                        kinds[0] = TAIL
                    yield made(records, kinds)
                    place, fresh = place + len(records), False
                waiting += values.slice(int(ends[-1]) if len(ends) else 0).to_pylist()
        yield from left()

    return rows.mapInArrow(cut, _CUT_TYPE)


def _put_together(fragments: DataFrame) -> DataFrame:
    """(path, start, place, value) of the records that cross splits, at the place
    of their first fragment."""
    order = Window.partitionBy("path").orderBy("start", "place")
    which = fragments.withColumn("_record", F.sum((F.col("cut") == FRONT).cast("long")).over(order))
    whole = which.groupBy("path", "_record").agg(F.array_sort(F.collect_list(F.struct("start", "place", "value"))).alias("parts"))
    first = F.get("parts", F.lit(0))
    return whole.select("path", first["start"].alias("start"), first["place"].alias("place"), F.array_join(F.col("parts.value"), "\n").alias("value"))


def records(rows: DataFrame, splits: DataFrame, multiline: bool) -> DataFrame:
    """(path, start, place, value) of every record, from ``lines`` and
    ``split_states`` (settled); ``start`` and ``place`` give their order in a file.
    A last record whose quote is never closed ends with its file."""
    known = splits.select("path", "start", "inside").distinct()
    cut = _cut_records(rows.join(F.broadcast(known), ["path", "start"]), multiline)
    whole = cut.filter(F.col("cut") == COMPLETE).drop("cut")
    if not multiline or splits.filter("crossed").isEmpty():
        return whole
    few = splits.filter("crossed").select("path", "start", "inside").distinct()
    crossing = _cut_records(rows.join(F.broadcast(few), ["path", "start"]), True).filter(F.col("cut") != COMPLETE)
    return whole.unionByName(_put_together(crossing))


def without_return(value: Column) -> Column:
    """A record without the carriage return of its line end."""
    return F.regexp_replace(value, r"\r\z", "")
