"""Ordered scans: what only a pass over a key's sorted rows can say."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Result rows of a batch.
ROWS = 10_000


def cells(column: pa.Array) -> list:
    """The values as Python objects; by numpy where that gives the same ones, which is several times as fast."""
    kind = column.type
    plain = pa.types.is_string(kind) or pa.types.is_large_string(kind) or (not column.null_count and (pa.types.is_integer(kind) or pa.types.is_floating(kind)))
    return column.to_numpy(zero_copy_only=False).tolist() if plain else column.to_pylist()


def scan_keys(df: DataFrame, keys: list[str], order: list[str], columns: list[str], fold: Callable[[Iterable[tuple]], Iterator[tuple]], schema: StructType, dealt: bool = False) -> DataFrame:
    """Rows ``keys`` + what ``fold`` makes of a key's ``columns`` in ascending order (nulls first).

    ``fold`` gets an iterator and yields tuples, so a task holds a batch of rows
    and the state of one key however many rows the key has. ``dealt``: a key's
    rows are in one partition already.
    """
    picked = (df if dealt else df.repartition(*keys)).sortWithinPartitions(*keys, *order).select(*keys, *columns)
    width, kinds = len(keys), to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def values() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*map(cells, batch.columns), strict=True)

        out: list[tuple] = []
        for key, own in groupby(values(), key=itemgetter(slice(width))):
            for made in fold(map(itemgetter(slice(width, None)), own)):
                out.append(key + made)
                if len(out) == ROWS:
                    yield batch_of(out)
                    out = []
        if out:
            yield batch_of(out)

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds)

    return picked.mapInArrow(run, schema)


def kept_apart(distance: int) -> Callable[[Iterable[tuple]], Iterator[tuple]]:
    """Rows kept one after another if their first value is ``distance`` or more from that of the last kept one."""

    def fold(rows: Iterable[tuple]) -> Iterator[tuple]:
        last = None
        for row in rows:
            if last is None or row[0] - last >= distance:
                last = row[0]
                yield row

    return fold


def gathered(size: int) -> Callable[[Iterable[tuple]], Iterator[tuple]]:
    """(start, end, bases) rows joined until a region holds more than ``size`` bases."""

    def fold(rows: Iterable[tuple]) -> Iterator[tuple]:
        region = None
        for s, e, bases in rows:
            if region is None or region[2] > size:
                if region is not None:
                    yield region
                region = (s, e, bases)
            else:
                region = (region[0], max(region[1], e), region[2] + bases)
        if region is not None:
            yield region

    return fold


def best_of_overlaps(rows: Iterable[tuple]) -> Iterator[tuple]:
    """(start, end, score) rows; of one that overlaps the last kept the better stays, the earlier of equals."""
    last = None
    for row in rows:
        if last is None or row[0] >= last[1]:
            if last is not None:
                yield last
            last = row
        elif row[2] > last[2]:
            last = row
    if last is not None:
        yield last


def depth_runs(tolerance: float) -> Callable[[Iterable[tuple]], Iterator[tuple]]:
    """(position, depth) rows as runs (start, end, sum of depths): positions follow each other and depths stay within a share of the run's first, both bounds rounded."""

    def fold(rows: Iterable[tuple]) -> Iterator[tuple]:
        run, low, high = None, 0, 0
        for at, depth in rows:
            if run is not None and at == run[1] and low <= depth <= high:
                run = (run[0], at + 1, run[2] + depth)
            else:
                if run is not None:
                    yield run
                run, low, high = (at, at + 1, depth), int(depth * (1 - tolerance) + 0.499), int(depth * (1 + tolerance) + 0.499)
        if run is not None:
            yield run

    return fold


def numbered_by_site(rows: Iterable[tuple]) -> Iterator[tuple]:
    """(position, sample, record, ref, allele, second allele or none, genotype) rows as (position, sample, ref, alt, genotype), of a sample's records at a position the last.

    Alleles are numbered by the position, in the order of samples; a sample's
    are known when its rows have passed, so the state is a position's list.
    """
    last, known, late = None, [], []

    def number() -> tuple:
        at, sample, _, ref, x, y, genotype = last
        k = known.index(x) + 1
        if y is not None:
            j = known.index(y) + 1
            return (at, sample, ref, f"{y},{x}", f"{k}|{j}") if j < k else (at, sample, ref, f"{x},{y}", genotype)
        return (at, sample, ref, f"{known[0]},{x}", genotype.replace("1", "2")) if k == 2 else (at, sample, ref, x, genotype)

    for row in rows:
        if last is not None and row[:3] != last[:3]:
            # Second alleles of equal records come after the first ones.
            known += [y for y in dict.fromkeys(sorted(late)) if y not in known] if late else ()
            late = []
            if row[:2] != last[:2]:
                yield number()
                if row[0] != last[0]:
                    known = []
        if row[4] not in known:
            known.append(row[4])
        if row[5] is not None:
            late.append(row[5])
        last = row
    if last is not None:
        known += [y for y in dict.fromkeys(sorted(late)) if y not in known]
        yield number()
