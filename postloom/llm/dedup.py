"""Copies of a record hidden by formatting (problem 2)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from postloom.llm.components import connected_components
from postloom.plans.lineage import cut

_LABELLED = r"(?U)^[^\p{L}\p{N}]*\p{L}[\p{L} ]{0,30}:\s+\S"
_HAS_LABELLED = r"(?Um)^[^\p{L}\p{N}\n]*\p{L}[\p{L} ]{0,30}:[^\S\n]+\S"


def plain(c: Column) -> Column:
    """Letters and digits only, in one case."""
    return F.regexp_replace(F.lower(F.upper(c)), r"[^\p{L}\p{N}]+", "")


def sorted_labels(c: Column) -> Column:
    """Letters and digits of a text, its labelled lines ("Label: value") sorted and put first; null where it has no labelled line."""
    lines = F.split(c, r"\r\n|\r|\n")
    is_labelled = lambda x: x.rlike(_LABELLED)
    labelled = F.array_join(F.array_sort(F.transform(F.filter(lines, is_labelled), plain)), "\n")
    rest = plain(F.array_join(F.filter(lines, lambda x: ~is_labelled(x)), " "))
    return F.when(c.rlike(_HAS_LABELLED), F.concat(labelled, F.lit("\n\n"), rest))


_SCANNED = "kind int, id long, rep long, n long, key_a string, key_b string"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walks rows sorted by (h, key_a, key_b, id) and compares each with the one before, by the full keys.

    Gives kind 0 for each copy (id, rep), kind 1 for each run (rep, n), and kind 2, with the keys, for the runs of the first and the last h:
    these may go on in another range.
    """
    run: list = []  # h, key_a, key_b, rep, n
    first_h = None
    edge: list[tuple] = []  # runs of the first and of the current h
    for batch in batches:
        out: list[tuple] = []
        hs, a, b, ids = batch.column(0).to_numpy(), batch.column(1), batch.column(2), batch.column(3).to_numpy().tolist()
        same = [False, *(hs[1:] == hs[:-1]).tolist()]
        hs = hs.tolist()
        key_a = key_b = None
        for i, h in enumerate(hs):
            if run and (same[i] if i else run[0] == h):
                if run[1] is None:
                    run[1], run[2] = a[i - 1].as_py(), b[i - 1].as_py()
                key_a, key_b = a[i].as_py(), b[i].as_py()
                if run[1] == key_a and run[2] == key_b:
                    run[4] += 1
                    out.append((0, ids[i], run[3], 1, None, None))
                    continue
            else:
                key_a = key_b = None
            if run:
                out.append((1, run[3], run[3], run[4], None, None))
                if run[0] == h or run[0] == first_h:
                    edge.append((run[0], 2, run[3], run[3], run[4], run[1], run[2]) if run[1] is not None else (run[0], 2, run[3], run[3], run[4], a[i - 1].as_py(), b[i - 1].as_py()))
                if run[0] != h:
                    edge = [x for x in edge if x[0] == first_h]
            else:
                first_h = h
            run = [h, key_a, key_b, ids[i], 1]
        if run and run[1] is None and len(hs):  # the next batch can't look back into this one
            run[1], run[2] = a[len(hs) - 1].as_py(), b[len(hs) - 1].as_py()
        yield _batch(out)
    if run:
        edge.append((run[0], 2, run[3], run[3], run[4], run[1], run[2]))
        yield _batch([(1, run[3], run[3], run[4], None, None), *(x[1:] for x in edge)])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * 6
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
    names = ("kind", "id", "rep", "n", "key_a", "key_b")
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=list(names))


def collapse_copies(df: DataFrame, id_col: str = "email_id", key_col: str = "message_id", text_col: str = "body") -> tuple[DataFrame, DataFrame]:
    """Collapses records that are equal up to formatting.

    Returns (copies, groups): ``copies(id, rep)`` pairs each further copy with the smallest id of its group, ``groups(rep, n)`` has one row
    for each distinct record with its exact number of copies.

    Two records are copies when their keys are equal as letters and digits in one case, and their texts are either equal in that form (white
    space, wrapping, case and punctuation differ) or equal with their labelled lines sorted (the order differs too). Both forms go as rows
    through one pass: they are range-partitioned by (hash of the form, id), so that one group of any size spreads over several ranges, sorted
    externally, and adjacent rows are compared by their full keys. Runs at the border of a range, a few for each range, are joined afterwards,
    and the pairs of both forms are united as connected components.

    A record without a key (null, or no letter or digit in it) is no copy of any other. A null text counts as empty. Ids are taken as unique:
    rows that repeat an id are one record. Rows without an id are left out.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(plain(F.col(key_col)), F.lit("")).alias("key_a"), F.array(plain(text), sorted_labels(text)).alias("forms"))
    rows = keyed.filter("id is not null and key_a <> ''").select("id", "key_a", F.posexplode("forms").alias("form", "key_b")).filter("key_b is not null")
    ranged = rows.select(F.xxhash64("key_a", "form", "key_b").alias("h"), F.concat(F.col("form").cast("string"), F.col("key_a")).alias("key_a"), "key_b", "id").repartitionByRange("h", "id").sortWithinPartitions("h", "key_a", "key_b", "id")
    scanned = cut(ranged.mapInArrow(_scan, _SCANNED).filter("kind <> 1"))
    edges = scanned.filter("kind = 2").select("key_a", "key_b", "rep").distinct()
    moved = edges.groupBy("key_a", "key_b").agg(F.min("rep").alias("first"), F.collect_set("rep").alias("reps")).filter(F.size("reps") > 1).select(F.explode("reps").alias("u"), F.col("first").alias("v"))
    links = scanned.filter("kind = 0").select(F.col("id").alias("u"), F.col("rep").alias("v")).unionByName(moved)
    copies = cut(connected_components(links).filter("id <> component").select("id", F.col("component").alias("rep")))
    groups = df.select(F.col(id_col).cast("long").alias("id")).filter("id is not null").distinct().join(copies, "id", "left").groupBy(F.coalesce("rep", "id").alias("rep")).agg(F.count("*").alias("n"))
    return copies, groups
