"""Long spans that stand verbatim in more than one record (problem 3)."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from postloom.llm.chunks import GEAR, Chunker
from postloom.plans.lineage import cut

#: Characters hashed at a time in a task.
_AT_ONCE = 1_000_000
#: Different hash values of records whose texts are looked at again; as many rows are broadcast at most.
_BUCKETS = 1 << 20


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[list[int], list[str], list]]:
    """Parts of a batch with about ``_AT_ONCE`` characters: ids, texts, and the third column if there is one."""
    ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    more = batch.column(2).to_pylist() if batch.num_columns > 2 else [None] * len(ids)
    first = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size > _AT_ONCE or i == len(texts) - 1:
            yield ids[first : i + 1], texts[first : i + 1], more[first : i + 1]
            first, size = i + 1, 0


def _chunk_rows(least: int, spread: int):
    before, after = spread + GEAR - 2, spread

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts, _ in _groups(batch):
                c = Chunker(texts, spread)
                start, end = c.boundaries[:-1], c.boundaries[1:]
                text = c.text_of[start]
                low, high = c.starts[text], c.starts[text + 1]
                # The characters that the chunk's two ends depend on belong to it.
                inside = (start - before >= low) & (end + after <= high) & (end - start <= spread)
                start, end, text, low, high = start[inside] - before, end[inside] + after, text[inside], low[inside], high[inside]
                w0 = start - (least - (end - start)) // 2
                has_window = (w0 >= low) & (w0 + least <= high)
                w0 = np.where(has_window, w0, low)
                window = c.digest(w0, np.where(has_window, w0 + least, low), 1)
                arrays = [pa.array(np.array(ids, dtype=np.int64)[text]), pa.array(((start - low) << 32) | (end - low)), pa.array(c.digest(start, end, 0)), pa.array(window, mask=~has_window)]
                yield pa.RecordBatch.from_arrays(arrays, names=["rec", "span", "d", "c"])

    return run


_FLAGGED = "rec long, span long, d long, c long, status int, edge int"


def _rows(rec, span, d, c, has, status, edge) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rec), 20_000):
        k = slice(at, at + 20_000)
        yield pa.RecordBatch.from_arrays([pa.array(rec[k]), pa.array(span[k]), pa.array(d[k]), pa.array(c[k], mask=~has[k]), pa.array(status[k].astype(np.int32)), pa.array(edge[k].astype(np.int32))], names=["rec", "span", "d", "c", "status", "edge"])


def _flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Flags the rows of one range, sorted by (d, c, rec), batch by batch. Status 2: another record has the same window; 1: the same chunk.

    A row waits for the next batch only while all rows of its chunk, or of its window, are of one record; so what waits is part of one record,
    however many rows have a chunk. Edge 2: the row's window may be shared in another range, 1: its chunk may. Rows of status -1 are the
    least and the greatest record of the first and the last chunk (edge 1) and window (edge 2) of the range.
    """
    kept: tuple | None = None  # rows that wait
    first: tuple | None = None  # d, has, c of the first row
    now: tuple | None = None  # d, least and greatest rec of its chunk, has, c, least and greatest rec of its window, of the last row
    begun: list[tuple | None] = [None, None]  # least and greatest rec of the first chunk and window

    def groups(new: np.ndarray, rec: np.ndarray, known: tuple[int, int] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.flatnonzero(new)
        low, high = np.minimum.reduceat(rec, at), np.maximum.reduceat(rec, at)
        if known is not None:
            low[0], high[0] = min(low[0], known[0]), max(high[0], known[1])
        return low, high, np.cumsum(new) - 1

    def emit(rows: tuple, status: np.ndarray, last: bool) -> Iterator[pa.RecordBatch]:
        rec, span, d, c, has = rows
        at_first = (d == first[0], (d == first[0]) & (has == first[1]) & (~has | (c == first[2])))
        at_last = (d == now[0], (d == now[0]) & (has == now[3]) & (~has | (c == now[4]))) if last else (np.zeros(len(d), bool),) * 2
        edge = np.where((at_first[1] | at_last[1]) & has & (status < 2), 2, np.where((at_first[0] | at_last[0]) & (status < 1), 1, 0))
        k = (status > 0) | (edge > 0)
        yield from _rows(rec[k], span[k], d[k], c[k], has[k] & (edge[k] == 2), status[k], edge[k])

    for batch in batches:
        if not batch.num_rows:
            continue
        c = batch.column(3)
        rows = (batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(), c.fill_null(0).to_numpy(zero_copy_only=False), c.is_valid().to_numpy(zero_copy_only=False))
        if kept is not None and len(kept[0]):
            rows = tuple(np.concatenate(x) for x in zip(kept, rows))
        rec, span, d, c, has = rows
        first = first or (d[0], has[0], c[0])
        new_d = np.concatenate(([True], d[1:] != d[:-1]))
        new_c = new_d | np.concatenate(([True], (c[1:] != c[:-1]) | (has[1:] != has[:-1])))
        same_d = now is not None and now[0] == d[0]
        same_c = same_d and now[3] == has[0] and now[4] == c[0]
        low_d, high_d, of_d = groups(new_d, rec, now[1:3] if same_d else None)
        low_c, high_c, of_c = groups(new_c, rec, now[5:7] if same_c else None)
        many_d, many_c = low_d != high_d, low_c != high_c
        for k, own in enumerate((d == first[0], (d == first[0]) & (has == first[1]) & (c == first[2]))):
            if own.any():
                low, high = int(rec[own].min()), int(rec[own].max())
                begun[k] = (low, high) if begun[k] is None else (min(low, begun[k][0]), max(high, begun[k][1]))
        status = np.where(many_c[of_c] & has, 2, np.where(many_d[of_d], 1, 0))
        n = len(rec)
        stop = n if many_d[-1] and many_c[-1] else int(np.flatnonzero(new_c)[-1]) if many_d[-1] else int(np.flatnonzero(new_d)[-1])
        now = (d[-1], low_d[-1], high_d[-1], has[-1], c[-1], low_c[-1], high_c[-1])
        yield from emit(tuple(x[:stop] for x in rows), status[:stop], False)
        kept, waiting = tuple(x[stop:] for x in rows), status[stop:]
    if now is None:
        return
    yield from emit(kept, waiting, True)
    marks = [(first[0], 0, False, *begun[0]), (now[0], 0, False, *now[1:3])]
    marks += [(first[0], first[2], True, *begun[1])] * bool(first[1]) + [(now[0], now[4], True, *now[5:7])] * bool(now[3])
    r, x, y, z = (np.array(v) for v in zip(*((r, d, c, of_c) for d, c, of_c, low, high in marks for r in (low, high))))
    yield from _rows(r.astype(np.int64), np.zeros(len(r), np.int64), x.astype(np.int64), y.astype(np.int64), z.astype(bool), np.full(len(r), -1), np.where(z, 2, 1))


def _windows(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts, spans in _groups(batch):
                c = Chunker(texts, 1 << 60)
                whose, at = [], []
                for i, own in enumerate(spans):
                    length = len(texts[i])
                    places = np.unique(np.concatenate([np.arange(max(0, (s & 0xFFFFFFFF) - least), min(s >> 32, length - least) + 1) for s in own]))
                    whose.append(np.full(len(places), i))
                    at.append(places)
                whose, at = np.concatenate(whose), np.concatenate(at)
                start = c.starts[whose] + at
                arrays = [pa.array(np.array(ids, dtype=np.int64)[whose]), pa.array(at.astype(np.int64)), pa.array(c.digest(start, start + least, 0)), pa.array(c.digest(start, start + least, 1))]
                yield pa.RecordBatch.from_arrays(arrays, names=["rec", "span", "d", "c"])

    return run


def _rims(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Digests of the chunks that some window reaches beyond what the record's settled windows cover."""
        for batch in batches:
            out: set[int] = set()
            for rows in batch.column(0).to_pylist():
                spans = [(r["span"] >> 32, r["span"] & 0xFFFFFFFF, r["d"], r["status"]) for r in rows]
                lows: list[int] = []
                highs: list[int] = []
                for low in sorted(a - (least - (b - a)) // 2 for a, b, _, status in spans if status == 2):
                    if highs and low <= highs[-1]:
                        highs[-1] = low + least
                    else:
                        lows.append(low)
                        highs.append(low + least)
                for a, b, d, _ in spans:
                    k = bisect_right(lows, max(0, b - least)) - 1
                    if k < 0 or highs[k] < a + least:
                        out.add(d)
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64())], names=["d"])

    return run


def _compare(rows: DataFrame) -> DataFrame:
    """(rec, span, d, status) of the ``rows(rec, span, d, c)`` that other records share: status 2 with the same d and c, 1 with the same d only.

    Rows are range-partitioned by (digests, record), sorted, and compared with their neighbours, so a digest that a third of all records have
    spreads over many ranges. What is still open at the borders of ranges, rows of one record for each, is settled afterwards.
    """
    order = ["d", "c", "rec"]
    flagged = cut(rows.select("rec", "span", "d", "c").repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_flag, _FLAGGED))
    marks = flagged.filter("status = -1")
    d_edges = marks.groupBy("d").agg((F.min("rec") != F.max("rec")).alias("many_d")).filter("many_d")
    c_edges = marks.filter("edge = 2").groupBy("d", "c").agg((F.min("rec") != F.max("rec")).alias("many_c")).filter("many_c")
    edges = flagged.filter("edge > 0 and status >= 0")
    at_edges = edges.join(c_edges, ["d", "c"], "left").join(d_edges, "d", "left").withColumn("status", F.greatest("status", F.when(F.col("many_c"), 2).when(F.col("many_d"), 1).otherwise(0)))
    return flagged.filter("edge = 0 and status > 0").select("rec", "span", "d", "status").unionByName(at_edges.select("rec", "span", "d", "status").filter("status > 0"))


def _cover(windows: DataFrame, least: int) -> DataFrame:
    """(rec, shared, spans): characters of the union of windows of ``least`` characters, and its parts."""
    starts = F.array_sort(F.array_distinct(F.collect_list("start")))
    gaps = lambda s: F.transform(F.slice(s, 2, F.greatest(F.size(s), F.lit(1))), lambda x, i: x - F.get(s, i))
    merged = windows.groupBy("rec").agg(starts.alias("s")).select("rec", F.transform(F.array("s"), gaps)[0].alias("g"))
    return merged.select("rec", (F.lit(least) + F.aggregate("g", F.lit(0), lambda a, x: a + F.least(x.cast("int"), F.lit(least)))).alias("shared"), (F.size(F.filter("g", lambda x: x > least)) + 1).alias("spans"))


def find_shared(records: DataFrame, least: int = 160, spread: int = 36, measure: bool = True) -> DataFrame:
    """(rec, shared, spans) for each record of ``records(rec, text)`` that has at least ``least`` characters in a row which also stand in another record.

    Texts are cut into chunks by their content; a chunk goes with the few characters before and after it that its ends depend on. With these
    settings any ``least`` characters hold a chunk so extended (``4 * spread + GEAR <= least``), so records that share them share its digest.
    Each chunk is compared together with the window of ``least`` characters around it. A shared window settles its record. Of records that
    share chunks but no such window, all windows over these chunks are compared. What decides has digests of 128 bits.

    ``shared`` counts the characters in such windows and ``spans`` the separate parts. With ``measure`` so are all windows over chunks at the
    rim of what some record's shared windows cover, and ``shared`` is exact; without, it may lack up to ``2 * spread`` characters at each end.

    Null and shorter texts share nothing. Rows of one ``rec`` are one record.
    """
    if 4 * spread + GEAR > least:
        raise ValueError("chunks too long for such spans")
    texts = records.filter(f"rec is not null and length(text) >= {least}").select("rec", "text")
    rows = texts.mapInArrow(_chunk_rows(least, spread), "rec long, span long, d long, c long")
    status = _compare(rows)
    start, end = F.shiftright("span", 32), F.col("span").bitwiseAND(F.lit(0xFFFFFFFF))
    settled = status.filter("status = 2").select("rec", (start - F.floor((F.lit(least) - (end - start)) / 2)).cast("int").alias("start"))
    if measure:
        open_ = status.groupBy("rec").agg(F.collect_list(F.struct("span", "d", "status")).alias("rows")).select("rows").mapInArrow(_rims(least), "d long")
    else:
        open_ = status.filter("status = 1").join(settled.select("rec").distinct(), "rec", "left_anti")
    # Settled rows with the same chunk take part: they may be the other side.
    spans = status.join(open_.select("d").distinct(), "d", "left_semi").groupBy("rec").agg(F.collect_set("span").alias("spans"))
    spans = cut(spans)
    # Texts of other records stay where they are: a list of the records' hash values, of a bounded number, goes to the scan.
    bucket = F.pmod(F.xxhash64("rec"), F.lit(_BUCKETS))
    asked = texts.join(F.broadcast(spans.select(bucket.alias("bucket")).distinct()), bucket == F.col("bucket"), "left_semi")
    windows = asked.join(spans, "rec").select("rec", "text", "spans").mapInArrow(_windows(least), "rec long, span long, d long, c long")
    shared = _compare(windows).filter("status = 2").select("rec", F.col("span").cast("int").alias("start"))
    return _cover(settled.unionByName(shared), least)
