"""Evaluation passages in training texts (problem 7)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from postloom.llm.fmindex import FMIndex
from postloom.plans.lineage import cut

#: Where a quoted block of an evaluation message begins.
_QUOTED = r"(?m)^\s*-{3,}\s*(?:Original|Forwarded)\b|^\s*-{3,}[^\n]*Forwarded by|^_{8,}\s*$|^\s*(?:On|Am)\b[^\n]{5,200}\b(?:wrote|schrieb)\b[^\n]*:\s*$|^[>|]|^[^\n]{2,80}\swrites:\s*$|^\*{3}[^\n]+said on[^\n]+\*{3}\s*$|^From: [^\n]+\n(?:Sent|Date|To): "
_NO_WORD = re.compile(r"[^\w\s]+|_+")
_TOKEN = re.compile(r"\S+")


def item_body(message: Column) -> Column:
    """The body of an evaluation message: after its first blank line, before any quoted block. Without blank line there is none."""
    text = F.regexp_replace(message, r"\r\n?", "\n")
    parts = F.split(text, r"\n[ \t]*\n", 2)
    return F.element_at(F.split(F.get(parts, F.lit(1)), _QUOTED, 2), 1)


def words(text: str) -> list[str]:
    """Words in lower case, without punctuation; what is punctuation only is no word."""
    return _NO_WORD.sub("", text.lower()).split()


_FOUND = "doc_id long, item_id long, first_word int, n_words int, start_char int, end_char int"
#: A shard: its documents' ids, texts and numbers of words, the different words, and the parts of the FM-index.
_SHARD = "ids binary, texts array<string>, lengths binary, words binary, before binary, kept binary, position binary"


def _shard_rows(shard_words: int):
    def shard(ids: list[int], texts: list[str]) -> pa.RecordBatch:
        each = [words(t) for t in texts]
        lengths = np.array([len(ws) for ws in each], dtype=np.int32)
        codes, names = pd.factorize(np.array([w for ws in each for w in ws], dtype=object))
        symbols = np.zeros(len(codes) + len(texts), dtype=np.int64)
        symbols[np.arange(len(codes)) + np.repeat(np.arange(len(texts)), lengths)] = codes + 1
        before, kept, position = FMIndex.parts(symbols)
        blob = lambda x: pa.array([x.tobytes() if isinstance(x, np.ndarray) else x], pa.binary())
        arrays = [blob(np.array(ids, np.int64)), pa.array([texts], pa.list_(pa.string())), blob(lengths), blob("\n".join(names).encode()), blob(before.astype(np.int32)), blob(np.packbits(kept)), blob(position.astype(np.int32))]
        return pa.RecordBatch.from_arrays(arrays, names=["ids", "texts", "lengths", "words", "before", "kept", "position"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        texts: list[str] = []
        size = 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(i)
                texts.append(text)
                size += len(text)
                if size > 6 * shard_words:
                    yield shard(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield shard(ids, texts)

    return run


def build_index(docs: DataFrame, shard_words: int = 500_000) -> DataFrame:
    """One row for each shard of about ``shard_words`` words of ``docs(doc_id, text)``: an FM-index and the texts it leads back to.

    Shards are parts of the scan's partitions, so no text is shuffled. The rows can be kept as a table and searched any number of times.
    Null and blank texts are left out.
    """
    corpus = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text is not null and text <> ''")
    return corpus.mapInArrow(_shard_rows(shard_words), _SHARD)


class _Patterns:
    """The different runs of ``least`` words of a block of items, as rows of codes."""

    def __init__(self, items: list[tuple[int, list[str]]], least: int):
        known: dict[str, int] = {}
        coded = [(item, np.array([known.setdefault(w, len(known)) for w in ws], dtype=np.int32)) for item, ws in items]
        grams = [np.lib.stride_tricks.sliding_window_view(c, least) for _, c in coded]
        self.least, self.vocabulary = least, list(known)
        self.whose = np.concatenate([np.full(len(g), item, dtype=np.int64) for (item, _), g in zip(coded, grams)] or [np.zeros(0, dtype=np.int64)])
        self.rows, which = np.unique(np.concatenate(grams), axis=0, return_inverse=True) if grams else (np.zeros((0, least), dtype=np.int32), np.zeros(0, dtype=np.int64))
        self.by_pattern = np.argsort(which.ravel(), kind="stable")
        self.bounds = np.searchsorted(which.ravel()[self.by_pattern], np.arange(len(self.rows) + 1))


def _search(batches: Iterator[pa.RecordBatch], items: list[tuple[int, list[str]]], least: int) -> Iterator[pa.RecordBatch]:
    patterns: _Patterns | None = None
    for batch in batches:
        for row in batch.to_pylist():
            patterns = patterns or _Patterns(items, least)
            yield from _search_shard(row, patterns)


def _search_shard(row: dict, patterns: _Patterns) -> Iterator[pa.RecordBatch]:
    least = patterns.least
    get = lambda name, kind: np.frombuffer(row[name], dtype=kind)
    ids, lengths, before = get("ids", np.int64), get("lengths", np.int32), get("before", np.int32)
    index = FMIndex(before, np.unpackbits(get("kept", np.uint8), count=len(before)).astype(bool), get("position", np.int32).astype(np.int64))
    symbol_of = pd.Index(row["words"].decode().split("\n")).get_indexer(patterns.vocabulary) + 1
    here = symbol_of[patterns.rows] if len(patterns.rows) else patterns.rows
    possible = np.flatnonzero((here > 0).all(axis=1)) if len(here) else np.zeros(0, dtype=np.int64)
    rows, low, high = index.search(here[possible])
    rows = possible[rows]
    starts = np.concatenate(([0], np.cumsum(lengths + 1)))[:-1]
    # Places are located block by block: a passage may stand in any number of texts.
    total = np.concatenate(([0], np.cumsum(high - low)))
    hits: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(0, int(total[-1]), 200_000):
        flat_no = np.arange(at, min(at + 200_000, int(total[-1])))
        k = np.searchsorted(total, flat_no, side="right") - 1
        hits.append((rows[k], index.locate(low[k] + flat_no - total[k])))
    if not hits:
        return
    at_row, position = (np.concatenate(x) for x in zip(*hits))
    n_items = patterns.bounds[at_row + 1] - patterns.bounds[at_row]
    doc = np.searchsorted(starts, position, side="right") - 1
    whose = patterns.whose[patterns.by_pattern[np.concatenate([np.arange(patterns.bounds[r], patterns.bounds[r + 1]) for r in at_row])]]
    pairs = pd.DataFrame({"doc": np.repeat(doc, n_items), "item": whose, "at": np.repeat(position - starts[doc], n_items)}).drop_duplicates().sort_values(["doc", "item", "at"])
    new = (pairs["doc"] != pairs["doc"].shift()) | (pairs["item"] != pairs["item"].shift()) | (pairs["at"] > pairs["at"].shift() + least)
    spans = pairs.groupby(new.cumsum()).agg(doc=("doc", "first"), item=("item", "first"), first=("at", "min"), last=("at", "max"))
    out = []
    for d, own in spans.groupby("doc"):
        places = [m.span() for m in _TOKEN.finditer(row["texts"][d]) if _NO_WORD.sub("", m[0])]
        for item, first, last in own[["item", "first", "last"]].itertuples(index=False):
            out.append((int(ids[d]), item, first, last + least - first, places[first][0], places[last + least - 1][1]))
    columns = list(zip(*out))
    kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "item_id", "first_word", "n_words", "start_char", "end_char"])


def search_index(index: DataFrame, items: DataFrame, least: int = 20, block_chars: int = 4_000_000) -> DataFrame:
    """Spans of the indexed documents with at least ``least`` consecutive words of an item of ``items(item_id, text)``, as in ``find_leaks``.

    The items are the stated query set: they go to the tasks in blocks of about ``block_chars`` characters, one pass over the index for each,
    so what a task holds of them is bounded.
    """
    items = items.select(F.col("item_id").cast("long"), F.col("text")).filter("item_id is not null and text is not null")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    found = None
    for k in range(blocks):
        block = [(i, ws) for i, t in items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect() if len(ws := words(t)) >= least]
        shared = index.sparkSession.sparkContext.broadcast(block)
        own = index.mapInArrow(lambda batches, shared=shared: _search(batches, shared.value, least), _FOUND)
        found = own if found is None else found.unionByName(own)
    return found


def find_leaks(docs: DataFrame, items: DataFrame, least: int = 20, shard_words: int = 500_000, block_chars: int = 4_000_000) -> DataFrame:
    """Spans of ``docs(doc_id, text)`` with at least ``least`` consecutive words of an item of ``items(item_id, text)``.

    Gives (doc_id, item_id, first_word, n_words, start_char, end_char): one row for each span, overlapping ones merged; the characters from
    ``start_char`` to ``end_char`` are to be removed. Words are compared in lower case and without punctuation.

    Every part of the corpus is indexed once, in shards (see ``build_index``) that are cut into the checkpoint folder, and each block of items
    searches them (see ``search_index``).

    Null and blank texts, and items of fewer words, have no spans. Repeated rows give a span each.
    """
    return search_index(cut(build_index(docs, shard_words)), items, least, block_chars)
