"""Flags of sorted ranges against a plain count, for all ways of cutting rows into ranges and batches."""

import random
from collections import defaultdict

import pyarrow as pa
import pytest
from postloom.llm import sharing


def batch(rows):
    rec, span, d, c = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(rec, pa.int64()), pa.array(span, pa.int64()), pa.array(d, pa.int64()), pa.array(c, pa.int64())], names=["rec", "span", "d", "c"])


@pytest.mark.parametrize("seed", range(60))
def test_ranges_and_batches(seed):
    rng = random.Random(seed)
    many = rng.choice((2, 4, 30))
    rows = sorted({(rng.randint(1, many), k, rng.choice((5, 5, rng.randint(0, 6))), rng.choice((None, 0, 1, 1, rng.randint(0, 3)))) for k in range(rng.randint(1, 60))}, key=lambda r: (r[2], r[3] is not None, r[3] or 0, r[0]))
    chunk, window = defaultdict(set), defaultdict(set)
    for rec, _, d, c in rows:
        chunk[d].add(rec)
        window[d, c].add(rec)
    want = {span: 2 if c is not None and len(window[d, c]) > 1 else 1 if len(chunk[d]) > 1 else 0 for rec, span, d, c in rows}
    cuts = sorted({0, len(rows), *(rng.randint(0, len(rows)) for _ in range(rng.randint(0, 4)))})
    out = []
    for a, b in zip(cuts, cuts[1:]):
        own, parts = rows[a:b], []
        while own:
            n = rng.randint(1, 7)
            parts, own = [*parts, batch(own[:n])], own[n:]
        out += [tuple(r.values()) for x in sharing._flag(iter(parts)) for r in x.to_pylist()]
    at_d, at_c = defaultdict(set), defaultdict(set)
    for rec, _, d, c, status, edge in out:
        if status == -1:
            at_d[d].add(rec)
            if edge == 2:
                at_c[d, c].add(rec)
    got = {}
    for rec, span, d, c, status, edge in out:
        if status >= 0:
            assert span not in got
            got[span] = max(status, 2 if edge == 2 and len(at_c[d, c]) > 1 else 1 if edge and len(at_d[d]) > 1 else 0)
    assert {k: got.get(k, 0) for k in want} == want


def test_no_rows():
    assert not list(sharing._flag(iter([])))


def test_hot_chunk_waits_for_nothing():
    """Of a chunk in all of very many records no row waits or is an edge."""
    parts = (batch([(r, r, 7, 3) for r in range(k, k + 1000)]) for k in range(0, 50_000, 1000))
    out = [r for x in sharing._flag(parts) for r in x.to_pylist()]
    assert sum(r["status"] == 2 and r["edge"] == 0 for r in out) == 50_000 and len(out) < 50_010
