"""Whole documents fill a chunk until it holds flush_every tokens; the next document starts a new one.

Since the fill starts anew after each chunk, it is a fold.  It is taken in blocks of positions: what a block does
depends only on how many tokens the open chunk still lacks where the block begins, so each block is summed up as a
step function of that number, which tells how many chunks it closes and what the open one lacks at its end.  The
functions of FAN neighbours are composed into one, level by level, until one group is left; the way back down tells
each block what its open chunk lacks and which number it has.  A function has no more steps than there are documents
in the first flush_every tokens of its block, so no task holds more than FAN times that or one block of sizes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 100_000
FAN = 64

_STEPS = "member long, total long, bound long, lacks long, closed long"


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _steps(member: int, total: int, bound: np.ndarray, lacks: np.ndarray, closed: np.ndarray) -> pa.Table:
    one = np.ones(len(bound), np.int64)
    return pa.table({"member": member * one, "total": total * one, "bound": bound, "lacks": lacks, "closed": closed})


def _within(bound: np.ndarray, every: int) -> np.ndarray:
    """Places of the distinct bounds that a chunk lacking 1 to every tokens can meet; one at least."""
    at = np.unique(bound, return_index=True)[1]
    met = (bound[at] > 0) & (np.append(0, bound[at][:-1]) < every)
    return at[met] if met.any() else at[:1]


def _of_block(table: pa.Table, every: int) -> pa.Table:
    """The step function of one block's documents (block, pos, n_tokens)."""
    ends = np.cumsum(_column(table.sort_by("pos"), "n_tokens"))
    n, total = len(ends), int(ends[-1])
    after = np.searchsorted(ends, ends + every, side="left").tolist()
    last, closed = list(range(n)), [1] * n
    for k in range(n - 1, -1, -1):
        if after[k] < n:
            last[k], closed[k] = last[after[k]], closed[after[k]] + 1
    at = _within(ends, every)
    return _steps(table.column("member")[0].as_py(), total, ends[at], every - (total - ends[np.array(last)[at]]), np.array(closed)[at])


def _members(table: pa.Table) -> list[tuple]:
    """(member, total, bound, lacks, closed) of each step function of a group, in order."""
    member, total, *steps = (_column(table, c) for c in ("member", "total", "bound", "lacks", "closed"))
    order = np.lexsort((steps[0], member))
    cuts = np.flatnonzero(np.diff(member[order])) + 1
    return [(int(member[k[0]]), int(total[k[0]]), *(s[k] for s in steps)) for k in np.split(order, cuts)]


def _through(lacks: np.ndarray, closed: np.ndarray, own: tuple) -> tuple[np.ndarray, np.ndarray]:
    """What chunks lack, and how many were closed, after one more member."""
    _, total, bound, then, more = own
    at = np.minimum(np.searchsorted(bound, lacks, side="left"), len(bound) - 1)
    ends = lacks <= total
    return np.where(ends, then[at], lacks - total), closed + np.where(ends, more[at], 0)


def _of_group(table: pa.Table, every: int) -> pa.Table:
    """The step function of a group's members, one after another."""
    members = _members(table)
    before = np.cumsum([0, *(m[1] for m in members)])
    bound = np.concatenate([m[2] + b for m, b in zip(members, before, strict=False) if b < every])
    bound = bound[_within(bound, every)]
    lacks, closed = bound, np.zeros(len(bound), np.int64)
    for m in members:
        lacks, closed = _through(lacks, closed, m)
    return _steps(table.column("group")[0].as_py(), int(before[-1]), bound, lacks, closed)


def _walked(state: pa.Table, table: pa.Table) -> pa.Table:
    """(member, lacks, chunk) where each member of a group begins."""
    lacks, chunk, rows = _column(state, "lacks"), _column(state, "chunk"), []
    for m in _members(table) if table.num_rows else []:
        rows.append((m[0], int(lacks[0]), int(chunk[0])))
        lacks, chunk = _through(lacks, chunk, m)
    return pa.table(dict(zip(("member", "lacks", "chunk"), map(pa.array, zip(*rows, strict=True)), strict=True))) if rows else pa.table({c: pa.array([], pa.int64()) for c in ("member", "lacks", "chunk")})


def _filled(state: pa.Table, table: pa.Table, every: int) -> pa.Table:
    """(pos, n_tokens, chunk_id) of one block's documents."""
    table = table.sort_by("pos")
    ends = np.cumsum(_column(table, "n_tokens"))
    closes = np.zeros(len(ends) + 1, np.int64)
    if len(ends):
        at = int(np.searchsorted(ends, state.column("lacks")[0].as_py(), side="left"))
        while at < len(ends):
            closes[at + 1] = 1
            at = int(np.searchsorted(ends, ends[at] + every, side="left"))
        closes[0] = state.column("chunk")[0].as_py()
    return table.select(["pos", "n_tokens"]).append_column("chunk_id", pa.array(np.cumsum(closes)[:-1]))


def chunk_ids(sizes: DataFrame, flush_every: int, held: int = 0, chunk: int = 0, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """(pos, n_tokens, chunk_id) of documents (pos, n_tokens) in the order of pos.

    The first document meets a chunk of the given number that already holds held tokens.  Sizes that are null count
    as 0; documents of no tokens after the one that closes a chunk belong to the next.  Rows without pos come last,
    in no stated order, as do rows of one pos among themselves; an empty table gives an empty one.  Positions are cut
    into ranges of one width, block documents each if they lie evenly.
    """
    if not 0 <= held < flush_every:
        raise ValueError("a chunk is closed once it holds flush_every tokens")
    docs = sizes.select("pos", F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)).alias("n_tokens"))
    low, high, n = docs.agg(F.min("pos"), F.max("pos"), F.count("*")).first()
    low, high = low or 0, high or 0
    width = max(1, -(-(high - low + 1) // max(1, -(-n // block))))
    member = F.coalesce(F.floor((F.col("pos") - F.lit(low)) / F.lit(width)), F.lit((high - low) // width))
    docs = docs.withColumn("member", member.cast("long"))
    blocks = (high - low) // width + 1

    levels = []
    while blocks > 1:
        if levels:
            steps = levels[-1].groupBy("group").applyInArrow(lambda t: _of_group(t, flush_every), _STEPS)
        else:
            steps = docs.groupBy("member").applyInArrow(lambda t: _of_block(t, flush_every), _STEPS)
        levels.append(steps.withColumn("group", F.floor(F.col("member") / fan).cast("long")))
        blocks = -(-blocks // fan)
    states = sizes.sparkSession.range(1).select(F.col("id").alias("member"), F.lit(flush_every - held).cast("long").alias("lacks"), F.lit(chunk).cast("long").alias("chunk"))
    for steps in reversed(levels):
        states = states.groupBy("member").cogroup(steps.groupBy("group")).applyInArrow(_walked, "member long, lacks long, chunk long")
    return states.groupBy("member").cogroup(docs.groupBy("member")).applyInArrow(lambda s, t: _filled(s, t, flush_every), "pos long, n_tokens long, chunk_id long")
