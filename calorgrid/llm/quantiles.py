"""Percentiles with bounded error from mergeable rank-interval summaries.

A summary keeps tuples ``(value, rmin, rmax)``: the value's rank among all values lies between rmin and
rmax. Values are laid together per scan partition, summaries built from them, compressed to the permitted
uncertainty and merged level by level; the rank error that has accumulated is always the largest open interval, so every percentile comes
with bounds that hold for certain.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from calorgrid.runtime import broadcast_if_small, scratch

#: Summaries merged by one task at a time.
FAN_IN = 64
#: Rows of a scan partition that are laid together.
PACK = 1 << 19
#: Values sorted at once, and values of a key that one task summarises.
LEAF, CHUNK = 1 << 16, 1 << 20


def compress(v: np.ndarray, lo: np.ndarray, hi: np.ndarray, n: int, eps: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Drops tuples as far as neighbours stay within ``2 * eps * n`` ranks; the extremes stay."""
    step = max(1.0, eps * n)
    if len(v) <= 2 or step <= 1:
        return v, lo, hi
    cell = np.floor((lo - 1) / step)
    keep = np.ones(len(v), dtype=bool)
    keep[1:-1] = cell[1:-1] != cell[2:]  # the last tuple of each cell
    return v[keep], lo[keep], hi[keep]


def merge(v: np.ndarray, lo: np.ndarray, hi: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merges summaries laid end to end (``sizes`` tuples each) into one.

    Below a tuple lie, of every summary, at least the rmin of that summary's tuple before it and at most
    one less than the rmax of the tuple after it; both sums are running sums over the merged order.
    """
    if len(sizes) == 1:
        return v, lo, hi
    first = np.zeros(len(v), dtype=bool)
    last = np.zeros(len(v), dtype=bool)
    ends = np.cumsum(sizes)
    first[np.concatenate([[0], ends[:-1]])] = True
    last[ends - 1] = True
    gain = np.diff(lo, prepend=0)
    gain[first] = lo[first]
    upto = np.empty_like(hi)  # how many values of its own summary may lie before the next tuple
    upto[:-1] = hi[1:] - 1
    upto[last] = hi[last]
    more = np.diff(upto, prepend=0)
    more[first] = upto[first]
    order = np.argsort(v, kind="stable")
    low, high = np.cumsum(gain[order]), np.cumsum(more[order])
    return v[order], low, high - upto[order] + hi[order]


def bounds(v: np.ndarray, lo: np.ndarray, hi: np.ndarray, n: int, p: float) -> tuple[float, float]:
    """Between which values the percentile (linear between neighbours) lies."""
    at = p * (n - 1)
    k0, k1 = int(np.floor(at)) + 1, int(np.ceil(at)) + 1
    share = at - np.floor(at)

    def span(k: int) -> tuple[float, float]:
        a = np.searchsorted(hi, k, side="right") - 1
        b = np.searchsorted(lo, k, side="left")
        return float(v[max(a, 0)]), float(v[min(b, len(v) - 1)])

    (a0, b0), (a1, b1) = span(k0), span(k1)
    return a0 + (a1 - a0) * share, b0 + (b1 - b0) * share


def rank_error(lo: np.ndarray, hi: np.ndarray) -> int:
    """Half the widest interval in which a rank is open, 0 for an exact summary."""
    return 0 if len(lo) < 2 else int(max(0, (hi[1:] - lo[:-1] - 1).max() + 1) // 2)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), offsets - offsets[0]


def _pack(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype("int32")
    flat = np.concatenate(arrays) if arrays else np.array([])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=kind))


def _packer(names: list[str]):
    """Rows ``names, position, value`` to one row per distinct names and :data:`PACK` rows with the lists of positions and values."""

    def larger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= PACK:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
        if any(b.num_rows for b in held):
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in larger(batches):
            code = np.zeros(batch.num_rows, dtype="int64")
            for c in names:
                index = batch.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                code = np.unique(code * (int(index.max()) + 1) + index, return_inverse=True)[1].astype("int64")
            order = np.argsort(code, kind="stable")
            starts = np.flatnonzero(np.diff(code[order], prepend=-1))
            offsets = pa.array(np.append(starts, len(order)).astype("int32"))
            first = pa.array(order[starts])
            lists = [pa.ListArray.from_arrays(offsets, batch.column(c).take(pa.array(order))) for c in ("__pos", "__value")]
            yield pa.record_batch([*[batch.column(c).take(first) for c in names], *lists], names=[*names, "pos", "vals"])

    return pack


class _Summary:
    """One summary of a stream of values: leaves of at most :data:`LEAF` values, merged in pairs of one level."""

    def __init__(self, eps: float):
        self.eps, self.waiting, self.held = eps, [], 0
        self.levels: list[tuple | None] = []

    def add(self, values: np.ndarray) -> None:
        self.waiting.append(values)
        self.held += len(values)
        if self.held >= LEAF:
            self.flush()

    def flush(self) -> None:
        if not self.held:
            return
        v = np.sort(np.concatenate(self.waiting))
        rank = np.arange(1, len(v) + 1, dtype="int64")
        self.waiting, self.held = [], 0
        node, level = (*compress(v, rank, rank, len(v), self.eps), len(v)), 0
        while level < len(self.levels) and self.levels[level] is not None:
            node, self.levels[level] = self.both(self.levels[level], node), None
            level += 1
        self.levels.extend([None] * (level + 1 - len(self.levels)))
        self.levels[level] = node

    def both(self, x: tuple, y: tuple) -> tuple:
        m = merge(*(np.concatenate([x[i], y[i]]) for i in range(3)), np.array([len(x[0]), len(y[0])]))
        return (*compress(*m, x[3] + y[3], self.eps), x[3] + y[3])

    def result(self) -> tuple | None:
        self.flush()
        out = None
        for node in self.levels:
            if node is not None:
                out = node if out is None else self.both(out, node)
        return out


def _builder(names: list[str], within: str, eps: float):
    """Summaries of rows sorted by ``names`` and ``within``; positions that repeat inside a ``within`` count once (the smallest value)."""

    def once(parts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        pos, v = (np.concatenate(x) for x in zip(*parts)) if len(parts) > 1 else parts[0]
        order = np.lexsort((v, pos))
        pos = pos[order]
        return v[order][np.concatenate([[True], pos[1:] != pos[:-1]])]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = place = summary = None
        parts: list = []
        done: list[tuple] = []
        kinds = None

        def close() -> None:
            if parts:
                summary.add(once(parts))
                parts.clear()

        def emit() -> pa.RecordBatch:
            columns = [pa.array([k[i] for k, _ in done], type=kinds[i]) for i in range(len(names))]
            vs, los, his, ns = zip(*[r for _, r in done])
            out = pa.record_batch([*columns, pa.array(ns, pa.int64()), _pack(list(vs), pa.float64()), _pack(list(los), pa.int64()), _pack(list(his), pa.int64())], names=[*names, "n", "v", "lo", "hi"])
            done.clear()
            return out

        for batch in batches:
            kinds = [batch.column(c).type for c in names]
            keys = list(zip(*(batch.column(c).to_pylist() for c in names)))
            places = batch.column(within).to_pylist()
            (pos, at), (vals, _) = _lists(batch.column("pos")), _lists(batch.column("vals"))
            for k in range(batch.num_rows):
                if summary is None or keys[k] != key:
                    close()
                    if summary is not None:
                        done.append((key, summary.result()))
                    key, place, summary = keys[k], places[k], _Summary(eps)
                elif places[k] != place:
                    close()
                    place = places[k]
                parts.append((pos[at[k] : at[k + 1]], vals[at[k] : at[k + 1]]))
            if done:
                yield emit()
        if summary is not None:
            close()
            done.append((key, summary.result()))
            yield emit()

    return build


def _merger(names: list[str], eps: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (v, at), (lo, _), (hi, _), (sizes, s_at) = (_lists(batch.column(c)) for c in ("v", "lo", "hi", "sizes"))
            n = batch.column("n").to_numpy(zero_copy_only=False)
            vs, los, his = [], [], []
            for k, (a, b) in enumerate(zip(at[:-1], at[1:])):
                m = merge(v[a:b], lo[a:b], hi[a:b], sizes[s_at[k] : s_at[k + 1]])
                mv, mlo, mhi = compress(*m, int(n[k]), eps)
                vs.append(mv), los.append(mlo), his.append(mhi)
            keys = [batch.column(c) for c in names]
            yield pa.record_batch([*keys, pa.array(n, pa.int64()), _pack(vs, pa.float64()), _pack(los, pa.int64()), _pack(his, pa.int64())], names=[*names, "n", "v", "lo", "hi"])

    return run


_TUPLES = "n long, v array<double>, lo array<long>, hi array<long>"


def _fields(df: DataFrame, names: Sequence[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)


def packed(df: DataFrame, keys: Sequence[str], within: str, position: Column, value: Column) -> DataFrame:
    """``keys, within, pos, vals``: the finite values laid together by key and ``within`` inside every partition of the scan."""
    d = value.cast("double")
    rows = df.where(d.isNotNull() & ~F.isnan(d) & (F.abs(d) < float("inf"))).select(*keys, within, position.cast("int").alias("__pos"), d.alias("__value"))
    names = [*keys, within]
    return rows.mapInArrow(_packer(names), f"{_fields(rows, names)}, pos array<int>, vals array<double>")


def summaries(packs: DataFrame, keys: Sequence[str], within: str, eps: float, chunk: int = CHUNK) -> DataFrame:
    """One summary of about ``1 / eps`` tuples per key, or per key and part of it for keys of more than ``chunk`` values.

    ``packs`` are :func:`packed` values. Columns: ``keys, __part, n, v, lo, hi``. A value's position counts
    once inside its ``within``, whatever partitions and batches deliver it. Null, NaN and infinite values
    are left out; null keys are keys; a key without a finite value has no summary. What is shuffled are the
    lists, once; a key with many values is split by ``within``, so no task holds more than its share.
    """
    keys = list(keys)
    sizes = packs.groupBy(*keys).agg(F.sum(F.size("vals")).alias("__n"))
    hot = scratch(sizes.where(F.col("__n") > chunk).select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keys)], F.ceil(F.col("__n") / chunk).alias("__parts")))
    n_hot = hot.count()
    if n_hot:
        side, cond = broadcast_if_small(hot, n_hot), F.lit(True)
        for i, c in enumerate(keys):
            cond = cond & packs[c].eqNullSafe(side[f"__k{i}"])
        part = F.pmod(F.xxhash64(within), F.coalesce("__parts", F.lit(1))).cast("int")
        packs = packs.join(side, cond, "left").select(*keys, within, "pos", "vals", part.alias("__part"))
    else:
        packs = packs.withColumn("__part", F.lit(0))
    names = [*keys, "__part"]
    laid = packs.repartition(*names).sortWithinPartitions(*names, within)
    return laid.mapInArrow(_builder(names, within, eps), f"{_fields(laid, names)}, {_TUPLES}")


def merge_by(parts: DataFrame, keys: Sequence[str], eps: float) -> DataFrame:
    """Merges all summaries of a key; ``parts`` has further columns than ``keys`` only for what is merged over."""
    keys = list(keys)
    grouped = parts.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.flatten(F.collect_list("v")).alias("v"), F.flatten(F.collect_list("lo")).alias("lo"), F.flatten(F.collect_list("hi")).alias("hi"),
        F.collect_list(F.size("v").cast("long")).alias("sizes"),
    )
    return grouped.mapInArrow(_merger(keys, eps), f"{_fields(grouped, keys)}, {_TUPLES}")


def merge_levels(parts: DataFrame, keys: Sequence[str], chunk: str, eps: float, most: int) -> DataFrame:
    """Merges the summaries of each key by levels of at most about :data:`FAN_IN`; ``most`` is the largest number of chunks of a key.

    Every level may add its share of ``eps``, so the accumulated rank error stays below ``eps * n``.
    """
    levels, width = 1, FAN_IN
    while width < most:
        width, levels = width * FAN_IN, levels + 1
    share = eps / (levels + 1)
    for level in range(levels - 1, 0, -1):
        parts = parts.withColumn("__b", F.pmod(F.xxhash64(chunk, F.lit(7)), F.lit(FAN_IN**level)))
        parts = merge_by(parts, [*keys, "__b"], share).withColumnRenamed("__b", chunk)
    return merge_by(parts, keys, share)


def _reader(names: list[str], probs: dict[str, float]):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (v, at), (lo, _), (hi, _) = (_lists(batch.column(c)) for c in ("v", "lo", "hi"))
            n = batch.column("n").to_numpy(zero_copy_only=False)
            got = {f"{q}_{side}": [] for q in probs for side in ("low", "high")}
            errors = []
            for k, (a, b) in enumerate(zip(at[:-1], at[1:])):
                errors.append(rank_error(lo[a:b], hi[a:b]))
                for q, p in probs.items():
                    low, high = bounds(v[a:b], lo[a:b], hi[a:b], int(n[k]), p)
                    got[f"{q}_low"].append(low), got[f"{q}_high"].append(high)
            keys = [batch.column(c) for c in names]
            kept = pa.array(np.diff(at), pa.int64())
            yield pa.record_batch([*keys, pa.array(n, pa.int64()), kept, pa.array(errors, pa.int64()), *[pa.array(x, pa.float64()) for x in got.values()]], names=[*names, "n", "n_tuples", "rank_error", *got])

    return read


def percentiles(merged: DataFrame, keys: Sequence[str], probs: dict[str, float]) -> DataFrame:
    """``keys, n, n_tuples, rank_error`` and for each percentile the certain bounds ``_low`` and ``_high``."""
    keys = list(keys)
    outs = ", ".join(f"{q}_{side} double" for q in probs for side in ("low", "high"))
    return merged.mapInArrow(_reader(keys, probs), f"{_fields(merged, keys)}, n long, n_tuples long, rank_error long, {outs}")
