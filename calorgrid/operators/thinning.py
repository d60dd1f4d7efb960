"""Deterministic, spatially thinned, stratified samples with quotas."""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from calorgrid.functions.hashing import GOLDEN, MIX_A, MIX_B, gamma, unsigned_order, with_splitmix64
from calorgrid.operators.prefix import prefix_sum
from calorgrid.runtime import broadcast_if_small, scratch

SECOND_SEED = 0xA5A5A5A5


def allocate(counts: dict[str, float], capacity: dict[str, int], total: int) -> dict[str, int]:
    """Quotas that add up to ``total``, in proportion to ``counts``, at least 1 and at most the capacity each.

    If the capacities fit into the total they are the quotas. Otherwise rounded-down shares are raised to 1
    and cut to the capacity; a surplus is taken where the share is exceeded most (ties: smallest name), a
    deficit given by largest remainder, then count, then name. Of more names than ``total`` those with most
    counts (then by name) get one place each, the others none.
    """
    if sum(capacity.values()) <= total:
        return dict(capacity)
    if len(counts) > total:
        served = set(sorted(counts, key=lambda k: (-counts[k], k))[:total])
        return {k: int(k in served) for k in counts}
    whole = sum(counts.values())
    share = {k: n / whole * total for k, n in counts.items()}
    quota = {k: min(max(int(share[k]), 1), capacity[k]) for k in counts}
    surplus = sum(quota.values()) - total
    if surplus > 0:
        heap = [(share[k] - q, k) for k, q in quota.items() if q > 1]
        heapq.heapify(heap)
        for _ in range(surplus):
            _, k = heapq.heappop(heap)
            quota[k] -= 1
            if quota[k] > 1:
                heapq.heappush(heap, (share[k] - quota[k], k))
    names = {k: i for i, k in enumerate(sorted(counts))}
    heap = [(-(share[k] - int(share[k])), -counts[k], -names[k], k) for k in counts if quota[k] < capacity[k]]
    heapq.heapify(heap)
    for _ in range(max(0, -surplus)):
        if not heap:
            break
        _, c, r, k = heapq.heappop(heap)
        quota[k] += 1
        if quota[k] < capacity[k]:
            heapq.heappush(heap, (1.0, c, r, k))
    return quota


def _quotas(total: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        q = allocate(dict(zip(pdf["image_id"], pdf["eligible"].astype(float))), dict(zip(pdf["image_id"], pdf["candidates"].astype(int))), total)
        return pd.DataFrame({"group_name": pdf["group_name"], "image_id": pdf["image_id"], "quota": [q[i] for i in pdf["image_id"]]})

    return run


def numbered(pixels: DataFrame) -> DataFrame:
    """Pixels with ``base_id``: the rank of (image, row, column) among them, from ranks per image plus an offset per image."""
    per = pixels.groupBy(F.col("image_id").alias("__i")).agg(F.count("*").alias("__n"))
    offsets = prefix_sum(per, ["__i"], {"__before": F.col("__n")})
    local = F.row_number().over(W.partitionBy("image_id").orderBy("thermal_row", "thermal_col")) - 1  # one image's grid
    return pixels.withColumn("__local", local).join(offsets, F.col("image_id") == F.col("__i")).withColumn("base_id", F.col("__local") + F.col("__before")).drop("__local", "__i", "__n", "__before")


def _tiles(pixels: DataFrame, tile: int) -> DataFrame:
    cell = lambda c: F.floor(F.col(c) / tile).cast("int")
    return pixels.withColumns({"tile_row": cell("thermal_row"), "tile_col": cell("thermal_col")})


def candidates(pixels: DataFrame, seeds: Sequence[int], tile: int) -> DataFrame:
    """Per seed the pixel with the smallest (unsigned) score of every (image, group, tile), with all its columns and ``second``, the increment of its second score.

    The scores of all seeds stand side by side, so pixels are laid by tile once and only what is drawn is
    multiplied by the seeds. Different numbers have different scores.
    """
    rows = _tiles(with_splitmix64(pixels, "base_id", {f"__z{i}": F.lit(gamma(s)) for i, s in enumerate(seeds)}), tile)
    by = W.partitionBy("image_id", "group_name", "tile_row", "tile_col")  # a tile's pixels
    drawn = [F.when(unsigned_order(F.col(f"__z{i}")) == F.min(unsigned_order(F.col(f"__z{i}"))).over(by), F.struct(F.lit(int(s)).alias("seed"), F.lit(gamma(s ^ SECOND_SEED)).alias("second"))) for i, s in enumerate(seeds)]
    best = rows.select(*pixels.columns, "tile_row", "tile_col", F.array(*drawn).alias("__d")).withColumn("__s", F.explode(F.array_compact("__d")))
    return best.select("__s.seed", "__s.second", "tile_row", "tile_col", *pixels.columns)


def sampling_plan(pixels: DataFrame, *, tile: int, per_image: int, per_group: int) -> DataFrame:
    """``group_name, image_id, limit, tiles``: how many pixels may be drawn of each stratum, whatever the seed.

    A tile gives one candidate for every seed, so capacities and quotas do not depend on it: at most
    ``per_image`` per stratum and, where a group's strata exceed ``per_group``, quotas in proportion to the
    eligible pixels (:func:`allocate`; a group's images meet in one task).
    """
    tiles = _tiles(pixels, tile).groupBy("group_name", "image_id", "tile_row", "tile_col").agg(F.count("*").alias("n"))
    strata = scratch(tiles.groupBy("group_name", "image_id").agg(F.sum("n").alias("eligible"), F.count("*").alias("tiles")).withColumn("candidates", F.least("tiles", F.lit(per_image))))
    sums = strata.groupBy(F.col("group_name").alias("__g")).agg(F.sum("candidates").alias("__all")).where(F.col("__all") > per_group)
    tight = strata.join(sums, F.col("group_name") == F.col("__g")).select("group_name", "image_id", "eligible", "candidates")
    q = tight.groupBy("group_name").applyInPandas(_quotas(per_group), "group_name string, image_id string, quota long")
    return strata.join(q, ["group_name", "image_id"], "left").select("group_name", "image_id", F.coalesce("quota", "candidates").cast("long").alias("limit"), "tiles")


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """splitmix64 of every number."""
    with np.errstate(over="ignore"):
        z = x + np.uint64((seed + GOLDEN) % (1 << 64))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX_A)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX_B)
    return z ^ (z >> np.uint64(31))


def _first(code: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Places in ``order`` (sorted by code) where a code begins."""
    sorted_code = code[order]
    return np.flatnonzero(np.concatenate([[True], sorted_code[1:] != sorted_code[:-1]])) if len(order) else np.empty(0, dtype=int)


def _draw(batch: pa.RecordBatch, seeds: Sequence[int], tile: int) -> pa.RecordBatch:
    """The rows of whole images that any seed draws, with the list of these seeds."""
    codes = []
    for c in ("image_id", "group_name"):
        codes.append(batch.column(c).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype("int64"))
    row, col = (batch.column(c).to_numpy(zero_copy_only=False).astype("int64") // tile for c in ("thermal_row", "thermal_col"))
    limit = batch.column("__limit").to_numpy(zero_copy_only=False)
    ids = batch.column("base_id").to_numpy(zero_copy_only=False).astype("uint64")
    stratum = np.unique(codes[0] * (codes[1].max() + 1) + codes[1], return_inverse=True)[1]
    cells = np.unique(np.stack([stratum, row, col]), axis=1, return_inverse=True)[1].ravel()
    drawn = np.zeros((len(seeds), batch.num_rows), dtype=bool)
    for k, seed in enumerate(seeds):
        order = np.lexsort((_mix(ids, seed), cells))
        best = order[_first(cells, order)]  # a candidate per tile
        order = best[np.lexsort((_mix(ids[best], seed ^ SECOND_SEED), stratum[best]))]
        starts = _first(stratum, order)
        rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
        drawn[k, order[rank < limit[order]]] = True
    kept = np.flatnonzero(drawn.any(axis=0))
    flags = drawn[:, kept].T
    offsets = np.concatenate([[0], np.cumsum(flags.sum(axis=1))]).astype("int32")
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.asarray(seeds, dtype="int64")[np.nonzero(flags)[1]]))
    rows = batch.take(pa.array(kept))
    return pa.record_batch([*rows.columns, lists], names=[*batch.schema.names, "seeds"])


def _drawer(seeds: Sequence[int], tile: int, most: int = 1 << 18):
    """Draws from rows sorted by image, whole images at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < most:
                continue
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            image = whole.column("image_id").dictionary_encode().indices.to_numpy(zero_copy_only=False)
            last = int(np.flatnonzero(image == image[-1])[0])  # the last image may go on
            if last:
                yield _draw(whole.slice(0, last), seeds, tile)
            held, n = [whole.slice(last)], whole.num_rows - last
        if n:
            yield _draw(pa.Table.from_batches(held).combine_chunks().to_batches()[0], seeds, tile)

    return run


def drawn_pixels(pixels: DataFrame, seeds: Sequence[int], *, tile: int, per_image: int, per_group: int) -> DataFrame:
    """The pixels that the samples of any of the seeds hold, once each, with ``seeds``, the list of these seeds.

    ``pixels`` hold ``image_id, group_name, thermal_row, thermal_col`` once per pixel. One pixel per tile is
    drawn (smallest first score), at most ``per_image`` per image and group, and at most ``per_group`` per
    group by quotas in proportion to the eligible pixels (of more images than places those with most
    eligible pixels get one place each), by second score. Pixels are laid by image once for all seeds.
    """
    plan = scratch(sampling_plan(pixels, tile=tile, per_image=per_image, per_group=per_group))
    side = broadcast_if_small(plan.select(F.col("group_name").alias("__g"), F.col("image_id").alias("__i"), F.col("limit").alias("__limit")), plan.count())
    base = numbered(pixels).join(side, (F.col("group_name") == F.col("__g")) & (F.col("image_id") == F.col("__i"))).drop("__g", "__i")
    laid = base.repartition("image_id").sortWithinPartitions("image_id")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in laid.schema.fields)
    return _tiles(laid.mapInArrow(_drawer([int(s) for s in seeds], tile), f"{schema}, seeds array<long>").drop("base_id", "__limit"), tile)


def thinned_sample(pixels: DataFrame, seeds: Sequence[int], *, tile: int, per_image: int, per_group: int) -> DataFrame:
    """``seed, group_name, image_id, thermal_row, thermal_col, tile_row, tile_col`` and the other columns of the sample of every seed: :func:`drawn_pixels`, a row per seed."""
    columns = ["seed", "group_name", "image_id", "thermal_row", "thermal_col", "tile_row", "tile_col", *[c for c in pixels.columns if c not in ("image_id", "group_name", "thermal_row", "thermal_col")]]
    return drawn_pixels(pixels, seeds, tile=tile, per_image=per_image, per_group=per_group).withColumn("seed", F.explode(F.col("seeds").cast("array<int>"))).select(*columns)


def sampling_manifest(pixels: DataFrame, sample: DataFrame) -> DataFrame:
    """Eligible and sampled pixels and their ratio per seed, group and image; strata without a sample have 0."""
    seeds = [r[0] for r in sample.select("seed").distinct().collect()]  # the given seeds
    e = pixels.groupBy("group_name", "image_id").agg(F.count("*").alias("eligible")).withColumn("seed", F.explode(F.array(*[F.lit(int(s)) for s in seeds])))
    s = sample.groupBy("seed", "group_name", "image_id").agg(F.count("*").alias("sampled"))
    out = e.join(s, ["seed", "group_name", "image_id"], "left").withColumn("sampled", F.coalesce("sampled", F.lit(0).cast("long")))
    return out.withColumn("fraction", F.col("sampled") / F.col("eligible"))
