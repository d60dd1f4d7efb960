"""Containers of fixed capacity filled by bulk-synchronous best-fit.

Items and gaps lie in tables sorted by size. In every round a sweep from large to small gives each item its
successor, the smallest open gap that holds it; a gap takes as many items of the size as it holds,
conflicts go by rank, the gaps shrink, and the next round begins; where nothing fits, containers are opened.
Items of one size are interchangeable, so both tables hold runs (a size and how many items, a width and a
row of containers): their length depends on the capacity and not on the number of documents. The runs are
cut into bands of size that are swept independently; bands widen while nothing fits inside them. The
documents are range-sorted once to get their rank among those of their size, and look their container up by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from calorgrid.runtime import broadcast_if_small, drop_scratch, scratch

#: Runs swept by one task, and ranks among which one task looks containers up.
BAND_ROWS, BLOCK = 20_000, 1 << 16
ITEM, GAP, MOVE = 1, 0, 2
#: A run: ``n`` items of ``size`` from rank ``first``, or ``n`` gaps of ``size`` from container ``first``; a move: ``n`` items from rank ``first`` to containers from ``container``, ``per`` to each.
STATE = "kind int, spec int, size long, first long, n long, container long, per long"
FIELDS = ["kind", "spec", "size", "first", "n", "container", "per"]


def sweep(rows: list[tuple[int, int, int, int]], spec: int) -> list[tuple]:
    """State rows after one sweep over runs ``(kind, size, first, n)`` sorted from large to small, gaps before items."""
    out: list[tuple] = []
    stack: list[list[int]] = []  # gaps not yet taken, the smallest on top
    for kind, size, first, n in rows:
        if kind == GAP:
            stack.append([size, first, n])
            continue
        while n and stack:
            width, container, many = stack[-1]
            per = width // size
            whole = min(many, n // per)
            if not whole:  # fewer items than one gap holds
                per, whole = n, 1
            out.append((MOVE, spec, size, first, whole * per, container, per))
            if width > per * size:
                out.append((GAP, spec, width - per * size, container, whole, 0, 0))
            first, n = first + whole * per, n - whole * per
            if whole == many:
                stack.pop()
            else:
                stack[-1] = [width, container + whole, many - whole]
        if n:
            out.append((ITEM, spec, size, first, n, 0, 0))
    out.extend((GAP, spec, width, container, many, 0, 0) for width, container, many in stack)
    return out


def _sweeper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sweeps the runs of each spec and band; rows come sorted by spec, band, size (descending), kind and first."""
    types = [pa.int32(), pa.int32(), *[pa.int64()] * 5]
    held: list[tuple] = []
    at = None

    def swept() -> pa.RecordBatch:
        columns = list(zip(*sweep(held, at[0])))
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=FIELDS)

    for batch in batches:
        for spec, band, *run in zip(*(batch.column(c).to_pylist() for c in ("spec", "band", "kind", "size", "first", "n"))):
            if (spec, band) != at:
                if held:
                    yield swept()
                held, at = [], (spec, band)
            held.append(tuple(run))
    if held:
        yield swept()


def best_fit(classes: DataFrame, specs: dict[int, int], band_rows: int = BAND_ROWS) -> DataFrame:
    """The moves ``spec, size, first, n, container, per`` that place all ``n`` items of every ``spec, size`` (sizes 1 to the capacity).

    One job per round; the driver sees a few counts per spec. A run is part of one band in a round, so runs
    and their sweeps stay the same whatever the partitioning.
    """
    spark = classes.sparkSession
    capacity = F.element_at(F.create_map(*[F.lit(x) for k, c in sorted(specs.items()) for x in (k, int(c))]), F.col("spec"))
    state = classes.select(F.lit(ITEM).alias("kind"), F.col("spec").cast("int").alias("spec"), F.col("size").cast("long").alias("size"), F.lit(0).cast("long").alias("first"), F.col("n").cast("long").alias("n"), F.lit(0).cast("long").alias("container"), F.lit(0).cast("long").alias("per"))
    state = scratch(state.where("n > 0"))
    moves = None
    opened = dict.fromkeys(specs, 0)
    bands = None
    is_item = F.col("kind") == ITEM
    while True:
        counts = {r["spec"]: r for r in state.groupBy("spec").agg(
            F.count("*").alias("rows"), F.coalesce(F.sum(F.when(is_item, F.col("size") * F.col("n"))), F.lit(0)).alias("left"), F.count_if(F.col("kind") == MOVE).alias("moved")
        ).collect()}
        open_specs = {k: r for k, r in counts.items() if r["left"]}
        placed = state.where(F.col("kind") == MOVE)
        moves = placed if moves is None else moves.unionByName(placed)
        if not open_specs:
            return moves.drop("kind")
        state = state.where((F.col("kind") != MOVE) & F.col("spec").isin(list(open_specs)))
        stuck = [k for k, r in open_specs.items() if not r["moved"]]
        if stuck and (bands or 1) > 1:
            bands = max(1, bands // 4)
        else:
            rows = []
            for k in stuck:
                more = -(-open_specs[k]["left"] // specs[k])
                rows.append((GAP, k, int(specs[k]), opened[k], more, 0, 0))
                opened[k] += more
            if rows:
                state = state.unionByName(spark.createDataFrame(rows, STATE))
            bands = max(1, max(r["rows"] for r in open_specs.values()) // band_rows)
        laid = state.withColumn("band", F.least(F.floor((F.col("size") - 1) * bands / capacity), F.lit(bands - 1)).cast("int"))
        laid = laid.repartition(len(open_specs) * bands, "spec", "band").sortWithinPartitions("spec", "band", F.desc("size"), "kind", "first")
        state = scratch(laid.select("spec", "band", "kind", "size", "first", "n").mapInArrow(_sweeper, STATE))


def _look_up(ranked: DataFrame, moves: DataFrame) -> DataFrame:
    """``ranked`` (``spec_id, n_tokens, rank`` and more) with the ``container_id`` of each item's move, found in blocks of ranks."""
    others = [c for c in ranked.columns if c not in ("spec_id", "n_tokens", "rank")]
    last = F.col("first") + F.col("n") - 1
    m = moves.withColumn("block", F.explode(F.sequence(F.floor(F.col("first") / BLOCK).cast("long"), F.floor(last / BLOCK).cast("long"))))
    m = m.select(
        F.col("spec").alias("spec_id"), F.col("size").alias("n_tokens"), F.greatest("first", F.col("block") * BLOCK).alias("rank"), "block",
        F.struct(F.col("first").alias("f"), F.col("container").alias("c"), F.col("per").alias("p")).alias("m"),
    )
    docs = ranked.withColumn("block", F.floor(F.col("rank") / BLOCK).cast("long"))
    both = docs.unionByName(m, allowMissingColumns=True).withColumn("doc", F.col("m").isNull())
    # of a block at most BLOCK documents and their moves meet; a move comes before the document of its first rank
    at = W.partitionBy("spec_id", "n_tokens", "block").orderBy("rank", "doc")
    held = both.withColumn("m", F.last("m", ignorenulls=True).over(at)).where("doc")
    container = F.col("m.c") + F.floor((F.col("rank") - F.col("m.f")) / F.col("m.p"))
    return held.select("spec_id", container.cast("long").alias("container_id"), "n_tokens", *others)


def fill_containers(sizes: DataFrame, specs: dict[int, int], doc_id: str = "doc_id", size: str = "n") -> DataFrame:
    """``spec_id, container_id, doc_id, part_no, token_from, n_tokens`` for every item and capacity.

    ``specs`` maps spec ids to capacities of at least 1. An item is kept whole unless it exceeds the
    capacity, then it is cut into full parts and a rest. Items of size 0 (and null sizes, counted as 0) take
    no space and are dealt over the containers. Equal sizes are ranked by id, so the result does not depend
    on partitioning; repeated rows are items of their own; an empty table gives no rows.
    """
    sized = scratch(sizes.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("__n")))  # sizes are computed once
    todo = F.array(*[F.struct(F.lit(k).alias("spec_id"), F.lit(int(c)).cast("long").alias("cap")) for k, c in sorted(specs.items())])
    base = sized.select("doc_id", "__n", F.explode(todo).alias("__s")).select("doc_id", "__n", "__s.*")
    parts = F.greatest(F.lit(1), F.ceil(F.col("__n") / F.col("cap"))).cast("int")
    items = base.withColumn("part_no", F.explode(F.sequence(F.lit(0), parts - 1))).withColumn("token_from", F.col("part_no") * F.col("cap"))
    items = items.select("spec_id", F.least("cap", F.col("__n") - F.col("token_from")).alias("n_tokens"), "doc_id", "part_no", "token_from")
    order = ["spec_id", "n_tokens", "doc_id", "part_no"]
    n = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranked = scratch(items.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    ranked = ranked.withColumn("__part", F.shiftright("__at", 33))
    # the rank of a row in its class: its place in its sorted partition plus the class's rows in partitions before
    runs = ranked.groupBy("spec_id", "n_tokens", "__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__many"))
    before = F.sum("__many").over(W.partitionBy("spec_id", "n_tokens").orderBy("__part")) - F.col("__many")
    runs = scratch(runs.withColumn("__before", before))
    classes = runs.where("n_tokens > 0").groupBy(F.col("spec_id").alias("spec"), F.col("n_tokens").alias("size")).agg(F.sum("__many").alias("n"))
    moves = scratch(best_fit(classes, specs))
    small = broadcast_if_small(runs.select(F.col("spec_id").alias("__k"), F.col("n_tokens").alias("__z"), F.col("__part").alias("__p"), "__first", "__before"), runs.count())
    placed = ranked.join(small, (ranked["spec_id"] == small["__k"]) & (ranked["n_tokens"] == small["__z"]) & (ranked["__part"] == small["__p"]))
    placed = placed.select("spec_id", "n_tokens", "doc_id", "part_no", "token_from", (F.col("__at") - F.col("__first") + F.col("__before")).alias("rank"))
    used = {r[0]: r[1] for r in moves.groupBy("spec").agg(F.max(F.col("container") + F.ceil(F.col("n") / F.col("per")))).collect()}  # one per spec
    most = F.element_at(F.create_map(*[F.lit(x) for k in sorted(specs) for x in (k, max(1, used.get(k, 1)))]), F.col("spec_id"))
    empty = placed.where("n_tokens = 0").withColumn("container_id", (F.col("rank") % most).cast("long"))
    out = ["spec_id", "container_id", "doc_id", "part_no", "token_from", "n_tokens"]
    drop_scratch(sized)
    return _look_up(placed.where("n_tokens > 0"), moves).select(*out).unionByName(empty.select(*out))
