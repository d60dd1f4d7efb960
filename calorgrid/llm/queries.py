"""Registered queries of this subpackage, with production parameters over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from calorgrid.llm import packing, quantiles, reading, sample, tokenize
from calorgrid.operators.selection import FINE, exact_quantiles
from calorgrid.runtime import broadcast_if_small, drop_scratch, scratch, table

STRATUM = ["analysis_family", "group_name", "image_id"]


def formal(pixels: DataFrame) -> DataFrame:
    """Pixel rows of the formal population: eligible, inside the target, finite difference."""
    d = F.col("delta_t_c")
    return pixels.where(F.col("analysis_eligible") & F.col("target_mask") & d.isNotNull() & ~F.isnan(d) & (F.abs(d) < float("inf")))


def formal_pixels(pixels: DataFrame) -> DataFrame:
    """``image_id, thermal_row, thermal_col, luhk, cover, arrival_batch`` of every formal pixel, once; the batch is that of its first delivery."""
    luhk = F.when(F.col("luhk_label_valid"), F.concat(F.col("luhk_class_code").cast("string"), F.lit(" | "), F.col("luhk_class_name")))
    cover = F.when(F.col("surface_cover_valid"), F.col("surface_cover_class"))
    rows = formal(pixels).select("image_id", "thermal_row", "thermal_col", luhk.alias("luhk"), cover.alias("cover"), "ingest_batch")
    return rows.groupBy("image_id", "thermal_row", "thermal_col", "luhk", "cover").agg(F.min("ingest_batch").alias("arrival_batch"))


def stratum_rates(manifest: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The frozen rate of each stratum and seed of the manifest; ``known`` are rates frozen before."""
    return sample.freeze_rates(manifest, on=STRATUM, seed="sampling_seed", eligible="eligible_pixel_count", sampled="sampled_pixel_count", as_of="as_of_batch", row_id="manifest_id", known=known)


def pixel_sample(pixels: DataFrame, rates: DataFrame) -> DataFrame:
    """``STRATUM, sampling_seed, arrival_batch, pixel_uid`` of the frozen sample of every stratum and seed with a rate.

    The pixels are laid by capture once, narrow; a capture's rates come beside them as one list (its strata
    are few), so that neither the strata a pixel belongs to nor their batches are shuffled. A batch of a
    stratum is part of a capture's grid, so ranking it is bounded.
    """
    rates = sample.usable(rates, "rate").where(" and ".join(f"{c} is not null" for c in STRATUM))
    lists = rates.groupBy("image_id").agg(F.collect_list(F.struct("analysis_family", "group_name", "sampling_seed", "rate")).alias("__rates"))
    rows = formal_pixels(pixels).repartition("image_id").join(lists, "image_id")
    group = F.create_map(F.lit("luhk"), F.col("luhk"), F.lit("surface_cover"), F.col("cover"), F.lit("image_comparison"), F.col("image_id"))
    rows = rows.withColumn("__groups", group).withColumn("__s", F.explode(F.filter("__rates", lambda r: r["group_name"] == F.col("__groups")[r["analysis_family"]])))
    uid = F.format_string("%s__r%04d_c%04d", "image_id", "thermal_row", "thermal_col")
    rows = rows.select("__s.analysis_family", "__s.group_name", "image_id", "__s.sampling_seed", "__s.rate", "arrival_batch", uid.alias("pixel_uid"))
    picked = sample.ranked_bottom_k(rows, [*STRATUM, "sampling_seed", "arrival_batch"], name="pixel_uid", rate="rate", seed="sampling_seed")
    return picked.select(*STRATUM, "sampling_seed", "arrival_batch", "pixel_uid")


def p2_pixel_sample(spark: SparkSession, sf: str) -> DataFrame:
    """The sampled pixels of every manifest stratum and seed with the batch that first delivered them."""
    return pixel_sample(table(spark, sf, "pixel_samples"), stratum_rates(table(spark, sf, "sampling_manifest")))


def p2_growth(spark: SparkSession, sf: str) -> DataFrame:
    """Per manifest batch what the sample was when pixels and manifest had arrived up to it: strata, pixels, and pixels lost since the batch before.

    Every state is drawn from the tables as they were, none from another state.
    """
    pixels, manifest = table(spark, sf, "pixel_samples"), table(spark, sf, "sampling_manifest")
    batches = sorted(r[0] for r in manifest.select("as_of_batch").where("as_of_batch is not null").distinct().collect())  # one per manifest
    states = None
    for k, b in enumerate(batches):
        state = pixel_sample(pixels.where(F.col("ingest_batch") <= b), stratum_rates(manifest.where(F.col("as_of_batch") <= b))).withColumn("__at", F.lit(k))
        states = state if states is None else states.unionByName(state)
    if states is None:
        return spark.createDataFrame([], "as_of_batch int, n_strata long, n_selected long, n_lost long")
    held = states.groupBy(*STRATUM, "sampling_seed", "pixel_uid").agg(F.collect_set("__at").alias("__held"))  # at most one entry per batch
    stratum = F.struct(*STRATUM, "sampling_seed")
    each = held.select(stratum.alias("s"), "__held", F.explode(F.array_distinct(F.flatten(F.transform("__held", lambda k: F.array(k, k + 1))))).alias("at")).where(F.col("at") < len(batches))
    now = F.array_contains("__held", F.col("at"))
    out = each.groupBy("at").agg(F.countDistinct(F.when(now, F.col("s"))).alias("n_strata"), F.count_if(now).alias("n_selected"), F.count_if(~now).alias("n_lost"))
    return out.select(F.element_at(F.array(*map(F.lit, batches)), F.col("at") + 1).alias("as_of_batch"), "n_strata", "n_selected", "n_lost")


def p2_manifest_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Each manifest row with the number of pixels selected as of its batch."""
    counts = p2_pixel_sample(spark, sf).groupBy(*STRATUM, "sampling_seed", "arrival_batch").agg(F.count("*").alias("n"))
    m = table(spark, sf, "sampling_manifest").select("manifest_id", *STRATUM, "sampling_seed", "as_of_batch", "sampled_pixel_count")
    c = counts.toDF(*[f"__{x}" for x in counts.columns])
    cond = m["sampling_seed"].eqNullSafe(c["__sampling_seed"]) & (c["__arrival_batch"] <= m["as_of_batch"])
    for k in STRATUM:
        cond = cond & (m[k] == c[f"__{k}"])
    return m.join(c, cond, "left").groupBy("manifest_id", "sampled_pixel_count").agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("n_selected"))


#: A flight's summary has at most about 2 / EPS tuples and a rank error of at most EPS / 2.
EPS = 0.02
SUMMARY_KEYS = ["flight_id", "luhk_class_code", "surface_cover_class"]
PERCENTILES = {"q05_full": 0.05, "q25_full": 0.25, "median_full": 0.5, "q75_full": 0.75, "q95_full": 0.95}


def packed_differences(pixels: DataFrame) -> DataFrame:
    """Differences of the formal pixels with a valid land-use label, laid together by flight, code, cover and capture."""
    place = [F.coalesce(F.col(c).cast("int"), F.lit(-32768)) for c in ("thermal_row", "thermal_col")]
    return scratch(quantiles.packed(formal(pixels).where("luhk_label_valid"), SUMMARY_KEYS, "image_id", place[0] * 65536 + place[1], F.col("delta_t_c")))


def flight_summaries(packs: DataFrame) -> DataFrame:
    """The rank-interval summary of every flight, code and cover."""
    parts = scratch(quantiles.summaries(packs, SUMMARY_KEYS, "image_id", EPS / 2))
    most = parts.agg(F.max("__part")).first()[0]
    if not most:
        return parts.drop("__part")
    merged = scratch(quantiles.merge_levels(parts, SUMMARY_KEYS, "__part", EPS / 2, most + 1))
    drop_scratch(parts)
    return merged


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Published percentiles that are more than 0.5 degrees off those of the pixels."""
    packs = packed_differences(table(spark, sf, "pixel_samples"))
    known = quantiles.percentiles(flight_summaries(packs), SUMMARY_KEYS, PERCENTILES)
    known = known.toDF(*[f"__{c}" if c in SUMMARY_KEYS else c for c in known.columns])
    published = table(spark, sf, "delta_t_summary").select("summary_id", *SUMMARY_KEYS, *PERCENTILES)

    def same(a: DataFrame, b: DataFrame):
        cond = F.lit(True)
        for c in SUMMARY_KEYS:
            cond = cond & a[c].eqNullSafe(b[f"__{c}"])
        return cond

    wrong = sure = None
    for q in PERCENTILES:
        low, high, value = F.col(f"{q}_low"), F.col(f"{q}_high"), F.col(q)
        off = F.coalesce((value < low - 0.5) | (value > high + 0.5), F.lit(False))
        on = F.coalesce((value >= high - 0.5) & (value <= low + 0.5), value.isNull())
        wrong = off if wrong is None else wrong | off
        sure = on if sure is None else sure & on
    judged = scratch(published.join(known, same(published, known)).select("summary_id", *SUMMARY_KEYS, *PERCENTILES, wrong.alias("wrong"), (wrong | sure).alias("sure")))
    found = judged.where("wrong").select("summary_id")
    open_rows = judged.where("not sure")
    n_open = open_rows.count()
    if n_open:  # the bounds leave these open: exact percentiles of their groups decide
        keys = broadcast_if_small(open_rows.select(*[F.col(c).alias(f"__{c}") for c in SUMMARY_KEYS]).distinct(), n_open)
        held = packs.join(keys, same(packs, keys), "left_semi").select(*SUMMARY_KEYS, "image_id", F.explode(F.arrays_zip("pos", "vals")).alias("x"))
        values = held.groupBy(*SUMMARY_KEYS, "image_id", "x.pos").agg(F.min("x.vals").alias("d"))
        exact = exact_quantiles(values, SUMMARY_KEYS, F.col("d"), {f"__{q}": p for q, p in PERCENTILES.items()}, scale=FINE)
        exact = exact.toDF(*[f"__{c}" if c in SUMMARY_KEYS else c for c in exact.columns])
        off = F.lit(False)
        for q in PERCENTILES:
            off = off | F.coalesce(F.abs(F.col(q) - F.col(f"__{q}")) > 0.5, F.lit(False))
        found = found.unionByName(open_rows.join(exact, same(open_rows, exact)).where(off).select("summary_id"))
    return found


def p4_class_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Percentile bounds per code and cover, merged from the flights' summaries."""
    flights = flight_summaries(packed_differences(table(spark, sf, "pixel_samples")))
    most = flights.groupBy("luhk_class_code", "surface_cover_class").count().agg(F.max("count")).first()[0] or 1
    keys = ["luhk_class_code", "surface_cover_class"]
    return quantiles.percentiles(quantiles.merge_levels(flights, keys, "flight_id", EPS, most), keys, PERCENTILES)


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of every document's text by byte_bpe_50k."""
    return tokenize.token_ids(table(spark, sf, "documents"), "doc_id", "text")


def p9_containers(spark: SparkSession, sf: str) -> DataFrame:
    """Every document (or part of one) in a container, for each capacity of container_specs."""
    specs = {r["spec_id"]: r["capacity_tokens"] for r in table(spark, sf, "container_specs").where("capacity_tokens > 0").select("spec_id", "capacity_tokens").collect()}
    return packing.fill_containers(tokenize.token_counts(table(spark, sf, "documents"), "doc_id", "text"), specs)


def p10_reading_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Estimated level and its parts for every document."""
    return reading.reading_levels(table(spark, sf, "documents"), table(spark, sf, "reading_labels"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of English prose that need level 4 or 5."""
    return p10_reading_levels(spark, sf).where("demanding").select("doc_id")


QUERIES = {"p2_pixel_sample": p2_pixel_sample, "p2_manifest_fit": p2_manifest_fit, "p2_growth": p2_growth, "p4_found": p4_found, "p4_class_percentiles": p4_class_percentiles, "p8_ids": p8_ids, "p9_containers": p9_containers, "p10_found": p10_found, "p10_reading_levels": p10_reading_levels}

def _strata_sql(pixels: str = "(select *, 0 as st from pixel_samples)", manifest: str = "(select *, 0 as st from sampling_manifest)") -> str:
    """Pixels of every stratum and seed with rank and quota in their batch, for each state ``at`` of the tables."""
    return f"""
    with formal as (
      select st, image_id, thermal_row, thermal_col, min(ingest_batch) as arrival_batch,
        case when luhk_label_valid then cast(luhk_class_code as varchar) || ' | ' || luhk_class_name end as luhk,
        case when surface_cover_valid then surface_cover_class end as cover
      from {pixels} where analysis_eligible and target_mask and isfinite(delta_t_c) group by all),
    strata as (
      select 'luhk' as analysis_family, luhk as group_name, * from formal where luhk is not null union all
      select 'surface_cover', cover, * from formal where cover is not null union all
      select 'image_comparison', image_id, * from formal),
    named as (select st, analysis_family, group_name, image_id, arrival_batch, image_id || '__r' || lpad(cast(thermal_row as varchar), 4, '0') || '_c' || lpad(cast(thermal_col as varchar), 4, '0') as pixel_uid from strata),
    rates as (
      select st, analysis_family, group_name, image_id, sampling_seed, arg_min(sampled_pixel_count / eligible_pixel_count, struct_pack(a := as_of_batch, i := manifest_id)) as rate
      from {manifest} where sampled_pixel_count > 0 and sampled_pixel_count <= eligible_pixel_count group by all),
    ranked as (
      select n.*, r.sampling_seed,
        row_number() over (partition by st, n.analysis_family, n.group_name, n.image_id, r.sampling_seed, arrival_batch order by md5(coalesce(cast(r.sampling_seed as varchar), '') || '|' || pixel_uid), pixel_uid) as rn,
        ceil(r.rate * count(*) over (partition by st, n.analysis_family, n.group_name, n.image_id, r.sampling_seed, arrival_batch) - 1e-9) as k
      from named n join rates r using (st) where n.analysis_family = r.analysis_family and n.group_name = r.group_name and n.image_id = r.image_id)"""


_STATES = "(select t.*, c.st from {} t join (select distinct as_of_batch as st from sampling_manifest where as_of_batch is not null) c on t.{} <= c.st)"
_GROWTH_SQL = (
    _strata_sql(_STATES.format("pixel_samples", "ingest_batch"), _STATES.format("sampling_manifest", "as_of_batch"))
    + """, picks as (select st, analysis_family, group_name, image_id, sampling_seed, pixel_uid from ranked where rn <= k),
    steps as (select st, lag(st) over (order by st) as before from (select distinct st from picks)),
    lost as (select s.st, count(*) n from picks p join steps s on s.before = p.st where not exists (select 1 from picks q where q.st = s.st and q.analysis_family = p.analysis_family
      and q.group_name = p.group_name and q.image_id = p.image_id and q.sampling_seed is not distinct from p.sampling_seed and q.pixel_uid = p.pixel_uid) group by 1)
    select p.st as as_of_batch, count(distinct (analysis_family, group_name, image_id, sampling_seed)) as n_strata, count(*) as n_selected, coalesce(any_value(l.n), 0) as n_lost from picks p left join lost l on l.st = p.st group by 1"""
)

SQL = {
    "p2_pixel_sample": _strata_sql() + " select analysis_family, group_name, image_id, sampling_seed, arrival_batch, pixel_uid from ranked where rn <= k",
    "p2_manifest_fit": _strata_sql()
    + """, counts as (select analysis_family, group_name, image_id, sampling_seed, arrival_batch, count(*) n from ranked where rn <= k group by all)
      select m.manifest_id, m.sampled_pixel_count, cast(coalesce(sum(c.n), 0) as bigint) as n_selected from sampling_manifest m left join counts c
        on c.analysis_family = m.analysis_family and c.group_name = m.group_name and c.image_id = m.image_id and c.sampling_seed is not distinct from m.sampling_seed and c.arrival_batch <= m.as_of_batch
      group by 1, 2""",
    "p2_growth": _GROWTH_SQL,
    "p4_found": """
      with px as (select flight_id, luhk_class_code c, surface_cover_class s, image_id, thermal_row, thermal_col, min(cast(delta_t_c as double)) d from pixel_samples
        where analysis_eligible and target_mask and luhk_label_valid and isfinite(delta_t_c) group by all),
      q as (select flight_id, c, s, quantile_cont(d, 0.05) a, quantile_cont(d, 0.25) b, quantile_cont(d, 0.5) m, quantile_cont(d, 0.75) e, quantile_cont(d, 0.95) f from px group by all)
      select summary_id from delta_t_summary t join q on q.flight_id is not distinct from t.flight_id and q.c is not distinct from t.luhk_class_code and q.s is not distinct from t.surface_cover_class
      where abs(q05_full - a) > 0.5 or abs(q25_full - b) > 0.5 or abs(median_full - m) > 0.5 or abs(q75_full - e) > 0.5 or abs(q95_full - f) > 0.5""",
}
