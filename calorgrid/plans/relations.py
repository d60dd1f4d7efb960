"""Registered queries of joins, aggregations, windows, orderings and set operations."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from calorgrid.functions.predicates import COVERS, NO_COVER, finite
from calorgrid.operators import describe as D, joins as J
from calorgrid.operators.selection import exact_quantiles
from calorgrid.plans.analysis import family_sample, sample_sql
from calorgrid.plans.registry import Registry
from calorgrid.plans.scalars import CELL_BOXES_SQL, FAMILY_SQL, GRID_SQL, STAMP_SQL, cell_boxes, family_groups, grid, px, stamp
from calorgrid.runtime import scratch, table

query = Registry()
QUERIES, SQL = query.queries, query.sql

Q5 = "round(quantile_cont({v}, 0.05), 4) q05, round(quantile_cont({v}, 0.25), 4) q25, round(quantile_cont({v}, 0.5), 4) median, round(quantile_cont({v}, 0.75), 4) q75, round(quantile_cont({v}, 0.95), 4) q95"
MOMENTS = "count({v}) n, round(avg({v}), 4) mean, round(coalesce(stddev_samp({v}), case when count({v}) = 1 then 0.0 end), 4) sd, round(min({v}), 4) as \"min\", round(max({v}), 4) as \"max\", "


@query("join01_checked_left", "select i.image_id, i.n, s.capture_seq from (select image_id, count(*) n from pixel_samples group by 1) i left join (select image_id, min(capture_seq) capture_seq from subzero_qa group by 1) s using (image_id)")
def _(spark, sf):
    images = px(spark, sf).groupBy("image_id").agg(F.count("*").alias("n"))
    return J.checked_join(images, table(spark, sf, "subzero_qa").groupBy("image_id").agg(F.min("capture_seq").alias("capture_seq")), ["image_id"])


@query("join03_coverage", """with a as (select distinct image_id i from validation_records), b as (select distinct image_id i from subzero_qa)
    select count(*) filter (where a.i is not null and b.i is not null) as both_sides, count(*) filter (where b.i is null) as left_only, count(*) filter (where a.i is null) as right_only from a full join b on a.i = b.i""")
def _(spark, sf):
    ids = lambda t, c: table(spark, sf, t).select(F.col("image_id").alias(c)).distinct()
    both = ids("validation_records", "a").join(ids("subzero_qa", "b"), F.col("a") == F.col("b"), "full")
    return both.agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both_sides"), F.count_if(F.col("b").isNull()).alias("left_only"), F.count_if(F.col("a").isNull()).alias("right_only"))


@query("join04_grid_lookup", """with v as (select record_id, cast(floor((gps_longitude + 180) / 0.02) as bigint) x, cast(floor((gps_latitude + 90) / 0.02) as bigint) y from validation_records where gps_latitude between -90 and 90),
    c as (select x, y, count(*) n_cells, min(cell_key) cell_key from (select cell_key, cast(floor((cell_center_lon + 180) / 0.02) as bigint) x, cast(floor((cell_center_lat + 90) / 0.02) as bigint) y from luhk_cells where cell_center_lat is not null) group by 1, 2)
    select record_id, cell_key from v left join c on v.x = c.x and v.y = c.y""")
def _(spark, sf):
    v = table(spark, sf, "validation_records").where("gps_latitude between -90 and 90")
    i = lambda c, o: F.floor((F.col(c) + o) / 0.02).cast("long")
    c = table(spark, sf, "luhk_cells").where("cell_center_lat is not null").groupBy(i("cell_center_lon", 180).alias("cx"), i("cell_center_lat", 90).alias("cy")).agg(F.min("cell_key").alias("cell_key"))
    v = v.select("record_id", i("gps_longitude", 180).alias("x"), i("gps_latitude", 90).alias("y"))
    return v.join(c, (v["x"] == c["cx"]) & (v["y"] == c["cy"]), "left").select("record_id", "cell_key")


_NAMES = ", ".join(f"({k}, '{v}')" for k, v in COVERS.items())


@query("join05_label_lookup", f"select e.vec_id, coalesce(c.name, '{NO_COVER}') as cover from embeddings e left join (values {_NAMES}) c(id, name) on e.label = c.id")
def _(spark, sf):
    names = spark.createDataFrame(list(COVERS.items()), "id int, cover string")
    return table(spark, sf, "embeddings").join(F.broadcast(names), F.col("label") == F.col("id"), "left").select("vec_id", F.coalesce("cover", F.lit(NO_COVER)).alias("cover"))


@query("join06_pair_in_time", f"""with v as (select record_id, flight_id, {STAMP_SQL.format('visible_path')} ts from validation_records), t as (select qa_id, flight_id, {STAMP_SQL.format('image_id')} ts from subzero_qa),
    p as (select v.record_id l, count(t.qa_id) n, min(t.qa_id) r, min(abs(epoch_us(v.ts) - epoch_us(t.ts)) / 1e6) g from v left join t on v.flight_id = t.flight_id and abs(epoch_us(v.ts) - epoch_us(t.ts)) <= 15000000 group by 1)
    select l as record_id, case when n = 1 then r end as qa_id, n as n_candidates, round(case when n = 1 then g end, 6) as gap_s from p""")
def _(spark, sf):
    """Delivered captures with the one QA capture of their flight within 15 seconds."""
    v = table(spark, sf, "validation_records").select("record_id", "flight_id", stamp("visible_path").alias("ts"))
    t = table(spark, sf, "subzero_qa").select("qa_id", "flight_id", stamp("image_id").alias("ts"))
    return J.pair_in_time(v, t, key="flight_id", left_id="record_id", right_id="qa_id", at="ts", tolerance_s=15).withColumn("gap_s", F.round("gap_s", 6))


_FILES_SQL = """(select distinct flight_id folder, regexp_extract(p, 'DJI_(\\d{14})_(\\d+)', 0) base, cast(regexp_extract(p, 'DJI_(\\d{14})_(\\d+)', 2) as bigint) % 400 sample, r role, p path from
    (select flight_id, visible_path p, 'V' r, record_id from validation_records union all select flight_id, thermal_path p, 'T' r, record_id from validation_records) where p is not null and p <> '')"""


@query("join07_pair_two_stage", f"""with f as {_FILES_SQL}, s as (select folder, base, count(*) filter (where role = 'V') nv, count(*) filter (where role = 'T') nt, min(path) filter (where role = 'V') visible, min(path) filter (where role = 'T') thermal from f group by 1, 2),
    one as (select * from s where nv = 1 and nt = 1), rest as (select f.* from f where not exists (select 1 from one where one.folder = f.folder and one.base = f.base)),
    two as (select folder, sample, count(*) filter (where role = 'V') nv, count(*) filter (where role = 'T') nt, min(path) filter (where role = 'V') visible, min(path) filter (where role = 'T') thermal from rest group by 1, 2)
    select 'base' as stage, folder, base as key, visible, thermal, 'ok' as status from one union all
    select 'sample', folder, cast(sample as varchar), case when nv = 1 then visible end, case when nt = 1 then thermal end, case when nv > 1 or nt > 1 then 'duplicate' when nv = 0 then 'missing_visible' when nt = 0 then 'missing_thermal' else 'ok' end from two""")
def _(spark, sf):
    v = table(spark, sf, "validation_records")
    name = lambda k: F.regexp_extract("path", r"DJI_(\d{14})_(\d+)", k)
    side = lambda col, role: v.select(F.col("flight_id").alias("folder"), F.col(col).alias("path"), F.lit(role).alias("role"))
    files = side("visible_path", "V").unionByName(side("thermal_path", "T")).where("path is not null and path != ''")
    files = files.select("folder", name(0).alias("base"), (name(2).cast("long") % 400).alias("sample"), "role", "path").distinct()
    return J.pair_two_stage(files, folder="folder", base="base", sample="sample", role="role", path="path")


@query("join08_pair_rows", """with r as (select record_id, 'visible' kind, visible_path p from validation_records union all select record_id, 'thermal', thermal_path from validation_records), m as (select image_id, min(minimum_temperature_c) t from subzero_qa group by 1)
    select r.record_id, kind, p as path, m.t as minimum_c from r left join m on m.image_id = nullif(regexp_extract(p, 'DJI_\\d{14}_\\d+', 0), '') where p is not null""")
def _(spark, sf):
    rows = table(spark, sf, "validation_records").selectExpr("record_id", "stack(2, 'visible', visible_path, 'thermal', thermal_path) as (kind, path)").where("path is not null")
    m = table(spark, sf, "subzero_qa").groupBy(F.col("image_id").alias("__i")).agg(F.min("minimum_temperature_c").alias("minimum_c"))
    return rows.join(m, F.regexp_extract("path", r"DJI_\d{14}_\d+", 0) == F.col("__i"), "left").select("record_id", "kind", "path", "minimum_c")


@query("join09_priority_merge", """select q.qa_id, coalesce(a.v, b.v, c.v) as cover, case when a.v is not null then 'image' when b.v is not null then 'flight' when c.v is not null then 'any' else 'unmatched' end as origin from subzero_qa q
    left join (select image_id, min(surface_cover_class) v from pixel_samples where target_id = 'tgt-0417' group by 1) a on a.image_id = q.image_id
    left join (select flight_id, max(surface_cover_class) v from pixel_samples where shadow_flag = 1 group by 1) b on b.flight_id = q.flight_id
    left join (select flight_id, min(luhk_class_name) v from pixel_samples group by 1) c on c.flight_id = q.flight_id""")
def _(spark, sf):
    p = px(spark, sf)
    a = p.where("target_id = 'tgt-0417'").groupBy("image_id").agg(F.min("surface_cover_class").alias("a"))
    b = p.where("shadow_flag = 1").groupBy("flight_id").agg(F.max("surface_cover_class").alias("b"))
    c = p.groupBy("flight_id").agg(F.min("luhk_class_name").alias("c"))
    q = table(spark, sf, "subzero_qa").select("qa_id", "image_id", "flight_id").join(a, "image_id", "left").join(b, "flight_id", "left").join(c, "flight_id", "left")
    origin = F.when(F.col("a").isNotNull(), "image").when(F.col("b").isNotNull(), "flight").when(F.col("c").isNotNull(), "any").otherwise("unmatched")
    return q.select("qa_id", F.coalesce("a", "b", "c").alias("cover"), origin.alias("origin"))


@query("join13_overlap", f"""with f as (select record_id, gps_longitude - altitude_m * 1e-5 x0, gps_longitude + altitude_m * 1e-5 x1, gps_latitude - altitude_m * 8e-6 y0, gps_latitude + altitude_m * 8e-6 y1 from validation_records where gps_latitude between -90 and 90 and gps_longitude between -180 and 180 and altitude_m > 0),
    c as {CELL_BOXES_SQL}
    select record_id, count(distinct cell_key) as n_cells, round(sum((least(x1, u1) - greatest(x0, u0)) * (least(y1, w1) - greatest(y0, w0))) * 1e9, 3) as area from f join c on x0 < u1 and u0 < x1 and y0 < w1 and w0 < y1 group by 1""")
def _(spark, sf):
    v = table(spark, sf, "validation_records").where("gps_latitude between -90 and 90 and gps_longitude between -180 and 180 and altitude_m > 0")
    f = v.select("record_id", F.expr("gps_longitude - altitude_m * 1e-5").alias("x0"), F.expr("gps_longitude + altitude_m * 1e-5").alias("x1"), F.expr("gps_latitude - altitude_m * 8e-6").alias("y0"), F.expr("gps_latitude + altitude_m * 8e-6").alias("y1"))
    hits = J.overlapping(f, cell_boxes(spark, sf), a_box=("x0", "x1", "y0", "y1"), b_box=("u0", "u1", "w0", "w1"), tile=0.002)
    return hits.groupBy("record_id").agg(F.count_distinct("cell_key").alias("n_cells"), F.round(F.sum("overlap_area") * 1e9, 3).alias("area"))


WINDOWS = [("early", "2023-01-01 00:00:00", "2023-12-31 23:59:59"), ("spring", "2023-03-01 00:00:00", "2024-05-31 23:59:59"), ("all", "1970-01-01 00:00:00", "2100-01-01 00:00:00")]
_WIN = ", ".join(f"('{n}', timestamp '{a}', timestamp '{b}')" for n, a, b in WINDOWS)


@query("join14_windows", f"select window_id, flight_id, count(*) as n, round(sum(mean_temperature_c) filter (where isfinite(mean_temperature_c)), 4) as total from subzero_qa join (values {_WIN}) w(window_id, a, b) on generated_at between a and b group by 1, 2")
def _(spark, sf):
    e = J.in_windows(table(spark, sf, "subzero_qa").withColumn("at", F.to_utc_timestamp(F.col("generated_at").cast("timestamp"), "UTC")), "at", WINDOWS)
    return e.groupBy("window_id", "flight_id").agg(F.count("*").alias("n"), F.round(F.sum(F.when(finite(F.col("mean_temperature_c")), F.col("mean_temperature_c"))), 4).alias("total"))


@query("join17_semi", "select qa_id from subzero_qa q where exists (select 1 from pixel_samples p where p.image_id = q.image_id and p.target_id = 'tgt-0417')")
def _(spark, sf):
    hit = px(spark, sf).where("target_id = 'tgt-0417'").select("image_id").distinct()
    return table(spark, sf, "subzero_qa").join(hit, "image_id", "left_semi").select("qa_id")


@query("join18_anti", "select v.record_id from validation_records v where not exists (select 1 from pixel_samples p where p.image_id = v.image_id)")
def _(spark, sf):
    return table(spark, sf, "validation_records").join(px(spark, sf).select("image_id").distinct(), "image_id", "left_anti").select("record_id")


@query("join22_unique_fallback", """with r as (select flight_id, image_id, luhk_class_name v from pixel_samples), e as (select flight_id, image_id, min(v) v from r group by 1, 2), u as (select flight_id, count(distinct v) n, min(v) v from r group by 1)
    select q.qa_id, coalesce(e.v, case when u.n = 1 then u.v end) as name, case when e.v is not null then 'exact' when u.n = 1 then 'unique' when u.n > 1 then 'ambiguous' else 'missing' end as match from subzero_qa q left join e using (flight_id, image_id) left join u using (flight_id)""")
def _(spark, sf):
    r = px(spark, sf).select("flight_id", "image_id", F.col("luhk_class_name").alias("name"))
    return J.unique_fallback(table(spark, sf, "subzero_qa").select("qa_id", "flight_id", "image_id"), r, exact=["flight_id", "image_id"], loose="flight_id", value="name").select("qa_id", "name", "match")


_D = "case when isfinite(delta_t_c) then cast(delta_t_c as double) end"


@query("agg01_describe", "select surface_cover_class, " + (MOMENTS + Q5).format(v="d") + f" from (select surface_cover_class, {_D} d from pixel_samples) group by 1")
def _(spark, sf):
    return D.describe(px(spark, sf), ["surface_cover_class"], F.col("delta_t_c"))


@query("agg02_describe_sd_null", "select image_id, " + (MOMENTS + Q5).format(v="d").replace("coalesce(stddev_samp(d), case when count(d) = 1 then 0.0 end)", "stddev_samp(d)") + f" from (select image_id, {_D} d from pixel_samples) group by 1")
def _(spark, sf):
    return D.describe(px(spark, sf), ["image_id"], F.col("delta_t_c"), single_sd=None)


@query("agg03_full_and_sample", f"""select f.luhk_class_code, f.n as n_full, f.n_images, round(f.mean, 4) as mean_full, coalesce(s.n, 0) as n_sampled, round(s.mean, 4) as mean_sampled, round(s.median, 4) as median_sampled from
    (select luhk_class_code, count(*) n, count(distinct image_id) n_images, avg(cast(delta_t_c as double)) mean from pixel_samples where isfinite(delta_t_c) group by 1) f left join
    (select cast(split_part(group_name, ' | ', 1) as int) c, count(*) n, avg(delta_t_c) mean, quantile_cont(delta_t_c, 0.5) median from {sample_sql('luhk')} group by 1) s on f.luhk_class_code = s.c""")
def _(spark, sf):
    p = px(spark, sf).where(finite(F.col("delta_t_c"))).withColumn("d", F.col("delta_t_c").cast("double"))
    per = p.groupBy("luhk_class_code", "image_id").agg(F.count("*").alias("n"), F.sum("d").alias("s"))
    full = per.groupBy("luhk_class_code").agg(F.sum("n").alias("n_full"), F.count("*").alias("n_images"), (F.sum("s") / F.sum("n")).alias("m"))
    drawn = scratch(family_sample(spark, sf, "luhk")[1].select(F.col("luhk_class_code").alias("code"), F.col("delta_t_c").alias("d")))
    s = drawn.groupBy("code").agg(F.count("*").alias("ns"), F.avg("d").alias("ms"))
    q = exact_quantiles(drawn, ["code"], F.col("d"), {"median": 0.5}).withColumnRenamed("code", "__q")
    out = full.join(s, full["luhk_class_code"].eqNullSafe(s["code"]), "left").join(q, full["luhk_class_code"].eqNullSafe(q["__q"]), "left")
    return out.select("luhk_class_code", "n_full", "n_images", F.round("m", 4).alias("mean_full"), F.coalesce("ns", F.lit(0).cast("long")).alias("n_sampled"), F.round("ms", 4).alias("mean_sampled"), F.round("median", 4).alias("median_sampled"))


@query("agg05_capture_reduction", f"""select image_id, count(*) filter (where analysis_eligible and target_mask and isfinite(temperature_c)) as n_temperature, count(*) filter (where analysis_eligible and target_mask and isfinite(temperature_c) and isfinite(delta_t_c)) as n_delta,
    round(avg(cast(temperature_c as double)) filter (where analysis_eligible and target_mask and isfinite(temperature_c)), 4) as mean_c, round(max(cast(delta_t_c as double)) filter (where analysis_eligible and target_mask and isfinite(temperature_c) and isfinite(delta_t_c)), 4) as max_delta_c from pixel_samples group by 1""")
def _(spark, sf):
    t = F.coalesce(F.col("analysis_eligible") & F.col("target_mask"), F.lit(False)) & finite(F.col("temperature_c"))
    d = t & finite(F.col("delta_t_c"))
    return px(spark, sf).groupBy("image_id").agg(F.count_if(t).alias("n_temperature"), F.count_if(d).alias("n_delta"), F.round(F.avg(F.when(t, F.col("temperature_c").cast("double"))), 4).alias("mean_c"), F.round(F.max(F.when(d, F.col("delta_t_c").cast("double"))), 4).alias("max_delta_c"))


STRATA = ["measurement_type", "temperature_source", "ambient_source", "ambient_definition", "ambient_data_qa_status", "source_method"]


@query("agg07_source_strata", f"select image_id, {', '.join(STRATA)}, count(*) as n, round(avg({_D}), 4) as mean_delta from pixel_samples group by image_id, {', '.join(STRATA)}")
def _(spark, sf):
    d = F.when(finite(F.col("delta_t_c")), F.col("delta_t_c").cast("double"))
    return px(spark, sf).groupBy("image_id", *STRATA).agg(F.count("*").alias("n"), F.round(F.avg(d), 4).alias("mean_delta"))


@query("agg08_mean_of_means", "select surface_cover_class, round(avg(m), 4) as mean, count(*) as n_units from (select surface_cover_class, image_id, avg(cast(temperature_c as double)) m from pixel_samples where isfinite(temperature_c) group by 1, 2) group by 1")
def _(spark, sf):
    return D.mean_of_means(px(spark, sf), ["surface_cover_class"], "image_id", "temperature_c").withColumn("mean", F.round("mean", 4))


@query("agg09_composition", "select flight_id, surface_cover_class, count(*) as n, round(count(*) / sum(count(*)) over (partition by flight_id), 6) as share from pixel_samples group by 1, 2")
def _(spark, sf):
    return D.composition(px(spark, sf), ["flight_id"], "surface_cover_class").withColumn("share", F.round("share", 6))


@query("agg10_extremes", """with b as (select image_id, cast(temperature_c as double) x, thermal_row r, thermal_col c from pixel_samples where isfinite(temperature_c)),
    e as (select image_id, count(*) n, min(x) lo, max(x) hi, quantile_cont(x, 0.01) a, quantile_cont(x, 0.99) z from b group by 1),
    t as (select image_id, count(*) filter (where abs(x - lo) <= 1e-7) l, count(*) filter (where abs(x - hi) <= 1e-7) h, count(*) filter (where x > z) q, min(r * 100000 + c) filter (where x = lo) pl, min(r * 100000 + c) filter (where x = hi) ph from b join e using (image_id) group by 1)
    select image_id, n, round(lo, 4) as min_value, round(hi, 4) as max_value, round(a, 4) as q01, round(z, 4) as q99, l as n_min_ties, h as n_max_ties, q as n_above_q99, cast(pl // 100000 as int) as min_row, cast(pl % 100000 as int) as min_col, cast(ph // 100000 as int) as max_row, cast(ph % 100000 as int) as max_col from e join t using (image_id)""".replace("r * 100000", "r::bigint * 100000"))
def _(spark, sf):
    out = D.extremes(px(spark, sf), ["image_id"], "temperature_c", "thermal_row", "thermal_col")
    return out.withColumns({c: F.round(c, 4) for c in ("min_value", "max_value", "q01", "q99")} | {c: F.col(c).cast("int") for c in ("min_row", "min_col", "max_row", "max_col")})


@query("agg13_zero_filled_classes", f"""with i as (select distinct image_id from pixel_samples), c as (select * from (values {_NAMES}) c(id, cover))
    select i.image_id, c.cover, count(p.row_id) as n, round(stddev_pop(case when isfinite(p.temperature_c) then cast(p.temperature_c as double) end), 4) as sd from i cross join c left join pixel_samples p on p.image_id = i.image_id and p.surface_cover_class = c.cover group by 1, 2""")
def _(spark, sf):
    p = px(spark, sf).withColumn("cover", F.col("surface_cover_class"))
    t = F.when(finite(F.col("temperature_c")), F.col("temperature_c").cast("double"))
    return D.zero_filled(p, p, ["image_id"], "cover", list(COVERS.values()), {"n": F.count("*"), "sd": F.round(F.stddev_pop(t), 4)})


@query("agg14_threshold_counts", """select flight_id, count(*) filter (where minimum_temperature_c < 0) as below_0, count(*) filter (where minimum_temperature_c < -5) as below_5, count(*) filter (where minimum_temperature_c < -10) as below_10, round(100.0 * count(*) filter (where minimum_temperature_c < 0) / count(*), 6) as percent from subzero_qa group by 1""")
def _(spark, sf):
    m = F.col("minimum_temperature_c")
    below = lambda t: F.count_if(m < t)
    return table(spark, sf, "subzero_qa").groupBy("flight_id").agg(below(0).alias("below_0"), below(-5).alias("below_5"), below(-10).alias("below_10"), F.round(100.0 * below(0) / F.count("*"), 6).alias("percent"))


def _cold(t):
    below = lambda c: F.count_if(t < c)
    return [below(0).alias("below_0"), below(-5).alias("below_5"), below(-10).alias("below_10"), F.round(F.try_divide(100.0 * below(0), F.count(t)), 6).alias("percent")]


_COLD = "count(*) filter (where t < 0) as below_0, count(*) filter (where t < -5) as below_5, count(*) filter (where t < -10) as below_10, round(100.0 * count(*) filter (where t < 0) / nullif(count(t), 0), 6) as percent"
_TEMPERATURES = "(select *, case when isfinite(temperature_c) then cast(temperature_c as double) end t from pixel_samples)"


@query("agg14_by_image", f"select image_id, {_COLD} from {_TEMPERATURES} group by 1")
def _(spark, sf):
    return px(spark, sf).groupBy("image_id").agg(*_cold(F.when(finite(F.col("temperature_c")), F.col("temperature_c"))))


@query("agg14_by_class", f"select image_id, surface_cover_class, {_COLD} from {_TEMPERATURES} group by 1, 2")
def _(spark, sf):
    return px(spark, sf).groupBy("image_id", "surface_cover_class").agg(*_cold(F.when(finite(F.col("temperature_c")), F.col("temperature_c"))))


@query("agg14_by_shadow", f"select image_id, shadow_flag, {_COLD} from {_TEMPERATURES} where shadow_valid group by 1, 2")
def _(spark, sf):
    return px(spark, sf).where("shadow_valid").groupBy("image_id", "shadow_flag").agg(*_cold(F.when(finite(F.col("temperature_c")), F.col("temperature_c"))))


@query("agg15_recurring_coordinates", """with k as (select thermal_row, thermal_col, count(distinct image_id) k from pixel_samples where temperature_c > 30 and not isnan(temperature_c) group by 1, 2), h as (select k, count(*) n from k group by 1)
    select cast(s as bigint) as images, coalesce(h.n, 0) as n_coordinates from generate_series(2, greatest(12, (select count(distinct image_id) from pixel_samples))) g(s) left join h on h.k = s""")
def _(spark, sf):
    k = px(spark, sf).where("temperature_c > 30 and not isnan(temperature_c)").select("thermal_row", "thermal_col", "image_id").distinct().groupBy("thermal_row", "thermal_col").agg(F.count("image_id").alias("images"))
    h = k.groupBy("images").agg(F.count("*").alias("n"))
    n = px(spark, sf).select("image_id").distinct().agg(F.count("image_id")).first()[0]
    # every recurrence up to the number of images, zero rows kept; 2 to 12 are there for fewer images too
    return spark.range(2, max(n, 12) + 1).withColumnRenamed("id", "images").join(h, "images", "left").select("images", F.coalesce("n", F.lit(0).cast("long")).alias("n_coordinates"))


@query("agg16_mode", """select flight_id, luhk_class_code, n from (select flight_id, luhk_class_code, count(*) n, row_number() over (partition by flight_id order by count(*) desc, luhk_class_code) r from pixel_samples group by 1, 2) where r = 1""")
def _(spark, sf):
    return D.mode(px(spark, sf), ["flight_id"], "luhk_class_code")


@query("agg17_area_proportions", """select luhk_category_name, round(sum(cell_area_m2) / sum(sum(cell_area_m2)) over (), 8) as proportion, count(*) as n_cells from (select distinct cell_key, luhk_category_name, cell_area_m2 from luhk_cells) group by 1""")
def _(spark, sf):
    c = table(spark, sf, "luhk_cells").select("cell_key", "luhk_category_name", "cell_area_m2").distinct()
    g = c.groupBy("luhk_category_name").agg(F.sum("cell_area_m2").alias("a"), F.count("*").alias("n_cells"))
    total = g.agg(F.sum("a")).first()[0]
    return g.select("luhk_category_name", F.round(F.col("a") / F.lit(total), 8).alias("proportion"), "n_cells")


@query("agg19_segment_statistics", f"select label, count(*) as n, min(thermal_row) as row_min, max(thermal_row) as row_max, round(avg(thermal_row), 6) as row_mean, round(avg(thermal_col), 6) as col_mean, round(avg(v), 6) as v_mean from {GRID_SQL} group by 1")
def _(spark, sf):
    return grid(spark, sf).groupBy("label").agg(F.count("*").alias("n"), F.min("thermal_row").alias("row_min"), F.max("thermal_row").alias("row_max"), F.round(F.avg("thermal_row"), 6).alias("row_mean"), F.round(F.avg("thermal_col"), 6).alias("col_mean"), F.round(F.avg("v"), 6).alias("v_mean"))


@query("agg20_review_rollup", """select image_id, case when bool_and(surface_cover_review_status = 'accepted') then 'all_reviewed' when bool_or(surface_cover_review_status = 'accepted') then 'partially_reviewed' else 'not_reviewed' end as status from pixel_samples group by 1""")
def _(spark, sf):
    ok = F.col("surface_cover_review_status") == "accepted"
    return px(spark, sf).groupBy("image_id").agg(F.when(F.bool_and(ok), "all_reviewed").when(F.bool_or(ok), "partially_reviewed").otherwise("not_reviewed").alias("status"))


@query("agg22_counters", "select camera_model, count(*) as n, array_to_string(list_sort(list(distinct cast(focal_length_mm as varchar)) filter (where focal_length_mm is not null)), ';') as focal_lengths from validation_records group by 1")
def _(spark, sf):
    return table(spark, sf, "validation_records").groupBy("camera_model").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set(F.col("focal_length_mm").cast("string"))), ";").alias("focal_lengths"))


@query("agg23_sampling_coverage", """select analysis_family, cast(sum(eligible_pixel_count) as bigint) as eligible, cast(sum(sampled_pixel_count) as bigint) as sampled, count(distinct image_id) as n_images, count(distinct case when sampled_pixel_count > 0 then image_id end) as n_sampled_images from sampling_manifest group by 1""")
def _(spark, sf):
    m = table(spark, sf, "sampling_manifest")
    return m.groupBy("analysis_family").agg(F.sum("eligible_pixel_count").alias("eligible"), F.sum("sampled_pixel_count").alias("sampled"), F.count_distinct("image_id").alias("n_images"), F.count_distinct(F.when(F.col("sampled_pixel_count") > 0, F.col("image_id"))).alias("n_sampled_images"))


@query("agg25_stratum_count", f"select count(*) as n_strata from (select distinct {', '.join(f'coalesce({c}, $$$$) as {c}' for c in STRATA)} from pixel_samples)")
def _(spark, sf):
    return px(spark, sf).select(*[F.coalesce(c, F.lit("")).alias(c) for c in STRATA]).distinct().agg(F.count("*").alias("n_strata"))


@query("agg26_unique_text", "select flight_id, array_to_string(list_sort(list(distinct trim(ambient_source)) filter (where trim(ambient_source) <> '')), ';') as sources from pixel_samples group by 1")
def _(spark, sf):
    t = F.nullif(F.trim("ambient_source"), F.lit(""))
    return px(spark, sf).groupBy("flight_id").agg(F.array_join(F.sort_array(F.collect_set(t)), ";").alias("sources"))


@query("agg27_single_value", "select flight_id, case when count(distinct round(a, 4)) = 1 then max(round(a, 4)) end as ambient_c from (select flight_id, cast(ambient_temperature_c as double) a from pixel_samples where isfinite(ambient_temperature_c)) group by 1")
def _(spark, sf):
    a = F.round(F.col("ambient_temperature_c").cast("double"), 4)
    return px(spark, sf).where(finite(F.col("ambient_temperature_c"))).groupBy("flight_id").agg(F.when(F.count_distinct(a) == 1, F.max(a)).alias("ambient_c"))


@query("agg29_pivot", """select surface_cover_class, count(*) filter (where shadow_flag = 0) as sunlit, count(*) filter (where shadow_flag = 1) as shaded from pixel_samples where shadow_flag in (0, 1) group by 1""")
def _(spark, sf):
    p = px(spark, sf).where("shadow_flag in (0, 1)").groupBy("surface_cover_class").pivot("shadow_flag", [0, 1]).count()
    return p.select("surface_cover_class", F.coalesce("0", F.lit(0).cast("long")).alias("sunlit"), F.coalesce("1", F.lit(0).cast("long")).alias("shaded"))


@query("agg31_number_summary", "select metadata_source, round(min(altitude_m), 4) as lowest, round(quantile_cont(altitude_m, 0.5), 4) as median, round(max(altitude_m), 4) as highest from validation_records group by 1")
def _(spark, sf):
    return table(spark, sf, "validation_records").groupBy("metadata_source").agg(F.round(F.min("altitude_m"), 4).alias("lowest"), F.round(F.median("altitude_m"), 4).alias("median"), F.round(F.max("altitude_m"), 4).alias("highest"))


@query("agg34_findings", " union all ".join(f"select flight_id, '{c}' as field, count(*) filter (where coalesce(trim({c}), '') = '') as n_missing, count(distinct nullif(trim({c}), '')) as n_distinct from pixel_samples group by 1" for c in STRATA))
def _(spark, sf):
    return D.findings(px(spark, sf), "flight_id", STRATA)


@query("win02_rank_limit", """select row_id from (select row_id, row_number() over (partition by image_id, surface_cover_class order by temperature_c desc nulls last, row_id) r from pixel_samples where isfinite(temperature_c)) where r <= 5""")
def _(spark, sf):
    w = W.partitionBy("image_id", "surface_cover_class").orderBy(F.col("temperature_c").desc_nulls_last(), "row_id")
    return px(spark, sf).where(finite(F.col("temperature_c"))).withColumn("r", F.row_number().over(w)).where("r <= 5").select("row_id")


@query("win04_gap_seconds", f"select qa_id, round((epoch_us(t) - lag(epoch_us(t)) over (partition by flight_id order by t nulls first, qa_id)) / 1e6, 6) as gap_s from (select qa_id, flight_id, {STAMP_SQL.format('image_id')} t from subzero_qa)")
def _(spark, sf):
    q = table(spark, sf, "subzero_qa").select("qa_id", "flight_id", F.unix_micros(stamp("image_id")).alias("us"))
    return q.select("qa_id", F.round((F.col("us") - F.lag("us").over(W.partitionBy("flight_id").orderBy("us", "qa_id"))) / 1e6, 6).alias("gap_s"))


@query("win05_duplicates", "select record_id from (select record_id, count(*) over (partition by image_id, capture_datetime) n from validation_records) where n > 1")
def _(spark, sf):
    return table(spark, sf, "validation_records").withColumn("n", F.count("*").over(W.partitionBy("image_id", "capture_datetime"))).where("n > 1").select("record_id")


@query("win06_population", "select coverage_id, count(*) over (partition by group_name) as population from sample_coverage")
def _(spark, sf):  # a hot key is counted map-side and joined back, not gathered in a window
    c = table(spark, sf, "sample_coverage").select("coverage_id", "group_name")
    n = c.groupBy(F.col("group_name").alias("__g")).agg(F.count("*").alias("population"))
    return c.join(n, c["group_name"].eqNullSafe(n["__g"])).select("coverage_id", "population")


@query("win07_first_last", "select flight_id, arg_min(qa_id, struct_pack(t := generated_at, e := qa_id)) as first_qa, arg_max(qa_id, struct_pack(t := generated_at, e := qa_id)) as last_qa from subzero_qa where generated_at is not null group by 1")
def _(spark, sf):
    k = F.struct("generated_at", "qa_id")
    return table(spark, sf, "subzero_qa").where("generated_at is not null").groupBy("flight_id").agg(F.min_by("qa_id", k).alias("first_qa"), F.max_by("qa_id", k).alias("last_qa"))


@query("srt02_pilot_selection", """select record_id from (select record_id, case validation_status when 'pass' then 0 when 'warn' then 1 else 2 end r, altitude_m from validation_records where thermal_path is not null) order by r, altitude_m desc nulls last, record_id limit 5""")
def _(spark, sf):
    rank = F.when(F.col("validation_status") == "pass", 0).when(F.col("validation_status") == "warn", 1).otherwise(2)
    return table(spark, sf, "validation_records").where("thermal_path is not null").orderBy(rank, F.col("altitude_m").desc_nulls_last(), "record_id").limit(5).select("record_id")


@query("top01_candidates", "select vec_id from embeddings order by embedding[1] desc, vec_id limit 25")
def _(spark, sf):
    return table(spark, sf, "embeddings").orderBy(F.col("embedding")[0].desc(), "vec_id").limit(25).select("vec_id")


@query("top02_largest_changes", """select thermal_row, thermal_col, round(hi - lo, 4) as range_c from (select thermal_row, thermal_col, max(cast(temperature_c as double)) hi, min(cast(temperature_c as double)) lo from pixel_samples where isfinite(temperature_c) group by 1, 2) order by hi - lo desc, thermal_row, thermal_col limit 20""")
def _(spark, sf):
    t = F.col("temperature_c").cast("double")
    g = px(spark, sf).where(finite(F.col("temperature_c"))).groupBy("thermal_row", "thermal_col").agg((F.max(t) - F.min(t)).alias("d"))
    return g.orderBy(F.desc("d"), "thermal_row", "thermal_col").limit(20).select("thermal_row", "thermal_col", F.round("d", 4).alias("range_c"))


@query("top03_evenly_spaced", """with o as (select flight_id, capture_seq, row_number() over (partition by flight_id order by capture_seq) - 1 i, count(*) over (partition by flight_id) n from (select distinct flight_id, capture_seq from subzero_qa))
    select flight_id, capture_seq from o where exists (select 1 from range(25) r(k) where i = floor(k * (n - 1) / 24.0))""")
def _(spark, sf):
    d = table(spark, sf, "subzero_qa").select("flight_id", "capture_seq").distinct()
    w = W.partitionBy("flight_id")
    o = d.withColumn("i", F.row_number().over(w.orderBy("capture_seq")) - 1).withColumn("n", F.count("*").over(w))
    spots = F.transform(F.sequence(F.lit(0), F.lit(24)), lambda k: F.floor(k * (F.col("n") - 1) / 24.0))
    return o.where(F.array_contains(spots, F.col("i").cast("long"))).select("flight_id", "capture_seq")


@query("lim01_examples", "select surface_cover_class, array_to_string(list_sort(list(distinct image_id))[1:3], ', ') as examples from pixel_samples group by 1")
def _(spark, sf):
    d = px(spark, sf).select("surface_cover_class", "image_id").distinct()
    r = d.withColumn("r", F.row_number().over(W.partitionBy("surface_cover_class").orderBy("image_id"))).where("r <= 3")
    return r.groupBy("surface_cover_class").agg(F.array_join(F.sort_array(F.collect_list("image_id")), ", ").alias("examples"))


@query("set01_union", "select image_id, 'qa' as origin, count(*) as n from subzero_qa group by 1 union all select image_id, 'capture', count(*) from validation_records group by 1")
def _(spark, sf):
    part = lambda t, o: table(spark, sf, t).groupBy("image_id").agg(F.count("*").alias("n")).withColumn("origin", F.lit(o))
    return part("subzero_qa", "qa").unionByName(part("validation_records", "capture"), allowMissingColumns=True)


@query("set02_keep_first", "select qa_id from (select qa_id, row_number() over (partition by flight_id, capture_seq order by qa_id) r from subzero_qa) where r = 1")
def _(spark, sf):
    return table(spark, sf, "subzero_qa").groupBy("flight_id", "capture_seq").agg(F.min("qa_id").alias("qa_id")).select("qa_id")


@query("set03_except", "select image_id from subzero_qa except select image_id from pixel_samples")
def _(spark, sf):
    return table(spark, sf, "subzero_qa").select("image_id").subtract(px(spark, sf).select("image_id"))


@query("set04_intersect", """select flight_id, thermal_row, thermal_col from (select distinct flight_id, image_id, thermal_row, thermal_col from pixel_samples where isfinite(temperature_c)) join
    (select flight_id, count(distinct image_id) n from pixel_samples group by 1) using (flight_id) group by flight_id, thermal_row, thermal_col, n having count(*) = n""")
def _(spark, sf):
    """Coordinates that are finite in every capture of their series, the flight."""
    p = px(spark, sf)
    captures = p.select("flight_id", "image_id").distinct().groupBy("flight_id").agg(F.count("image_id").alias("n_captures"))
    hits = p.where(finite(F.col("temperature_c"))).select("flight_id", "image_id", "thermal_row", "thermal_col").distinct().groupBy("flight_id", "thermal_row", "thermal_col").agg(F.count("image_id").alias("n"))
    return hits.join(captures, "flight_id").where("n = n_captures").select("flight_id", "thermal_row", "thermal_col")


@query("set05_equal_sets", "select (select count(*) from (select image_id from subzero_qa except select image_id from validation_records)) = 0 and (select count(*) from (select image_id from validation_records except select image_id from subzero_qa)) = 0 as same")
def _(spark, sf):
    a, b = (table(spark, sf, t).select("image_id").distinct() for t in ("subzero_qa", "validation_records"))
    diff = a.withColumn("l", F.lit(1)).join(b.withColumn("r", F.lit(1)), "image_id", "full").where("l is null or r is null")
    return diff.agg((F.count("*") == 0).alias("same"))
