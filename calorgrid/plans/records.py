"""Registered queries of metadata records, capture summaries, further roll-ups and checked scans."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from calorgrid.functions import geo, text as T
from calorgrid.functions.predicates import COVERS, density_status, finite, near
from calorgrid.operators import alignment, describe as D, joins as J
from calorgrid.operators.selection import exact_quantiles
from calorgrid.operators.timenorm import with_parses
from calorgrid.plans.analysis import _COVER_PX, cover_pixels, family_sample, sample_sql
from calorgrid.plans.registry import Registry
from calorgrid.plans.scalars import CELL_BOXES_SQL, FAMILY_SQL, GRID_SQL, cell_boxes, family_groups, grid, px
from calorgrid.runtime import scratch, table
from calorgrid.sources.tables import one_row_each, with_defaults

query = Registry()
QUERIES, SQL = query.queries, query.sql


@query("src01_projected_scan", "select image_id, thermal_row, thermal_col, temperature_c > 30 as warm, 'degC' as unit, -1 as roi from pixel_samples where temperature_c is not null and not isnan(temperature_c)")
def _(spark, sf):
    wanted = {"image_id": None, "thermal_row": None, "thermal_col": None, "temperature_c": None, "unit": "degC", "roi": -1}
    p = with_defaults(px(spark, sf), wanted, required=["image_id"]).where(F.col("temperature_c").isNotNull() & ~F.isnan("temperature_c"))
    return p.select("image_id", "thermal_row", "thermal_col", (F.col("temperature_c") > 30).alias("warm"), "unit", "roi")


@query("src03_three_columns", "select image_id, surface_cover_class, round(cast(delta_t_c as double), 4) as delta_t_c from pixel_samples where delta_t_c is not null and isfinite(delta_t_c)")
def _(spark, sf):
    return px(spark, sf).where(finite(F.col("delta_t_c"))).select("image_id", "surface_cover_class", F.round(F.col("delta_t_c").cast("double"), 4).alias("delta_t_c"))


@query("agg35_image_count_mean_median", "select image_id, count(t) as n, round(avg(t), 4) as mean, round(quantile_cont(t, 0.5), 4) as median from (select image_id, case when isfinite(temperature_c) then cast(temperature_c as double) end t from pixel_samples) group by 1")
def _(spark, sf):
    """Count, mean and median per capture in one aggregate: a capture's distinct values are bounded by its grid."""
    t = F.when(finite(F.col("temperature_c")), F.col("temperature_c").cast("double"))
    return px(spark, sf).groupBy("image_id").agg(F.count(t).alias("n"), F.round(F.avg(t), 4).alias("mean"), F.round(F.percentile(t, F.lit(0.5)), 4).alias("median"))


@query("src02_image_scan", "select thermal_row, thermal_col, round(cast(temperature_c as double), 3) as t from pixel_samples where image_id = (select min(image_id) from pixel_samples)")
def _(spark, sf):
    first = px(spark, sf).agg(F.min("image_id")).first()[0]
    return px(spark, sf).where(F.col("image_id") == first).select("thermal_row", "thermal_col", F.round(F.col("temperature_c").cast("double"), 3).alias("t"))


@query("src20_parameter_row", "select flight_id, n, lowest from (select flight_id, count(*) n, min(minimum_temperature_c) lowest from subzero_qa group by 1) where lowest is not null")
def _(spark, sf):
    p = table(spark, sf, "subzero_qa").groupBy("flight_id").agg(F.count("*").alias("n"), F.min("minimum_temperature_c").alias("lowest")).where("lowest is not null")
    return one_row_each(p, "flight_id")


@query("snk06_ordered_sample", "select image_id, cast(null as varchar) as roi_id, thermal_row from pixel_samples")
def _(spark, sf):
    from calorgrid.sources.tables import ordered

    return ordered(px(spark, sf), ["image_id", "roi_id", "thermal_row"])


@query("proj16_camera_parameters", """with c as (select record_id, case when record_id % 4 = 0 then 70.0 end fov, focal_length_mm f, case when record_id % 3 = 0 then 36.0 end s, case when record_id % 2 = 0 then 24.0 end f35 from validation_records)
    select record_id, round(coalesce(fov, degrees(2 * atan(s / (2 * f))), degrees(2 * atan(36.0 / (2 * f35))), 61.0), 6) as fov, case when fov is not null then 'metadata' when s is not null and f is not null then 'sensor' when f35 is not null then 'equivalent' else 'fallback' end as origin from c""")
def _(spark, sf):
    r, f = F.col("record_id"), F.col("focal_length_mm")
    fov, s, f35 = F.when(r % 4 == 0, 70.0), F.when(r % 3 == 0, 36.0), F.when(r % 2 == 0, 24.0)
    by = lambda sensor, focal: F.degrees(2 * F.atan(sensor / (2 * focal)))
    origin = F.when(fov.isNotNull(), "metadata").when(s.isNotNull() & f.isNotNull(), "sensor").when(f35.isNotNull(), "equivalent").otherwise("fallback")
    return table(spark, sf, "validation_records").select("record_id", F.round(F.coalesce(fov, by(s, f), by(F.lit(36.0), f35), F.lit(61.0)), 6).alias("fov"), origin.alias("origin"))


@query("proj22_category_resolver", """select distinct luhk_raw_code, luhk_category_name, case when luhk_raw_code = 31 or lower(trim(luhk_category_name)) = 'gic / open space' then 'gic_open_space' when luhk_raw_code in (1, 2, 3) or lower(trim(luhk_category_name)) = 'residential' then 'residential' else 'other' end as category from luhk_cells""")
def _(spark, sf):
    code, name = F.col("luhk_raw_code"), F.lower(F.trim("luhk_category_name"))
    c = F.when((code == 31) | (name == "gic / open space"), "gic_open_space").when(code.isin(1, 2, 3) | (name == "residential"), "residential").otherwise("other")
    return table(spark, sf, "luhk_cells").select("luhk_raw_code", "luhk_category_name", c.alias("category")).distinct()


_BY_NAME = {v.lower(): k for k, v in COVERS.items() if k not in (0, 9)}


@query("proj23_cover_resolver", "select value, id, case when id is not null then name end as cover from (select v.value, c.id, c.name from (select distinct trim(surface_cover_class) as value from pixel_samples union select distinct upper(trim(surface_cover_class)) from pixel_samples union select distinct cast(luhk_raw_code % 11 as varchar) from luhk_cells) v left join (values " + ", ".join(f"({k}, $${v}$$)" for k, v in COVERS.items() if k not in (0, 9)) + ") c(id, name) on try_cast(v.value as int) = c.id or try_cast(v.value as int) is null and lower(v.value) = lower(c.name)) where value is not null")
def _(spark, sf):
    """Cover ids of texts that are an id or a name in any case; 0, 9 and unknown ones resolve to nothing."""
    names = px(spark, sf).select(F.trim("surface_cover_class").alias("value")).distinct()
    numbers = table(spark, sf, "luhk_cells").select((F.col("luhk_raw_code") % 11).cast("string").alias("value"))
    values = names.unionByName(names.select(F.upper("value").alias("value"))).unionByName(numbers).where("value is not null").distinct()
    number = F.col("value").try_cast("int")
    name_of = F.create_map(*[F.lit(x) for k, v in COVERS.items() if k not in (0, 9) for x in (k, v)])
    id_of = F.create_map(*[F.lit(x) for k, v in _BY_NAME.items() for x in (k, v)])
    found = F.when(number.isNull(), id_of[F.lower("value")]).when(name_of[number].isNotNull(), number)
    return values.select("value", found.alias("id")).withColumn("cover", name_of[F.col("id")])


_REASONS = {"temperature_qa_failed": "Temperature check failed", "label_unknown": "No label", "annotation_not_accepted": "Annotation not accepted"}


@query("proj25_reason_text", "select exclusion_reason, n, case " + " ".join(f"when exclusion_reason = '{k}' then '{v}'" for k, v in _REASONS.items()) + " when starts_with(exclusion_reason, 'outside_') then 'Outside: ' || replace(substr(exclusion_reason, 9), '_', ' ') else replace(exclusion_reason, '_', ' ') end as message from (select exclusion_reason, count(*) n from pixel_samples where exclusion_reason is not null group by 1)")
def _(spark, sf):
    r = F.col("exclusion_reason")
    m = F.when(r.startswith("outside_"), F.concat(F.lit("Outside: "), F.replace(F.substring(r, 9, 1000), F.lit("_"), F.lit(" ")))).otherwise(F.replace(r, F.lit("_"), F.lit(" ")))
    for k, v in _REASONS.items():
        m = F.when(r == k, F.lit(v)).otherwise(m)
    return px(spark, sf).where("exclusion_reason is not null").groupBy("exclusion_reason").agg(F.count("*").alias("n")).select("exclusion_reason", "n", m.alias("message"))


@query("dt01_parsed_text", r"""with t as (select record_id, trim(capture_datetime) t from validation_records) select record_id, case when regexp_matches(t, '^\d{4}[:-]\d{2}[:-]\d{2}[ T]\d{2}:\d{2}:\d{2}$') then epoch_us(try_strptime(substr(t, 1, 4) || '-' || substr(t, 6, 2) || '-' || substr(t, 9, 2) || ' ' || substr(t, 12, 8), '%Y-%m-%d %H:%M:%S')) end as wall_us from t""")
def _(spark, sf):
    """Wall times in the camera's or the ISO form; other forms (see ``p5_capture_instants``) give null here."""
    known = F.col("capture_datetime").rlike(r"^ *\d{4}[:-]\d{2}[:-]\d{2}[ T]\d{2}:\d{2}:\d{2} *$")
    v = table(spark, sf, "validation_records").select("record_id", F.when(known, F.col("capture_datetime")).alias("t"))
    return with_parses(v, "t", "p").select("record_id", F.col("p_one").alias("wall_us"))


@query("dt02_zone_to_utc", r"""select record_id, case when regexp_matches(capture_datetime, '^\d{14}$') and capture_timezone = 'Asia/Hong_Kong' then epoch_us(try_strptime(capture_datetime, '%Y%m%d%H%M%S')) - 28800000000 end as utc_us from validation_records""")
def _(spark, sf):
    """Instants of wall times of 14 digits in Hong Kong; the general case is ``p5_capture_instants``."""
    known = F.col("capture_datetime").rlike(r"^\d{14}$") & (F.col("capture_timezone") == "Asia/Hong_Kong")
    v = table(spark, sf, "validation_records").select("record_id", F.when(known, F.col("capture_datetime")).alias("t"))
    p = with_parses(v, "t", "p")
    return p.select("record_id", F.unix_micros(F.to_utc_timestamp(F.timestamp_micros("p_one"), "Asia/Hong_Kong")).alias("utc_us"))


@query("dt03_time_priority", r"""with c as (select record_id, case when regexp_matches(capture_datetime, '^\d{4}:\d{2}:\d{2} \d{2}:\d{2}:\d{2}$') then try_strptime(capture_datetime, '%Y:%m:%d %H:%M:%S') end a, case when regexp_matches(capture_time_local, '^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$') then try_strptime(capture_time_local, '%Y-%m-%d %H:%M:%S') end b, try_strptime(nullif(regexp_extract(thermal_path, 'DJI_(\d{14})', 1), ''), '%Y%m%d%H%M%S') f from validation_records)
    select record_id, case when a is not null then 'exif' when b is not null then 'local' when f is not null then 'filename' else 'missing' end as origin, epoch_us(coalesce(a, b, f)) as wall_us from c""")
def _(spark, sf):
    v = table(spark, sf, "validation_records").select("record_id", F.when(F.col("capture_datetime").rlike(r"^\d{4}:\d{2}:\d{2} \d{2}:\d{2}:\d{2}$"), F.col("capture_datetime")).alias("a"), F.when(F.col("capture_time_local").rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"), F.col("capture_time_local")).alias("b"), F.regexp_extract("thermal_path", r"DJI_(\d{14})", 1).alias("f"))
    for c in "abf":
        v = with_parses(v, c, c)
    origin = F.when(F.col("a_one").isNotNull(), "exif").when(F.col("b_one").isNotNull(), "local").when(F.col("f_one").isNotNull(), "filename").otherwise("missing")
    return v.select("record_id", origin.alias("origin"), F.coalesce("a_one", "b_one", "f_one").alias("wall_us"))


@query("dt04_bundle_agreement", r"""with c as (select record_id, case when regexp_matches(trim(capture_datetime), '^\d{10}$') then cast(trim(capture_datetime) as bigint) * 1000000 end a, case when regexp_matches(capture_time_local, '^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}[+-]\d{2}:\d{2}$') then capture_time_local end l from validation_records)
    select record_id, abs(a - (epoch_us(try_strptime(substr(l, 1, 19), '%Y-%m-%dT%H:%M:%S')) - (case substr(l, 20, 1) when '-' then -1 else 1 end) * (cast(substr(l, 21, 2) as bigint) * 3600000000 + cast(substr(l, 24, 2) as bigint) * 60000000))) <= 1 as valid from c""")
def _(spark, sf):
    """Whether epoch seconds and a local time with offset name the same instant; null where a row has not both."""
    a = F.when(F.trim("capture_datetime").rlike(r"^\d{10}$"), F.col("capture_datetime")).alias("a")
    b = F.when(F.col("capture_time_local").rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}[+-]\d{2}:\d{2}$"), F.col("capture_time_local")).alias("b")
    p = with_parses(with_parses(table(spark, sf, "validation_records").select("record_id", a, b), "a", "a"), "b", "b")
    return p.select("record_id", (F.abs(F.col("a_one") - (F.col("b_one") - F.col("b_off") * 1_000_000)) <= 1).alias("valid"))


@query("geo05_box_overlap", f"""with c as {CELL_BOXES_SQL} select distinct a.cell_key as a, b.cell_key as b from c a join c b on a.cell_key < b.cell_key and a.w0 < b.w1 + 0.00005 and b.w0 < a.w1 + 0.00005 and a.u0 < b.u1 + 0.00005 and b.u0 < a.u1 + 0.00005""")
def _(spark, sf):
    """Land-use cells that touch or overlap."""
    c = cell_boxes(spark, sf).selectExpr("cell_key", "u0 as w", "u1 + 0.00005 as e", "w0 as s", "w1 + 0.00005 as n")
    a, b = c.toDF("a", "aw", "ae", "as_", "an"), c.toDF("b", "bw", "be", "bs", "bn")
    return J.overlapping(a, b, a_box=("aw", "ae", "as_", "an"), b_box=("bw", "be", "bs", "bn"), tile=0.005).where("a < b").select("a", "b").distinct()


@query("geo13_affine_fit")
def _(spark, sf):
    e = table(spark, sf, "validation_records").selectExpr("flight_id", "gps_longitude as x", "gps_latitude as y", "altitude_m as u", "focal_length_mm as v").where("x between -180 and 180 and y between -90 and 90")
    return alignment.fit(e.where("u is not null and v is not null and not isnan(x) and not isnan(y)").groupBy("flight_id", F.floor(F.col("x") * 500).alias("k"), F.floor(F.col("y") * 500).alias("l")).agg(*[F.avg(c).alias(c) for c in "xyuv"]), "flight_id")


@query("geo14_clamped_box", """with b as (select qa_id, cast(capture_seq % 700 as double) x, cast(capture_seq % 600 as double) y, cast(matrix_width / 2 as double) w, cast(matrix_height / 2 as double) h from subzero_qa where matrix_width is not null and matrix_height is not null), c as (select qa_id, greatest(0.0, least(x, 640 - greatest(1.0, least(w, 640.0)))) l, greatest(0.0, least(y, 512 - greatest(1.0, least(h, 512.0)))) t from b)
    select qa_id, cast(round_even(l, 0) as int) as x0, cast(round_even(t, 0) as int) as y0 from c""")
def _(spark, sf):
    q = table(spark, sf, "subzero_qa").where("matrix_width is not null and matrix_height is not null")
    d = lambda c: c.cast("double")
    box = alignment.clamped_box(d(F.col("capture_seq") % 700), d(F.col("capture_seq") % 600), d(F.col("matrix_width") / 2), d(F.col("matrix_height") / 2), (640, 512))
    return q.select("qa_id", box.alias("b")).select("qa_id", "b.x0", "b.y0")


@query("join02_composite_key", "select v.record_id, q.n from validation_records v left join (select image_id, pair_id, count(*) n from subzero_qa group by 1, 2) q on q.image_id = v.image_id and q.pair_id = v.pair_id")
def _(spark, sf):
    q = table(spark, sf, "subzero_qa").groupBy("image_id", "pair_id").agg(F.count("*").alias("n"))
    return J.checked_join(table(spark, sf, "validation_records").select("record_id", "image_id", "pair_id"), q, ["image_id", "pair_id"], left_unique=False).select("record_id", "n")


@query("join10_path_or_name", r"""with m as (select visible_path p, min(altitude_m) a from validation_records where visible_path <> '' group by 1), n as (select image_id i, min(altitude_m) a from validation_records group by 1)
    select q.qa_id, coalesce(m.a, n.a) as altitude_m from subzero_qa q left join m on m.p = 'raw/' || q.flight_id || '/' || q.image_id || '_V.JPG' left join n on n.i = q.image_id""")
def _(spark, sf):
    v = table(spark, sf, "validation_records")
    m = v.where("visible_path != ''").groupBy(F.col("visible_path").alias("p")).agg(F.min("altitude_m").alias("a"))
    n = v.groupBy(F.col("image_id").alias("i")).agg(F.min("altitude_m").alias("b"))
    q = table(spark, sf, "subzero_qa").select("qa_id", "image_id", F.concat(F.lit("raw/"), "flight_id", F.lit("/"), "image_id", F.lit("_V.JPG")).alias("path"))
    return q.join(m, F.col("path") == F.col("p"), "left").join(n, F.col("image_id") == F.col("i"), "left").select("qa_id", F.coalesce("a", "b").alias("altitude_m"))


@query("join12_manifest_counts", f"""with e as (select image_id, surface_cover_class g, count(*) n from pixel_samples group by 1, 2), s as (select image_id, group_name g, count(*) n from {sample_sql('surface_cover')} group by 1, 2)
    select e.image_id, e.g as group_name, e.n as eligible, coalesce(s.n, 0) as sampled from e left join s on s.image_id = e.image_id and s.g = e.g""")
def _(spark, sf):
    e = px(spark, sf).groupBy("image_id", F.col("surface_cover_class").alias("group_name")).agg(F.count("*").alias("eligible"))
    s = family_sample(spark, sf, "surface_cover")[1].groupBy(F.col("image_id").alias("__i"), F.col("group_name").alias("__g")).agg(F.count("*").alias("n"))
    out = e.join(s, (F.col("image_id") == F.col("__i")) & F.col("group_name").eqNullSafe(F.col("__g")), "left")
    return out.select("image_id", "group_name", "eligible", F.coalesce("n", F.lit(0).cast("long")).alias("sampled"))


@query("join19_set_differences", """select 'only_pixels' as side, count(*) as n from (select distinct image_id from pixel_samples except select image_id from sampling_manifest) union all select 'only_manifest', count(*) from (select distinct image_id from sampling_manifest except select image_id from pixel_samples)""")
def _(spark, sf):
    a, b = px(spark, sf).select("image_id").distinct(), table(spark, sf, "sampling_manifest").select("image_id").distinct()
    side = lambda x, y, name: x.join(y, "image_id", "left_anti").agg(F.count("*").alias("n")).select(F.lit(name).alias("side"), "n")
    return side(a, b, "only_pixels").unionByName(side(b, a, "only_manifest"))


@query("join20_segment_paint", f"select g.image_id, coalesce(n.cover, 'none') as cover, count(*) as n_pixels from {GRID_SQL} g left join (values {', '.join(f'({k}, $${v}$$)' for k, v in COVERS.items())}) n(id, cover) on n.id = g.label group by 1, 2")
def _(spark, sf):
    names = F.broadcast(spark.createDataFrame(list(COVERS.items()), "id int, cover string"))
    return grid(spark, sf).join(names, F.col("label") == F.col("id"), "left").groupBy("image_id", F.coalesce("cover", F.lit("none")).alias("cover")).agg(F.count("*").alias("n_pixels"))


@query("join21_coverage_rule", """with c as (select group_name g, max(full_image_count) m from sample_coverage where group_name is not null group by 1), p as (select x.g a, y.g b, x.m ma, y.m mb from c x join c y on x.g < y.g where x.m >= 8 and y.m >= 8)
    select a, b, case when least(ma, mb) < 9 then 'insufficient_coverage_for_conclusion' else 'covered' end as status from p""")
def _(spark, sf):
    c = scratch(table(spark, sf, "sample_coverage").where("group_name is not null").groupBy("group_name").agg(F.max("full_image_count").alias("m")).where("m >= 8"))
    a, b = c.toDF("a", "ma"), c.toDF("b", "mb")
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.when(F.least("ma", "mb") < 9, "insufficient_coverage_for_conclusion").otherwise("covered").alias("status"))


_T = "case when isfinite(temperature_c) then cast(temperature_c as double) end"


@query("agg04_eight_statistics", f"select flight_id, round(min(t), 3) as lowest, round(max(t), 3) as highest, round(avg(t), 4) as mean, round(quantile_cont(t, 0.5), 4) as median, round(quantile_cont(t, 0.01), 4) as q01, round(quantile_cont(t, 0.05), 4) as q05, round(quantile_cont(t, 0.95), 4) as q95, round(quantile_cont(t, 0.99), 4) as q99 from (select flight_id, {_T} t from pixel_samples) group by 1")
def _(spark, sf):
    d = D.describe(px(spark, sf), ["flight_id"], F.col("temperature_c"), {"median": 0.5, "q01": 0.01, "q05": 0.05, "q95": 0.95, "q99": 0.99})
    return d.select("flight_id", F.round("min", 3).alias("lowest"), F.round("max", 3).alias("highest"), "mean", "median", "q01", "q05", "q95", "q99")


@query("agg06_image_summary", f"select image_id, count(*) as n_pixels, count(*) filter (where surface_cover_valid) as n_cover, count(*) filter (where luhk_label_valid) as n_luhk, round(avg({_T}), 4) as mean_c from pixel_samples group by 1")
def _(spark, sf):
    t = F.when(finite(F.col("temperature_c")), F.col("temperature_c").cast("double"))
    return px(spark, sf).groupBy("image_id").agg(F.count("*").alias("n_pixels"), F.count_if("surface_cover_valid").alias("n_cover"), F.count_if("luhk_label_valid").alias("n_luhk"), F.round(F.avg(t), 4).alias("mean_c"))


@query("agg18_area_percentages", "select surface_cover_class, round(100.0 * count(*) / sum(count(*)) over (), 6) as percent from pixel_samples group by 1")
def _(spark, sf):
    g = scratch(px(spark, sf).groupBy("surface_cover_class").agg(F.count("*").alias("n")))
    return g.select("surface_cover_class", F.round(100.0 * F.col("n") / F.lit(g.agg(F.sum("n")).first()[0]), 6).alias("percent"))


@query("agg21_class_counts", f"select c.cover, count(p.row_id) as n from (values {', '.join(f'($${v}$$)' for v in COVERS.values())}, ('unseen')) c(cover) left join pixel_samples p on p.surface_cover_class = c.cover group by 1")
def _(spark, sf):
    n = px(spark, sf).groupBy(F.col("surface_cover_class").alias("cover")).agg(F.count("*").alias("n"))
    outer = spark.createDataFrame([(v,) for v in [*COVERS.values(), "unseen"]], "cover string")
    return outer.join(n, "cover", "left").select("cover", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query("agg24_interval_regularity", """with i as (select flight_id, capture_seq - lag(capture_seq) over (partition by flight_id order by capture_seq) d from (select distinct flight_id, capture_seq from subzero_qa))
    select flight_id, count(d) + 1 as n_captures, coalesce(max(d) - min(d) > 1, false) as irregular, max(d) as largest from i group by 1""")
def _(spark, sf):
    s = table(spark, sf, "subzero_qa").select("flight_id", "capture_seq").distinct()
    d = s.withColumn("d", F.col("capture_seq") - F.lag("capture_seq").over(W.partitionBy("flight_id").orderBy("capture_seq")))
    return d.groupBy("flight_id").agg((F.count("d") + 1).alias("n_captures"), F.coalesce(F.max("d") - F.min("d") > 1, F.lit(False)).alias("irregular"), F.max("d").alias("largest"))


@query("agg30_status_lists", "select processing_status, count(*) as n, min(image_id) as first_image, max(image_id) as last_image from validation_records group by 1")
def _(spark, sf):
    return table(spark, sf, "validation_records").groupBy("processing_status").agg(F.count("*").alias("n"), F.min("image_id").alias("first_image"), F.max("image_id").alias("last_image"))


@query("agg32_median_order", f"select group_name, rank() over (order by m desc, group_name) as place from (select group_name, quantile_cont(delta_t_c, 0.5) m from {_COVER_PX} group by 1)")
def _(spark, sf):
    q = exact_quantiles(cover_pixels(spark, sf), ["group_name"], F.col("delta_t_c"), {"m": 0.5})
    return q.select("group_name", F.rank().over(W.orderBy(F.desc("m"), "group_name")).cast("long").alias("place"))  # one row per cover


@query("st06_mean_differences", f"with g as (select group_name g, avg(delta_t_c) m, quantile_cont(delta_t_c, 0.5) q from {_COVER_PX} group by 1) select x.g as a, y.g as b, round(x.m - y.m, 3) as mean_difference, round(x.q - y.q, 3) as median_difference from g x join g y on x.g < y.g")
def _(spark, sf):
    p = scratch(cover_pixels(spark, sf))
    q = exact_quantiles(p, ["group_name"], F.col("delta_t_c"), {"q": 0.5}).drop("n_values")
    g = scratch(p.groupBy("group_name").agg(F.avg("delta_t_c").alias("m")).join(q, "group_name"))  # one row per cover
    a, b = g.toDF("a", "ma", "qa"), g.toDF("b", "mb", "qb")
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.round(F.col("ma") - F.col("mb"), 3).alias("mean_difference"), F.round(F.col("qa") - F.col("qb"), 3).alias("median_difference"))


@query("t03_capture_reasons", """with c as (select image_id, count(*) filter (where analysis_eligible and target_mask and isfinite(temperature_c)) n, count(*) filter (where analysis_eligible and target_mask and isfinite(temperature_c) and isfinite(delta_t_c)) d, bool_and(qa_status in ('pass', 'warn')) q from pixel_samples group by 1)
    select image_id, n as n_eligible, concat_ws(';', case when n = 0 then 'no_eligible_pixels' end, case when d = 0 then 'no_finite_delta' end, case when not q then 'qa_status_not_accepted' end) as reasons from c""")
def _(spark, sf):
    t = F.coalesce(F.col("analysis_eligible") & F.col("target_mask"), F.lit(False)) & finite(F.col("temperature_c"))
    c = px(spark, sf).groupBy("image_id").agg(F.count_if(t).alias("n_eligible"), F.count_if(t & finite(F.col("delta_t_c"))).alias("d"), F.bool_and(F.col("qa_status").isin("pass", "warn")).alias("q"))
    rules = [(F.col("n_eligible") == 0, "no_eligible_pixels"), (F.col("d") == 0, "no_finite_delta"), (~F.col("q"), "qa_status_not_accepted")]
    return c.select("image_id", "n_eligible", F.concat_ws(";", F.array_compact(F.array(*[F.when(k, F.lit(v)) for k, v in rules]))).alias("reasons"))


@query("t04_identity_conflicts", """select target_id, concat_ws(';', case when count(distinct lower(target_name)) > 1 then 'several_names' end, case when count(distinct flight_id) > 1 then 'several_flights' end, case when count(distinct measurement_type) > 1 then 'several_measurements' end) as conflicts from pixel_samples where target_id is not null group by 1""")
def _(spark, sf):
    p = px(spark, sf).where("target_id is not null").select("target_id", F.lower("target_name").alias("name"), "flight_id", "measurement_type").distinct()
    many = lambda c, text: F.when(F.count_distinct(c) > 1, F.lit(text))
    return p.groupBy("target_id").agg(many("name", "several_names").alias("a"), many("flight_id", "several_flights").alias("b"), many("measurement_type", "several_measurements").alias("c")).select("target_id", F.concat_ws(";", "a", "b", "c").alias("conflicts"))


@query("t07_outside_windows", "select qa_id from subzero_qa where not coalesce(generated_at between timestamp '2023-01-01 00:00:00' and timestamp '2023-06-30 23:59:59' or generated_at between timestamp '2025-05-01 00:00:00' and timestamp '2025-05-31 23:59:59', false)")
def _(spark, sf):
    spans = [("a", "2023-01-01 00:00:00", "2023-06-30 23:59:59"), ("b", "2025-05-01 00:00:00", "2025-05-31 23:59:59")]
    e = table(spark, sf, "subzero_qa").withColumn("at", F.col("generated_at").cast("timestamp"))
    return e.select("qa_id").join(J.in_windows(e, "at", spans).select("qa_id"), "qa_id", "left_anti")


@query("qa04_sample_checks", "select count(*) as n_rows, count(*) - count(distinct manifest_id) as n_repeated, count(*) filter (where sampled_pixel_count > eligible_pixel_count) as n_impossible, count(*) filter (where sampling_seed is null) as n_without_seed, count(distinct sampling_seed) as n_seeds from sampling_manifest")
def _(spark, sf):
    return table(spark, sf, "sampling_manifest").agg(F.count("*").alias("n_rows"), (F.count("*") - F.count_distinct("manifest_id")).alias("n_repeated"), F.count_if(F.col("sampled_pixel_count") > F.col("eligible_pixel_count")).alias("n_impossible"), F.count_if(F.col("sampling_seed").isNull()).alias("n_without_seed"), F.count_distinct("sampling_seed").alias("n_seeds"))


@query("x05_incomplete_records", "select record_id, concat_ws(';', case when altitude_m is null then 'altitude' end, case when focal_length_mm is null then 'focal_length' end, case when gps_latitude is null or isnan(gps_latitude) then 'latitude' end) as missing from validation_records where altitude_m is null or focal_length_mm is null or gps_latitude is null or isnan(gps_latitude)")
def _(spark, sf):
    lat = F.col("gps_latitude").isNull() | F.isnan("gps_latitude")
    rules = [(F.col("altitude_m").isNull(), "altitude"), (F.col("focal_length_mm").isNull(), "focal_length"), (lat, "latitude")]
    m = F.concat_ws(";", F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in rules])))
    return table(spark, sf, "validation_records").select("record_id", m.alias("missing")).where("missing != ''")


@query("x06_single_success", "select image_id, min(record_id) as record_id from validation_records where processing_status = 'success' group by 1 having count(*) = 1")
def _(spark, sf):
    return table(spark, sf, "validation_records").where("processing_status = 'success'").groupBy("image_id").agg(F.min("record_id").alias("record_id"), F.count("*").alias("n")).where("n = 1").select("image_id", "record_id")


@query("x19_best_candidate", "select label, vec_id, round(cast(s as double), 5) as score from (select label, vec_id, embedding[1] s, row_number() over (partition by label order by embedding[1] desc, vec_id) r from embeddings where abs(embedding[2]) <= 1) where r = 1 and s > 0")
def _(spark, sf):
    e = table(spark, sf, "embeddings").select("label", "vec_id", F.col("embedding")[0].alias("s"), F.col("embedding")[1].alias("d")).where("abs(d) <= 1")
    best = e.groupBy("label").agg(F.min_by(F.struct("vec_id", "s"), F.struct((-F.col("s")).alias("a"), "vec_id")).alias("b"))
    return best.where("b.s > 0").select("label", "b.vec_id", F.round(F.col("b.s").cast("double"), 5).alias("score"))


@query("proj15_camera_tolerance", "select record_id, abs(focal_length_mm - 9.1) <= 0.5 as near_wide from validation_records where focal_length_mm is not null")
def _(spark, sf):
    return table(spark, sf, "validation_records").where("focal_length_mm is not null").select("record_id", near(F.col("focal_length_mm"), 9.1, 0.5).alias("near_wide"))


@query(
    "x17_annotation_template",
    """with c as (select image_id, luhk_cell_id, surface_cover_class k, count(*) n, sum(coalesce(shadow_flag, 0)) s from pixel_samples where luhk_cell_id <> '' and surface_cover_class is not null group by 1, 2, 3),
    g as (select image_id, luhk_cell_id, arg_min(k, struct_pack(n := -n, k := k)) k, max(n) m, sum(n) t, sum(s) s from c group by 1, 2)
    select image_id as pair_id, luhk_cell_id as segment_id, k as suggested_class, '' as manual_class, case when 2 * s > t then 'shaded' else 'sunlit' end as shadow_status, round(m / t, 6) as confidence, 'Not yet' as review_status, '' as notes from g""",
)
def _(spark, sf):
    """Segments (the land-use cells of a capture) with the most frequent cover as suggestion, laid out for review."""
    p = px(spark, sf).where("luhk_cell_id != '' and surface_cover_class is not null")
    c = p.groupBy("image_id", "luhk_cell_id", F.col("surface_cover_class").alias("k")).agg(F.count("*").alias("n"), F.sum(F.coalesce("shadow_flag", F.lit(0))).alias("s"))
    g = c.groupBy("image_id", "luhk_cell_id").agg(F.min_by("k", F.struct((-F.col("n")).alias("n"), "k")).alias("k"), F.max("n").alias("m"), F.sum("n").alias("t"), F.sum("s").alias("s"))
    none = F.lit("")
    shade = F.when(2 * F.col("s") > F.col("t"), "shaded").otherwise("sunlit")
    return g.select(
        F.col("image_id").alias("pair_id"), F.col("luhk_cell_id").alias("segment_id"), F.col("k").alias("suggested_class"), none.alias("manual_class"), shade.alias("shadow_status"), F.round(F.col("m") / F.col("t"), 6).alias("confidence"),
        F.lit("Not yet").alias("review_status"), none.alias("notes"),
    )


@query("geo04_hong_kong_grid")
def _(spark, sf):
    """Grid coordinates of every record in the territory the grid is made for, null elsewhere."""
    v = table(spark, sf, "validation_records").withColumn("inside", F.expr("coalesce(gps_latitude between 22 and 23 and gps_longitude between 113 and 115, false)"))
    g = v.where("inside").select("record_id", geo.hong_kong_grid(F.col("gps_latitude"), F.col("gps_longitude")).alias("g"))
    g = g.select("record_id", F.round("g.easting", 2).alias("easting"), F.round("g.northing", 2).alias("northing"))
    return g.unionByName(v.where("not inside").select("record_id"), allowMissingColumns=True)


@query("geo12_region_of_interest", """with c as (select record_id, least(1.0, tan(radians(61.0) / 2) / tan(radians(degrees(2 * atan(36.0 / (2 * focal_length_mm * 2)))) / 2)) s from validation_records where focal_length_mm > 0)
    select record_id, round((4032 - 4032 * s) / 2, 4) as x0, round(3024 * s, 4) as h from c""")
def _(spark, sf):
    v = table(spark, sf, "validation_records").where("focal_length_mm > 0")
    roi = geo.region_of_interest(geo.field_of_view(F.col("focal_length_mm") * 2, F.lit(36.0)), F.lit(61.0), F.lit(4032.0), F.lit(3024.0))
    return v.select("record_id", roi.alias("r")).select("record_id", F.round("r.x0", 4).alias("x0"), F.round("r.h", 4).alias("h"))


@query(
    "str08_report_records",
    """with q as (select *, row_number() over (partition by flight_id order by qa_id) as e from subzero_qa where qa_id in (select min(qa_id) from subzero_qa where image_id is not null and flight_id is not null and capture_seq is not null group by image_id))
    select flight_id, cast(e as bigint) as entry, upper(image_id) || '_T.JPG' as image_name, upper(image_id) as image_id, case when qa_id % 5 = 0 then null when qa_id % 2 = 0 then -capture_seq - 0.5 else capture_seq + 0.5 end as ambient_temperature_c, case when qa_id % 5 = 0 then 'missing' else 'ok' end as ambient_parse_status,
      cast(matrix_width as double) as distance_m, coalesce('M' || matrix_height, '') as camera_model, '2024-01-02 03:04:05' as captured, 22.25 as latitude, -114.5 as longitude, 60.5 as humidity_percent from q""",
)
def _(spark, sf):
    """The flights' reports, written from the QA rows in mixed languages and parsed again."""
    q = table(spark, sf, "subzero_qa").where("image_id is not null and flight_id is not null and capture_seq is not null")
    q = q.join(q.groupBy("image_id").agg(F.min("qa_id").alias("qa_id")), ["image_id", "qa_id"])
    name = F.concat("image_id", F.lit("_T.JPG"))
    seen = F.col("qa_id") % 5 != 0
    parts = F.array(
        F.concat(F.lit("Image: "), name), name, F.when(seen, "环境温度："), F.when(seen, F.concat(F.when(F.col("qa_id") % 2 == 0, "-").otherwise(""), F.col("capture_seq").cast("string"), F.lit(",5 °C"))), F.lit("Relative Humidity 60,5 %"),
        F.concat(F.lit("OBJECT DISTANCE: "), F.col("matrix_width").cast("string"), F.lit(" m")), F.concat(F.lit("Model: M"), F.col("matrix_height").cast("string")), F.lit("taken 2024/01/02  03:04:05".replace("  ", " ")), F.lit("GPS"), F.lit("22.25, -114,5"),
    )
    lines = q.select("flight_id", "qa_id", F.posexplode(F.array_compact(parts)).alias("k", "line")).select("flight_id", (F.col("qa_id") * 16 + F.col("k")).alias("line_no"), "line")
    r = T.report_records(lines, "flight_id")
    return r.select(
        "flight_id", F.col("report_entry_index").alias("entry"), "image_name", "image_id", "ambient_temperature_c", "ambient_parse_status", "distance_m", F.col("camera_model_report").alias("camera_model"), F.col("report_capture_datetime").alias("captured"),
        F.col("gps_latitude_report").alias("latitude"), F.col("gps_longitude_report").alias("longitude"), "humidity_percent",
    )


@query(
    "str09_measurements",
    """with q as (select qa_id, flight_id, capture_seq c, maximum_temperature_c hi, mean_temperature_c m, minimum_temperature_c lo from subzero_qa where flight_id is not null and capture_seq is not null),
    p as (select flight_id, 'P' || c as id, 'point' as kind, 'point_value' as statistic, m as value, qa_id % 7 = 0 as f, cast(c as double) as x from q where m is not null and not isnan(m)),
    r as (select flight_id, 'R' || c || ':' || s.k as id, 'region' as kind, s.k as statistic, s.v as value, qa_id % 7 = 0 as f, cast(null as double) as x from (select *, unnest([{'k': 'min', 'v': lo}, {'k': 'max', 'v': hi}, {'k': 'mean', 'v': m}]) s from q where lo is not null and not isnan(lo) and hi is not null and not isnan(hi) and m is not null and not isnan(m))),
    b as (select * from p union all select * from r)
    select flight_id, id as measurement_id, kind, statistic, round(value, 6) as value, x, case when f then 'not_celsius' when count(*) over (partition by flight_id, id) > 1 then 'duplicate' else 'ok' end as status from b""",
)
def _(spark, sf):
    """Point and region lines written from the QA rows in free wording and parsed again; captures that come twice repeat their ids."""
    q = table(spark, sf, "subzero_qa").where("flight_id is not null and capture_seq is not null")
    t = lambda c: F.when(~F.isnan(c), F.col(c).cast("decimal(18,6)").cast("string"))
    unit = F.when(F.col("qa_id") % 7 == 0, " °F").otherwise(F.when(F.col("qa_id") % 2 == 0, " °C").otherwise(""))
    seq = F.col("capture_seq").cast("string")
    point = F.concat(F.lit("Point P"), seq, F.lit(" on the roof: x="), seq, F.lit(", y=7; after noon Temp = "), t("mean_temperature_c"), unit)
    region = F.concat(F.lit("see region R"), seq, F.lit("; polygon = 1 1, 2 2; min="), t("minimum_temperature_c"), F.lit(", max = "), t("maximum_temperature_c"), F.lit(" and mean="), t("mean_temperature_c"), unit)
    lines = q.select("flight_id", F.explode(F.array_compact(F.array(point, region))).alias("line"))
    m = T.measurements(lines, "flight_id")
    return m.select("flight_id", "measurement_id", "kind", "statistic", F.round("value", 6).alias("value"), "x", "status")


_POOLED = ["measurement_type", "temperature_source", "temperature_definition", "temperature_unit", "ambient_source", "ambient_definition", "ambient_unit", "ambient_data_qa_status", "source_method"]


@query("st11_spectrum_summary", f"""with f as (select family, group_name, delta_t_c from {FAMILY_SQL} union all select 'overall', 'all formal pixels', delta_t_c from {FAMILY_SQL} where family = 'image_comparison'), k as (select count(*) n from (select distinct {', '.join(f'coalesce({c}, $$$$) as {c}' for c in _POOLED)} from {FAMILY_SQL} where family = 'image_comparison'))
    select family, group_name, n, round(m, 4) as mean, round(q, 4) as median, case when family = 'overall' and (select n from k) > 1 then 'not_pooled_heterogeneous_sources' when n < 100 then 'insufficient_samples' when u < 5 then 'too_few_distinct_values' when sd < 0.02 then 'near_constant' else 'eligible' end as density
    from (select family, group_name, count(*) n, avg(cast(delta_t_c as double)) m, quantile_cont(cast(delta_t_c as double), 0.5) q, count(distinct delta_t_c) u, stddev_samp(cast(delta_t_c as double)) sd from f group by 1, 2)""")
def _(spark, sf):
    """Every group of every family and all formal pixels, which are not pooled into one density where their sources differ."""
    d = F.col("delta_t_c").cast("double").alias("d")
    every = family_groups(px(spark, sf))
    whole = every.where("family = 'image_comparison'")
    strata = whole.select(*[F.coalesce(c, F.lit("")).alias(c) for c in _POOLED]).distinct().count()
    p = every.select("family", "group_name", d).unionByName(whole.select(F.lit("overall").alias("family"), F.lit("all formal pixels").alias("group_name"), d))
    g = p.groupBy("family", "group_name", "d").agg(F.count("*").alias("c"))  # values first, so that a hot group is combined map-side
    s = g.groupBy("family", "group_name").agg(F.sum("c").alias("n"), F.count("*").alias("u"), F.sum(F.col("c") * F.col("d")).alias("s"), F.sum(F.col("c") * F.col("d") * F.col("d")).alias("ss"))
    sd = F.sqrt(F.greatest(F.lit(0.0), (F.col("ss") - F.col("s") * F.col("s") / F.col("n")) / F.when(F.col("n") > 1, F.col("n") - 1)))
    q = exact_quantiles(p, ["family", "group_name"], F.col("d"), {"q": 0.5}).drop("n_values")
    out = s.join(q, ["family", "group_name"])
    status = F.when((F.col("family") == "overall") & F.lit(strata > 1), "not_pooled_heterogeneous_sources").otherwise(density_status(F.col("n"), F.col("u"), sd))
    return out.select("family", "group_name", "n", F.round(F.col("s") / F.col("n"), 4).alias("mean"), F.round("q", 4).alias("median"), status.alias("density"))


@query("agg28_family_totals", "select analysis_family, cast(sum(full_eligible_pixel_count) as bigint) as eligible, cast(sum(sampled_pixel_count) as bigint) as sampled, max(full_image_count) as images from sample_coverage group by 1")
def _(spark, sf):
    return table(spark, sf, "sample_coverage").groupBy("analysis_family").agg(F.sum("full_eligible_pixel_count").alias("eligible"), F.sum("sampled_pixel_count").alias("sampled"), F.max("full_image_count").alias("images"))


@query("agg33_evidence_rollup", """select flight_id, n_missing, n_distinct, case when n_missing > 0 then 'incomplete' when n_distinct > 1 then 'differs' else 'same' end as status from (select flight_id, count(*) filter (where nullif(ambient_source_record, '') is null) n_missing, count(distinct nullif(ambient_source_record, '')) n_distinct from pixel_samples group by 1)""")
def _(spark, sf):
    f = D.findings(px(spark, sf), "flight_id", ["ambient_source_record"])
    status = F.when(F.col("n_missing") > 0, "incomplete").when(F.col("n_distinct") > 1, "differs").otherwise("same")
    return f.select("flight_id", "n_missing", "n_distinct", status.alias("status"))


@query("qa10_checkpoint_rollup", "select flight_id, case when bool_and(coalesce(minimum_temperature_c, 0) > -5) then 'continue' when bool_or(minimum_temperature_c < -20) then 'review' else 'continue_with_warning' end as advice from subzero_qa group by 1")
def _(spark, sf):
    m = F.col("minimum_temperature_c")
    advice = F.when(F.bool_and(F.coalesce(m, F.lit(0.0)) > -5), "continue").when(F.bool_or(m < -20), "review").otherwise("continue_with_warning")
    return table(spark, sf, "subzero_qa").groupBy("flight_id").agg(advice.alias("advice"))


@query("x04_match_by_key_or_place", """with r as (select record_id place, image_id k from validation_records), o as (select qa_id place, case when qa_id % 3 <> 0 then image_id end k, capture_seq v from subzero_qa),
    a as (select k, min(v) v from o where k is not null group by 1), b as (select place, min(v) v from o where k is null group by 1)
    select r.place as record_id, case when a.k is not null then a.v else b.v end as capture_seq, case when a.k is not null then 'key' when b.place is not null then 'place' else 'missing' end as found_by from r left join a using (k) left join b on b.place = r.place""")
def _(spark, sf):
    r = table(spark, sf, "validation_records").select("record_id", "image_id")
    o = table(spark, sf, "subzero_qa").select(F.col("qa_id").alias("record_id"), F.when(F.col("qa_id") % 3 != 0, F.col("image_id")).alias("image_id"), "capture_seq")
    return J.match_by_key_or_place(r, o, key="image_id", place="record_id", value="capture_seq").select("record_id", "capture_seq", "found_by")


@query("x16_capture_summary", f"""select image_id, flight_id, count(*) as n, count(*) filter (where isfinite(temperature_c)) as n_finite, round(max({_T}) - min({_T}), 3) as range_c, min(ingest_batch) as first_batch from pixel_samples group by 1, 2""")
def _(spark, sf):
    t = F.when(finite(F.col("temperature_c")), F.col("temperature_c").cast("double"))
    return px(spark, sf).groupBy("image_id", "flight_id").agg(F.count("*").alias("n"), F.count(t).alias("n_finite"), F.round(F.max(t) - F.min(t), 3).alias("range_c"), F.min("ingest_batch").alias("first_batch"))
