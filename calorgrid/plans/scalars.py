"""Registered queries of projections, predicates and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from calorgrid.functions import geo, hashing, predicates as P, text as T
from calorgrid.plans.registry import Registry
from calorgrid.runtime import table

query = Registry()
QUERIES, SQL = query.queries, query.sql


def px(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pixel_samples")


def grid(spark: SparkSession, sf: str) -> DataFrame:
    """``image_id, thermal_row, thermal_col, v, label`` of the dense 64-column grids in ``embeddings``."""
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("thermal_col", "v"))
    row = (F.col("vec_id") % 64).cast("int")
    return e.select(F.format_string("IMG_%05d", F.floor(F.col("vec_id") / 64)).alias("image_id"), row.alias("thermal_row"), "thermal_col", F.col("v").cast("double").alias("v"), "label")


GRID_SQL = """(select printf('IMG_%05d', vec_id // 64) image_id, cast(vec_id % 64 as int) thermal_row, cast(generate_subscripts(embedding, 1) - 1 as int) thermal_col, cast(unnest(embedding) as double) v, label from embeddings)"""


CELL_BOXES_SQL = """(select distinct cell_key, u0, u1, cell_min_lat w0, cell_max_lat w1 from (select *, cell_min_lon u0, case when cell_min_lon <= cell_max_lon then cell_max_lon else 180 end u1 from luhk_cells union all select *, -180, cell_max_lon from luhk_cells where cell_min_lon > cell_max_lon))"""


def cell_boxes(spark, sf):
    """``cell_key, u0, u1, w0, w1``: longitudes and latitudes of each cell, one that crosses the 180th meridian as two boxes."""
    west, east = F.col("cell_min_lon"), F.col("cell_max_lon")
    one = F.struct(west.alias("u0"), F.when(west <= east, east).otherwise(F.lit(180.0)).alias("u1"))
    boxes = F.when(west > east, F.array(one, F.struct(F.lit(-180.0).alias("u0"), east.alias("u1")))).otherwise(F.array(one))
    c = table(spark, sf, "luhk_cells").select("cell_key", F.explode(boxes).alias("b"), F.col("cell_min_lat").alias("w0"), F.col("cell_max_lat").alias("w1"))
    return c.select("cell_key", "b.u0", "b.u1", "w0", "w1").distinct()


#: The capture time in a file name or image id, as SQL.
STAMP_SQL = "try_strptime(nullif(regexp_extract({}, 'DJI_([0-9]{{14}})', 1), ''), '%Y%m%d%H%M%S')"


def stamp(name):
    """The same as a column: a time stamp, null where there is none."""
    return F.try_to_timestamp(F.nullif(F.regexp_extract(name, r"DJI_(\d{14})", 1), F.lit("")), F.lit("yyyyMMddHHmmss"))


@query("proj01_delta_t", """select row_id, round(cast(case when isfinite(temperature_c) and isfinite(ambient_temperature_c) then temperature_c - ambient_temperature_c end as double), 4) as delta_t from pixel_samples""")
def _(spark, sf):
    d = P.delta_t(F.col("temperature_c"), F.col("ambient_temperature_c"))
    return px(spark, sf).select("row_id", F.round(d.cast("double"), 4).alias("delta_t"))


@query("proj02_formal_population", """select row_id, coalesce(analysis_eligible and target_mask and isfinite(delta_t_c), false) as formal from pixel_samples""")
def _(spark, sf):
    return px(spark, sf).select("row_id", P.formal_population(F.col("analysis_eligible"), F.col("target_mask"), F.col("delta_t_c")).alias("formal"))


FAMILIES = ["luhk", "surface_cover", "luhk_surface_cover", "surface_cover_shadow", "image_comparison"]


def family_groups(pixels: DataFrame) -> DataFrame:
    """Formal pixels once per analysis family that they are eligible for, with the group's label."""
    d = pixels.where(P.formal_population(F.col("analysis_eligible"), F.col("target_mask"), F.col("delta_t_c")))
    luhk = F.concat_ws(" | ", F.col("luhk_class_code").cast("string"), "luhk_class_name")
    cover, shadow = F.col("surface_cover_class"), F.concat(F.col("surface_cover_class"), F.lit(" | shadow="), F.col("shadow_flag").cast("int").cast("string"))
    rules = [
        ("luhk", F.col("luhk_label_valid"), luhk),
        ("surface_cover", F.col("surface_cover_valid"), cover),
        ("luhk_surface_cover", F.col("luhk_label_valid") & F.col("surface_cover_valid"), F.concat(luhk, F.lit(" | "), cover)),
        ("surface_cover_shadow", F.col("surface_cover_valid") & F.col("shadow_valid"), shadow),
        ("image_comparison", F.lit(True), F.col("image_id")),
    ]
    groups = F.array_compact(F.array(*[F.when(ok & label.isNotNull(), F.struct(F.lit(name).alias("family"), label.alias("group_name"))) for name, ok, label in rules]))
    return d.withColumn("__g", F.explode(groups)).select("*", "__g.family", "__g.group_name").drop("__g")


FAMILY_SQL = """(
  with d as (select *, concat_ws(' | ', cast(luhk_class_code as varchar), luhk_class_name) as lk from pixel_samples where analysis_eligible and target_mask and isfinite(delta_t_c)),
  x as (select *, 'luhk' as family, lk as group_name from d where luhk_label_valid union all
    select *, 'surface_cover', surface_cover_class from d where surface_cover_valid union all
    select *, 'luhk_surface_cover', lk || ' | ' || surface_cover_class from d where luhk_label_valid and surface_cover_valid union all
    select *, 'surface_cover_shadow', surface_cover_class || ' | shadow=' || cast(shadow_flag as varchar) from d where surface_cover_valid and shadow_valid union all
    select *, 'image_comparison', image_id from d)
  select * from x where group_name is not null)"""


@query("proj03_family_groups", f"select family, group_name, count(*) as n_pixels, count(distinct image_id) as n_images from {FAMILY_SQL} group by 1, 2")
def _(spark, sf):
    per_image = family_groups(px(spark, sf)).groupBy("family", "group_name", "image_id").agg(F.count("*").alias("n"))
    return per_image.groupBy("family", "group_name").agg(F.sum("n").alias("n_pixels"), F.count("image_id").alias("n_images"))


@query("proj04_grid_flatten", f"select image_id || '__r' || lpad(cast(thermal_row as varchar), 4, '0') || '_c' || lpad(cast(thermal_col as varchar), 4, '0') as pixel_uid, thermal_row, thermal_col, round(20 + 10 * v, 6) as temperature_c from {GRID_SQL}")
def _(spark, sf):
    uid = F.format_string("%s__r%04d_c%04d", "image_id", "thermal_row", "thermal_col")
    return grid(spark, sf).select(uid.alias("pixel_uid"), "thermal_row", "thermal_col", F.round(20 + 10 * F.col("v"), 6).alias("temperature_c"))


@query(
    "proj05_exclusion_reason",
    """select row_id, case when label_known and target_mask and isfinite(temperature_c) and qa_status = 'fail' then 'temperature_qa_failed'
      when label_known and target_mask and isfinite(temperature_c) and annotation_review_status <> 'accepted' then 'annotation_not_accepted'
      when not label_known then 'label_unknown' when not target_mask then 'outside_target_selection'
      when not coalesce(isfinite(temperature_c), false) then 'non_finite_temperature' else '' end as reason from pixel_samples""",
)
def _(spark, sf):
    r = P.exclusion_reason(P.finite(F.col("temperature_c")), F.col("target_mask"), F.col("label_known"), F.col("annotation_review_status") == "accepted", F.col("qa_status") == "fail")
    return px(spark, sf).select("row_id", r.alias("reason"))


_COVER_CASE = "case label " + " ".join(f"when {k} then '{v}'" for k, v in P.COVERS.items()) + f" else '{P.NO_COVER}' end"


@query("proj06_cover_validity", f"select vec_id, label not in (0, 9) as valid, {_COVER_CASE} as cover from embeddings")
def _(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", (~F.col("label").isin(0, 9)).alias("valid"), P.cover_name(F.col("label")).alias("cover"))


@query("proj07_open_space", """select row_id, lower(coalesce(cast(luhk_class_code as varchar), '')) in ('31', 'gic_open_space') or contains(lower(coalesce(luhk_class_name, '')), 'gic') or contains(lower(coalesce(luhk_class_name, '')), 'open space') as open_space from pixel_samples""")
def _(spark, sf):
    return px(spark, sf).select("row_id", P.open_space(F.col("luhk_class_code"), F.col("luhk_class_name")).alias("open_space"))


@query("proj08_text_boolean", "select record_id, coalesce(lower(trim(validation_status)) in ('1', 'true', 'yes', 'y', 'ok', 'pass'), false) as passed from validation_records")
def _(spark, sf):
    return table(spark, sf, "validation_records").select("record_id", P.truthy(F.col("validation_status"), ("ok", "pass")).alias("passed"))


@query("proj09_shadow_flag", """with t as (select row_id, lower(trim(coalesce(cast(shadow_flag as varchar), case when thermal_col % 3 = 0 then 'shaded' when thermal_col % 3 = 1 then 'unclear' end, ''))) s from pixel_samples)
    select row_id, case when s in ('', 'no', 'none', 'false', 'not_shadow', 'sunlit') then 0 when s in ('yes', 'true', 'shadow', 'shaded') then 1 else cast(try_cast(s as double) as int) end as flag from t""")
def _(spark, sf):
    words = F.coalesce(F.col("shadow_flag").cast("string"), F.when(F.col("thermal_col") % 3 == 0, "shaded").when(F.col("thermal_col") % 3 == 1, "unclear"))
    return px(spark, sf).select("row_id", P.shadow_flag(words).alias("flag"))


@query("proj10_label_fill", """select row_id, coalesce(nullif(trim(coalesce(surface_cover_class, '')), ''), nullif(trim(coalesce(luhk_class_name, '')), ''), '') as label from pixel_samples""")
def _(spark, sf):
    return px(spark, sf).select("row_id", F.trim(P.filled(F.col("surface_cover_class"), F.col("luhk_class_name"))).alias("label"))


_CH = {k: f"abs(cast(embedding[{i + 1}] as double)) - floor(abs(cast(embedding[{i + 1}] as double)))" for i, k in enumerate(["r", "g", "b", "h", "s", "v"])}


@query(
    "proj11_segment_class",
    "with c as (select vec_id, " + ", ".join(f"{e} as {k}" for k, e in _CH.items()) + """ from embeddings),
      x as (select *, s > 0.18 and g - greatest(r, b) > 0.06 as green from c)
      select vec_id, case when v < 0.18 then 'unclear_ignore' when green and v < 0.5 then 'vegetation_tree' when green then 'grass_low_vegetation'
        when h between 0.48 and 0.66 and s > 0.25 and v > 0.2 then 'water' when s < 0.12 and v > 0.58 then 'concrete_pavement'
        when s < 0.16 and v between 0.2 and 0.46 then 'asphalt_road' else 'unclear_ignore' end as cover from x""",
)
def _(spark, sf):
    at = lambda k: F.abs(F.col("embedding")[k].cast("double")) - F.floor(F.abs(F.col("embedding")[k].cast("double")))
    return table(spark, sf, "embeddings").select("vec_id", P.segment_class(at(0), at(1), at(2), at(3), at(4), at(5), F.lit(0.001)).alias("cover"))


@query("proj12_spatial_pattern", """select qa_id, case when below_0_pixel_count = 0 then 'none' when below_0_percent_of_valid / 10 >= 0.75 then 'edge_concentrated'
    when capture_seq % 40 > 0 and below_minus_5_pixel_count / below_0_pixel_count >= 0.5 then 'clustered'
    when capture_seq % 40 >= greatest(10, floor(below_0_pixel_count / 3)) then 'mostly_isolated_or_speckled' else 'mixed' end as pattern from subzero_qa where below_0_pixel_count >= 0""")
def _(spark, sf):
    q = table(spark, sf, "subzero_qa").where("below_0_pixel_count >= 0")
    return q.select("qa_id", P.spatial_pattern(F.col("below_0_pixel_count"), F.col("capture_seq") % 40, F.col("below_minus_5_pixel_count"), F.col("below_0_percent_of_valid") / 10).alias("pattern"))


@query("proj13_qa_notes", """select qa_id, coalesce(case when below_0_percent_of_valid > 50 then 'fail' when below_0_percent_of_valid > 0 then 'warn' else 'pass' end, 'pass') as status,
    concat_ws('; ', case when below_0_percent_of_valid > 0 then 'sub-zero pixels present' end, case when below_0_percent_of_valid > 50 then 'most valid pixels are sub-zero' end, case when minimum_temperature_c is null then 'no minimum' end) as notes from subzero_qa""")
def _(spark, sf):
    share = F.col("below_0_percent_of_valid")
    status = F.when(share > 50, "fail").when(share > 0, "warn").otherwise("pass")
    notes = P.ladder_notes((share > 0, "sub-zero pixels present"), (share > 50, "most valid pixels are sub-zero"), (F.col("minimum_temperature_c").isNull(), "no minimum"))
    return table(spark, sf, "subzero_qa").select("qa_id", status.alias("status"), notes.alias("notes"))


@query("proj14_matrix_flags", """with a as (select image_id, min(t) lo, max(t) hi, stddev_pop(t) sd, count(t) n, bool_and(abs(t - round(t)) <= 1e-6) ints, bool_and(abs(t) <= 1e-8) zero, count(distinct t) u
      from (select image_id, case when isfinite(temperature_c) then cast(temperature_c as double) end t from pixel_samples) group by 1)
    select image_id, case when n = 0 then 'no_finite_values' else concat_ws(';', case when zero then 'all_zero' end, case when sd < 1e-6 then 'all_constant' end, case when lo >= 0 and hi <= 255 and ints and u <= 256 then 'preview_like' end,
      case when lo < 0 or hi > 80 then 'outside_typical_range' end, case when lo < -80 or hi > 200 then 'outside_plausible_range' end) end as flags from a""")
def _(spark, sf):
    t = F.when(P.finite(F.col("temperature_c")), F.col("temperature_c").cast("double"))
    a = px(spark, sf).select("image_id", t.alias("t")).groupBy("image_id").agg(
        F.min("t").alias("lo"), F.max("t").alias("hi"), F.stddev_pop("t").alias("sd"), F.count("t").alias("n"), F.bool_and(F.abs(F.col("t") - F.round("t")) <= 1e-6).alias("ints"),
        F.bool_and(F.abs("t") <= 1e-8).alias("zero"), F.count_distinct("t").alias("u"),
    )
    lo, hi = F.col("lo"), F.col("hi")
    rules = [(F.col("zero"), "all_zero"), (F.col("sd") < 1e-6, "all_constant"), ((lo >= 0) & (hi <= 255) & F.col("ints") & (F.col("u") <= 256), "preview_like"), ((lo < 0) | (hi > 80), "outside_typical_range"), ((lo < -80) | (hi > 200), "outside_plausible_range")]
    flags = F.concat_ws(";", F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in rules])))
    return a.select("image_id", F.when(F.col("n") == 0, "no_finite_values").otherwise(flags).alias("flags"))


CAMERAS = [("wide_visible", 6.7, 24.0), ("medium_tele_visible", 19.4, 70.0), ("tele_visible", 44.5, 168.0)]


@query("proj15_camera_class", """with c as (select record_id, focal_length_mm f, focal_length_mm * 53 / 12 f35, case when record_id % 3 = 0 then 'Thermal' when record_id % 3 = 1 then 'visible' end kind from validation_records)
    select record_id, case when lower(kind) = 'thermal' then case when abs(f - 12) <= 0.5 and (abs(f35 - 53) <= 1.5 or abs(f35 - 52) <= 1.5) then 'thermal' else 'thermal_unconfirmed' end
      when lower(kind) = 'visible' then case when abs(f35 - 24) <= 1 then 'wide_visible' when abs(f35 - 70) <= 1 then 'medium_tele_visible' when abs(f35 - 168) <= 1 then 'tele_visible' else 'visible_unclassified' end else 'unknown' end as camera from c""")
def _(spark, sf):
    kind = F.when(F.col("record_id") % 3 == 0, "Thermal").when(F.col("record_id") % 3 == 1, "visible")
    f = F.col("focal_length_mm")
    return table(spark, sf, "validation_records").select("record_id", P.camera_class(kind, f, f * 53 / 12, CAMERAS)["key"].alias("camera"))


@query("proj17_first_available", "select record_id, coalesce(nullif(trim(visible_path), ''), nullif(trim(thermal_path), ''), nullif(trim(image_id), '')) as path from validation_records")
def _(spark, sf):
    return table(spark, sf, "validation_records").select("record_id", P.first_available(F.col("visible_path"), F.col("thermal_path"), F.col("image_id")).alias("path"))


@query("proj19_readable_group", """select coverage_id, replace(array_to_string(list_filter(string_split(group_name, ' | '), lambda p: not regexp_matches(p, '^[a-z_]+=([^0-9]|[0-9].)')), ', '), '_', ' ') as label from sample_coverage""")
def _(spark, sf):
    return table(spark, sf, "sample_coverage").select("coverage_id", T.readable_group(F.col("group_name")).alias("label"))


@query("proj20_density_status", """select image_id, case when n < 100 then 'insufficient_samples' when u < 5 then 'too_few_distinct_values' when sd < 0.02 then 'near_constant' else 'eligible' end as status
    from (select image_id, count(*) n, count(distinct delta_t_c) u, stddev_samp(cast(delta_t_c as double)) sd from pixel_samples where isfinite(delta_t_c) group by 1)""")
def _(spark, sf):
    a = px(spark, sf).where(P.finite(F.col("delta_t_c"))).groupBy("image_id").agg(F.count("*").alias("n"), F.count_distinct("delta_t_c").alias("u"), F.stddev_samp(F.col("delta_t_c").cast("double")).alias("sd"))
    return a.select("image_id", P.density_status(F.col("n"), F.col("u"), F.col("sd")).alias("status"))


@query("proj24_ambient_precedence", """with i as (select image_id, avg(cast(ambient_temperature_c as double)) a from pixel_samples where isfinite(ambient_temperature_c) group by 1), f as (select flight_id, avg(cast(ambient_temperature_c as double)) a from pixel_samples where isfinite(ambient_temperature_c) group by 1)
    select q.qa_id, round(coalesce(i.a, f.a), 4) as ambient_c, case when i.a is not null then 'image' when f.a is not null then 'flight' else 'none' end as origin from subzero_qa q left join i using (image_id) left join f using (flight_id)""")
def _(spark, sf):
    ok = px(spark, sf).where(P.finite(F.col("ambient_temperature_c"))).select("image_id", "flight_id", F.col("ambient_temperature_c").cast("double").alias("a"))
    per = lambda k: ok.groupBy(k).agg(F.avg("a").alias(f"a_{k}"))
    q = table(spark, sf, "subzero_qa").select("qa_id", "image_id", "flight_id").join(per("image_id"), "image_id", "left").join(per("flight_id"), "flight_id", "left")
    origin = F.when(F.col("a_image_id").isNotNull(), "image").when(F.col("a_flight_id").isNotNull(), "flight").otherwise("none")
    return q.select("qa_id", F.round(F.coalesce("a_image_id", "a_flight_id"), 4).alias("ambient_c"), origin.alias("origin"))


@query("proj26_missing_metadata", "select record_id, lower(trim(coalesce(capture_timezone, ''))) in ('', 'unknown', 'none', 'nan', 'null', 'not_available', 'n/a') as missing from validation_records")
def _(spark, sf):
    return table(spark, sf, "validation_records").select("record_id", P.missing_metadata(F.col("capture_timezone")).alias("missing"))


@query("str01_capture_name", r"""select record_id, 'DJI_' || regexp_extract(thermal_path, '(?i)DJI_(\d{14})_(\d+)', 1) || '_' || regexp_extract(thermal_path, '(?i)DJI_(\d{14})_(\d+)', 2) as image,
    cast(regexp_extract(thermal_path, '(?i)DJI_(\d{14})_(\d+)', 2) as bigint) as sample, upper(regexp_extract(thermal_path, '(?i)DJI_(\d{14})_(\d+)_([VT])', 3)) as role from validation_records where thermal_path is not null and regexp_matches(thermal_path, '(?i)DJI_\d{14}_\d+_[VT]')""")
def _(spark, sf):
    n = T.capture_name(F.col("thermal_path"))
    return table(spark, sf, "validation_records").select("record_id", n["image"].alias("image"), n["sample"].alias("sample"), n["role"].alias("role")).where("role is not null")


@query("str02_session_from_path", "select record_id, string_split(pair_id, '::')[1] as session, string_split(string_split(pair_id, '::')[1], '/')[2] as location from validation_records where pair_id is not null")
def _(spark, sf):
    head = F.split("pair_id", "::")[0]
    return table(spark, sf, "validation_records").where("pair_id is not null").select("record_id", head.alias("session"), F.get(F.split(head, "/"), F.lit(1)).alias("location"))


@query("str03_number_in_text", r"""select doc_id, case when contains(lower(text), 'below sea') then -abs(n) else n end as first_number from (select doc_id, text, try_cast(nullif(regexp_extract(replace(replace(text, '−', '-'), ',', ''), '[-+]?\d+(\.\d+)?([eE][-+]?\d+)?', 0), '') as double) n from documents)""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.number_in_text(F.col("text")).alias("first_number"))


@query("str04_coordinate", """with c as (select record_id, gps_latitude g from validation_records where gps_latitude between -90 and 90), t as (select record_id, g, floor(abs(g)) d, floor((abs(g) - floor(abs(g))) * 60) m from c)
    select record_id, round((case when g < 0 then -1 else 1 end) * (d + m / 60.0), 6) as latitude from t""")
def _(spark, sf):
    g = F.col("gps_latitude")
    deg = F.floor(F.abs(g))
    written = F.format_string("%d deg %d' 0.0\"", deg, F.floor((F.abs(g) - deg) * 60))
    return table(spark, sf, "validation_records").where("gps_latitude between -90 and 90").select("record_id", F.round(T.coordinate(written, F.when(g < 0, "South").otherwise("North")), 6).alias("latitude"))


@query("str05_plain_tag", r"select record_id, regexp_replace(lower(regexp_extract(group_id, '([^:]*)$', 1)), '[^a-z0-9]', '', 'g') as tag from validation_records")
def _(spark, sf):
    return table(spark, sf, "validation_records").select("record_id", T.plain_tag(F.col("group_id")).alias("tag"))


LABELS = {"title": ("title", "titel"), "note": ("note", "please read this note."), "summary": ("summary", "resumen")}


def _labels_sql() -> str:
    parts = []
    for field, labels in LABELS.items():
        alone = "low in (" + ", ".join(f"'{x}'" for x in labels) + ")"
        rest = lambda x: f"regexp_replace(substr(line, {len(x) + 1}), '^[\\s:：]+|[\\s:：]+$', '', 'g')"
        prefix = " ".join(f"when starts_with(low, '{x}') and {rest(x)} <> '' then {rest(x)}" for x in labels)
        parts.append(f"select doc_id, k, '{field}' as field, {alone} as alone, case when {alone} then nxt {prefix} end as value from n")
    return " union all ".join(parts)


@query(
    "str06_value_after_label",
    f"""with a as (select distinct doc_id, text from documents), l as (select doc_id, generate_subscripts(string_split_regex(text, '\\r?\\n'), 1) k, regexp_replace(unnest(string_split_regex(text, '\\r?\\n')), '^[ \\t]+|[ \\t]+$', '', 'g') line from a where text is not null),
    n as (select doc_id, k, line, lead(line) over (partition by doc_id order by k) nxt, lower(regexp_replace(line, '^[\\s:：]+|[\\s:：]+$', '', 'g')) low from l where line <> ''), h as ({_labels_sql()})
    select doc_id, field as label, arg_min(struct_pack(v := value), k).v as value from h where alone or value is not null group by 1, 2""",
)
def _(spark, sf):
    lines = T.lines(table(spark, sf, "documents"), "doc_id", "text")
    return T.value_after_label(lines, "doc_id", LABELS).withColumnRenamed("field", "label")


@query("str07_report_lines", r"""with l as (select doc_id, regexp_replace(unnest(regexp_split_to_array(text, '\r?\n')), '^[ \t]+|[ \t]+$', '', 'g') as line from documents) select doc_id, count(*) as n_lines, cast(sum(length(line)) as bigint) as n_chars from l where line <> '' group by 1""")
def _(spark, sf):
    return T.lines(table(spark, sf, "documents"), "doc_id", "text").groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("line").cast("long")).alias("n_chars"))


@query("str10_slug", "select coverage_id, regexp_replace(regexp_replace(lower(group_name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') as slug from sample_coverage")
def _(spark, sf):
    return table(spark, sf, "sample_coverage").select("coverage_id", T.slug(F.col("group_name")).alias("slug"))


@query("str11_normal_path", r"select record_id, lower(replace(thermal_path, '\', '/')) as path from validation_records")
def _(spark, sf):
    return table(spark, sf, "validation_records").select("record_id", T.normal_path(F.col("thermal_path")).alias("path"))


@query("dt05_local_date", "select record_id, strftime(received_at + interval 8 hour, '%Y-%m-%d') as local_date from validation_records")
def _(spark, sf):
    local = F.timestamp_micros(F.unix_micros(F.col("received_at").cast("timestamp")) + 8 * 3_600_000_000)
    return table(spark, sf, "validation_records").select("record_id", F.date_format(local, "yyyy-MM-dd").alias("local_date"))


@query("dt07_day_night", f"""select flight_id, bool_or(hour(t) >= 6 and hour(t) < 18) as day, bool_or(hour(t) < 6 or hour(t) >= 18) as night, round((epoch_us(max(t)) - epoch_us(min(t))) / 3.6e9, 5) as span_hours from (select flight_id, {STAMP_SQL.format('image_id')} t from subzero_qa) group by 1""")
def _(spark, sf):
    q = table(spark, sf, "subzero_qa").select("flight_id", stamp("image_id").alias("t"))
    h, us = F.hour("t"), F.unix_micros("t")
    return q.groupBy("flight_id").agg(F.bool_or((h >= 6) & (h < 18)).alias("day"), F.bool_or((h < 6) | (h >= 18)).alias("night"), F.round((F.max(us) - F.min(us)) / 3.6e9, 5).alias("span_hours"))


_HAV = "2 * 6371008.8 * atan2(sqrt({h}), sqrt(greatest(0.0, 1 - ({h}))))"


@query("geo01_haversine", """with c as (select v.record_id, radians(gps_latitude) a, radians(m.y) b, radians(m.x - gps_longitude) dl from validation_records v join (select flight_id, avg(gps_latitude) y, avg(gps_longitude) x from validation_records where gps_latitude between -90 and 90 and gps_longitude between -180 and 180 group by 1) m using (flight_id) where gps_latitude between -90 and 90 and gps_longitude between -180 and 180),
    h as (select record_id, pow(sin((b - a) / 2), 2) + cos(a) * cos(b) * pow(sin(dl / 2), 2) h from c)
    select record_id, round(""" + _HAV.format(h="h") + ", 2) as metres from h")
def _(spark, sf):
    v = table(spark, sf, "validation_records").where("gps_latitude between -90 and 90 and gps_longitude between -180 and 180").select("record_id", "flight_id", "gps_latitude", "gps_longitude")
    m = v.groupBy("flight_id").agg(F.avg("gps_latitude").alias("y"), F.avg("gps_longitude").alias("x"))
    return v.join(m, "flight_id").select("record_id", F.round(geo.haversine_m(F.col("gps_latitude"), F.col("gps_longitude"), F.col("y"), F.col("x")), 2).alias("metres"))


@query("geo02_field_of_view", """select record_id, round(degrees(2 * atan(36.0 / (2 * focal_length_mm))), 6) as fov, round(sqrt(36.0 * 36 + 24 * 24) / (focal_length_mm * 4.5 / focal_length_mm) * 640 / sqrt(640.0 * 640 + 512 * 512), 6) as sensor_mm from validation_records where focal_length_mm > 0""")
def _(spark, sf):
    f = F.col("focal_length_mm")
    v = table(spark, sf, "validation_records").where("focal_length_mm > 0")
    return v.select("record_id", F.round(geo.field_of_view(f, F.lit(36.0)), 6).alias("fov"), F.round(geo.sensor_size(f, f * 4.5, F.lit(640.0), F.lit(512.0)), 6).alias("sensor_mm"))


@query("geo03_footprint", """select record_id, round(2 * altitude_m * tan(radians(61.0) / 2), 4) as width_m, round(2 * altitude_m * tan(radians(48.0) / 2), 4) as height_m, round(2 * altitude_m * tan(radians(61.0) / 2) / 640, 6) as gsd_m, altitude_m is null as incomplete from validation_records""")
def _(spark, sf):
    h = F.col("altitude_m")
    wide = geo.ground_length(h, F.lit(61.0))
    return table(spark, sf, "validation_records").select("record_id", F.round(wide, 4).alias("width_m"), F.round(geo.ground_length(h, F.lit(48.0)), 4).alias("height_m"), F.round(wide / 640, 6).alias("gsd_m"), h.isNull().alias("incomplete"))


@query("geo06_grid_index", "select cell_key, cast(floor((cell_min_lat + 90) / 0.0009) as bigint) as grid_row, cast(floor((cell_min_lon + 180) / 0.0009) as bigint) as grid_col from luhk_cells")
def _(spark, sf):
    return table(spark, sf, "luhk_cells").select("cell_key", geo.grid_index(-90.0, F.col("cell_min_lat"), 0.0009).alias("grid_row"), geo.grid_index(-180.0, F.col("cell_min_lon"), 0.0009).alias("grid_col"))


@query("geo07_shoelace", """with c as (select vec_id, list_transform(embedding[1:8], lambda v: cast(v as double)) x, list_transform(embedding[9:16], lambda v: cast(v as double)) y from embeddings)
    select vec_id, round(list_sum(list_transform(range(1, 9), lambda i: x[i] * y[i % 8 + 1] - x[i % 8 + 1] * y[i])) / 2, 6) as area from c""")
def _(spark, sf):
    part = lambda a: F.transform(F.slice("embedding", a, 8), lambda v: v.cast("double"))
    e = table(spark, sf, "embeddings").select("vec_id", part(1).alias("x"), part(9).alias("y"))
    return e.select("vec_id", F.round(geo.shoelace(F.col("x"), F.col("y")), 6).alias("area"))


@query("geo08_valid_polygon", f"""with e as (select vec_id, [cast(v as double) for v in embedding[1:8]] x, [cast(v as double) for v in embedding[9:16]] y from embeddings), a as (select *, {' + '.join(f"(x[{i + 1}] * y[{(i + 1) % 8 + 1}] - x[{(i + 1) % 8 + 1}] * y[{i + 1}])" for i in range(8))} s from e)
    select vec_id, len(x) = len(y) and len(x) >= 3 and len([v for v in x || y if v is null or not isfinite(v)]) = 0 and abs(s / 2) >= 1e-6 as valid from a""")
def _(spark, sf):
    part = lambda a: F.transform(F.slice("embedding", a, 8), lambda v: v.cast("double"))
    e = table(spark, sf, "embeddings").select("vec_id", part(1).alias("x"), part(9).alias("y"))
    return e.select("vec_id", geo.valid_polygon(F.col("x"), F.col("y")).alias("valid"))


POLYGON = [(100.0, 50.0), (500.0, 80.0), (420.0, 400.0), (150.0, 300.0)]


def _edges_sql() -> str:
    out = []
    for (x0, y0), (x1, y1) in zip(POLYGON, POLYGON[1:] + POLYGON[:1]):
        out.append(f"cast(({y0} > y) <> ({y1} > y) and x < {x1 - x0} * (y - {y0}) / {y1 - y0} + {x0} as int)")
    return " + ".join(out)


@query("geo09_rasterise", f"select image_id, count(*) as n_inside from (select image_id, cast(thermal_col as double) x, cast(thermal_row as double) y from pixel_samples) where ({_edges_sql()}) % 2 = 1 group by 1")
def _(spark, sf):
    return px(spark, sf).where(geo.inside_polygon(F.col("thermal_col").cast("double"), F.col("thermal_row").cast("double"), POLYGON)).groupBy("image_id").agg(F.count("*").alias("n_inside"))


@query("geo10_map_to_pixel", "select record_id, round((gps_longitude + 180) / 360 * 6375, 4) as px, round((gps_latitude + 90) / 180 * 4800, 4) as py from validation_records where gps_latitude between -90 and 90")
def _(spark, sf):
    at = lambda c, low, high, n: F.round(geo.map_to_pixel(F.col(c), F.lit(low), F.lit(high), F.lit(n)), 4)
    return table(spark, sf, "validation_records").where("gps_latitude between -90 and 90").select("record_id", at("gps_longitude", -180.0, 180.0, 6375).alias("px"), at("gps_latitude", -90.0, 90.0, 4800).alias("py"))


@query("geo11_grid_consistency", """with r as (select cell_max_lat - cell_min_lat h, cell_center_lat - (cell_min_lat + cell_max_lat) / 2 d from luhk_cells where cell_center_lat is not null)
    select round(quantile_cont(h, 0.5), 8) as median_height, round(max(abs(d)), 6) as worst_residual, count(*) as n from r""")
def _(spark, sf):
    c = table(spark, sf, "luhk_cells").where("cell_center_lat is not null")
    h, d = F.col("cell_max_lat") - F.col("cell_min_lat"), F.col("cell_center_lat") - (F.col("cell_min_lat") + F.col("cell_max_lat")) / 2
    return c.agg(F.round(F.median(h), 8).alias("median_height"), F.round(F.max(F.abs(d)), 6).alias("worst_residual"), F.count("*").alias("n"))


@query("hsh01_stratum_id", """select record_id, substr(sha256('dataset_id=' || coalesce(dataset_id, '') || '|flight_id=' || coalesce(flight_id, '') || '|camera_model=' || coalesce(camera_model, '')), 1, 16) as stratum_id from validation_records""")
def _(spark, sf):
    return table(spark, sf, "validation_records").select("record_id", hashing.stratum_id({c: F.col(c) for c in ("dataset_id", "flight_id", "camera_model")}).alias("stratum_id"))


def _mix_sql(x: str, seed: int) -> str:
    m = 1 << 64
    a = f"(({x}::uhugeint + {(seed + hashing.GOLDEN) % m}) % {m})"
    return f"""select *, xor(c, c // 2147483648) as z from (select *, (xor(b, b // 134217728) * {hashing.MIX_B}) % {m} as c from (select *, (xor(a, a // 1073741824) * {hashing.MIX_A}) % {m} as b from (select *, {a} as a from base)))"""


@query("smp01_splitmix64", f"with base as (select row_id from pixel_samples) select row_id, cast(z // 4294967296 as bigint) as high, cast(z % 4294967296 as bigint) as low from ({_mix_sql('row_id', 20260715)})")
def _(spark, sf):
    rows = hashing.with_splitmix64(px(spark, sf).select("row_id"), "row_id", F.lit(hashing.gamma(20260715)), "z")
    return rows.select("row_id", F.shiftrightunsigned("z", 32).alias("high"), F.col("z").bitwiseAND(F.lit((1 << 32) - 1)).alias("low"))


@query("hsh05_group_seed")
def _(spark, sf):
    return table(spark, sf, "sample_coverage").select("group_name", (20260715 + F.crc32(F.col("group_name").cast("binary"))).alias("seed")).distinct()


@query("jsn01_interval_json", "select flight_id, cast(to_json([s[i + 1] - s[i] for i in range(1, len(s))]) as varchar) as gaps_json from (select flight_id, list_sort(list(distinct capture_seq)) s from subzero_qa where capture_seq is not null group by 1)")
def _(spark, sf):
    e = table(spark, sf, "subzero_qa").groupBy("flight_id").agg(F.sort_array(F.collect_set("capture_seq")).alias("s"))  # bounded by the captures of a flight
    return e.select("flight_id", F.to_json(F.zip_with(F.slice("s", 2, F.size("s")), F.slice("s", 1, F.greatest(F.size("s") - 1, F.lit(0))), lambda b, a: b - a)).alias("gaps_json"))
