"""Registered queries of the general problems, with production parameters over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from calorgrid.operators import drift, near, selection, spikes, timenorm
from calorgrid.runtime import scratch, side_by_side, table

QUANTILES = {"q05": 0.05, "q25": 0.25, "median": 0.5, "q75": 0.75, "q95": 0.95}


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Captures within 12 m of each other and the land-use cell that contains each."""
    return near.near_or_inside(
        table(spark, sf, "validation_records"), table(spark, sf, "luhk_cells"), point_id="record_id", group="image_id", lat="gps_latitude", lon="gps_longitude", distance_m=12.0,
        region_id="cell_key", bounds=("cell_min_lat", "cell_max_lat", "cell_min_lon", "cell_max_lon"),
    )


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Group names with at least 3 % of all rows or of all eligible pixels."""
    return selection.hot_keys(table(spark, sf, "sample_coverage"), "group_name", "full_eligible_pixel_count", 0.03)


def p3_group_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Rows, pixels and exact percentiles of every group name."""
    return selection.key_profile(table(spark, sf, "sample_coverage"), "group_name", "full_eligible_pixel_count", QUANTILES)


TIME_FIELDS = {"text": "capture_datetime", "fallback": "capture_time_local", "zone": "capture_timezone", "assumption": "timezone_assumption", "source": "metadata_source"}
TIME_DEFAULTS = {"project_default_timezone": "Asia/Hong_Kong", "assumed_utc": "UTC"}


def p5_capture_instants(spark: SparkSession, sf: str) -> DataFrame:
    """Instant, status and chosen reading of every delivered capture."""
    return timenorm.normalise(table(spark, sf, "validation_records"), row_id="record_id", defaults=TIME_DEFAULTS, **TIME_FIELDS)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose instant can be told."""
    return p5_capture_instants(spark, sf).where("utc_micros is not null").select("record_id", "utc_micros")


PIXEL_READINGS = {"temperature_c": spikes.Reading(spikes.SpikeRule(0.2), 8, "temperature_c < -273.15")}
CAPTURE_READINGS = {
    "below_0_pixel_count": spikes.Reading(spikes.SpikeRule(5.0), 0, "below_0_pixel_count < 0 or below_0_pixel_count > valid_temperature_pixel_count"),
    "minimum_temperature_c": spikes.Reading(spikes.SpikeRule(0.2), 6, "minimum_temperature_c < -273.15"),
}
PIXEL_ORDER, CAPTURE_ORDER = ["thermal_row", "thermal_col"], ["capture_seq"]
#: Seasons: bands of 64 rows within a capture (the frame's drift), hours of the day within a flight.
PIXEL_SEASON, CAPTURE_SEASON = "thermal_row div 64", "hour(generated_at)"


def _odd_pixels(df: DataFrame) -> DataFrame:
    return spikes.odd_readings(df, row_id="row_id", source="image_id", order=PIXEL_ORDER, band=256, readings=PIXEL_READINGS, season=F.expr(PIXEL_SEASON))


def _odd_captures(df: DataFrame) -> DataFrame:
    return spikes.odd_readings(df, row_id="qa_id", source="flight_id", order=CAPTURE_ORDER, band=4096, readings=CAPTURE_READINGS, needed=["valid_temperature_pixel_count"], season=F.expr(CAPTURE_SEASON))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of pixel_samples and subzero_qa with an odd reading: the tails' candidates that the exact rule confirms, stuck and impossible ones."""
    def rows(name, odd, source, order, row_id):
        df = table(spark, sf, name)
        cases = odd(df).where("case != 'peak'")
        return spikes.delivered(df, cases, source, order, row_id).select(F.lit(name).alias("table_name"), "record_id")

    # the tables do not wait for each other's small jobs
    pixels, captures = side_by_side(
        spark, lambda: rows("pixel_samples", _odd_pixels, "image_id", PIXEL_ORDER, "row_id"), lambda: rows("subzero_qa", _odd_captures, "flight_id", CAPTURE_ORDER, "qa_id")
    )
    return pixels.unionByName(captures)


def p6_capture_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Every case of the capture QA, tail peaks included: flight, capture, reading, case."""
    return _odd_captures(table(spark, sf, "subzero_qa")).select(F.col("source").alias("flight_id"), F.col("o0").alias("capture_seq"), "reading", "case")


def p6_flight_tails(spark: SparkSession, sf: str) -> DataFrame:
    """Pixels beyond the fitted tail of their flight, as residuals from the flight's level at their hour of capture."""
    hour = F.regexp_extract("image_id", r"DJI_\d{8}(\d{2})", 1).try_cast("int")
    p = table(spark, sf, "pixel_samples").select("row_id", "flight_id", "image_id", "thermal_row", "thermal_col", "temperature_c", hour.alias("hour"))
    place = [F.col(c) for c in ("image_id", "thermal_row", "thermal_col")]
    once = scratch(p.groupBy(F.col("flight_id").alias("source"), *place).agg(F.min(spikes.clean(F.col("temperature_c"))).alias("temperature_c"), F.min(F.coalesce("hour", F.lit(-1))).alias("season")))
    tail = spikes.candidates(once, {"temperature_c": spikes.SpikeRule(0.2)})
    return tail.select(F.col("source").alias("flight_id"), "image_id", "thermal_row", "thermal_col", F.nullif("season", F.lit(-1)).alias("hour"), F.round("residual", 3).alias("residual"), F.round("cutoff", 3).alias("tail_cutoff"))


EXPORT_FIELDS = {"payload": "payload", "feed": "feed", "file_id": "file_id", "seq": "file_seq", "key": "pixel_uid"}


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every schema change of an export file against the file before it in its feed."""
    return drift.changes(table(spark, sf, "raw_exports"), **EXPORT_FIELDS)


def p7_lifespans(spark: SparkSession, sf: str) -> DataFrame:
    """Every lifespan of a field and type in a feed: from which file to which, and how it begins and ends."""
    spans = drift.history(table(spark, sf, "raw_exports"), **EXPORT_FIELDS)[1]
    return spans.select("feed", "field", F.coalesce("ftype", F.lit("")).alias("json_type"), F.col("island").cast("int").alias("island"), "first_file", "last_file", F.col("n_files").cast("int").alias("n_files"), "begins", "ends")


def p7_records(spark: SparkSession, sf: str) -> DataFrame:
    """Every valid exported line in one consistent table."""
    return drift.consistent_table(table(spark, sf, "raw_exports"), keep=["record_id", "feed", "file_id", "file_seq", "line_no"], **EXPORT_FIELDS)


QUERIES = {"p1_found": p1_found, "p3_found": p3_found, "p3_group_profile": p3_group_profile, "p5_found": p5_found, "p5_capture_instants": p5_capture_instants, "p6_found": p6_found, "p6_capture_cases": p6_capture_cases, "p6_flight_tails": p6_flight_tails, "p7_found": p7_found, "p7_lifespans": p7_lifespans, "p7_records": p7_records}



def _odd_sql(table_name: str, row_id: str, source: str, order: list[str], value: str, floor: float, least: int, impossible: str, other: str = "0") -> str:
    place = ", ".join(order)
    same = " and ".join(f"p.{c} = odd.{c}" for c in order)
    return f"""select distinct '{table_name}' as table_name, {row_id} as record_id from {table_name} p join (
      with d as (select {source} src, {place}, min(case when not isnan(cast({value} as double)) then cast({value} as double) end) v, min({other}) o from {table_name} group by all),
      q as (select src, quantile_cont(v, 0.5) m, greatest(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), {floor}) s from d where v is not null group by 1),
      b as (select *, case when v is null or lag(v) over w is null or v <> lag(v) over w then 1 else 0 end b from d window w as (partition by src order by {place})),
      r as (select *, sum(b) over (partition by src order by {place}) run from b), n as (select *, count(*) over (partition by src, run) n from r)
      select src, {place} from d join q using (src) where abs(v - m) > 5 * s union select src, {place} from n where v is not null and n >= {least} union select src, {place} from d where {impossible}
    ) odd on p.{source} = odd.src and {same}"""


def _tail_sql(rows: str, place: str, floor: float) -> str:
    """Candidates of ``rows`` (source, season, place.., v) by the fitted tails."""
    return f"""select * from (with r as (select * from ({rows}) where v is not null and not isnan(v)),
      q as (select source, quantile_cont(v, 0.5) m, greatest(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), {floor}) s, count(*) ns from r where isfinite(v) group by 1),
      j as (select r.*, m, s, ns, greatest(-1.5 * s, least(1.5 * s, v - m)) w from r join q on r.source is not distinct from q.source),
      l as (select source, season, any_value(m) + avg(w) lv, count(*) c, var_pop(w) vr from j group by 1, 2), d as (select source, sqrt(sum(c * vr) / sum(c)) d from l group by 1),
      x as (select j.*, v - lv res, 1.5 * least(s, greatest(1.349 * d, {floor})) st, (5 * s - abs(lv - m)) * (1 - 1e-9) - 1e-9 bound from j join l on j.source is not distinct from l.source and j.season is not distinct from l.season join d on j.source is not distinct from d.source),
      p as (select *, res > 0 up from x where abs(res) > least(st, bound)),
      b as (select source, up, least(floor((abs(res) - st) / (5 * s - st) * 64), 63) cell, count(*) c, sum(abs(res) - st) sm, any_value(ns) ns from p where abs(res) > st and abs(res) <= 5 * s group by 1, 2, 3),
      e as (select *, sum(c) over (partition by source, up order by cell) - c bf, sum(c) over (partition by source, up) k from b),
      t as (select source, up, max(k) k, max(ns) ns, sum(sm) / max(k) a, sum(sm * (k - bf - (c + 1) / 2.0)) / max(k) / greatest(1, max(k) - 1) b from e group by 1, 2),
      f as (select source, up, case when k >= 10 and a - 2 * b > 1e-12 * a and ns * 1e-4 / 2 / k < 1 then 2 * a * b / (a - 2 * b) / xi * (pow(ns * 1e-4 / 2 / k, -xi) - 1) end beyond
        from (select *, case when abs(2 - a / (a - 2 * b)) < 1e-6 then 1e-6 else 2 - a / (a - 2 * b) end xi from t))
      select p.source, {place}, p.season, v, m, s, res, coalesce(st + beyond, 5 * s) cutoff, bound from p left join f on p.source is not distinct from f.source and p.up = f.up) where abs(res) > least(cutoff, bound)"""


def _capture_cases_sql() -> str:
    """Every case of both readings of the captures."""
    def clean(c):
        return f"min(case when not isnan(cast({c} as double)) then cast({c} as double) end)"

    base = f"select flight_id source, capture_seq, {clean('below_0_pixel_count')} n, {clean('minimum_temperature_c')} t, {clean('valid_temperature_pixel_count')} o, min(hour(generated_at)) season from subzero_qa group by 1, 2"
    parts = []
    for reading, c, floor, impossible in (("below_0_pixel_count", "n", 5.0, "n < 0 or n > o"), ("minimum_temperature_c", "t", 0.2, "t < -273.15")):
        tail = _tail_sql(f"select source, capture_seq, season, {c} v from base", "capture_seq", floor)
        parts.append(f"select source, capture_seq, '{reading}' as reading, case when abs(v - m) > 5 * s then 'spike' else 'peak' end as \"case\" from ({tail})")
        parts.append(f"select source, capture_seq, '{reading}', 'impossible' from base where {impossible}")
    runs = """select *, sum(b) over (partition by source order by capture_seq) run from (select *, case when t is null or lag(t) over w is null or t <> lag(t) over w then 1 else 0 end b from base where capture_seq is not null window w as (partition by source order by capture_seq))"""
    parts.append(f"select source, capture_seq, 'minimum_temperature_c', 'stuck' from (select *, count(*) over (partition by source, run) k from ({runs})) where t is not null and k >= 6")
    return f"with base as ({base}) select source as flight_id, capture_seq, reading, \"case\" from (" + " union all ".join(parts) + ")"


_FLIGHT_PX = r"""select flight_id source, image_id, thermal_row, thermal_col, min(case when not isnan(temperature_c) then cast(temperature_c as double) end) v, min(try_cast(nullif(regexp_extract(image_id, 'DJI_\d{8}(\d{2})', 1), '') as int)) season
  from pixel_samples group by 1, 2, 3, 4"""

_EXPORT_SQL = """with lines as (select feed, file_id, file_seq, cast(payload as json) p from raw_exports where json_valid(payload) and json_type(payload) = 'OBJECT'),
    files as (select *, row_number() over w o, lag(file_id) over w prev, lead(file_id) over w nxt from (select distinct feed, file_id, file_seq from raw_exports) window w as (partition by feed order by file_seq, file_id)),
    pairs as (select feed, file_id, p, unnest(json_keys(p)) k from lines),
    cells as (select feed, file_id, k, json_extract_string(p, '$.pixel_uid') uid, json_type(p, '$."' || k || '"') jt, json_extract_string(p, '$."' || k || '"') x from pairs),
    typed as (select feed, file_id, k, uid, x, case when jt = 'NULL' then null when jt = 'VARCHAR' then 'string' when jt in ('BOOLEAN', 'ARRAY', 'OBJECT') then lower(jt) else 'number' end t from cells),
    cat as (select c.*, f.o, f.prev, f.nxt from (select feed, file_id, k, arg_min(t, struct_pack(n := -n, t := t)) filter (where t is not null) t from (select feed, file_id, k, t, count(*) n from typed group by all) group by 1, 2, 3) c join files f on f.feed = c.feed and f.file_id = c.file_id)"""

_CHANGES_SQL = """, gone as (select a.feed, a.nxt f, a.file_id src, a.k, a.t from cat a where a.nxt is not null and not exists (from cat b where b.feed = a.feed and b.o = a.o + 1 and b.k = a.k)),
    new as (select a.feed, a.file_id f, a.file_id src, a.k, a.t from cat a where a.prev is not null and not exists (from cat b where b.feed = a.feed and b.o = a.o - 1 and b.k = a.k)),
    vals as (select feed, file_id, uid, k, min(v) v from (select feed, file_id, uid, k, case when t in ('number', 'string') and try_cast(x as double) is not null then 'n:' || cast(try_cast(x as double) as varchar) else t || ':' || x end v from typed where t is not null and uid is not null and x is not null) group by 1, 2, 3, 4 having count(distinct v) = 1),
    agree as (select g.f, g.k gk, g.t gt, n.k nk, n.t nt, count(*) eq from gone g join new n using (feed, f) join vals a on a.file_id = g.src and a.k = g.k join vals b on b.file_id = n.src and b.k = n.k and b.uid = a.uid group by all having count(*) filter (where a.v <> b.v) = 0),
    one as (select * from agree qualify row_number() over (partition by f, gk order by eq desc, nk) = 1), fit as (select * from one qualify row_number() over (partition by f, nk order by eq desc, gk) = 1)
    select f as file_id, k as field_before, '' as field_after, 'removed' as change_kind from gone g where not exists (from fit where fit.f = g.f and fit.gk = g.k)
    union all select f, '', k, 'added' from new n where not exists (from fit where fit.f = n.f and fit.nk = n.k)
    union all select f, gk, nk, 'renamed' from fit union all select f, gk, nk, 'retyped' from fit where gt <> nt
    union all select b.file_id, b.k, b.k, 'retyped' from cat a join cat b on a.feed = b.feed and a.k = b.k and b.o = a.o + 1 where a.t <> b.t"""

_SPANS_SQL = """, isl as (select *, o - row_number() over (partition by feed, k, t order by o) g from cat), sp as (select feed, k, t, min(o) a, max(o) b, arg_min(file_id, o) first_file, arg_max(file_id, o) last_file, count(*) n, arg_min(struct_pack(x := prev), o).x pv, arg_max(struct_pack(x := nxt), o).x nx from isl group by feed, k, t, g)
    select feed, k as field, coalesce(t, '') as json_type, cast(row_number() over (partition by feed, k, t order by a) as int) as island, first_file, last_file, cast(n as int) as n_files,
      pv is not null and not coalesce(lag(b) over w = a - 1, false) as begins, nx is not null and not coalesce(lead(a) over w = b + 1, false) as ends from sp window w as (partition by feed, k order by a)"""

_PLACES = "(select record_id, image_id, gps_latitude lat, gps_longitude lon from validation_records where gps_latitude between -90 and 90 and gps_longitude between -180 and 180 and not (gps_latitude = 0 and gps_longitude = 0))"

SQL = {
    "p7_found": _EXPORT_SQL + _CHANGES_SQL,
    "p7_lifespans": _EXPORT_SQL + _SPANS_SQL,
    "p1_found": f"""
        select distinct 'near' as relation, a.record_id as left_id, b.record_id as right_id from {_PLACES} a join {_PLACES} b on a.record_id < b.record_id and a.image_id <> b.image_id and abs(a.lat - b.lat) < 0.0002
        where 2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) <= 12
        union all
        select distinct 'inside', p.record_id, c.cell_key from {_PLACES} p join luhk_cells c on p.lat >= c.cell_min_lat and p.lat < c.cell_max_lat
          and case when c.cell_min_lon <= c.cell_max_lon then p.lon >= c.cell_min_lon and p.lon < c.cell_max_lon else p.lon >= c.cell_min_lon or p.lon < c.cell_max_lon end""",
    "p6_found": " union all ".join(
        [
            _odd_sql("pixel_samples", "row_id", "image_id", PIXEL_ORDER, "temperature_c", 0.2, 8, "v < -273.15"),
            "select * from ("
            + _odd_sql("subzero_qa", "qa_id", "flight_id", CAPTURE_ORDER, "minimum_temperature_c", 0.2, 6, "v < -273.15")
            + " union "
            + _odd_sql("subzero_qa", "qa_id", "flight_id", CAPTURE_ORDER, "below_0_pixel_count", 5, 1_000_000_000, "v < 0 or v > o", "valid_temperature_pixel_count")
            + ")",
        ]
    ),
    "p6_capture_cases": _capture_cases_sql(),
    "p6_flight_tails": f"select source as flight_id, image_id, thermal_row, thermal_col, season as hour, round(res, 3) as residual, round(cutoff, 3) as tail_cutoff from ({_tail_sql(_FLIGHT_PX, 'image_id, thermal_row, thermal_col', 0.2)})",
    "p3_found": """
        with g as (select group_name, count(*) n, coalesce(sum(full_eligible_pixel_count), 0) t from sample_coverage group by 1),
        w as (select sum(n) n, sum(t) t from g)
        select group_name from g, w where group_name is not null and (g.n >= 0.03 * w.n or (g.t >= 0.03 * w.t and w.t > 0))""",
    "p3_group_profile": """
        select group_name, count(*) as n_rows, cast(coalesce(sum(full_eligible_pixel_count), 0) as bigint) as total, count(full_eligible_pixel_count) as n_values,
          quantile_cont(cast(full_eligible_pixel_count as double), 0.05) as q05, quantile_cont(cast(full_eligible_pixel_count as double), 0.25) as q25,
          quantile_cont(cast(full_eligible_pixel_count as double), 0.5) as median, quantile_cont(cast(full_eligible_pixel_count as double), 0.75) as q75,
          quantile_cont(cast(full_eligible_pixel_count as double), 0.95) as q95
        from sample_coverage group by group_name""",
}
