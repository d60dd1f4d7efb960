"""Text parsing as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

CAPTURE_NAME = r"(?i)DJI_(\d{14})_(\d+)(?:_([VT]))?"
NUMBER = r"[-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?"


def capture_name(path: Column) -> dict[str, Column]:
    """Identifier, time stamp, sample number and role (V or T) out of a capture's file name; null where absent."""
    part = lambda k: F.nullif(F.regexp_extract(path, CAPTURE_NAME, k), F.lit(""))
    return {"image": F.when(part(1).isNotNull(), F.concat(F.lit("DJI_"), part(1), F.lit("_"), part(2))), "stamp": part(1), "sample": part(2).cast("long"), "role": F.upper(part(3))}


def number_in_text(text: Column, comma: str = "thousands") -> Column:
    """The first number of a text. ``comma``: "thousands" drops commas, "decimal" reads them as points; "below sea" turns the sign."""
    t = F.regexp_replace(text, "−", "-")
    t = F.regexp_replace(t, ",", "" if comma == "thousands" else ".")
    n = F.regexp_extract(t, NUMBER, 0).try_cast("double")
    return F.when(F.lower(text).contains("below sea"), -F.abs(n)).otherwise(n)


def coordinate(text: Column, ref: Column) -> Column:
    """Decimal degrees of ``22 deg 18' 30.5" N`` or ``22.3`` with a hemisphere in the text or in ``ref``."""
    numbers = F.regexp_extract_all(text, F.lit(r"\d+(?:\.\d+)?"), F.lit(0))
    at = lambda k: F.coalesce(F.get(numbers, k).try_cast("double"), F.lit(0.0))
    size = F.when(F.size(numbers) == 0, None).otherwise(at(0) + at(1) / 60 + at(2) / 3600)
    side = F.upper(F.coalesce(F.nullif(F.regexp_extract(text, r"([NSEWnsew])\s*$", 1), F.lit("")), F.substring(F.trim(ref), 1, 1), F.lit("")))
    return F.when(side.isin("S", "W") | F.trim(text).startswith("-"), -size).otherwise(size)


def plain_tag(name: Column) -> Column:
    """A metadata tag without group prefix, lower case letters and digits only."""
    return F.regexp_replace(F.lower(F.regexp_extract(name, r"([^:]*)$", 1)), "[^a-z0-9]", "")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def normal_path(path: Column) -> Column:
    return F.lower(F.replace(path, F.lit("\\"), F.lit("/")))


def readable_group(name: Column) -> Column:
    """A group's name without its ``column=value`` parts, underscores as blanks."""
    parts = F.filter(F.split(name, r" \| "), lambda p: ~p.rlike(r"^[a-z_]+=(?!\d$)"))
    return F.replace(F.array_join(parts, ", "), F.lit("_"), F.lit(" "))


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, line_no, line``: trimmed lines of a text, blank ones left out."""
    rows = df.select(key, F.posexplode(F.split(text, r"\r?\n")).alias("line_no", "line"))
    return rows.select(key, "line_no", F.regexp_replace("line", r"^[ \t]+|[ \t]+$", "").alias("line")).where("line != ''")


def value_after_label(line_table: DataFrame, key: str, fields: dict[str, Sequence[str]]) -> DataFrame:
    """``key, field, value``: what follows a field's label on its line, or the next line where the label stands alone.

    ``fields`` maps a field to its labels in any language, tried in order; case, and colons of either width
    around a label, do not matter. The first hit per key and field counts; a label alone on the last line
    gives null. Lines of one text are ordered in one task: texts are bounded.
    """
    nxt = F.lead("line").over(W.partitionBy(key).orderBy("line_no"))
    rows = line_table.withColumn("__next", nxt).withColumn("__low", F.lower(F.regexp_replace("line", r"^[\s:：]+|[\s:：]+$", "")))
    hits = []
    for field, labels in fields.items():
        alone = F.col("__low").isin([x.lower() for x in labels])
        value, prefix = F.lit(None).cast("string"), F.lit(False)
        for label in reversed(labels):
            rest = F.regexp_replace(F.substring(F.col("line"), len(label) + 1, 1 << 20), r"^[\s:：]+|[\s:：]+$", "")
            starts = F.col("__low").startswith(label.lower()) & (rest != "")
            value, prefix = F.when(starts, rest).otherwise(value), starts | prefix
        hits.append(F.when(alone | prefix, F.struct(F.lit(field).alias("field"), F.when(alone, F.col("__next")).otherwise(value).alias("value"))))
    found = rows.select(key, "line_no", F.explode(F.array_compact(F.array(*hits))).alias("h")).select(key, "line_no", "h.*")
    return found.groupBy(key, "field").agg(F.min_by("value", "line_no").alias("value"))


def report_entries(line_table: DataFrame, key: str) -> DataFrame:
    """Lines with the number of the entry they belong to: an entry starts at a line with a thermal file name that does not repeat the one right before."""
    w = W.partitionBy(key).orderBy("line_no")
    name = F.upper(F.nullif(F.coalesce(F.regexp_extract("line", FILE_NAME, 1), F.lit("")), F.lit("")))
    rows = line_table.withColumn("__name", name)
    starts = F.col("__name").isNotNull() & ~F.col("__name").eqNullSafe(F.lag("__name").over(w))
    return rows.withColumn("entry", F.sum(starts.cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))).withColumnRenamed("__name", "entry_name")


#: A thermal file name anywhere in a line (fixed value).
FILE_NAME = r"(?i)\b(DJI_[A-Z0-9_]+_T\.JPE?G)\b"
#: Labels of a report's parameters (fixed values).
REPORT_LABELS = {
    "distance_m": ("距离", "Distance", "Object Distance"),
    "humidity_percent": ("空气湿度", "相对湿度", "Humidity", "Relative Humidity"),
    "emissivity": ("发射率", "Emissivity"),
    "reflected_temperature_c": ("反射温度", "Reflected Temperature", "Reflected Apparent Temperature"),
    "ambient_temperature_c": ("环境温度", "Ambient Temperature", "Ambient Temp", "Atmospheric Temperature"),
    "camera_model": ("设备型号", "Camera Model", "Model"),
    "serial_number": ("序列号", "Serial Number"),
    "focal_length": ("焦距", "Focal Length"),
    "aperture": ("光圈", "Aperture"),
    "image_width": ("宽度", "Width"),
    "image_height": ("高度", "Height"),
    "created_time": ("创建时间", "Created Time", "Create Time"),
    "modified_time": ("修改时间", "Modified Time", "Modify Time"),
    "gps": ("经纬度", "GPS", "Latitude/Longitude"),
}
#: Lines of an entry that are kept as its raw text, and the mark of humidities, which are not used (fixed values).
RAW_LINES, HUMIDITY_STATUS = 34, "not_used_unreliable_tat3_export"


def report_records(line_table: DataFrame, key: str) -> DataFrame:
    """One row per report entry with its parameters, numbers read with either decimal mark; absent texts are ``''``, absent numbers null.

    ``line_table`` has ``key, line_no, line``, blank lines left out (:func:`lines`).
    """
    entries = report_entries(line_table, key).where("entry > 0").withColumn("__e", F.struct(F.col(key).alias("k"), F.col("entry").alias("n")))
    when = F.replace(F.regexp_extract("line", r"\b\d{4}[/-]\d{2}[/-]\d{2}\s+\d{2}:\d{2}:\d{2}\b", 0), F.lit("/"), F.lit("-"))
    heads = entries.withColumn("__at", F.when(when != "", when)).groupBy("__e").agg(
        F.min_by("entry_name", F.when(F.col("entry_name").isNotNull(), F.col("line_no"))).alias("image_name"),
        F.min_by("__at", F.when(F.col("__at").isNotNull(), F.col("line_no"))).alias("report_capture_datetime"),
        F.array_join(F.transform(F.slice(F.sort_array(F.collect_list(F.struct("line_no", "line"))), 1, RAW_LINES), lambda x: x["line"]), "\n").alias("raw_parameter_text"),
    )
    values = value_after_label(entries.select("__e", "line_no", "line"), "__e", REPORT_LABELS)
    wide = values.groupBy("__e").agg(*[F.max(F.when(F.col("field") == x, F.col("value"))).alias(x) for x in REPORT_LABELS])
    number = lambda c: F.regexp_extract(F.replace(c, F.lit(","), F.lit(".")), r"[-+]?\d+(?:\.\d+)?", 0).try_cast("double")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    places = F.regexp_extract_all(F.coalesce("gps", F.lit("")), F.lit(r"[-+]?\d+(?:[.,]\d+)?"), F.lit(0))
    place = lambda k: F.when(F.size(places) >= 2, number(F.get(places, k)))
    out = heads.join(wide, "__e", "left")
    ambient = number(F.col("ambient_temperature_c"))
    return out.select(
        F.col("__e.k").alias(key), F.col("__e.n").alias("report_entry_index"), "image_name", F.regexp_replace("image_name", r"_T\.JPE?G$", "").alias("image_id"),
        F.when(ambient.isNotNull(), "ok").otherwise("missing").alias("ambient_parse_status"), ambient.alias("ambient_temperature_c"),
        *[number(F.col(c)).alias(c) for c in ("reflected_temperature_c", "distance_m", "emissivity", "humidity_percent")],
        F.lit(HUMIDITY_STATUS).alias("humidity_use_status"), text("report_capture_datetime").alias("report_capture_datetime"), text("created_time").alias("created_time"), text("modified_time").alias("modified_time"),
        place(0).alias("gps_latitude_report"), place(1).alias("gps_longitude_report"),
        *[text(c).alias(f"{c}_report") for c in ("camera_model", "serial_number", "focal_length", "aperture")],
        *[number(F.col(c)).cast("int").alias(f"{c}_report") for c in ("image_width", "image_height")],
        "raw_parameter_text",
    )


def _assigned(line: Column, names: str) -> tuple[Column, Column]:
    """Number and unit letter of the first ``name = number`` of a line, null where absent."""
    rx = rf"(?i)\b(?:{names})\s*=\s*(-?\d+(?:\.\d+)?)\s*(?:°?\s*([CFK])(?![A-Za-z]))?"
    return F.regexp_extract(line, rx, 1).try_cast("double"), F.upper(F.regexp_extract(line, rx, 2))


def measurements(line_table: DataFrame, key: str) -> DataFrame:
    """``key, measurement_id, kind, name, x, y, region_type, geometry, statistic, value, status`` of the point and region lines of reports.

    Free text may stand between the parts. A point has a temperature (``temperature``, ``temp`` or ``value``)
    and perhaps ``x`` and ``y``; a region gives a row each for ``min``, ``max`` and ``mean`` and perhaps a
    geometry. ``status`` is ``ok``, ``not_celsius`` (unit F or K, or named so) or ``duplicate`` (the id occurs
    more than once in its report); :func:`valid_measurements` makes the latter two errors.
    """
    line = F.col("line")
    name = lambda kind: F.nullif(F.regexp_extract(line, rf"(?i)\b{kind}\s+([A-Za-z0-9_.-]+)", 1), F.lit(""))
    value, unit = _assigned(line, "temperature|temp|value")
    x = F.regexp_extract(line, r"(?i)\bx\s*=\s*(-?\d+(?:\.\d+)?)[,; ]+y\s*=\s*(-?\d+(?:\.\d+)?)", 1).try_cast("double")
    y = F.regexp_extract(line, r"(?i)\bx\s*=\s*(-?\d+(?:\.\d+)?)[,; ]+y\s*=\s*(-?\d+(?:\.\d+)?)", 2).try_cast("double")
    low, high, (mean, mean_unit) = _assigned(line, "min")[0], _assigned(line, "max")[0], _assigned(line, "mean")
    geometry = F.trim(F.regexp_extract(line, r"(?i)(?:geometry|polygon|rectangle|ellipse)\s*=\s*(.+?)(?:;\s*(?:min|max|mean)\s*=|$)", 1))
    shape = F.when(F.lower(line).contains("polygon"), "polygon").otherwise("region")
    named = line.rlike("(?i)fahrenheit|kelvin")
    none = F.lit(None).cast("double")

    def row(kind, label, at, stat, v, u, area, form):
        ident = F.concat(label, F.lit(":"), F.lit(stat)) if kind == "region" else label
        return F.struct(
            ident.alias("measurement_id"), F.lit(kind).alias("kind"), label.alias("name"), at[0].alias("x"), at[1].alias("y"), form.alias("region_type"), area.alias("geometry"),
            F.lit(stat).alias("statistic"), v.alias("value"), (~u.isin("", "C") | named).alias("foreign"),
        )

    point = F.array(row("point", name("point"), (x, y), "point_value", value, unit, F.lit(""), F.lit("")))
    region = F.array(*[row("region", name("region"), (none, none), s, v, mean_unit, geometry, shape) for s, v in (("min", low), ("max", high), ("mean", mean))])
    whole = name("region").isNotNull() & low.isNotNull() & high.isNotNull() & mean.isNotNull()
    rows = line_table.select(key, F.explode(F.when(name("point").isNotNull() & value.isNotNull(), point).when(whole, region)).alias("m")).select(key, "m.*")
    n = F.count("*").over(W.partitionBy(key, "measurement_id"))  # the lines of a report
    status = F.when(F.col("foreign"), "not_celsius").when(n > 1, "duplicate").otherwise("ok")
    return rows.withColumn("status", status).drop("foreign")


def valid_measurements(line_table: DataFrame, key: str) -> DataFrame:
    """:func:`measurements`, read once more: a measurement that is not in Celsius or whose id repeats is an error."""
    m = measurements(line_table, key)
    bad = F.when(F.col("status") != "ok", F.raise_error(F.concat(F.col(key).cast("string"), F.lit(": "), F.col("measurement_id"), F.lit(" "), F.col("status"))))
    return m.where(bad.isNull()).drop("status")


def number_list(text: str, most: int) -> list[int]:
    """Numbers of ``1,3-5``: sorted, distinct, within 1..most; anything else is an error."""
    out: set[int] = set()
    for part in filter(None, (p.strip() for p in text.split(","))):
        a, _, b = part.partition("-")
        first, last = int(a), int(b or a)
        if not 1 <= first <= last <= most:
            raise ValueError(f"{part!r} is not within 1..{most}")
        out.update(range(first, last + 1))
    return sorted(out)
