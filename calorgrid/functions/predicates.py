"""Scalar predicates, normalisers and first-match ladders as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Surface-cover ids and names; 0 and 9 are no valid cover (fixed values).
COVERS = {1: "roof", 2: "concrete_pavement", 3: "asphalt_road", 4: "grass_low_vegetation", 5: "vegetation_tree", 6: "bare_soil", 7: "water", 8: "vehicle_temporary_object"}
NO_COVER = "unknown_or_unlabelled"
#: Texts that mean a missing metadata value (fixed values).
MISSING = ["", "unknown", "none", "nan", "null", "not_available", "n/a"]
TRUE_TEXTS = ["1", "true", "yes", "y"]


def finite(c: Column) -> Column:
    d = c.cast("double")
    return F.coalesce(d.isNotNull() & ~F.isnan(d) & (F.abs(d) < float("inf")), F.lit(False))


def delta_t(temperature: Column, ambient: Column) -> Column:
    """Single-precision difference; null unless both are finite."""
    return F.when(finite(temperature) & finite(ambient), (temperature - ambient).cast("float"))


def formal_population(eligible: Column, target: Column, delta: Column) -> Column:
    return F.coalesce(eligible & target, F.lit(False)) & finite(delta)


def truthy(text: Column, also: tuple[str, ...] = ("ok",)) -> Column:
    """Whether a text reads as true; ``also`` lists the words that only some sources use."""
    return F.coalesce(F.lower(F.trim(text.cast("string"))).isin(*TRUE_TEXTS, *also), F.lit(False))


def missing_metadata(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)).isin(MISSING), F.lit(True))


def open_space(code: Column, name: Column) -> Column:
    """Institutional or open-space land use by code or by name, literally."""
    n = F.lower(F.coalesce(name, F.lit("")))
    return F.lower(F.coalesce(code.cast("string"), F.lit(""))).isin("31", "gic_open_space") | n.contains("gic") | n.contains("open space")


def cover_name(label: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in COVERS.items() for x in pair])
    return F.coalesce(names[label.cast("int")], F.lit(NO_COVER))


def exclusion_reason(is_finite: Column, in_target: Column, known: Column, accepted: Column, qa_failed: Column) -> Column:
    """Why a pixel is left out, the last rule that applies; ``''`` if it is not."""
    return (
        F.when(known & in_target & is_finite & qa_failed, "temperature_qa_failed")
        .when(known & in_target & is_finite & ~accepted, "annotation_not_accepted")
        .when(~known, "label_unknown")
        .when(~in_target, "outside_target_selection")
        .when(~is_finite, "non_finite_temperature")
        .otherwise("")
    )


def shadow_flag(text: Column) -> Column:
    """0/1 of a shadow text: blank is 0, words are mapped, other integers kept, the rest null."""
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return F.when(t.isin("", "no", "none", "false", "not_shadow", "sunlit"), 0).when(t.isin("yes", "true", "shadow", "shaded"), 1).otherwise(t.try_cast("double").cast("int"))


def filled(first: Column, second: Column) -> Column:
    """The first text that is not blank."""
    blank = lambda c: F.when(F.trim(c) != "", c)
    return F.coalesce(blank(first), blank(second), F.lit(""))


def first_available(*candidates: Column) -> Column:
    """The first candidate that is neither null nor blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(c.cast("string")), F.lit("")) for c in candidates])


def segment_class(r: Column, g: Column, b: Column, hue: Column, saturation: Column, value: Column, area: Column) -> Column:
    """Suggested surface cover of an image segment from its mean colours; the first rule that fits."""
    excess = g - F.greatest(r, b)
    green = (saturation > 0.18) & (excess > 0.06)
    return (
        F.when(value < 0.18, "unclear_ignore")
        .when(green & ((value < 0.5) | (area > 0.01)), "vegetation_tree")
        .when(green, "grass_low_vegetation")
        .when(hue.between(0.48, 0.66) & (saturation > 0.25) & (value > 0.2), "water")
        .when((saturation < 0.12) & (value > 0.58), "concrete_pavement")
        .when((saturation < 0.16) & value.between(0.2, 0.46), "asphalt_road")
        .otherwise("unclear_ignore")
    )


def spatial_pattern(count: Column, components: Column, largest: Column, edge_share: Column) -> Column:
    """How the cold pixels of a capture lie."""
    return (
        F.when(count == 0, "none")
        .when(edge_share >= 0.75, "edge_concentrated")
        .when((components > 0) & (largest / count >= 0.5), "clustered")
        .when(components >= F.greatest(F.lit(10), F.floor(count / 3)), "mostly_isolated_or_speckled")
        .otherwise("mixed")
    )


def density_status(n: Column, distinct: Column, sd: Column, least: int = 100) -> Column:
    """Whether a density can be estimated from a sample."""
    return F.when(n < least, "insufficient_samples").when(distinct < 5, "too_few_distinct_values").when(sd < 0.02, "near_constant").otherwise("eligible")


def near(c: Column, to: float, tolerance: float) -> Column:
    return F.coalesce(F.abs(c - to) <= tolerance, F.lit(False))


def camera_class(kind: Column, focal: Column, focal_35: Column, rules: list[tuple[str, float, float]]) -> Column:
    """Camera key and confidence by focal lengths: ``rules`` are (key, focal mm, 35 mm equivalent) of visible cameras."""
    out = F.struct(F.lit("visible_unclassified").alias("key"), F.lit("needs_review").alias("confidence"))
    for key, mm, mm_35 in reversed(rules):
        hit = F.struct(F.lit(key).alias("key"), F.when(near(focal, mm, 0.5), "high").otherwise("medium").alias("confidence"))
        out = F.when(near(focal_35, mm_35, 1.0), hit).otherwise(out)
    thermal = near(focal, 12.0, 0.5) & (near(focal_35, 53.0, 1.5) | near(focal_35, 52.0, 1.5))
    warm = F.when(thermal, F.struct(F.lit("thermal").alias("key"), F.lit("high").alias("confidence"))).otherwise(F.struct(F.lit("thermal_unconfirmed").alias("key"), F.lit("needs_review").alias("confidence")))
    none = F.struct(F.lit("unknown").alias("key"), F.lit("needs_review").alias("confidence"))
    return F.when(F.lower(kind) == "thermal", warm).when(F.lower(kind) == "visible", out).otherwise(none)


def ladder_notes(*rules: tuple[Column, str]) -> Column:
    """The notes whose condition holds, in order, joined by ``; ``."""
    return F.concat_ws("; ", F.array_compact(F.array(*[F.when(cond, F.lit(note)) for cond, note in rules])))
