"""Mixed timestamp texts and zones to one UTC instant.

Every text is parsed under each format that can read it. Where several can (all-digit dates with slashes),
expectation-maximisation over a mixture of formats per source decides: each text contributes its likelihood
under every valid parse, the mixture weights are re-estimated from the posteriors, and the posterior picks
the reading or leaves the text open. The texts enter as counts per (source, set of valid parses), so a
source's share of the rows does not matter. Zone arithmetic stays in the JVM.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from calorgrid.runtime import broadcast_if_small, scratch, small_methods, spread

OFFSET = r"(Z|UTC|GMT|[+-]\d{1,2}:?\d{2}|[+-]\d{1,2})?"
CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?\s*(AM|PM|A\.M\.|P\.M\.)?\s*" + OFFSET
ISO = r"(?i)^(\d{4})[-:/.](\d{1,2})[-:/.](\d{1,2})(?:[T ]\s*" + CLOCK + ")?$"
COMPACT = r"(?i)^(\d{4})(\d{2})(\d{2})(?:[T_ -]?(\d{2})(\d{2})(\d{2})?(?:[.,](\d+))?\s*()" + OFFSET + ")?$"
SLASH = r"(?i)^(\d{1,2})/(\d{1,2})/(\d{4})(?:[ ,T]+" + CLOCK + ")?$"
DAY_MONTH = r"(?i)^(\d{1,2})[- ./]+([A-Z]{3,9})[- .,/]+(\d{4})(?:[ ,T]+" + CLOCK + ")?$"
MONTH_DAY = r"(?i)^([A-Z]{3,9})[- .]+(\d{1,2})[ ,]+(\d{4})(?:[ ,T]+" + CLOCK + ")?$"
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
MISSING_ZONES = ["", "unknown", "not_available"]
FORMATS = ["iso", "compact", "epoch", "named", "dmy", "mdy"]
SECOND, MINUTE, DAY = 1_000_000, 60_000_000, 86_400_000_000


def _int(c: Column) -> Column:
    return F.when(c != "", c).try_cast("int")


def _month(name: Column) -> Column:
    names = {n: k for k, month in enumerate(MONTHS, 1) for n in (month, month[:3])} | {"sept": 9}
    return F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[F.lower(name)]


def _wall(y: Column, mo: Column, d: Column, clock_us: Column) -> Column:
    """Microseconds of a wall time, null if there is no such date or clock."""
    first = F.when(y.between(1, 9999) & mo.between(1, 12), F.make_date(y, mo, F.lit(1)))
    return F.when((d >= 1) & (d <= F.day(F.last_day(first))), (F.unix_date(first).cast("long") + d - 1) * DAY + clock_us)


def _offset(text: Column) -> Column:
    """Seconds of ``Z``, ``UTC``, ``GMT``, ``+8``, ``+08:00``, ``+0800``; null otherwise."""
    sign = F.when(F.regexp_extract(text, r"^([+-])", 1) == "-", -1).otherwise(1)
    hh = _int(F.regexp_extract(text, r"^[+-](\d{1,2})(?::?\d{2})?$", 1))
    mm = F.coalesce(_int(F.regexp_extract(text, r"^[+-]\d{1,2}:?(\d{2})$", 1)), F.lit(0))
    plain = F.upper(text).isin("Z", "UTC", "GMT")
    return F.when(plain, F.lit(0)).when((hh <= 18) & (mm < 60), sign * (hh * 3600 + mm * 60))


def with_parses(df: DataFrame, text: str, to: str) -> DataFrame:
    """Adds all readings of a text: ``{to}_kind, _one`` (wall time or instant, us)``, _dmy, _mdy, _unit, _off, _bad``.

    Intermediate results are arrays, not structs, so that the optimiser does not inline (and repeat) the regular expressions.
    """
    t = F.regexp_replace(F.col(text), r"^[\s\u00a0]+|[\s\u00a0]+$", "")

    def groups(kind: str, rx: str, y: int, mo: int, d: int) -> Column:
        return F.regexp_replace(t, rx, "|".join([kind, *[f"${k}" for k in (y, mo, d, 4, 5, 6, 7, 8, 9)]]))

    g = (
        F.when(t.rlike(r"^(\d{10}|\d{13})$"), F.concat(F.lit("epoch|"), t, F.lit("||||||||")))
        .when(t.rlike(SLASH), groups("slash", SLASH, 3, 2, 1))
        .when(t.rlike(ISO), groups("iso", ISO, 1, 2, 3))
        .when(t.rlike(COMPACT), groups("compact", COMPACT, 1, 2, 3))
        .when(t.rlike(DAY_MONTH), groups("named", DAY_MONTH, 3, 2, 1))
        .when(t.rlike(MONTH_DAY), groups("named", MONTH_DAY, 3, 1, 2))
    )
    df = df.withColumn("__g", F.split(g, r"\|"))
    at = lambda k: F.col("__g")[k]
    named = at(0) == "named"
    frac, half = at(7), at(8)
    df = df.withColumn("__i", F.array(_int(F.when(at(0) != "epoch", at(1))), F.when(named, _month(at(2))).otherwise(_int(at(2))), _int(at(3)), F.when(at(4) == "", 0).otherwise(_int(at(4))), F.when(at(5) == "", 0).otherwise(_int(at(5))), F.when(at(6) == "", 0).otherwise(_int(at(6)))))
    i = lambda k: F.col("__i")[k]
    h = F.when(half == "", F.when(i(3).between(0, 23), i(3))).when(i(3).between(1, 12), i(3) % 12 + F.when(F.lower(F.substring(half, 1, 1)) == "p", 12).otherwise(0))
    us = F.when(frac == "", F.lit(0)).otherwise(F.rpad(F.substring(frac, 1, 6), 6, "0").try_cast("int")).cast("long")
    clock = F.when(i(4).between(0, 59) & i(5).between(0, 59), h.cast("long") * 60 * MINUTE + i(4).cast("long") * MINUTE + i(5).cast("long") * SECOND + us)
    df = df.withColumn("__c", F.array(clock, _offset(at(9)).cast("long")))
    clock = F.col("__c")[0]
    epoch = at(0) == "epoch"
    one = F.when(epoch, at(1).try_cast("long") * F.when(F.length(at(1)) == 10, SECOND).otherwise(1000)).when(at(0) != "slash", _wall(i(0), i(1), i(2), clock))
    unit = F.when(epoch, 1000).when(at(4) == "", DAY).when(at(6) == "", MINUTE).when(frac == "", SECOND).otherwise(F.pow(F.lit(10), F.greatest(F.lit(0), 6 - F.length(frac)))).cast("long")
    slash = at(0) == "slash"
    return df.withColumns(
        {f"{to}_kind": at(0), f"{to}_one": one, f"{to}_dmy": F.when(slash, _wall(i(0), i(1), i(2), clock)), f"{to}_mdy": F.when(slash, _wall(i(0), i(2), i(1), clock)), f"{to}_unit": unit, f"{to}_off": F.col("__c")[1], f"{to}_bad": (at(9) != "") & F.col("__c")[1].isNull()}
    ).drop("__g", "__i", "__c")


def _mixture(tolerance: float, rounds: int):
    """EM of one source over its counts per signature; a signature lists the likelihood of each format."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        like = np.array(pdf["likes"].tolist(), dtype=float)
        n = pdf["n"].to_numpy(dtype=float)
        weights = np.full(len(FORMATS), 1 / len(FORMATS))
        for _ in range(rounds):
            joint = like * weights
            whole = joint.sum(axis=1, keepdims=True)
            post = np.divide(joint, whole, out=np.zeros_like(joint), where=whole > 0)
            new = (post * n[:, None]).sum(axis=0) / max(n.sum(), 1)
            if np.abs(new - weights).max() < tolerance:
                weights = new
                break
            weights = new
        joint = like * weights
        whole = joint.sum(axis=1, keepdims=True)
        post = np.divide(joint, whole, out=np.zeros_like(joint), where=whole > 0)
        best = post.argmax(axis=1)
        slashed = max(weights[4] + weights[5], 1e-300)
        return pd.DataFrame({"source": pdf["source"], "sig": pdf["sig"], "pick": [FORMATS[b] for b in best], "posterior": post.max(axis=1), "order_weight": [weights[b] / slashed if b > 3 else 1.0 for b in best]})

    return fit


def _signature(side: str, other: str | None) -> Column:
    """Likelihood of each format: 0 where it cannot read the text, less where the other field shows another day."""
    seen = F.when(F.col(f"{other}_kind") != "epoch", F.col(f"{other}_one")) if other else F.lit(None).cast("long")

    def like(wall: Column) -> Column:
        return F.when(wall.isNull(), 0.0).when(seen.isNull(), 1.0).when(F.abs(wall - seen) <= DAY, 0.95).otherwise(0.05)

    kind, one = F.col(f"{side}_kind"), F.col(f"{side}_one")
    single = lambda k: F.when((kind == k) & one.isNotNull(), 1.0).otherwise(0.0)
    return F.array(single("iso"), single("compact"), single("epoch"), single("named"), like(F.col(f"{side}_dmy")), like(F.col(f"{side}_mdy")))


def zone_table(spark: SparkSession) -> DataFrame:
    """Lower-case name to zone id for all ids that the JVM knows (about 600 rows)."""
    ids = sorted(str(x) for x in spark.sparkContext._jvm.java.time.ZoneId.getAvailableZoneIds())
    return spark.createDataFrame([(x.lower(), x) for x in ids], "__zl string, __zone string").dropDuplicates(["__zl"])


def zone_offset(name: Column) -> Column:
    """Seconds of a zone given as an offset (``+08:00``, ``UTC+8``, ``GMT+05:30``, ``Z``); null for other names."""
    n = F.upper(F.regexp_replace(name, r"\s", ""))
    return F.coalesce(_offset(n), _offset(F.regexp_extract(n, r"^(?:UTC|GMT)([+-].*)$", 1)))


def _shift(instant: Column, zone: Column) -> Column:
    """Offset of a zone at an instant, in microseconds; independent of the session's zone."""
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(instant), zone)) - instant


def normalise(df: DataFrame, *, row_id: str, text: str, fallback: str, zone: str, assumption: str, source: str, defaults: dict[str, str], sure: float = 0.99) -> DataFrame:
    """``row_id, utc_micros, status, reading`` for every row.

    ``text`` counts if it is a valid time, else ``fallback``. An offset or UTC mark in the text decides;
    10 or 13 digits are seconds or milliseconds since 1970 UTC; other texts are wall times in ``zone``
    (any letter case, padded, or an offset), a missing zone being replaced by ``defaults[assumption]``.
    A wall time without zone, or one that occurs twice, takes the offset of ``fallback`` if that shows the
    same wall time to the coarser precision. Status: ``ok``, ``invalid`` (no valid time; null and empty
    texts too), ``ambiguous_format``, ``ambiguous_time``, ``nonexistent_time``, ``no_zone``; ``utc_micros``
    is null unless ``ok``. Digits beyond the microsecond are cut, missing units are 0. A null source is a
    source of its own. Rows are kept as they are (repeated rows come out repeatedly); empty input, empty output.
    """
    spark = df.sparkSession
    rows = df.select(F.col(row_id).alias("__id"), F.col(source).cast("string").alias("source"), F.col(text).cast("string").alias("__t"), F.col(fallback).cast("string").alias("__l"), F.col(zone).alias("__z"), F.lower(F.trim(F.col(assumption))).alias("__a"))
    rows = with_parses(with_parses(spread(rows, "__id", per_core=1), "__t", "p"), "__l", "l").drop("__t", "__l")
    rows = rows.withColumn("likes", _signature("p", "l")).withColumn("llikes", _signature("l", None))
    rows = rows.withColumn("sig", F.concat_ws(",", F.col("likes").cast("array<string>"))).withColumn("lsig", F.concat_ws(",", F.col("llikes").cast("array<string>")))
    with small_methods(spark):
        rows = scratch(rows)
    evidence = rows.select("source", F.explode(F.array(F.struct("sig", "likes"), F.struct(F.col("lsig").alias("sig"), F.col("llikes").alias("likes")))).alias("e")).select("source", "e.*")
    counts = evidence.groupBy("source", "sig").agg(F.first("likes").alias("likes"), F.count("*").alias("n"))
    picks = scratch(counts.groupBy("source").applyInPandas(_mixture(1e-10, 2000), "source string, sig string, pick string, posterior double, order_weight double"))
    n_picks = picks.count()
    for side, sig in (("p", "sig"), ("l", "lsig")):
        names = [f"__{side}source", f"__{side}sig", f"{side}pick", f"{side}post", f"{side}weight"]
        small = broadcast_if_small(picks.toDF(*names), n_picks)
        rows = rows.join(small, rows["source"].eqNullSafe(small[names[0]]) & (rows[sig] == small[names[1]]), "left").drop(*names[:2])
    def settled(side: str) -> tuple[Column, Column]:
        slash, pick = F.col(f"{side}_kind") == "slash", F.col(f"{side}pick")
        certain = F.coalesce((F.col(f"{side}post") >= sure) & (F.col(f"{side}weight") >= 0.05), F.lit(False))
        read = F.when(slash, F.when(pick == "dmy", F.col(f"{side}_dmy")).when(pick == "mdy", F.col(f"{side}_mdy"))).otherwise(F.col(f"{side}_one"))
        valid = F.when(~F.coalesce(F.col(f"{side}_bad"), F.lit(False)), read)
        return F.when(~slash | certain, valid), F.coalesce(slash & valid.isNotNull() & ~certain, F.lit(False))

    pw, popen = settled("p")
    lw, lopen = settled("l")
    rows = rows.withColumns({"pw": pw, "popen": popen, "lw": lw, "lopen": lopen})
    main = F.col("pw").isNotNull()
    take = lambda c: F.when(main, F.col(f"p_{c}")).otherwise(F.col(f"l_{c}"))
    missing = F.coalesce(F.lower(F.trim(F.col("__z"))).isin(*MISSING_ZONES), F.lit(True))
    default = F.lit(None).cast("string")
    for k, v in defaults.items():
        default = F.when(F.col("__a") == k, F.lit(v)).otherwise(default)
    rows = rows.withColumn("zname", F.when(missing, default).otherwise(F.regexp_replace("__z", r"^\s+|\s+$", ""))).withColumn("wall", F.coalesce("pw", "lw")).withColumn("kind", take("kind")).withColumn("off", take("off"))
    zones = F.broadcast(zone_table(spark))  # a fixed list
    rows = rows.withColumn("zoff", zone_offset(F.col("zname")).cast("long")).join(zones, F.lower("zname") == F.col("__zl"), "left")
    z, w = F.coalesce("__zone", F.lit("UTC")), F.coalesce("wall", F.lit(0).cast("long"))
    # the offsets well before and well after the wall time; where they differ, each must hold at the instant it gives
    rows = rows.withColumn("__o", F.array(_shift(w - 16 * 60 * MINUTE, z), _shift(w + 14 * 60 * MINUTE, z)))
    rows = rows.withColumn("ca", w - F.col("__o")[0]).withColumn("cb", w - F.col("__o")[1])
    rows = rows.withColumn("va", _shift(F.col("ca"), z) == w - F.col("ca")).withColumn("vb", _shift(F.col("cb"), z) == w - F.col("cb"))
    coarse = F.greatest("p_unit", "l_unit")
    same = main & F.col("lw").isNotNull() & F.col("l_off").isNotNull() & (F.floor(F.col("pw") / coarse) == F.floor(F.col("lw") / coarse))
    by_local = F.when(same, F.col("pw") - F.col("l_off") * SECOND)
    named = F.col("__zone").isNotNull()
    twice = named & F.col("va") & F.col("vb") & (F.col("ca") != F.col("cb"))
    utc = (
        F.when(F.col("popen") | F.col("wall").isNull(), None)
        .when(F.col("kind") == "epoch", F.col("wall"))
        .when(F.col("off").isNotNull(), F.col("wall") - F.col("off") * SECOND)
        .when(F.col("zoff").isNotNull(), F.col("wall") - F.col("zoff") * SECOND)
        .when(twice | ~named, by_local)
        .when(F.col("va"), F.col("ca"))
        .when(F.col("vb"), F.col("cb"))
    )
    status = (
        F.when(F.col("utc_micros").isNotNull(), "ok")
        .when(F.col("popen") | (F.col("wall").isNull() & F.col("lopen")), "ambiguous_format")
        .when(F.col("wall").isNull(), "invalid")
        .when(twice, "ambiguous_time")
        .when(named, "nonexistent_time")
        .otherwise("no_zone")
    )
    reading = F.when(F.col("kind") == "slash", F.col("ppick")).otherwise(F.col("kind"))
    out = rows.withColumn("utc_micros", utc).select(F.col("__id").alias(row_id), "utc_micros", status.alias("status"), reading.alias("reading"))
    with small_methods(spark):
        return scratch(out)
