"""Registered queries of sampling, statistics, series and quality."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from calorgrid.functions import hashing
from calorgrid.functions.predicates import finite
from calorgrid.operators import quality as QA, ranks, temporal as T, thinning
from calorgrid.operators.selection import FINE, exact_quantiles
from calorgrid.plans.registry import Registry
from calorgrid.plans.scalars import FAMILY_SQL, GRID_SQL, STAMP_SQL, _mix_sql, family_groups, grid, px, stamp
from calorgrid.runtime import broadcast_if_small, scratch, side_by_side, table

query = Registry()
QUERIES, SQL = query.queries, query.sql

SEED, TILE, PER_IMAGE, PER_GROUP = 20260715, 8, 2500, 10_000


def cover_pixels(spark, sf):
    """Formal pixels with a valid cover, once each: ``image_id, group_name, thermal_row, thermal_col, delta_t_c``."""
    p = px(spark, sf).where(F.col("analysis_eligible") & F.col("target_mask") & F.col("surface_cover_valid") & finite(F.col("delta_t_c")) & F.col("surface_cover_class").isNotNull())
    return p.groupBy("image_id", "thermal_row", "thermal_col", F.col("surface_cover_class").alias("group_name")).agg(F.min(F.col("delta_t_c").cast("double")).alias("delta_t_c"))


_COVER_PX = "(select image_id, thermal_row, thermal_col, surface_cover_class as group_name, min(cast(delta_t_c as double)) delta_t_c from pixel_samples where analysis_eligible and target_mask and surface_cover_valid and isfinite(delta_t_c) and surface_cover_class is not null group by all)"


@query(
    "win01_tile_candidates",
    f"""with base as (select *, dense_rank() over (order by image_id, thermal_row, thermal_col) - 1 as base_id from {_COVER_PX})
    select image_id, group_name, cast(thermal_row as int) as thermal_row, cast(thermal_col as int) as thermal_col from (select *, row_number() over (partition by image_id, group_name, thermal_row // {TILE}, thermal_col // {TILE} order by z, base_id) r from ({_mix_sql('base_id', SEED)})) where r = 1""",
)
def _(spark, sf):
    c = thinning.candidates(thinning.numbered(cover_pixels(spark, sf)), [SEED], TILE)
    return c.select("image_id", "group_name", F.col("thermal_row").cast("int").alias("thermal_row"), F.col("thermal_col").cast("int").alias("thermal_col"))


def family_pixels(spark, sf, family):
    """Formal pixels of an analysis family, once per group."""
    p = family_groups(px(spark, sf)).where(F.col("family") == family)
    return scratch(p.groupBy("image_id", "thermal_row", "thermal_col", "group_name").agg(F.min(F.col("delta_t_c").cast("double")).alias("delta_t_c"), F.min("luhk_class_code").alias("luhk_class_code")))


def family_sample(spark, sf, family, seeds=(SEED,)):
    """The pixels of a family and their thinned sample with their values."""
    pixels = family_pixels(spark, sf, family)
    return pixels, thinning.thinned_sample(pixels, list(seeds), tile=TILE, per_image=PER_IMAGE, per_group=PER_GROUP)


def _sample(spark, sf, seeds=(SEED,)):
    return family_sample(spark, sf, "surface_cover", seeds)


def _families(spark, sf, families, seeds=(SEED,)):
    """The samples of several families, with the family as a column."""
    samples = side_by_side(spark, *[lambda f=f: family_sample(spark, sf, f, seeds)[1].withColumn("family", F.lit(f)) for f in families])
    out = samples[0]
    for s in samples[1:]:
        out = out.unionByName(s)
    return out


def sample_sql(family: str, seed: int = SEED) -> str:
    """A family's sample, for shares that come out after one round of largest remainders (as those of the test data do)."""
    base = f"(select image_id, thermal_row, thermal_col, group_name, min(cast(delta_t_c as double)) delta_t_c from {FAMILY_SQL} where family = '{family}' group by 1, 2, 3, 4)"
    numbered = f"(select *, dense_rank() over (order by image_id, thermal_row, thermal_col) - 1 as base_id, count(*) over (partition by image_id, group_name) as n from {base})"
    first = _mix_sql("base_id", seed).replace("from base", f"from {numbered}")
    tiles = f"(select image_id, thermal_row, thermal_col, group_name, delta_t_c, base_id, n from (select *, row_number() over (partition by image_id, group_name, thermal_row // {TILE}, thermal_col // {TILE} order by z) r from ({first})) where r = 1)"
    second = _mix_sql("base_id", seed ^ thinning.SECOND_SEED).replace("from base", f"from {tiles}")
    ranked = f"(select *, row_number() over (partition by image_id, group_name order by z) r from ({second}) qualify r <= {PER_IMAGE})"
    return f"""(with c as {ranked}, i as (select group_name, image_id, max(n) n, count(*) cap from c group by 1, 2), g as (select group_name, sum(n) n from i group by 1 having sum(cap) > {PER_GROUP}),
      h as (select i.*, i.n / g.n * {PER_GROUP} share from i join g using (group_name)), q as (select *, least(greatest(floor(share), 1), cap) k from h), d as (select *, {PER_GROUP} - sum(k) over (partition by group_name) left_over, row_number() over (partition by group_name order by k < cap desc, share - floor(share) desc, n desc, image_id desc) place from q),
      quota as (select group_name, image_id, k + case when k < cap and place <= left_over then 1 else 0 end k from d)
      select cast({seed} as int) as seed, '{family}' as family, c.group_name, c.image_id, thermal_row, thermal_col, cast(thermal_row // {TILE} as int) as tile_row, cast(thermal_col // {TILE} as int) as tile_col, delta_t_c
      from c left join quota on quota.group_name = c.group_name and quota.image_id = c.image_id where quota.k is null or c.r <= quota.k)"""


_DRAWN = "seed, group_name, image_id, thermal_row, thermal_col, tile_row, tile_col"


@query("smp02_thinned_sample", f"select {_DRAWN} from {sample_sql('surface_cover')}")
def _(spark, sf):
    return _sample(spark, sf)[1].drop("delta_t_c", "luhk_class_code")


@query("smp03_three_seeds", " union all ".join(f"select {_DRAWN} from {sample_sql('surface_cover', SEED + k)}" for k in range(3)))
def _(spark, sf):
    """The sample of three seeds over one numbering of the pixels."""
    return _sample(spark, sf, (SEED, SEED + 1, SEED + 2))[1].drop("delta_t_c", "luhk_class_code")


@query("smp05_quota_manifest", f"""with s as (select group_name, image_id, count(*) n from {sample_sql('surface_cover')} group by 1, 2), e as (select group_name, image_id, count(*) n from {_COVER_PX} group by 1, 2)
    select e.group_name, e.image_id, e.n as eligible, cast({SEED} as int) as seed, coalesce(s.n, 0) as sampled, coalesce(s.n, 0) / e.n as fraction from e left join s using (group_name, image_id)""")
def _(spark, sf):
    pixels, sample = _sample(spark, sf)
    return thinning.sampling_manifest(pixels, sample)


@query("smp06_sample_checksum", f"""select seed, count(*) as n, {', '.join(f"cast(sum(cast('0x' || substr(h, {8 * k + 1}, 8) as bigint)) as bigint) as d{k}" for k in range(8))} from (select seed, sha256(group_name || '|' || image_id || '|' || thermal_row || '|' || thermal_col) h from {sample_sql('surface_cover')}) group by 1""")
def _(spark, sf):
    s = _sample(spark, sf)[1]
    row = F.sha2(F.concat_ws("|", "group_name", "image_id", F.col("thermal_row").cast("string"), F.col("thermal_col").cast("string")), 256)
    # an order-free digest: 32 sums of 8-bit pieces, combined map-side
    return s.groupBy("seed").agg(F.count("*").alias("n"), *[F.sum(F.conv(F.substring(row, 8 * k + 1, 8), 16, 10).cast("long")).alias(f"d{k}") for k in range(8)])


FAMILIES = ["luhk", "surface_cover", "luhk_surface_cover"]
_TWO = f"(select family s, group_name g, image_id, round(delta_t_c, 6) v from (select * from {sample_sql('luhk')} union all select * from {sample_sql('surface_cover')} union all select * from {sample_sql('luhk_surface_cover')}))"
_VALID = f"""with b as {_TWO}, i as (select s, g, count(*) n, count(distinct image_id) k, avg(v) m, quantile_cont(v, 0.5) q from b group by 1, 2), ok as (select s, g from i where n >= 100 and k >= 2), t as (select b.* from b join ok using (s, g))"""


def _group_tests(spark, sf, families=FAMILIES):
    s = _families(spark, sf, families).withColumn("v", F.round("delta_t_c", 6))
    return ranks.group_tests(s, scope="family", group="group_name", unit="image_id", value="v")


@query(
    "st01_kruskal_wallis",
    _VALID + """, r as (select s, g, rank() over (partition by s order by v) + (count(*) over (partition by s, v) - 1) / 2.0 as k from t), u as (select s, g, sum(k) rs, count(*) n from r group by 1, 2), x as (select s, sum(c * c * c - c) t from (select s, cast(count(*) as double) c from t group by s, v) group by 1), m as (select s, cast(count(*) as double) n from t group by 1),
    h as (select u.s, count(*) k, (12 / (max(m.n) * (max(m.n) + 1)) * sum(rs * rs / u.n) - 3 * (max(m.n) + 1)) / (1 - max(x.t) / (max(m.n) * max(m.n) * max(m.n) - max(m.n))) v from u join x using (s) join m using (s) group by 1 having count(*) >= 2)
    select a.s as family, h.k as n_groups, round(h.v, 3) as statistic, cast(h.k - 1 as int) as freedom, case when h.s is null then 'skipped' else 'exploratory_only_spatial_dependence_remains' end as status from (select distinct s from b) a left join h using (s)""",
)
def _(spark, sf):
    """Kruskal-Wallis test of every family's sample over the groups with enough pixels and images."""
    k = _group_tests(spark, sf)[0]
    return k.select(F.col("scope").alias("family"), "n_groups", F.round("statistic", 3).alias("statistic"), "freedom", "status")


@query("st01_p_values")
def _(spark, sf):
    return _group_tests(spark, sf)[0]


_PAIRS = ", p as (select x.s, x.g a, y.g b, x.n na, y.n nb, x.k ka, y.k kb, x.m - y.m dm, x.q - y.q dq from i x join i y on x.s = y.s and x.g < y.g), u as (select p.s, p.a, p.b, t.g, t.v from p join t on t.s = p.s and (t.g = p.a or t.g = p.b) where least(na, nb) >= 100 and least(ka, kb) >= 2), r as (select *, rank() over (partition by s, a, b order by v) + (count(*) over (partition by s, a, b, v) - 1) / 2.0 k from u), w as (select s, a, b, sum(k) filter (where g = a) - count(*) filter (where g = a) * (count(*) filter (where g = a) + 1) / 2.0 as u from r group by 1, 2, 3)"


@query(
    "st02_mann_whitney",
    _VALID + _PAIRS + """ select p.s as family, p.a as group_a, p.b as group_b, na as n_a, nb as n_b, ka as images_a, kb as images_b, round(w.u, 1) as u, round(2 * w.u / (na * nb) - 1, 6) as effect, round(case when w.u is not null then dm end, 4) as mean_difference, round(case when w.u is not null then dq end, 4) as median_difference,
      case when w.u is null then 'skipped' else 'exploratory_only_spatial_dependence_remains' end as status, case when least(na, nb) < 100 then 'At least one group has fewer than 100 sampled pixels.' when least(ka, kb) < 2 then 'At least one group occurs in fewer than 2 images.' else '' end as reason from p left join w using (s, a, b) where p.s <> 'luhk_surface_cover'""",
)
def _(spark, sf):
    """Mann-Whitney tests of all pairs of groups of a family, those of too few pixels or images as skipped."""
    p = _group_tests(spark, sf, FAMILIES[:2])[1]
    return p.select(F.col("scope").alias("family"), "group_a", "group_b", "n_a", "n_b", "images_a", "images_b", F.round("u", 1).alias("u"), F.round("effect", 6).alias("effect"), F.round("mean_difference", 4).alias("mean_difference"), F.round("median_difference", 4).alias("median_difference"), "status", "reason")


@query("st05_adjusted_p_values")
def _(spark, sf):
    return _group_tests(spark, sf, FAMILIES[:2])[1].select("scope", "group_a", "group_b", "p_value", "adjusted")


@query(
    "st05_adjustment",
    """with t as (select analysis_family f, coverage_id i, sampling_fraction p from sample_coverage where sampling_fraction between 0 and 1 and group_name is not null), r as (select *, row_number() over (partition by f order by p, i) k, count(*) over (partition by f) m from t)
    select f as family, i as coverage_id, round(least(1.0, min(p * m / k) over (partition by f order by k desc rows between unbounded preceding and current row)), 9) as adjusted from r""",
)
def _(spark, sf):
    """The adjustment alone, on shares read as p values."""
    t = table(spark, sf, "sample_coverage").where("sampling_fraction between 0 and 1 and group_name is not null").selectExpr("analysis_family as family", "coverage_id", "sampling_fraction as p_value")
    return ranks.with_adjusted(t, ["family"], ["coverage_id"]).select("family", "coverage_id", F.round("adjusted", 9).alias("adjusted"))


_SHADOW = f"(select group_name g, regexp_extract(group_name, '^(.*) \\| shadow=', 1) c, cast(regexp_extract(group_name, 'shadow=(-?[0-9]+)$', 1) as int) f, image_id, round(delta_t_c, 6) v from {sample_sql('surface_cover_shadow')})"


@query(
    "st03_shadow_contrast",
    f"""with b as {_SHADOW}, i as (select c, list_sort(list(distinct f)) fl, count(*) filter (where f = 0) n0, count(*) filter (where f = 1) n1, count(distinct image_id) filter (where f = 0) k0, count(distinct image_id) filter (where f = 1) k1, avg(v) filter (where f = 0) - avg(v) filter (where f = 1) dm, quantile_cont(v, 0.5) filter (where f = 0) - quantile_cont(v, 0.5) filter (where f = 1) dq from b group by 1),
    e as (select *, case when fl <> [0, 1] then 'Within-cover shadow contrast skipped because both shadow_flag=0 and shadow_flag=1 are not present.' when least(n0, n1) < 100 or least(k0, k1) < 2 then 'Within-cover shadow contrast fails minimum sampled-pixel or image-coverage rules.' else '' end why from i),
    r as (select b.*, rank() over (partition by c order by v) + (count(*) over (partition by c, v) - 1) / 2.0 k from b where c in (select c from e where why = '')), w as (select c, sum(k) filter (where f = 0) u from r group by 1)
    select e.c as cover, n0 as n_sunlit, n1 as n_shaded, k0 as images_sunlit, k1 as images_shaded, round(w.u - n0 * (n0 + 1) / 2.0, 1) as u, round(2 * (w.u - n0 * (n0 + 1) / 2.0) / (n0 * n1) - 1, 6) as effect, round(case when why = '' then dm end, 4) as mean_difference, round(case when why = '' then dq end, 4) as median_difference,
      case when why = '' then 'exploratory_only_spatial_dependence_remains' else 'skipped' end as status, why as reason from e left join w using (c)""",
)
def _(spark, sf):
    return _shadow_contrast(spark, sf).select(
        "cover", "n_sunlit", "n_shaded", "images_sunlit", "images_shaded", F.round("u", 1).alias("u"), F.round("effect", 6).alias("effect"), F.round("mean_difference", 4).alias("mean_difference"), F.round("median_difference", 4).alias("median_difference"), "status", "reason"
    )


@query("st03_shadow_tests")
def _(spark, sf):
    """The contrasts with their p values."""
    return _shadow_contrast(spark, sf)


def _shadow_contrast(spark, sf):
    """Mann-Whitney test of sunlit against shaded sampled pixels within each cover; skipped unless both and only both flags occur, with enough pixels and images each."""
    s = family_sample(spark, sf, "surface_cover_shadow")[1]
    s = s.select(F.regexp_extract("group_name", r"^(.*) \| shadow=", 1).alias("cover"), F.regexp_extract("group_name", r"shadow=(-?\d+)$", 1).cast("int").alias("flag"), "image_id", F.round("delta_t_c", 6).alias("v"))
    s = scratch(s)
    side = lambda k, c: F.when(F.col("flag") == k, F.col(c))
    info = s.groupBy("cover").agg(
        F.sort_array(F.collect_set("flag")).alias("flags"), F.count(side(0, "v")).alias("n_sunlit"), F.count(side(1, "v")).alias("n_shaded"), F.count_distinct(side(0, "image_id")).alias("images_sunlit"), F.count_distinct(side(1, "image_id")).alias("images_shaded"),
    )
    both = F.col("flags") == F.array(F.lit(0), F.lit(1))
    enough = (F.least("n_sunlit", "n_shaded") >= ranks.LEAST_PIXELS) & (F.least("images_sunlit", "images_shaded") >= ranks.LEAST_IMAGES)
    why = F.when(~both, "Within-cover shadow contrast skipped because both shadow_flag=0 and shadow_flag=1 are not present.").when(~enough, "Within-cover shadow contrast fails minimum sampled-pixel or image-coverage rules.").otherwise("")
    p = ranks.group_tests(s.where("flag in (0, 1)"), scope="cover", group="flag", unit="image_id", value="v")[1]
    out = info.withColumn("reason", why).drop("flags").join(p.select(F.col("scope").alias("cover"), "u", "p_value", "effect", "mean_difference", "median_difference"), "cover", "left")
    done = F.col("reason") == ""
    values = [F.when(done, F.col(c)).alias(c) for c in ("u", "p_value", "effect", "mean_difference", "median_difference")]
    return out.select("cover", "n_sunlit", "n_shaded", "images_sunlit", "images_shaded", *values, F.when(done, "exploratory_only_spatial_dependence_remains").otherwise("skipped").alias("status"), "reason")


SEEDS = [SEED + k for k in range(21)]


@query("st07_seed_stability")
def _(spark, sf):
    """Group and pair rows of the samples of 21 seeds, and how many secondary seeds agree with the primary one in the sign of a pair's differences.

    A pair is stable if mean, median and effect agree in at least 0.8 of the secondary seeds each, and
    cannot be concluded on where a group has too few sampled pixels or images of the primary seed.
    """
    def counted(family):
        pixels = family_pixels(spark, sf, family)
        drawn = thinning.drawn_pixels(pixels, SEEDS, tile=TILE, per_image=PER_IMAGE, per_group=PER_GROUP)
        # values are counted before the seeds are laid apart
        c = drawn.groupBy("group_name", F.round("delta_t_c", 6).alias("v"), "seeds").agg(F.count("*").alias("c")).withColumn("seed", F.explode("seeds"))
        images = pixels.select("group_name", "image_id").distinct().groupBy(F.lit(family).alias("family"), "group_name").agg(F.count("image_id").alias("images"))
        return scratch(c.groupBy(F.lit(family).alias("family"), "seed", "group_name", "v").agg(F.sum("c").alias("c"))), images

    (c0, i0), (c1, i1) = side_by_side(spark, lambda: counted("luhk"), lambda: counted("surface_cover"))
    counts, images = c0.unionByName(c1), i0.unionByName(i1)
    s = counts.withColumn("s", F.concat_ws("|", "family", F.col("seed").cast("string")))
    q = F.percentile("v", F.array(F.lit(0.5), F.lit(0.25), F.lit(0.75)), F.col("c"))  # of at most PER_GROUP pixels
    groups = s.groupBy("s", "family", "seed", "group_name").agg(F.sum("c").alias("n"), (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean"), q.alias("q")).join(images, ["family", "group_name"])
    groups = scratch(groups.withColumns({"median": F.col("q")[0], "q25": F.col("q")[1], "q75": F.col("q")[2]}).drop("q"))  # seeds x groups
    effects = ranks.rank_statistics(s, "group_name", "v", F.col("s"), weight="c")[1].select("s", "a", "b", (2.0 * F.col("u") / (F.col("n_a") * F.col("n_b")) - 1).alias("effect"))
    names = ["s", "family", "seed", "group", "n", "images", "mean", "median", "q25", "q75"]
    laid = groups.select("s", "family", "seed", F.col("group_name").alias("group"), "n", "images", "mean", "median", "q25", "q75")
    a, b = (laid.toDF(*[c if c in ("s", "family", "seed") else f"{c}_{side}" for c in names]) for side in "ab")
    pairs = a.join(b.drop("family", "seed"), "s").where("group_a < group_b and n_a >= 2 and n_b >= 2").join(effects, (F.col("group_a") == F.col("a")) & (F.col("group_b") == F.col("b")) & (a["s"] == effects["s"]))
    pairs = scratch(pairs.select(a["s"], "family", "seed", "group_a", "group_b", "n_a", "n_b", "images_a", "images_b", "mean_a", "mean_b", "median_a", "median_b", "q25_a", "q75_a", "effect"))
    signs = {"mean": F.signum(F.col("mean_a") - F.col("mean_b")), "median": F.signum(F.col("median_a") - F.col("median_b")), "effect": F.signum("effect")}
    first = pairs.where(F.col("seed") == SEED).select("family", "group_a", "group_b", ((F.least("n_a", "n_b") >= ranks.LEAST_PIXELS) & (F.least("images_a", "images_b") >= ranks.LEAST_IMAGES)).alias("enough"), *[x.alias(f"first_{k}") for k, x in signs.items()])
    other = pairs.where(F.col("seed") != SEED).join(first, ["family", "group_a", "group_b"])
    agree = other.groupBy("family", "group_a", "group_b").agg(F.first("enough").alias("enough"), *[F.avg((x == F.col(f"first_{k}")).cast("int")).alias(f"agreement_{k}") for k, x in signs.items()])
    status = F.when(~F.col("enough"), "insufficient_coverage_for_conclusion").when(F.least(*[f"agreement_{k}" for k in signs]) >= 0.8, "stable_sign_across_seeds").otherwise("seed_sensitive_sign")
    out = pairs.drop("s", "images_a", "images_b").join(agree.withColumn("stability_status", status).drop("enough"), ["family", "group_a", "group_b"], "left").withColumn("record_type", F.lit("pair"))
    single = groups.select("family", "seed", F.col("group_name").alias("group_a"), F.col("n").alias("n_a"), F.col("mean").alias("mean_a"), F.col("median").alias("median_a"), F.col("q25").alias("q25_a"), F.col("q75").alias("q75_a"), F.lit("group").alias("record_type"), F.lit("group_distribution_record").alias("stability_status"))
    return out.unionByName(single, allowMissingColumns=True)


def _bootstrap(estimate: str):
    """1000 resamples of a group's values, seeded by its name; the estimate and its 2.5 and 97.5 percentiles."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import zlib

        f = getattr(np, estimate)
        v = pdf.sort_values(["image_id", "thermal_row", "thermal_col"])["delta_t_c"].to_numpy()
        rng = np.random.default_rng(SEED + zlib.crc32(pdf["group_name"].iloc[0].encode()))
        estimates = np.array([f(rng.choice(v, len(v))) for _ in range(1000)])
        low, high = np.quantile(estimates, [0.025, 0.975])
        return pd.DataFrame({"group_name": [pdf["group_name"].iloc[0]], "n": [len(v)], estimate: [f(v)], "low": [low], "high": [high]})

    return run


@query("st09_bootstrap_mean")
def _(spark, sf):
    """95 % intervals of the mean of each cover's thinned sample, of at most PER_GROUP pixels."""
    return _sample(spark, sf)[1].groupBy("group_name").applyInPandas(_bootstrap("mean"), "group_name string, n long, mean double, low double, high double")


@query("st09_bootstrap_median")
def _(spark, sf):
    """The same of the median."""
    return _sample(spark, sf)[1].groupBy("group_name").applyInPandas(_bootstrap("median"), "group_name string, n long, median double, low double, high double")


@query("st10_density")
def _(spark, sf):
    """Gaussian density of each cover's thinned sample on 512 points, bandwidth by Scott's rule."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.sort(pdf["delta_t_c"].to_numpy())
        sd = v.std(ddof=1) if len(v) > 1 else 0.0
        if len(v) < 100 or sd < 0.02 or len(np.unique(v)) < 5:
            return pd.DataFrame({"group_name": [], "x": [], "density": []})
        h = sd * len(v) ** -0.2
        x = np.linspace(v[0], v[-1], 512)
        d = np.concatenate([np.exp(-0.5 * ((part[:, None] - v) / h) ** 2).mean(axis=1) for part in np.array_split(x, 16)]) / (h * math.sqrt(2 * math.pi))
        return pd.DataFrame({"group_name": pdf["group_name"].iloc[0], "x": x, "density": d})

    return _sample(spark, sf)[1].groupBy("group_name").applyInPandas(run, "group_name string, x double, density double")


@query("st12_pearson", "select image_id, round(abs(corr(cast(temperature_c as double), cast(thermal_row as double))), 6) as r from pixel_samples where isfinite(temperature_c) group by 1")
def _(spark, sf):
    p = px(spark, sf).where(finite(F.col("temperature_c")))
    t, r = F.col("temperature_c").cast("double"), F.col("thermal_row").cast("double")
    return p.groupBy("image_id").agg(F.round(F.abs(F.try_divide(F.covar_pop(t, r), F.sqrt(F.var_pop(t) * F.var_pop(r)))), 6).alias("r"))


@query(
    "st13_mutual_information",
    """with o as (select image_id, cast(temperature_c as double) x, cast(thermal_col as double) y from pixel_samples where not isnan(temperature_c) and temperature_c is not null), e as (select image_id, min(x) x0, max(x) x1, min(y) y0, max(y) y1 from o group by 1),
    j as (select image_id, case when x1 > x0 then least(31, floor((x - x0) / (x1 - x0) * 32)) else 0 end i, case when y1 > y0 then least(31, floor((y - y0) / (y1 - y0) * 32)) else 0 end k, cast(count(*) as double) n from o join e using (image_id) group by 1, 2, 3),
    h as (select image_id, ln(sum(n)) - sum(n * ln(n)) / sum(n) h from j group by 1), hx as (select image_id, ln(sum(n)) - sum(n * ln(n)) / sum(n) h from (select image_id, i, sum(n) n from j group by 1, 2) group by 1), hy as (select image_id, ln(sum(n)) - sum(n * ln(n)) / sum(n) h from (select image_id, k, sum(n) n from j group by 1, 2) group by 1)
    select image_id, round(greatest(0.0, least(1.0, 2 * (hx.h + hy.h - h.h) / greatest(hx.h + hy.h, 1e-12))), 5) as nmi from h join hx using (image_id) join hy using (image_id)""",
)
def _(spark, sf):
    return QA.mutual_information(px(spark, sf), ["image_id"], "temperature_c", "thermal_col").withColumn("nmi", F.round("nmi", 5))


@query("st13_cross_correlation", "select image_id, round(coalesce(case when sqrt(var_pop(x) * var_pop(y)) * count(*) > 1e-12 then corr(x, y) end, 0), 5) as ncc from (select image_id, cast(temperature_c as double) x, cast(thermal_col as double) y from pixel_samples where isfinite(temperature_c) and thermal_col is not null) group by 1")
def _(spark, sf):
    return QA.correlation(px(spark, sf), ["image_id"], "temperature_c", "thermal_col").withColumn("ncc", F.round("ncc", 5))


@query(
    "st13_edge_overlap",
    """with m as (select image_id, thermal_row::int r, thermal_col::int c, max(coalesce(shadow_flag = 1, false)::int) a, max(coalesce(temperature_c < 15, false)::int) b from pixel_samples where coalesce(shadow_flag = 1, false) or coalesce(temperature_c < 15, false) group by 1, 2, 3),
    o as (select i, j from range(-2, 3) x(i), range(-2, 3) y(j) where abs(i) + abs(j) <= 2), d as (select distinct image_id, r + i r, c + j c, k from (select image_id, r, c, 'a' k from m where a = 1 union all select image_id, r, c, 'b' from m where b = 1), o),
    s as (select m.image_id, sum(a) na, sum(b) nb, sum(a * (db.k is not null)::int) x, sum(b * (da.k is not null)::int) y from m left join d da on da.k = 'a' and da.image_id = m.image_id and da.r = m.r and da.c = m.c left join d db on db.k = 'b' and db.image_id = m.image_id and db.r = m.r and db.c = m.c group by 1)
    select image_id, cast(na as bigint) as n_a, cast(nb as bigint) as n_b, round(case when na > 0 and nb > 0 and x + y > 0 then 2 * (x / na) * (y / nb) / (x / na + y / nb) else 0 end, 6) as f1 from s""",
)
def _(spark, sf):
    """How the cold pixels of a capture follow its shaded ones."""
    a, b = F.coalesce(F.col("shadow_flag") == 1, F.lit(False)), F.coalesce((F.col("temperature_c") < 15) & ~F.isnan("temperature_c"), F.lit(False))
    return QA.edge_overlap(px(spark, sf), "image_id", "thermal_row", "thermal_col", a, b).withColumn("f1", F.round("f1", 6))


@query("st14_display_limits", "select image_id, round(a - p, 4) as low, round(z + p, 4) as high from (select *, case when a = z then greatest(0.5, abs(a) * 0.01) else 0 end p from (select image_id, quantile_cont(v, 0.01) a, quantile_cont(v, 0.99) z from (select image_id, cast(temperature_c as double) v from pixel_samples where isfinite(temperature_c)) group by 1))")
def _(spark, sf):
    """Where the values of a capture are shown: between its first and last percent, padded where these are equal."""
    q = exact_quantiles(px(spark, sf), ["image_id"], F.col("temperature_c"), {"low": 0.01, "high": 0.99}, reread=True, scale=FINE)
    pad = F.when(F.col("low") == F.col("high"), F.greatest(F.lit(0.5), F.abs("low") * 0.01)).otherwise(0.0)
    return q.select("image_id", F.round(F.col("low") - pad, 4).alias("low"), F.round(F.col("high") + pad, 4).alias("high"))


@query("t05_duplicate_times", f"select record_id from (select record_id, t, count(*) over (partition by flight_id, t) n from (select record_id, flight_id, {STAMP_SQL.format('thermal_path')} t from validation_records)) where n > 1")
def _(spark, sf):
    v = table(spark, sf, "validation_records").select("record_id", "flight_id", stamp("thermal_path").alias("t"))
    return T.duplicate_times(v, ["flight_id"], "t").where("duplicate_time").select("record_id")


CAPTURE_STATISTICS = {"mean": "mean", "median": "median", "q95": "q95", "max": "max", "absolute_pixel": ("max", "min")}


def capture_series(spark, sf):
    """Each flight's captures with time, local day and the statistics of their eligible temperatures, each pixel once."""
    p = px(spark, sf).where(F.col("analysis_eligible") & F.col("target_mask") & finite(F.col("temperature_c")))
    p = scratch(p.groupBy("flight_id", "image_id", "thermal_row", "thermal_col").agg(F.min(F.col("temperature_c").cast("double")).alias("v")))
    q = exact_quantiles(p, ["flight_id", "image_id"], F.col("v"), {"median": 0.5, "q95": 0.95}, reread=True, scale=FINE).drop("n_values").withColumnsRenamed({"flight_id": "__f", "image_id": "__i"})
    m = p.groupBy("flight_id", "image_id").agg(F.avg("v").alias("mean"), F.max("v").alias("max"), F.min("v").alias("min"))
    c = m.join(q, m["flight_id"].eqNullSafe(q["__f"]) & m["image_id"].eqNullSafe(q["__i"])).drop("__f", "__i")
    return c.withColumn("at", stamp("image_id")).withColumn("window_id", F.date_format("at", "yyyy-MM-dd"))


_SERIES_SQL = f"""(select flight_id, image_id, {STAMP_SQL.format('image_id')} t, avg(v) mean, quantile_cont(v, 0.5) median, quantile_cont(v, 0.95) q95, max(v) hi, min(v) lo from
    (select flight_id, image_id, thermal_row, thermal_col, min(cast(temperature_c as double)) v from pixel_samples where analysis_eligible and target_mask and isfinite(temperature_c) group by 1, 2, 3, 4) group by 1, 2)"""


@query(
    "t08_peak_to_trough",
    f"""with e as (select flight_id, strftime(t, '%Y-%m-%d') w, image_id, epoch_us(t) t, s.k k, s.h h, s.l l from (select *, unnest([{{'k': 'mean', 'h': mean, 'l': mean}}, {{'k': 'median', 'h': median, 'l': median}}, {{'k': 'q95', 'h': q95, 'l': q95}}, {{'k': 'max', 'h': hi, 'l': hi}}, {{'k': 'absolute_pixel', 'h': hi, 'l': lo}}]) s from {_SERIES_SQL})),
    g as (select flight_id, w, k, count(distinct image_id) n, arg_min(struct_pack(v := h, t := t, i := image_id), struct_pack(a := -h, t := t, i := image_id)) h, arg_min(struct_pack(v := l, t := t, i := image_id), struct_pack(a := l, t := t, i := image_id)) l from e group by 1, 2, 3)
    select flight_id, w as window_id, k as statistic, n as n_captures, case when n < 2 then 'fewer_than_two_compatible_captures' else '' end as unavailable_reason, round(case when n >= 2 then h.v - l.v end, 4) as range, case when n >= 2 then h.i end as max_image, case when n >= 2 then l.i end as min_image, round(case when n >= 2 then abs(h.t - l.t) / 3.6e9 end, 5) as hours_between from g""",
)
def _(spark, sf):
    r = T.peak_to_trough(capture_series(spark, sf), ["flight_id", "window_id"], "image_id", "at", CAPTURE_STATISTICS)
    return r.select("flight_id", "window_id", "statistic", "n_captures", "unavailable_reason", F.round("range", 4).alias("range"), "max_image", "min_image", F.round("hours_between", 5).alias("hours_between"))


@query(
    "t09_sampling_coverage",
    f"""with c as (select distinct flight_id, image_id, {STAMP_SQL.format('image_id')} ts from subzero_qa where {STAMP_SQL.format('image_id')} is not null), e as (select *, epoch_us(ts) t, epoch_us(ts) - lag(epoch_us(ts)) over (partition by flight_id order by ts, image_id) g from c),
    s as (select flight_id, count(*) n, (max(t) - min(t)) / 3.6e9 span, max(g) / 3.6e9 gap, bool_or(hour(ts) >= 6 and hour(ts) < 18) d, bool_or(hour(ts) < 6 or hour(ts) >= 18) k from e group by 1),
    f as (select *, concat_ws(';', case when n < 6 then 'fewer_than_six_eligible_captures' end, case when not d then 'daytime_not_represented' end, case when not k then 'nighttime_not_represented' end, case when span < 23 then 'observation_span_less_than_23_hours' end, case when coalesce(gap > 4, true) then 'maximum_sampling_gap_exceeds_four_hours' end) x from s)
    select flight_id, n as n_captures, round(span, 4) as span_hours, round(gap, 4) as largest_gap_hours, x as gate_failures, case when n = 1 then 'single_capture' when x = '' then 'full_day_sampling_design_confirmed' when d and k then 'day_and_night_observed_but_daily_extrema_not_established' else 'partial_observation_window' end as status from f""",
)
def _(spark, sf):
    c = table(spark, sf, "subzero_qa").select("flight_id", "image_id", stamp("image_id").alias("at")).where("at is not null").distinct()
    c = T.sampling_coverage(c, ["flight_id"], "image_id", "at", F.hour("at"), True)
    return c.select("flight_id", "n_captures", F.round("span_hours", 4).alias("span_hours"), F.round("largest_gap_hours", 4).alias("largest_gap_hours"), "gate_failures", "status")


@query("t10_series_groups", "select target_id, measurement_type, count(distinct image_id) as n_images from pixel_samples group by 1, 2 having count(distinct image_id) >= 2")
def _(spark, sf):
    return T.series_groups(px(spark, sf).select("target_id", "measurement_type", "image_id").distinct(), ["target_id", "measurement_type"], "image_id")


@query(
    "t11_pixelwise_range",
    f"""with f as (select image_id from {GRID_SQL} group by 1 having count(*) = 4096), g as (select * from {GRID_SQL} where image_id in (select image_id from f))
    select thermal_row, thermal_col, round(max(v), 6) as max_value, round(min(v), 6) as min_value, round(max(v) - min(v), 6) as range, arg_min(image_id, struct_pack(a := -v, i := image_id)) as max_image, arg_min(image_id, struct_pack(a := v, i := image_id)) as min_image from g group by 1, 2 having count(distinct image_id) = (select count(*) from f)""",
)
def _(spark, sf):
    g = grid(spark, sf)
    whole = scratch(g.groupBy("image_id").count().where("count = 4096").select("image_id"))
    n = whole.count()
    r = T.pixelwise_range(g.join(broadcast_if_small(whole, n), "image_id"), "image_id", "thermal_row", "thermal_col", "v", n)
    return r.withColumns({c: F.round(c, 6) for c in ("max_value", "min_value", "range")})


@query("t12_exclusions", """with s as (select distinct image_id from validation_records), c as (select image_id, list_distinct(list(exclusion_reason order by exclusion_reason) filter (where exclusion_reason <> '')) r from pixel_samples group by 1)
    select s.image_id, case when c.image_id is null then 'not_found' else coalesce(array_to_string(list_sort(c.r), ';'), '') end as reasons from s left join c using (image_id)""")
def _(spark, sf):
    p = px(spark, sf).select("image_id", "exclusion_reason").distinct()  # a capture's distinct reasons are few
    return T.exclusions(table(spark, sf, "validation_records").select("image_id").distinct(), p, "image_id", ["exclusion_reason"])


@query("qa01_layer_consistency", """select unnest(['unknown_with_name', 'known_without_code', 'valid_cover_without_class', 'shadow_valid_without_flag']) as "check", unnest([count(*) filter (where luhk_class_code = -1 and luhk_cell_id <> ''), count(*) filter (where luhk_label_valid and luhk_class_code = -1), count(*) filter (where surface_cover_valid and surface_cover_class is null), count(*) filter (where shadow_valid and shadow_flag is null)]) as n_violations from pixel_samples""")
def _(spark, sf):
    checks = {
        "unknown_with_name": (F.col("luhk_class_code") == -1) & (F.col("luhk_cell_id") != ""),
        "known_without_code": F.col("luhk_label_valid") & (F.col("luhk_class_code") == -1),
        "valid_cover_without_class": F.col("surface_cover_valid") & F.col("surface_cover_class").isNull(),
        "shadow_valid_without_flag": F.col("shadow_valid") & F.col("shadow_flag").isNull(),
    }
    return QA.ledger(px(spark, sf), checks).select("check", "n_violations")


@query("qa03_delta_formula", """select count(*) filter (where isfinite(temperature_c) and isfinite(ambient_temperature_c) and not (isfinite(delta_t_c) and abs(cast(delta_t_c as double) - (cast(temperature_c as double) - cast(ambient_temperature_c as double))) <= 1e-5)) as n_wrong, count(*) filter (where not coalesce(isfinite(ambient_temperature_c), false) and coalesce(isfinite(delta_t_c), false)) as n_invented from pixel_samples""")
def _(spark, sf):
    d, t, a = (F.col(c).cast("double") for c in ("delta_t_c", "temperature_c", "ambient_temperature_c"))
    right = finite(d) & (F.abs(d - (t - a)) <= 1e-5)
    return px(spark, sf).agg(F.count_if(finite(t) & finite(a) & ~right).alias("n_wrong"), F.count_if(~finite(a) & finite(d)).alias("n_invented"))


@query("qa06_value_audit", """select image_id, count(*) as n, count(*) filter (where temperature_c is null) as n_null, count(*) filter (where isnan(temperature_c)) as n_nan, count(*) filter (where isfinite(temperature_c)) as n_finite from pixel_samples group by 1""")
def _(spark, sf):
    t = F.col("temperature_c")
    return px(spark, sf).groupBy("image_id").agg(F.count("*").alias("n"), F.count_if(t.isNull()).alias("n_null"), F.count_if(F.isnan(t)).alias("n_nan"), F.count_if(finite(t)).alias("n_finite"))


@query("qa08_components")
def _(spark, sf):
    return QA.component_sizes(grid(spark, sf).where("v < 0"), "image_id", "thermal_row", "thermal_col")


@query("qa09_edge_share", f"select image_id, round(avg(cast(thermal_row < 5 or thermal_row >= 59 or thermal_col < 5 or thermal_col >= 59 as int)), 6) as edge_share from {GRID_SQL} where v < 0 group by 1")
def _(spark, sf):
    e = QA.edge(F.col("thermal_row"), F.col("thermal_col"), 64, 64).cast("int")
    return grid(spark, sf).where("v < 0").groupBy("image_id").agg(F.round(F.avg(e), 6).alias("edge_share"))


@query("qa12_grid_completeness", f"""with g as (select image_id, count(*) n, count(distinct (thermal_row, thermal_col)) d, cast(max(thermal_row) + 1 as bigint) * (max(thermal_col) + 1) e from {GRID_SQL} group by 1) select image_id, n, d as n_distinct, e as expected, case when n > d then 'duplicates' when d < e then 'incomplete' else 'complete' end as state from g""")
def _(spark, sf):
    return QA.grid_completeness(grid(spark, sf), "image_id", "thermal_row", "thermal_col")


@query("x01_pair_records", """select record_id, case when nullif(visible_path, '') is null then 'missing_visible' when nullif(thermal_path, '') is null then 'missing_thermal' else 'ok' end as status, concat_ws('; ', case when altitude_m is null then 'no altitude' end, case when camera_model = '' then 'no camera' end) as notes from validation_records""")
def _(spark, sf):
    blank = lambda c: F.nullif(F.col(c), F.lit("")).isNull()
    status = F.when(blank("visible_path"), "missing_visible").when(blank("thermal_path"), "missing_thermal").otherwise("ok")
    notes = F.concat_ws("; ", F.array_compact(F.array(F.when(F.col("altitude_m").isNull(), "no altitude"), F.when(F.col("camera_model") == "", "no camera"))))
    return table(spark, sf, "validation_records").select("record_id", status.alias("status"), notes.alias("notes"))


@query("x03_first_occurrence", """with r as (select visible_path p, record_id * 2 k from validation_records union all select thermal_path, record_id * 2 + 1 from validation_records) select p as path, min(k) as first_seen from r where p is not null and p <> '' group by 1""")
def _(spark, sf):
    rows = table(spark, sf, "validation_records").selectExpr("stack(2, visible_path, record_id * 2, thermal_path, record_id * 2 + 1) as (path, k)").where("path is not null and path != ''")
    return rows.groupBy("path").agg(F.min("k").alias("first_seen"))


@query("x09_stat_or_blank", "select flight_id, round(min(m), 4) as lowest, round(max(m), 4) as highest, round(avg(m), 4) as mean, round(quantile_cont(m, 0.01), 4) as p01, round(quantile_cont(m, 0.99), 4) as p99 from (select flight_id, minimum_temperature_c m from subzero_qa where minimum_temperature_c is not null and not isnan(minimum_temperature_c)) group by 1")
def _(spark, sf):
    s = table(spark, sf, "subzero_qa").where(finite(F.col("minimum_temperature_c")))
    q = exact_quantiles(s, ["flight_id"], F.col("minimum_temperature_c"), {"p01": 0.01, "p99": 0.99})
    m = s.groupBy("flight_id").agg(F.round(F.min("minimum_temperature_c"), 4).alias("lowest"), F.round(F.max("minimum_temperature_c"), 4).alias("highest"), F.round(F.avg("minimum_temperature_c"), 4).alias("mean"))
    return m.join(q, "flight_id").select("flight_id", "lowest", "highest", "mean", F.round("p01", 4).alias("p01"), F.round("p99", 4).alias("p99"))


@query("x10_last_row_wins", "select image_id, arg_max(record_id, struct_pack(t := received_at, r := record_id)) as record_id from validation_records group by 1")
def _(spark, sf):
    return table(spark, sf, "validation_records").groupBy("image_id").agg(F.max_by("record_id", F.struct("received_at", "record_id")).alias("record_id"))


@query("x18_control_points", "select record_id, try_cast(string_split(focal, ',')[1] as double) as fx from (select record_id, cast(focal_length_mm as varchar) || ',' || cast(altitude_m as varchar) as focal from validation_records where validation_status = 'pass') where try_cast(string_split(focal, ',')[1] as double) is not null")
def _(spark, sf):
    rows = table(spark, sf, "validation_records").where("validation_status = 'pass'").select("record_id", F.concat_ws(",", F.col("focal_length_mm").cast("string"), F.col("altitude_m").cast("string")).alias("f"), "focal_length_mm", "altitude_m")
    fx = F.split("f", ",")[0].try_cast("double")
    return rows.where("focal_length_mm is not null and altitude_m is not null").select("record_id", fx.alias("fx")).where("fx is not null")


@query("x20_shared_limits", f"""with s as (select group_name, min(delta_t_c) lo, max(delta_t_c) hi from {_COVER_PX} group by 1) select group_name, round(lo, 4) as low, round(hi, 4) as high, round(min(lo) over (), 4) as shared_low, round(max(hi) over (), 4) as shared_high from s""")
def _(spark, sf):
    s = scratch(cover_pixels(spark, sf).groupBy("group_name").agg(F.min("delta_t_c").alias("lo"), F.max("delta_t_c").alias("hi")))
    lo, hi = s.agg(F.min("lo"), F.max("hi")).first()
    return s.select("group_name", F.round("lo", 4).alias("low"), F.round("hi", 4).alias("high"), F.round(F.lit(lo), 4).alias("shared_low"), F.round(F.lit(hi), 4).alias("shared_high"))
