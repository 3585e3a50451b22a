"""Splits, folds, filter sets, curricula and seeded selections (section J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import bins, rules
from gridloom.operators import sampling as Sm, splits as Sp
from gridloom.plans.fixtures import fx_metrics, fx_patch, fx_pixel, fx_quality, fx_vec
from gridloom.plans.q_reports import rounded
from gridloom.plans.q_scalars import METRICS, POOL_SQL, metric_args
from gridloom.plans.registry import query

TEST, VAL = ["NATION_0", "NATION_1", "NATION_2", "NATION_3", "NATION_4"], ["NATION_5", "NATION_6", "NATION_7"]
PRIORITY = {"AFRICA": ["missing", "NATION_20"], "ASIA": ["NATION_12"]}


def h_sql(*keys: str, salt: str) -> str:
    """The seeded sample order in SQL."""
    return f"CAST(concat('0x', substr(md5(concat_ws('|', '{salt}', {', '.join(keys)})), 1, 8)) AS BIGINT)"


@query(
    "assign_split",
    f"""SELECT patch_id, city, CASE WHEN city IN {tuple(TEST)} THEN 'test' WHEN city IN {tuple(VAL)} THEN 'val' ELSE 'train' END AS split, 'main' AS fold_id,
      CASE WHEN city IN {tuple(TEST)} THEN 3 WHEN city IN {tuple(VAL)} THEN 2 ELSE 1 END AS split_role_order FROM fx_patch""",
)
def _(spark, d):
    return Sp.assign_split(fx_patch(spark, d), TEST, VAL).select("patch_id", "city", "split", "fold_id", "split_role_order")


@query(
    "loro_cities",
    """WITH v AS (SELECT city FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY CASE WHEN city = 'NATION_20' AND region = 'AFRICA' THEN 1 WHEN city = 'NATION_12' AND region = 'ASIA' THEN 0 ELSE 1000 END, city) AS rn FROM (SELECT DISTINCT city, region FROM fx_patch)) WHERE rn = 1)
      SELECT concat('leave_out_', replace(lower(h.region), ' ', '_')) AS fold_id, h.region AS heldout_region, c.region, c.city,
      CASE WHEN c.region = h.region THEN 'test' WHEN c.city IN (SELECT city FROM v) THEN 'val' ELSE 'train' END AS split FROM (SELECT DISTINCT city, region FROM fx_patch) c, (SELECT DISTINCT region FROM fx_patch) h""",
)
def _(spark, d):
    return Sp.loro(Sp.city_table(fx_patch(spark, d)), PRIORITY).select("fold_id", "heldout_region", "region", "city", "split")


CITY_STATS = """cs AS (SELECT city, region, count(*) AS n, count(*) FILTER (label_positive_pixels > 0) AS k FROM fx_patch GROUP BY city, region),
  tg AS (SELECT 100.0 * sum(k) / sum(n) AS tp, median(n) AS tn FROM cs),
  sc AS (SELECT cs.*, CASE WHEN n >= {n} AND k >= {k} THEN 0 ELSE 1 END AS short, abs(100.0 * k / n - tp) AS dist, abs(n - tn) / greatest(tn, 1) AS rel FROM cs, tg)"""


def loco_sql(n, k):
    return "WITH " + CITY_STATS.format(n=n, k=k) + """, pk AS (SELECT t.city AS test_city, v.city AS val_city, v.short, row_number() OVER (PARTITION BY t.city ORDER BY v.short, v.dist, v.rel, v.city) AS rn
      FROM sc t JOIN sc v ON t.city <> v.city) """  # fmt: skip


@query("loco_folds", loco_sql(600, 300) + "SELECT concat('fold_test_', lower(test_city)) AS fold_id, test_city, val_city, short = 1 AS used_fallback FROM pk WHERE rn = 1")
def _(spark, d):
    return Sp.loco(fx_patch(spark, d), 600, 300)


@query(
    "loco_fold_summary",
    loco_sql(100, 20)
    + """SELECT concat('fold_test_', lower(p.test_city)) AS fold_id, p.test_city, p.val_city, t.n AS test_patches, t.k AS test_positive_patches, v.n AS val_patches, v.k AS val_positive_patches,
      CAST((SELECT sum(n) FROM cs) - t.n - v.n AS BIGINT) AS train_patches, CAST((SELECT sum(k) FROM cs) - t.k - v.k AS BIGINT) AS train_positive_patches
      FROM pk p JOIN cs t ON t.city = p.test_city JOIN cs v ON v.city = p.val_city WHERE rn = 1""",
)
def _(spark, d):
    p = fx_patch(spark, d)
    return Sp.loco_fold_summary(p, Sp.loco(p))


LORO_SQL = "WITH " + CITY_STATS.format(n=100, k=20) + """, vc AS (SELECT city FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY short, dist, rel, city) AS rn FROM sc) WHERE rn <= 2),
  roles AS (SELECT h.region AS heldout_region, c.city, c.region, CASE WHEN c.region = h.region THEN 'test' WHEN c.city IN (SELECT city FROM vc) THEN 'val' ELSE 'train' END AS split
    FROM cs c, (SELECT DISTINCT region FROM cs) h) """  # fmt: skip


@query("loro_patch_roles", LORO_SQL + "SELECT concat('fold_test_', replace(lower(heldout_region), ' ', '_')) AS fold_id, heldout_region, city, region, split FROM roles")
def _(spark, d):
    return Sp.loro_patches(fx_patch(spark, d), per_region=2)


@query(
    "loro_fold_patches",
    LORO_SQL + "SELECT heldout_region, r.split, count(*) AS patches, CAST(sum(p.label_positive_pixels) AS BIGINT) AS pixels FROM fx_patch p JOIN roles r ON p.city = r.city GROUP BY ALL",
)
def _(spark, d):
    p = fx_patch(spark, d)
    rows = Sp.apply_roles(p, Sp.loro_patches(p, per_region=2))
    return rows.groupBy("heldout_region", "split").agg(F.count(F.lit(1)).alias("patches"), F.sum("label_positive_pixels").alias("pixels"))


AWAY = "abs(c.n + {p} - {goal}) - 0.1 * least(c.k + {q}, 20)"  # distance to the goal, with the bonus for positives


@query(
    "loro_greedy",
    f"""WITH RECURSIVE c AS (SELECT region, city, count(*) AS n, count(*) FILTER (label_positive_pixels > 0) AS k FROM fx_patch GROUP BY 1, 2),
      f AS (SELECT h.region AS held, sum(c.n) AS total, count(DISTINCT c.region) AS regions FROM (SELECT DISTINCT region FROM c) h JOIN c ON c.region <> h.region GROUP BY 1),
      goal AS (SELECT held, regions, least(greatest(greatest(100, round_even(total * 0.2, 0)), 1), greatest(1, total - 1)) AS target FROM f),
      own AS (SELECT g.held, g.target, c.*, count(*) OVER (PARTITION BY g.held, c.region) AS members, bool_or(c.k > 0) OVER (PARTITION BY g.held, c.region) AS has_pos,
              {AWAY.format(p=0, q=0, goal="greatest(1.0, g.target / g.regions)")} AS away FROM goal g JOIN c ON c.region <> g.held),
      firsts AS (SELECT held, region, city, n, k FROM own WHERE members > 1 AND (k > 0 OR NOT has_pos) QUALIFY row_number() OVER (PARTITION BY held, region ORDER BY away, n, city) = 1),
      begun AS (SELECT g.held, g.target, list(p.city) FILTER (p.city IS NOT NULL) AS cities, list(p.region) FILTER (p.city IS NOT NULL) AS regions, coalesce(sum(p.n), 0) AS n, coalesce(sum(p.k), 0) AS k
        FROM goal g LEFT JOIN firsts p ON p.held = g.held GROUP BY 1, 2),
      grown(held, target, cities, regions, n, k) AS (
        SELECT held, target, coalesce(cities, []), coalesce(regions, []), n::BIGINT, k::BIGINT FROM begun
        UNION ALL
        SELECT held, target, list_append(cities, best.city), list_append(regions, best.region), n + best.n, k + best.k FROM (
          SELECT s.held, s.target, s.cities, s.regions, s.n, s.k, arg_min({{'city': c.city, 'region': c.region, 'n': c.n, 'k': c.k}}, {{'a': {AWAY.format(p="s.n", q="s.k", goal="s.target")}, 'n': c.n, 'c': c.city}}) AS best
          FROM grown s JOIN (SELECT *, count(*) OVER (PARTITION BY region) AS members FROM c) c
            ON c.region <> s.held AND NOT list_contains(s.cities, c.city) AND c.members - len(list_filter(s.regions, lambda x: x = c.region)) > 1
          WHERE s.n < s.target OR s.k < 20 GROUP BY s.held, s.target, s.cities, s.regions, s.n, s.k)),
      last AS (SELECT held, arg_max(cities, len(cities)) AS cities FROM grown GROUP BY 1)
      SELECT l.held AS heldout_region, c.region, c.city, CASE WHEN c.region = l.held THEN 'test' WHEN list_contains(l.cities, c.city) THEN 'val' ELSE 'train' END AS split FROM last l CROSS JOIN c""",
)
def _(spark, d):
    return Sp.loro_greedy(fx_patch(spark, d))


@query(
    "region_covered_split",
    f"""WITH p AS (SELECT * REPLACE (CASE WHEN region = 'ASIA' THEN concat('ASIA_', patch_id % 3 // 2) ELSE city END AS city) FROM fx_patch),
      cs AS (SELECT city, region, count(*) AS n, sum(label_positive_pixels) AS px, count(*) FILTER (label_positive_pixels > 0) AS k FROM p GROUP BY city, region),
      rk AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY px DESC, k DESC, n DESC, city) AS r, count(*) OVER (PARTITION BY region) AS m FROM cs),
      ro AS (SELECT *, CASE WHEN r = 1 THEN 'test' WHEN r = 2 AND m >= 3 THEN 'val' WHEN r = 2 THEN 'source' ELSE 'train' END AS role FROM rk),
      w AS (SELECT *, least(greatest(round_even(n * 0.2, 0), 50), 250, n - 1) AS want FROM ro WHERE role = 'source'),
      q AS (SELECT *, least(k, greatest(1, round_even(want * k / n, 0))) AS qp FROM w),
      s AS (SELECT p.patch_id, p.city, CASE WHEN label_positive_pixels > 0 THEN 1 ELSE 0 END AS pos, row_number() OVER (PARTITION BY p.city, label_positive_pixels > 0 ORDER BY {h_sql("patch_id", salt="val")}, patch_id) AS rn
        FROM p JOIN q ON p.city = q.city),
      v AS (SELECT s.patch_id FROM s JOIN q ON s.city = q.city WHERE rn <= CASE WHEN pos = 1 THEN qp ELSE want - qp END)
      SELECT p.patch_id, p.city, CASE WHEN role IN ('test', 'val') THEN role WHEN p.patch_id IN (SELECT patch_id FROM v) THEN 'val' ELSE 'train' END AS split,
      CASE role WHEN 'test' THEN 'test_city_holdout' WHEN 'val' THEN 'val_city_holdout' ELSE CASE WHEN p.patch_id IN (SELECT patch_id FROM v) THEN 'val_patch_sample_from_train_city' ELSE 'train_city' END END AS split_assignment_type
      FROM p JOIN ro ON p.city = ro.city""",
)
def _(spark, d):
    two = F.concat(F.lit("ASIA_"), F.floor((F.col("patch_id") % 3) / 2).cast("string"))  # a region of two cities only
    rows = fx_patch(spark, d).withColumn("city", F.when(F.col("region") == "ASIA", two).otherwise(F.col("city")))
    return Sp.region_covered_split(rows).select("patch_id", "city", "split", "split_assignment_type")


@query(
    "stratified_sample",
    f"""WITH g AS (SELECT city, count(*) AS n, count(*) FILTER (label_positive_pixels > 0) AS k FROM fx_patch GROUP BY city),
      w AS (SELECT *, least(greatest(round_even(n * 0.1, 0), 40), 60, n - 1) AS want FROM g), q AS (SELECT *, least(k, greatest(1, round_even(want * k / n, 0))) AS qp FROM w),
      r AS (SELECT p.patch_id, p.city, label_positive_pixels > 0 AS pos, row_number() OVER (PARTITION BY p.city, label_positive_pixels > 0 ORDER BY {h_sql("patch_id", salt="s")}, patch_id) AS rn FROM fx_patch p)
      SELECT r.patch_id, r.city, r.pos FROM r JOIN q ON r.city = q.city WHERE rn <= CASE WHEN pos THEN qp ELSE want - qp END""",
)
def _(spark, d):
    out = Sp.stratified_sample(fx_patch(spark, d), ["city"], "patch_id", 0.1, 40, 60, "s")
    return out.select("patch_id", "city", (F.col("label_positive_pixels") > 0).alias("pos"))


def folded(spark, d):
    return fx_quality(spark, d).withColumns({"split_strategy": F.lit("custom"), "fold_id": F.lit("main")})


def _filter_sql(s):
    qual = {"all": "TRUE", "basic_quality": "passes_basic_quality_filter", "strict_nodata5": "passes_basic_quality_filter AND max_nodata_percent <= 5"}[s.quality]
    p = f"label_positive_percent > {s.threshold}"
    if s.train == "all":
        return f"SELECT patch_id, '{s.name}' AS filter_set_id, 'all_selected' AS filter_inclusion_group FROM fx_quality WHERE {qual}"
    if s.train == "positive_only":
        return f"SELECT patch_id, '{s.name}', 'positive_only' FROM fx_quality WHERE {qual} AND {p}"
    key = f"concat_ws('|', '{s.name}', 'custom', 'main', patch_id)"
    return f"""SELECT patch_id, '{s.name}', 'train_positive' FROM fx_quality WHERE {qual} AND split = 'train' AND {p}
      UNION ALL SELECT patch_id, '{s.name}', 'eval_quality_all' FROM fx_quality WHERE {qual} AND split <> 'train'
      UNION ALL SELECT patch_id, '{s.name}', 'train_negative_sampled' FROM (SELECT patch_id, row_number() OVER (ORDER BY {h_sql(key, salt="42")}, {key}) AS rn FROM fx_quality WHERE {qual} AND split = 'train' AND NOT {p})
        WHERE rn <= (SELECT round_even(count(*) * {s.ratio}, 0) FROM fx_quality WHERE {qual} AND split = 'train' AND {p})"""


FILTERS = " UNION ALL ".join(_filter_sql(s) for s in Sm.FILTER_SPECS)


@query("filter_sets", FILTERS)
def _(spark, d):
    return Sm.filter_sets(folded(spark, d)).select("patch_id", "filter_set_id", "filter_inclusion_group")


@query(
    "filter_set_overall",
    f"""WITH f AS ({FILTERS}), m AS (SELECT f.filter_set_id, q.* FROM f JOIN fx_quality q USING (patch_id))
      SELECT filter_set_id, count(*) AS total_patches, {", ".join(f"CAST(count(*) FILTER (split = '{r}') AS BIGINT) AS {r}_patches" for r in ("train", "val", "test"))},
      CAST(count(*) FILTER (is_positive_patch) AS BIGINT) AS positive_patches, CAST(count(*) FILTER (NOT is_positive_patch) AS BIGINT) AS negative_patches,
      round(100.0 * count(*) FILTER (is_positive_patch) / count(*), 6) AS positive_patch_percent, count(DISTINCT city) AS cities,
      CAST(count(*) FILTER (split = 'train' AND is_positive_patch) AS BIGINT) AS train_positive_patches, CAST(count(*) FILTER (split = 'train' AND NOT is_positive_patch) AS BIGINT) AS train_negative_patches,
      round(count(*) FILTER (split = 'train' AND NOT is_positive_patch) / CAST(count(*) FILTER (split = 'train' AND is_positive_patch) AS DOUBLE), 6) AS train_negative_to_positive_ratio
      FROM m GROUP BY filter_set_id""",
)
def _(spark, d):
    return rounded(Sm.filter_set_overall(Sm.filter_sets(folded(spark, d))))


def pooled(spark, d):
    flags = rules.pool_flags(*metric_args())
    return fx_metrics(spark, d).where("split = 'train'").select("*", *[c.alias(f"pool_{n}") for n, c in flags.items()])


@query(
    "curriculum_sizes",
    f"""WITH t(pool, quota) AS (VALUES {", ".join(f"('{p}', {q})" for p, q in Sm.allocate(5003, Sm.RECIPES["v2_balanced"]).items())}),
      a AS ({" UNION ALL ".join(f"SELECT '{n}' AS pool, count(*) AS n FROM {METRICS} WHERE split = 'train' AND ({c})" for n, c in zip(rules.POOLS, POOL_SQL))})
      SELECT t.pool AS sample_pool, a.n < quota AS sampled_with_replacement, CAST(quota AS BIGINT) AS rows FROM t JOIN a ON t.pool = a.pool WHERE a.n > 0""",
)
def _(spark, d):
    m = Sm.curriculum(pooled(spark, d), Sm.RECIPES["v2_balanced"], 5003)
    return m.groupBy("sample_pool", "sampled_with_replacement").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "curriculum_unique",
    f"""WITH q(pool, quota) AS (VALUES {", ".join(f"('{p}', {q})" for p, q in Sm.allocate(5000, Sm.RECIPES["v2_conservative"]).items())}),
      a AS ({" UNION ALL ".join(f"SELECT '{n}' AS pool, split, region, city, patch_id FROM {METRICS} WHERE split = 'train' AND ({c})" for n, c in zip(rules.POOLS, POOL_SQL))}),
      p AS (SELECT a.*, quota, row_number() OVER (PARTITION BY a.pool ORDER BY {h_sql("concat_ws('|', a.pool, patch_id)", salt="42")}, concat_ws('|', a.pool, patch_id)) AS pos, count(*) OVER (PARTITION BY a.pool) AS n FROM a JOIN q ON a.pool = q.pool),
      d AS (SELECT s.pool, i AS draw, {h_sql("s.pool", "i", salt="42")} % n + 1 AS pos FROM (SELECT DISTINCT pool, quota, n, unnest(range(1, quota + 1)) AS i FROM p WHERE n < quota) s),
      b AS (SELECT split, region, city, patch_id, pool, pos AS draw, FALSE AS again FROM p WHERE n >= quota AND pos <= quota UNION ALL SELECT split, region, city, patch_id, p.pool, d.draw, TRUE FROM d JOIN p ON p.pool = d.pool AND p.pos = d.pos),
      m AS (SELECT *, printf('v2_conservative_%06d', row_number() OVER (ORDER BY {h_sql("pool", "draw", salt="42:order")}, pool, draw) - 1) AS id FROM b)
      SELECT split, region, city, patch_id, arg_min(pool, id) AS sample_pool, arg_min(again, id) AS sampled_with_replacement, min(id) AS curriculum_row_id FROM m GROUP BY ALL""",
)
def _(spark, d):
    m = Sm.curriculum(pooled(spark, d), Sm.RECIPES["v2_conservative"], 5000, name="v2_conservative")
    one = Sm.unique_manifest(m, ["split", "region", "city", "patch_id"], "curriculum_row_id")
    return one.select("split", "region", "city", "patch_id", "sample_pool", "sampled_with_replacement", "curriculum_row_id")


@query(
    "augment_manifest",
    """SELECT density_class, augmentation, count(*) AS rows FROM (SELECT patch_id, density_class, unnest(['none', 'rot90', 'rot180', 'rot270', 'hflip', 'vflip', 'hflip_rot90', 'vflip_rot90', 'gain_up', 'gain_down', 's1_gain_up', 's1_gain_down'][1:m]) AS augmentation FROM
      (SELECT patch_id, CASE WHEN p <= 0 THEN 0 WHEN p <= 1 THEN 1 WHEN p <= 5 THEN 2 WHEN p <= 20 THEN 3 ELSE 4 END AS density_class, CASE WHEN p <= 0 THEN 1 WHEN p <= 1 THEN 12 WHEN p <= 5 THEN 9 WHEN p <= 20 THEN 7 ELSE 6 END AS m
       FROM (SELECT patch_id, label_positive_percent AS p FROM fx_patch WHERE split = 'train'))) GROUP BY ALL""",
)
def _(spark, d):
    train = fx_patch(spark, d).where("split = 'train'").withColumn("density_class", bins.density_class(F.col("label_positive_percent")))
    m = Sm.augment_manifest(train, F.col("density_class"))
    return m.groupBy("density_class", "augmentation").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "select_random",
    f"SELECT patch_id, city FROM fx_patch ORDER BY {h_sql('patch_id', salt='42')}, patch_id LIMIT 500",
)
def _(spark, d):
    return Sm.select_n(fx_patch(spark, d), "random", 500).select("patch_id", "city")


@query(
    "select_balanced",
    f"""WITH r AS (SELECT patch_id, label_positive_pixels > 0 AS pos, row_number() OVER (PARTITION BY label_positive_pixels > 0 ORDER BY {h_sql("patch_id", salt="42")}, patch_id) AS rn FROM fx_patch)
      SELECT patch_id, pos FROM r WHERE rn <= 300""",
)
def _(spark, d):
    out = Sm.select_n(fx_patch(spark, d), "balanced", 600)
    return out.select("patch_id", (F.col("label_positive_pixels") > 0).alias("pos"))


@query("select_first", "SELECT patch_id, city FROM fx_patch ORDER BY patch_id LIMIT 100")
def _(spark, d):
    return Sm.select_n(fx_patch(spark, d), "first", 100).select("patch_id", "city")


@query(
    "bounded_sample",
    f"""SELECT raster_id, event_id FROM (SELECT *, {h_sql("event_id", salt="42")} AS h FROM fx_pixel) QUALIFY row_number() OVER (PARTITION BY raster_id ORDER BY h) <= 300 ORDER BY h LIMIT 1000""",
)
def _(spark, d):
    return Sm.bounded_sample(fx_pixel(spark, d), ["raster_id"], F.col("event_id"), 300, 1000).select("raster_id", "event_id")


@query(
    "probe_folds",
    """WITH g AS (SELECT region, count(*) AS n, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS q FROM fx_vec GROUP BY region), t AS (SELECT *, sum(p) OVER () - p AS tp, sum(q) OVER () - q AS tq FROM g)
      SELECT region AS heldout_value, n AS test_samples, p AS test_positive, q AS test_negative, CAST(tp AS BIGINT) AS train_positive, CAST(tq AS BIGINT) AS train_negative, CAST(tp + tq AS BIGINT) AS train_samples,
      CASE WHEN n < 95 THEN concat('test_samples=', n, ' < 95') WHEN tp < 5 THEN 'x' WHEN tq < 5 THEN 'x' WHEN p < 50 THEN concat('test_pos=', p, ' < 50') WHEN q < 50 THEN concat('test_neg=', q, ' < 50') ELSE '' END AS skip_reason FROM t""",
)
def _(spark, d):
    return Sp.probe_folds(fx_vec(spark, d), "region", "y", min_test=95, min_test_pos=50, min_test_neg=50)


@query(
    "shuffle_splits",
    f"""WITH r AS (SELECT patch_id, y, rep, row_number() OVER (PARTITION BY rep, y ORDER BY {h_sql("concat_ws(':', rep, patch_id)", salt="42")}, concat_ws(':', rep, patch_id)) AS rn, count(*) OVER (PARTITION BY rep, y) AS n
        FROM fx_vec, (SELECT unnest(range(1, 6)) AS rep)) SELECT patch_id, y, CAST(rep AS INTEGER) AS repeat, CASE WHEN rn <= ceil(n * 0.25) THEN 'test' ELSE 'train' END AS role FROM r""",
)
def _(spark, d):
    return Sp.shuffle_splits(fx_vec(spark, d).select("patch_id", "y"), "y", "patch_id")
