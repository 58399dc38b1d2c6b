"""Operators against brute force on small tables, and their tie, null and skew rules."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapgrid.functions import grid, ordering
from gapgrid.operators import checks, cleaning, evaluation, geometry, network, profiles, stats, users, zones
from gapgrid.params import DEFAULT


def cells(spark, qr):
    return spark.createDataFrame(qr, "q long, r long").select(grid.pack(F.col("q"), F.col("r"), 8).alias("cell"))


def test_running_matches_a_plain_scan_when_split(spark):
    rows = [(float(i % 37), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "v double, k long")
    for ranges in (1, 3, 5000):
        got = {r.k: (r.n, r.s) for r in ordering.running(df, ["v", "k"], "n", {"s": "v"}, ranges=ranges).collect()}
        total = 0.0
        for i, (v, k) in enumerate(sorted(rows), 1):
            total += v
            assert got[k] == (i, total)


def test_ranges_follow_the_order_and_don_t_grow_the_plan(spark):
    df = spark.range(20000).select((F.col("id") * 7919 % 20011).alias("k"), F.lit("x").alias("t"))
    cut = ordering.in_ranges(df, ["k"], 5000)
    spans = sorted((r.a, r.b, r.c) for r in cut.groupBy("_range").agg(F.min("k").alias("a"), F.max("k").alias("b"), F.min("_range").alias("c")).collect())
    assert len(spans) > 4000 and all(x[1] < y[0] and x[2] < y[2] for x, y in zip(spans, spans[1:]))
    plans = [ordering.running(df, ["k"], "n", ranges=r)._jdf.queryExecution().optimizedPlan().toString() for r in (2, 5000)]
    assert abs(len(plans[0]) - len(plans[1])) < 100


def test_hash_rank_is_a_permutation_per_group(spark):
    df = spark.range(500).select(F.col("id").alias("k"), (F.col("id") % 3).alias("g"))
    out = ordering.hash_rank(df, "k", 7, "rn", ["g"]).toPandas()
    for _, part in out.groupby("g"):
        assert sorted(part.rn) == list(range(1, len(part) + 1))


def test_average_ranks(spark):
    df = spark.createDataFrame([(v,) for v in (3.0, 1.0, 3.0, 2.0, 3.0)], "v double")
    assert {r.v: r["rank"] for r in ordering.average_ranks(df, "v").collect()} == {1.0: 1.0, 2.0: 2.0, 3.0: 4.0}


def test_spearman_against_numpy(spark):
    rnd = random.Random(1)
    rows = [(float(rnd.randint(0, 9)), float(rnd.randint(0, 9))) for _ in range(200)]
    df = spark.createDataFrame(rows, "x double, y double")

    def rank(v):
        v = np.array(v)
        return np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])

    a, b = (rank([r[i] for r in rows]) for i in (0, 1))
    assert math.isclose(stats.spearman(df, "x", "y").first()[0], np.corrcoef(a, b)[0, 1], abs_tol=1e-12)


def test_seconds_between_across_slots(spark):
    ts = [0, 0, 5, 59, 61, 400, 400, 100000]
    df = spark.createDataFrame([(1, t) for t in ts] + [(2, 9)], "user_id long, s long").select(
        "user_id", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"))
    want = sorted(b - a for a, b in zip(ts, ts[1:]))
    for slot in (1, 60, 10**6):
        got = users.seconds_between(df, slot).collect()
        assert sorted(itertools.chain.from_iterable([r.seconds] * r.freq for r in got)) == want
        assert {r.user_id for r in got} == {1}


def test_one_query_user_has_no_median_and_no_fast_signal(spark):
    df = spark.createDataFrame([(1, "2024-01-01 00:00:00", -17.4, -66.1, -17.4, -66.2)],
                               "user_id long, t string, lat_orig double, lon_orig double, lat_dest double, lon_dest double")
    out = users.signals_of_trips(df.withColumn("ts", F.col("t").cast("timestamp_ntz"))).first()
    assert out.median_seconds is None and out.s_fast is False and out.anomalous is False


@pytest.mark.parametrize("listed", [[1], []])
def test_null_users_are_never_kept(spark, listed):
    df = spark.createDataFrame([(1,), (2,), (None,)], "user_id long")
    bad = spark.createDataFrame([(u,) for u in listed], "user_id long")
    assert sorted(r.user_id for r in cleaning.exclude_users(df, bad).collect()) == [u for u in (1, 2) if u not in listed]


def test_flow_counts_each_row_once(stages):
    flow = {r.step: r for r in cleaning.filter_flow(stages.steps).collect()}
    raw = stages.trips.count()
    assert flow[0].kept == raw and sum(r.removed for r in flow.values()) + flow[6].kept == raw
    assert flow[6].kept == stages.clean.count()


def test_components_match_flood_fill_and_tie_rule(spark):
    two = [(q, r) for q in range(3) for r in range(3)]
    qr = two + [(q + 10, r + 10) for q, r in two] + [(30, 30)]
    df = cells(spark, qr)
    best = {r.cell for r in geometry.largest_component(df, 1).collect()}
    assert best == {r.cell for r in cells(spark, two).collect()}
    rnd = random.Random(5)
    some = list({(rnd.randint(0, 25), rnd.randint(0, 25)) for _ in range(260)})
    labels = {}
    for r in geometry.component_labels(cells(spark, some), 1).select(grid.cell_q("cell"), grid.cell_r("cell"), "label").collect():
        labels[(r[0], r[1])] = r[2]
    seen, sets = set(), []
    for s in some:
        if s in seen:
            continue
        stack, comp = [s], set()
        seen.add(s)
        while stack:
            q, r = stack.pop()
            comp.add((q, r))
            for dq, dr in ((1, 0), (-1, 0), (0, 1), (0, -1), (1, -1), (-1, 1)):
                n = (q + dq, r + dr)
                if n in labels and n not in seen:
                    seen.add(n)
                    stack.append(n)
        sets.append(comp)
    assert len({labels[s] for s in some}) == len(sets)
    assert all(len({labels[c] for c in comp}) == 1 for comp in sets)


def test_long_chain_is_one_component(spark):
    chain = cells(spark, [(i, 0) for i in range(300)])
    assert geometry.largest_component(chain, 1).count() == 300


def test_hull_holds_every_point(stages):
    ring = geometry.convex_hull(stages.origins)
    for r in stages.origins.collect():
        for a, b in zip(ring, ring[1:] + ring[:1]):
            assert (b[0] - a[0]) * (r.lat - a[1]) - (b[1] - a[1]) * (r.lon - a[0]) > -1e-9


@pytest.mark.parametrize("ring", [[(-66.2, -17.4)], [(-66.2, -17.4), (-66.1, -17.4)], [(-66.2, -17.4), (-66.1, -17.45), (-66.1, -17.35)]])
def test_area_closed_forms_against_sampling(spark, ring):
    area = geometry.make_area(ring, 2000.0)
    xs, ys = [p[0] for p in area.ring_xy], [p[1] for p in area.ring_xy]
    n, pad = 400, 2500.0
    gx, gy = np.meshgrid(np.linspace(min(xs) - pad, max(xs) + pad, n), np.linspace(min(ys) - pad, max(ys) + pad, n))
    inside = np.zeros(gx.shape, bool)
    solid = np.ones(gx.shape, bool)
    for (x1, y1), (x2, y2) in zip(area.ring_xy, area.ring_xy[1:] + area.ring_xy[:1]):
        solid &= (x2 - x1) * (gy - y1) - (y2 - y1) * (gx - x1) >= 0
        size = (x2 - x1) ** 2 + (y2 - y1) ** 2
        t = np.clip(((gx - x1) * (x2 - x1) + (gy - y1) * (y2 - y1)) / size, 0, 1) if size else 0
        inside |= np.hypot(gx - x1 - t * (x2 - x1), gy - y1 - t * (y2 - y1)) < 2000
    inside |= solid & (len(ring) > 2)
    cell = (gx[0, 1] - gx[0, 0]) * (gy[1, 0] - gy[0, 0]) / 1e6
    km2, cx, cy, _ = geometry.area_parts(area)
    assert abs(km2 - inside.sum() * cell) / km2 < 0.01
    assert abs(cx - gx[inside].mean()) < 60 and abs(cy - gy[inside].mean()) < 60


def test_both_forms_of_the_area_test_agree(spark):
    rnd = random.Random(8)
    df = spark.createDataFrame([(rnd.uniform(-66.25, -66.05), rnd.uniform(-17.5, -17.3)) for _ in range(2000)], "lon double, lat double")
    for ring in ([(-66.2, -17.4)], [(-66.2, -17.4), (-66.1, -17.4)], [(-66.2, -17.4), (-66.1, -17.45), (-66.1, -17.35)]):
        area = geometry.make_area(ring, 1500.0)
        out = geometry.add_inside(df, area, "lat", "lon", "a").withColumn("b", geometry.within_area(area))
        assert out.where("a <> b").isEmpty() and 0 < out.where("a").count() < 2000


def test_nearest_distance_is_exact_near_and_far(spark):
    rnd = random.Random(2)
    tgt = [(rnd.uniform(0, 5000), rnd.uniform(0, 5000)) for _ in range(300)] + [(1.0, 1.0)] * 5
    pts = [(i, rnd.uniform(-3000, 9000), rnd.uniform(-3000, 9000)) for i in range(200)] + [(999, 250000.0, -90000.0), (1000, 1.0, 1.0)]
    got = {r.k: r.distance for r in network.nearest_distance(
        spark.createDataFrame(pts, "k long, x double, y double"), spark.createDataFrame(tgt, "x double, y double"), "k").collect()}
    for k, x, y in pts:
        assert math.isclose(got[k], min(math.hypot(x - a, y - b) for a, b in tgt), abs_tol=1e-9)


def test_densify_keeps_both_ends_and_skips_single_points(spark):
    shapes = spark.createDataFrame([(1, 1, -17.40, -66.10), (1, 2, -17.41, -66.10), (1, 3, -17.41, -66.12), (2, 1, -17.4, -66.1)],
                                   "shape_id long, seq int, lat double, lon double")
    out = network.densify_polyline(shapes, 50.0).orderBy("i").collect()
    seg = {r.seq: r for r in network.segments(shapes).where("shape_id = 1").collect()}
    total = seg[3].upto
    assert {r.shape_id for r in out} == {1} and len(out) == max(2, int(total / 50))
    assert (out[0].x, out[0].y) == (seg[1].x, seg[1].y)
    assert math.isclose(out[-1].x, seg[3].x, abs_tol=1e-6) and math.isclose(out[-1].y, seg[3].y, abs_tol=1e-6)
    gaps = [math.hypot(b.x - a.x, b.y - a.y) for a, b in zip(out, out[1:])]
    assert max(gaps) <= total / (len(out) - 1) + 1e-6


def test_copies_of_a_shape_are_sampled_once(spark, monkeypatch):
    a, b, c = (-17.40, -66.10), (-17.41, -66.10), (-17.41, -66.12)
    lines = {5: [a, b, c], 3: [a, b, c], 9: [a, c, b], 4: [a, b], 7: [a, a], 8: [b, b], 6: [a, b, c], 2: [c]}
    shapes = spark.createDataFrame([(k, i, *v) for k, vs in lines.items() for i, v in enumerate(vs)], "shape_id long, seq int, lat double, lon double")
    whole, seen = network.densify_polyline(shapes, 50.0).select("x", "y").distinct().collect(), []
    plain = network.densify_polyline
    monkeypatch.setattr(network, "densify_polyline", lambda s, *rest: seen.append(s) or plain(s, *rest))
    got = network.network_points(shapes).collect()
    near = lambda rows: sorted((round(r.x, 6), round(r.y, 6)) for r in rows)
    assert near(got) == near(whole)
    assert {r.shape_id for r in seen[0].collect()} == {2, 3, 4, 7, 8, 9}
    assert network.network_points(shapes.limit(0)).isEmpty()


def test_lengths_do_not_depend_on_the_slices(stages, monkeypatch):
    key = ["shape_id", "seq"]
    a = network.segments(stages.shapes).select(*key, "upto", "before").collect()
    monkeypatch.setattr(network, "SLICE", 3)
    b = {(r.shape_id, r.seq): r for r in network.segments(stages.shapes).collect()}
    assert len(a) == len(b)
    for r in a:
        o = b[r.shape_id, r.seq]
        assert math.isclose(r.upto, o.upto, abs_tol=1e-6) and math.isclose(r.before, o.before, abs_tol=1e-6)
    last = None
    for r in sorted(b.values(), key=lambda r: (r.shape_id, r.seq)):
        assert r.before == (last.upto if last and last.shape_id == r.shape_id else 0.0)
        last = r


def test_repaired_labels_are_counted_together(spark):
    rows = [(1, "Chimor\u00c3\u00a9")] * 2 + [(1, "Chimor\u00e9")] * 2 + [(1, "Sacaba")] * 3
    r = zones.modal_label(spark.createDataFrame(rows, "cell long, muni string")).first()
    assert (r.label, r.modal_queries, r.total_queries) == ("Chimor\u00e9", 4, 7)


@pytest.mark.parametrize("per_range", [5, 10_000])
def test_quantiles_equal_numpy(spark, monkeypatch, per_range):
    import numpy as np

    monkeypatch.setattr(ordering, "ROWS_PER_RANGE", per_range)
    rnd = random.Random(8)
    rows = [(rnd.choice("abc"), rnd.choice([None, 1.0, 2.5, rnd.gauss(0, 9)])) for _ in range(400)] + [("d", 4.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    qs = {"lo": 0.0, "q1": 0.25, "m": 0.5, "p9": 0.987, "hi": 1.0}
    for r in ordering.quantiles(df, "v", qs, ["g"]).collect():
        own = [v for g, v in rows if g == r.g and v is not None]
        assert all(math.isclose(r[n], np.quantile(own, q), abs_tol=1e-9) for n, q in qs.items())
    r = ordering.quantiles(df, "v", qs).first()
    assert all(math.isclose(r[n], np.quantile([v for _, v in rows if v is not None], q), abs_tol=1e-9) for n, q in qs.items())


def test_share_near_network_by_brute_force(spark):
    rnd = random.Random(3)
    x, y = network.project_xy("lat", "lon", DEFAULT)
    o = [(-17.39 + rnd.uniform(-.03, .03), -66.15 + rnd.uniform(-.03, .03), rnd.randint(1, 5)) for _ in range(150)]
    t = spark.createDataFrame([(-17.39 + rnd.uniform(-.03, .03), -66.15 + rnd.uniform(-.03, .03)) for _ in range(25)], "lat double, lon double")
    targets = t.select(x.alias("x"), y.alias("y"))
    df = spark.createDataFrame(o, "lat double, lon double, n long")
    pts, tgt = df.select(x.alias("x"), y.alias("y"), "n").collect(), targets.collect()
    near = sum(p.n for p in pts if min(math.hypot(p.x - q.x, p.y - q.y) for q in tgt) <= DEFAULT.coverage_m)
    assert math.isclose(network.share_near_network(df, targets).first()[0], near / sum(p.n for p in pts) * 100)


def test_modal_label_ties_and_nulls(spark):
    rows = [(1, "b"), (1, "a"), (2, None), (2, "z"), (3, "x"), (3, "x"), (3, None)]
    out = {r.cell: (r.label, r.modal_queries, r.total_queries) for r in zones.modal_label(spark.createDataFrame(rows, "cell long, muni string")).collect()}
    assert out == {1: ("a", 1, 2), 2: (None, 1, 2), 3: ("x", 2, 3)}


def test_nearest_label_votes_in_the_first_labelled_ring(spark):
    base = cells(spark, [(0, 0)])
    lab = spark.createDataFrame([(2, 0, "b"), (0, 2, "a"), (-2, 0, "b"), (0, 3, "c"), (3, 0, "c")], "q long, r long, label string").select(
        grid.pack(F.col("q"), F.col("r"), 8).alias("cell"), "label")
    assert zones.nearest_label(base, lab, 30).first().label == "b"
    assert zones.nearest_label(base, lab, 1).count() == 0


def test_deciles_differ_from_ntile(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(23)], "cell long, expected double")
    out = [r.decile for r in evaluation.rank_first_deciles(df, "expected", "cell").orderBy("cell").collect()]
    edges = [1 + 22 * i / 10 for i in range(11)]
    want = [max(1, next(i for i in range(1, 11) if rank <= edges[i] + 1e-12)) for rank in range(1, 24)]
    assert out == want


def test_draw_rounds_half_even(spark):
    blocks = spark.createDataFrame([(i, "A1") for i in range(10)] + [(100 + i, "A2") for i in range(2)], "block_id long, distance_ring string")
    n = {r.distance_ring: r["count"] for r in zones.stratified_block_draw(blocks, 0.25, 1).groupBy("distance_ring").count().collect()}
    assert n == {"A1": 2, "A2": 1}  # 2.5 → 2, 0.5 → 0 → at least one


def test_gini_and_cliff_against_brute_force(spark):
    v = [0, 0, 0, 1, 5, 5, 9, 40]
    df = spark.createDataFrame([(i, x, i % 2) for i, x in enumerate(v)], "cell long, v long, g int")
    s = np.sort(np.array(v, float))
    assert math.isclose(stats.gini(df, "v").first()[0], (len(v) + 1 - 2 * (np.cumsum(s) / s.sum()).sum()) / len(v), abs_tol=1e-12)
    assert stats.gini(df.where("v = 0"), "v").first()[0] == 0.0
    a, b = np.array(v[0::2]), np.array(v[1::2])
    want = (a[:, None] > b).mean() - (a[:, None] < b).mean()
    assert math.isclose(stats.cliffs_delta(df, "v", "g", 0, 1).first()[0], want, abs_tol=1e-12)


def test_island_has_no_weights_and_its_own_label(spark):
    df = cells(spark, [(0, 0), (1, 0), (0, 1), (50, 50)]).withColumn("y", F.rand(3))
    island = cells(spark, [(50, 50)]).first().cell
    assert island not in {r.src for r in stats.hex_weights(df).collect()}
    out = {r.cell: r for r in stats.lisa_clusters(df, "y", 19, 1).collect()}
    assert out[island].cluster == "sin vecinas" and out[island].p_value is None
    assert len(out) == 4


@pytest.mark.parametrize("per_range", [7, 1 << 18])
def test_lisa_p_values_against_numpy_draws(spark, monkeypatch, per_range):
    """The spatial draws are random, so compare p-values with an independent simulation, not draw by draw."""
    monkeypatch.setattr(stats, "VALUES_PER_RANGE", per_range)
    rnd = random.Random(4)
    qr = [(q, r) for q in range(6) for r in range(6)]
    df = spark.createDataFrame([(q, r, float(q > 2) * 3 + rnd.random()) for q, r in qr], "q long, r long, y double").select(
        grid.pack(F.col("q"), F.col("r"), 8).alias("cell"), grid.cell_q(grid.pack(F.col("q"), F.col("r"), 8)).alias("q"), "r", "y")
    perms = 499
    got = {(r.q, r.r): r for r in stats.lisa_clusters(df, "y", perms, 1).join(df.select("cell", "q", "r"), "cell").collect()}
    vals = {(r.q, r.r): r.y for r in df.collect()}
    mean = np.mean(list(vals.values()))
    gen = np.random.default_rng(0)
    for (q, r), row in got.items():
        nb = [(q + a, r + b) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1), (1, -1), (-1, 1)) if (q + a, r + b) in vals]
        z = vals[(q, r)] - mean
        obs = z * np.mean([vals[n] - mean for n in nb])
        rest = np.array([v - mean for c, v in vals.items() if c != (q, r)])
        sims = np.array([z * gen.choice(rest, len(nb), replace=False).mean() for _ in range(perms)])
        larger = (sims >= obs).sum()
        assert abs((min(larger, perms - larger) + 1) / (perms + 1) - row.p_value) < 0.12


def test_checks_see_violations(spark):
    df = spark.createDataFrame([(1, 2.0, None), (1, -1.0, "x")], "k int, v double, s string")
    assert checks.check_unique(df, ["k"]).first().violations == 1
    assert checks.check_no_nulls(df).first().violations == 1
    assert checks.check_range(df, "v", 0).first().violations == 1
    assert checks.check_domain(df, "s", ["x"]).first().violations == 1
    assert checks.check_disjoint(df, df, ["k"]).first().violations == 1
    assert checks.set_equal(df, df.limit(1), ["v"]).first().violations == 1
    assert checks.check_no_leak(df.selectExpr("'v' AS parameter"), ["v"], ["v"]).first().violations == 1
    assert checks.check_roundtrip(df, df.limit(1)).first().violations == 1


def test_null_keys_count_as_equal_duplicates(spark):
    df = spark.createDataFrame([(None, 1), (None, 1), (2, 1)], "a int, b int")
    assert profiles.duplicate_profile(df, {"d": ["a", "b"]}).first().surplus == 1


def test_no_gap_gives_nulls(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-01-01 00:00:00' ts UNION ALL SELECT timestamp_ntz'2024-01-09 00:00:00'")
    weeks = profiles.weekly_coverage(df)
    assert weeks.count() == 2 and profiles.gap_bounds(weeks).first().gap_start is None


def test_area_variants_grow_with_radius(stages):
    rows = {r.variant: r for r in geometry.area_variants(stages.origins, (None, 1), DEFAULT).collect()}
    assert rows["component k=1"].cells <= rows["all cells"].cells and rows["component k=1"].area_km2 <= rows["all cells"].area_km2


def test_ring_distance_and_labels_by_brute_force(spark):
    rnd = random.Random(11)
    dist = lambda a, b: (abs(a[0] - b[0]) + abs(a[1] - b[1]) + abs(a[0] + a[1] - b[0] - b[1])) // 2
    for k_max, spread, n in ((30, 60, 25), (3, 9, 20), (1, 3, 8)):
        every = sorted({(rnd.randint(-spread, spread), rnd.randint(-spread, spread)) for _ in range(6 * n)})
        lab, todo = {c: rnd.choice("abc") for c in every[::5]}, [c for i, c in enumerate(every) if i % 5]
        ids = {r.cell: (r.q, r.r) for r in spark.createDataFrame(every, "q long, r long").select("q", "r", grid.pack(F.col("q"), F.col("r"), 8).alias("cell")).collect()}
        back = {v: k for k, v in ids.items()}
        known = spark.createDataFrame([(back[c], x) for c, x in lab.items()] + [(back[todo[0]], None)], "cell long, label string")
        got = {ids[r.cell]: r.label for r in zones.nearest_label(cells(spark, todo), known, k_max).collect()}
        want = {}
        for c in todo:
            near = min(dist(c, x) for x in lab)
            if near <= k_max:
                votes = [v for x, v in lab.items() if dist(c, x) == near]
                want[c] = min(votes, key=lambda v: (-votes.count(v), v))
        assert got == want


def test_copies_are_merged_and_the_rest_passes(spark):
    rnd = random.Random(12)
    rows = [(rnd.choice([None, 1, 2]), rnd.choice([0.0, -0.0, 1.5, None]), rnd.choice("xy"), f"f{rnd.randint(0, 3)}") for _ in range(60)]
    rows += [(i, float(i), "z", "f9") for i in range(100, 200)] + [(500, 1.0, "hot", f"f{i % 7}") for i in range(300)]
    df = spark.createDataFrame(rows, "a long, b double, c string, source_file string")
    want = {}
    for a, b, c, f in rows:
        key = (a, b if b is None else b + 0.0, c)
        n, low = want.get(key, (0, f))
        want[key] = (n + 1, min(low, f))
    got = {(r.a, r.b if r.b is None else r.b + 0.0, r.c): (r.copies, r.source_file) for r in cleaning.first_distinct(df).collect()}
    assert got == want and cleaning.first_distinct(df).count() == len(want)
    some = cleaning.first_distinct(df, among=F.col("c") != "hot")
    assert some.where("c = 'hot'").count() == 300 and some.where("c <> 'hot'").count() == len(want) - 1
    assert cleaning.first_distinct(df.limit(0)).count() == 0


def test_area_test_stays_compiled(spark):
    """The generated code doesn't grow with the edges of the area: methods of over 8,000 bytes are left to the interpreter by the JVM."""
    def sizes(n):
        ring = [(-66.157 + 0.05 * math.cos(2 * math.pi * k / n), -17.394 + 0.05 * math.sin(2 * math.pi * k / n)) for k in range(n)]
        area = geometry.make_area(ring, 1000.0)
        rows = spark.range(10).select((F.lit(-17.45) + F.col("id") * 0.02).alias("lat"), (F.lit(-66.2) + F.col("id") * 0.01).alias("lon"))
        units = geometry.add_inside(rows, area, "lat", "lon", "inside").agg(F.count_if("inside"))._jdf.queryExecution().debug().codegenToSeq()
        return [units.apply(i)._3().maxMethodCodeSize() for i in range(units.size())]

    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that the plan is there before it runs
    try:
        for n in (13, 60):  # before: 12,865 bytes, and a method that is too large for the class file (-1)
            assert sizes(n) and all(0 < s < 8000 for s in sizes(n))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_area_test_equals_plain_arithmetic(spark):
    """Rings of no, one, two and many vertices, with a vertex twice, against the distance to each segment."""
    rnd = random.Random(5)
    pts = [(i, rnd.uniform(-3000, 3000), rnd.uniform(-3000, 3000)) for i in range(400)] + [(400, 0.0, 0.0), (401, None, None)]
    df = spark.createDataFrame(pts, "id int, px double, py double")
    ring = [(-900.0, -800.0), (1000.0, -700.0), (1000.0, -700.0), (1100.0, 900.0), (-300.0, 1200.0)]
    for xy in ([], ring[:1], ring[:2], ring):
        area = geometry.StudyArea(tuple(xy), tuple(xy), 500.0)
        got = {r.id: r.v for r in df.select("id", geometry._inside(area, F.col("px"), F.col("py")).alias("v")).collect()}
        for i, x, y in pts[:-1]:
            edges = list(zip(xy, xy[1:] + xy[:1]))
            solid = len(edges) > 2 and all((b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) >= 0 for a, b in edges)
            near = []
            for a, b in edges:
                n = (b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2
                t = max(0.0, min(1.0, ((x - a[0]) * (b[0] - a[0]) + (y - a[1]) * (b[1] - a[1])) / n)) if n else 0.0
                near.append(math.hypot(x - a[0] - t * (b[0] - a[0]), y - a[1] - t * (b[1] - a[1])))
            assert got[i] == (solid or min(near, default=math.inf) < 500.0), (len(xy), i)
        assert not got[401]
