"""Places in numbers: names that thousands share, crowds far away, and countries full of cities."""

from __future__ import annotations

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from agro_jobs.operators import grids, places
from agro_jobs.plans import catalogue
from tests.oracle import connect, rows


def km(a, b, c, d):
    return math.sqrt(((b - d) * math.cos(math.radians((a + c) / 2)) * 111.32) ** 2 + ((a - c) * 111.32) ** 2)


def test_far_points_look_at_few_spots(spark):
    """A crowd on another continent used to be paired with every point that is far from all."""
    rnd = random.Random(7)
    crowd = [(i, 20 + rnd.random(), 77 + rnd.random()) for i in range(3000)] + [(9000 + i, 20.5, 77.5) for i in range(500)]
    far = [(i, rnd.uniform(-60, -10), rnd.uniform(-150, 60)) for i in range(200)] + [(500, 20.5, 77.5), (501, None, 3.0), (502, float("nan"), 3.0), (503, 89.9, 179.0), (504, -90.0, -180.0)]
    spots, points = spark.createDataFrame(crowd, "id long, lat double, lon double"), spark.createDataFrame(far, "point_id long, lat double, lon double")
    got = {r["point_id"]: (r["id"], r["km"]) for r in places.nearest_place(points, spots).collect()}
    want = {p: (lambda m: (m[1], m[0]))(min((round(km(a, b, c, d), 6), i) for i, c, d in crowd)) for p, a, b in far if a is not None and a == a}
    assert {p: i for p, (i, _) in got.items()} == {p: i for p, (i, _) in want.items()} | {501: None, 502: None}
    assert all(abs(got[p][1] - k) < 2e-6 for p, (_, k) in want.items())
    each = spots.selectExpr("0 AS kind", "lat AS lat2", "lon AS lon2", "id AS item").dropDuplicates(["lat2", "lon2"])
    met = grids._found(points.where("point_id < 500").selectExpr("0 AS kind", "lat", "lon"), each, F.lit(0.0), None, True)
    assert met.count() < 200 * 100  # of 600,200 pairs


def greedy(cities, most):
    names, countries, out = set(), {}, set()
    for i, name, country, _ in sorted(cities, key=lambda c: (-(c[3] if c[3] is not None else -math.inf), c[0])):
        if name.lower() not in names and countries.get(country, 0) < most:
            names.add(name.lower())
            countries[country] = countries.get(country, 0) + 1
            out.add(i)
    return out


def test_full_countries_refuse_all_smaller_cities_at_once(spark, monkeypatch):
    rnd, schema = random.Random(4), "id long, name string, country int, population long"
    for n, names, most in ((400, 60, 4), (300, 9, 2), (50, 50, 1)):
        cities = [(i, f"{rnd.choice('Cc')}ity {rnd.randrange(names)}", rnd.choice([None, 1, 2, 3, 4, 5]), rnd.choice([None, *range(40)])) for i in range(n)]
        assert {r["id"] for r in places.capped_cities(spark.createDataFrame(cities, schema), most).collect()} == greedy(cities, most)
    # Names that all want into one full country with one small city after the other: these were rounds, one each.
    crowd = [(0, "a", 1, 1000)] + [(1 + i, "b", 1, 500 - i) for i in range(60)] + [(100 + i, f"n{i}", 1 + i % 2, 900 - i) for i in range(40)]
    writes, real = [], places.written
    monkeypatch.setattr(places, "written", lambda *a: writes.append(a[1]) or real(*a))
    assert {r["id"] for r in places.capped_cities(spark.createDataFrame(crowd, schema), 1).collect()} == greedy(crowd, 1)
    assert len(writes) < 12


def test_geo_match_against_brute_force(spark):
    rnd = random.Random(9)
    codes = [(i, rnd.choice(["Agra", "agra ", "Élan"]), rnd.choice([None, "AGRA", "elan"]), rnd.choice(["a", "b", None]), rnd.uniform(20, 30), rnd.uniform(70, 80), rnd.choice([None, *range(50)])) for i in range(900)]
    asked = [(i, rnd.choice(["agra", "Elan", "Pune"]), rnd.choice(["a", "b", "c", None]), rnd.uniform(18, 32), rnd.uniform(68, 82)) for i in range(300)]
    a = spark.createDataFrame(asked, "id long, name string, class string, lat double, lon double")
    b = spark.createDataFrame(codes, "id long, name string, ascii string, class string, lat double, lon double, population long")
    fold = {"Agra": "agra", "agra ": "agra", "Élan": "elan", "AGRA": "agra", "elan": "elan", "agra": "agra", "Elan": "elan", "Pune": "pune"}
    for radius in (60.0, 400.0):
        want = {}
        for i, name, of, lat, lon in asked:
            near = [(of and c[3] and (c[3] == of), c, km(lat, lon, c[4], c[5])) for c in codes if fold[name] in (fold[c[1]], fold[c[2] or c[1]])]
            near = [((-1 if of is None or c[3] is None else int(right), -1 if c[6] is None else c[6], -c[0]), c[0]) for right, c, k in near if k <= radius]
            if near:
                want[i] = max(near)[1]
        got = {r["id"]: r["code_id"] for r in places.geo_match(a, b, radius).collect()}
        assert got == want
    each = b.select(F.lit(0).alias("kind"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), F.struct("population", (-F.col("id")).alias("first")).alias("item"))
    assert grids._found(a.selectExpr("0 AS kind", "lat", "lon"), each, F.lit(0.0), 400.0, False).count() < 270_000 / 4


@pytest.fixture(scope="module")
def namesakes(spark, data, tmp_path_factory):
    """30,000 parts of two names: half a billion pairs of namesakes."""
    at = tmp_path_factory.mktemp("namesakes")
    name = "CASE id % 2 WHEN 0 THEN 'red bolt' ELSE 'Red bolt north' END AS p_name"
    some = spark.range(30_000).selectExpr("id AS p_partkey", name, "'Brand#' || id % 3 AS p_brand", "CASE WHEN id % 5 = 0 THEN 'redbox' ELSE 'LARGE' END AS p_type", "CAST(1 AS INT) AS p_size", "CAST(1 AS DOUBLE) AS p_retailprice")
    some.write.parquet(f"{at}/part.parquet")
    return str(at)


def test_qualified_namesakes(spark, namesakes):
    begun = time.time()
    got = {r["span_id"]: (r["n"], r["first"]) for r in catalogue.QUERIES["resolve_qualified"](spark, namesakes).collect()}
    assert time.time() - begun < 100
    # 0: name and brand; 1: name and type; 2: nowhere (the name cut off its last word is no help); 3: the name.
    want = {}
    for i in range(30_000):
        mine = [j for j in range(i % 2, 30, 2) if i % 4 == 3 or (i % 4 == 0 and j % 3 == i % 3) or (i % 4 == 1 and (j % 5 == 0) == (i % 5 == 0))]
        if i % 4 != 2:
            want[i] = (len(mine) * 1000, mine[0])
    assert got == want


def test_qualified_rows_are_all_that_fit(spark):
    known = [(1, "Rampur", "UP", "Rampur"), (2, "rampur", "Bihar", "UP"), (3, "rampur", None, "Gaya"), (4, "gaya", "Bihar", None)]
    gazetteer = spark.createDataFrame(known, "id long, name string, state string, district string")
    said = ["Rampur, up", "rampur gaya", "rampur", "rampur,", "rampur xyz", "in gaya", "Rampur, Uttar P", None, "gaya, bihar!"]
    spans = spark.createDataFrame(list(enumerate(said)), "span_id long, span string")
    got = {}
    for r in places.resolve_qualified(spans, gazetteer, {"uttar p": "UP"}).collect():
        got.setdefault((r["span_id"], r["head"], r["qualifier"]), set()).add(r["id"])
    assert got == {(0, "rampur", "up"): {1, 2}, (1, "rampur", "gaya"): {3}, (2, "rampur", None): {1, 2, 3}, (3, "rampur", None): {1, 2, 3}, (6, "rampur", "uttar p"): {1}, (8, "gaya", "bihar"): {4}}


def test_exact_namesakes(spark, namesakes):
    begun = time.time()
    got = {r["span_id"]: (r["head"], r["n"], r["first"]) for r in catalogue.QUERIES["resolve_exact"](spark, namesakes).collect()}
    assert time.time() - begun < 100
    want = {}
    for i in range(30_000):  # with " north", six letters of it, with ", somewhere"
        if i % 3 != 1:
            odd = i % 2 == 1 or i % 3 == 0
            want[i] = ("red bolt north" if odd else "red bolt", 15_000, int(odd))
            if i % 2 == 1 and i % 3 == 0:  # "red bolt north north" is cut after its third word
                want[i] = ("red bolt north", 15_000, 1)
    assert got == want


def test_exact_rows_are_all_of_a_name(spark):
    gazetteer = spark.createDataFrame([(1, "Agra"), (2, "agra"), (3, "agra fort"), (4, "delhi")], "id long, name string")
    spans = spark.createDataFrame([(0, "Agra Fort, UP"), (1, "agra x y"), (2, "AGRA"), (3, "nowhere"), (4, None), (5, "AGRA")], "span_id long, span string")
    got = sorted((r["span_id"], r["head"], r["id"]) for r in places.resolve_exact(spans, gazetteer).collect())
    assert got == [(0, "agra fort", 3), (1, "agra", 1), (1, "agra", 2), (2, "agra", 1), (2, "agra", 2), (5, "agra", 1), (5, "agra", 2)]
    assert places.known_heads(spans, gazetteer).count() == 4


def test_ranked_namesakes(spark, namesakes):
    begun = time.time()
    got = {r["span_id"]: (r["best"], r["ambiguous"]) for r in catalogue.QUERIES["resolve_rank_ambiguous"](spark, namesakes).collect()}
    assert time.time() - begun < 100
    # The broadest level of the even names is the state, of the odd ones the district; both stand in several states.
    assert set(got.values()) <= {(0, True), (1, True)} and len(got) >= 20_000
    assert all(best == (i % 2) for i, (best, _) in got.items() if i % 3 == 2)


def test_most_local_names_in_a_crowd(spark):
    rnd = random.Random(11)
    levels = [*places.LEVEL_RANK, "odd", None]
    crowd = [(i, rnd.choice([f"p{i}", f"p{i} (CT)", "(x)", None]), rnd.choice(levels), 20 + rnd.random(), 77 + rnd.random()) for i in range(800)] + [(2000 + i, f"q{i}", "village", 20.5, 77.5) for i in range(400)]
    points = [(i, 19.8 + 1.5 * rnd.random(), 76.8 + 1.5 * rnd.random()) for i in range(150)] + [(900, 20.5, 77.5), (901, -40.0, 10.0), (902, None, None)]
    a, b = spark.createDataFrame(points, "point_id long, lat double, lon double"), spark.createDataFrame(crowd, "id long, name string, level string, lat double, lon double")
    for within in (4.0, 25.0):
        want = {}
        for p, lat, lon in points:
            near = [((-places.LEVEL_RANK.get(c[2], -1), round(km(lat, lon, c[3], c[4]), 6), c[0]), c[1]) for c in crowd if lat is not None]
            name = min(((k, n) for k, n in near if k[1] <= within), key=lambda x: x[0], default=(None, None))[1]
            want[p] = (name or "").replace(" (CT)", "").replace("(x)", "") or "your location"
        assert {r["point_id"]: r["name"] for r in places.named_point(a, b, within=within).collect()} == want
    at, spots = a.selectExpr("0 AS kind", "lat", "lon"), b.selectExpr("0 AS kind", "lat AS lat2", "lon AS lon2", "id AS item")
    assert grids.nearest(at, spots, 25.0).count() <= len(points)
    met = grids._found(at.dropna(), spots.dropDuplicates(["lat2", "lon2"]), F.lit(0.0), 25.0, True)
    assert met.count() < 150 * 60  # places meet points after the copies of a spot are one, and no farther than the nearest may be


def test_chains_are_not_sent_to_the_driver(spark, monkeypatch):
    plans, real = [], places.written
    monkeypatch.setattr(places, "written", lambda rows, name: plans.append(rows._jdf.queryExecution().executedPlan().toString()) or real(rows, name))
    tree = spark.range(1, 40).selectExpr("id", "CASE WHEN id > 1 THEN id DIV 2 END AS parent_id", "'n' || id AS name")
    got = {r["id"]: r["chain"] for r in places.chains(tree).collect()}
    assert got[39] == ["n19", "n9", "n4", "n2", "n1"] and got[1] == [] and len(got) == 39
    assert len(plans) > 2 and not any("Broadcast" in p for p in plans)
