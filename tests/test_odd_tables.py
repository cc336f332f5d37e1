"""Queries against their SQL on small tables made for what the test tables lack: edges, copies, crowded places."""

from concurrent.futures import ThreadPoolExecutor

import duckdb
import numpy as np
import pytest

from terrafold.operators import match, near
from terrafold.plans import catalog
from tests.test_queries import plain

SF = "/root/testdata/sf0.001"


@pytest.fixture
def made(tmp_path):
    """made(name=SQL over sf0.001's tables): a folder of those tables, written by DuckDB."""

    def write(**tables):
        con = duckdb.connect()
        for t in ("lineitem", "supplier", "customer", "embeddings"):
            con.sql(f"CREATE VIEW old_{t} AS SELECT * FROM '{SF}/{t}.parquet'")
        for t, sql in tables.items():
            con.sql(f"COPY ({sql}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
        return str(tmp_path)

    return write


def equals_sql(spark, name, where, tables):
    con = duckdb.connect()
    for t in tables:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{where}/{t}.parquet'")
    want = con.sql(catalog.ORACLE_SQL[name])
    df = catalog.QUERIES[name](spark, where).select(*want.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.collect()), key=str)
    assert got and got == sorted((tuple(plain(v) for v in r) for r in want.fetchall()), key=str)


def lines(rows):
    """SQL of lineitem rows: (partkey, suppkey, quantity, discount, tax), an order each."""
    values = ", ".join(f"({k}, {a}, {b}, {q}, {c}, {t})" for k, (a, b, q, c, t) in enumerate(rows))
    return f"SELECT CAST(v.k AS BIGINT) AS l_orderkey, CAST(v.a AS BIGINT) AS l_partkey, CAST(v.b AS BIGINT) AS l_suppkey, CAST(v.q AS DOUBLE) AS l_quantity, CAST(v.c AS DOUBLE) AS l_discount, CAST(v.t AS DOUBLE) AS l_tax, o.* EXCLUDE (l_orderkey, l_partkey, l_suppkey, l_quantity, l_discount, l_tax) FROM (VALUES {values}) v(k, a, b, q, c, t), (SELECT * FROM old_lineitem LIMIT 1) o"


def test_points_on_the_lassos_edge_are_outside(spark, made):
    # (2 x - 100) / (z + 60) is -0.505 at x = 29.8, z = 20, as is that of y.
    where = made(lineitem=lines([(29, 50, 20, 0.08, 0), (50, 29, 20, 0, 0.08), (50, 50, 20, 0, 0), (65, 50, 40, 0, 0)]))
    equals_sql(spark, "screen_rules", where, ["lineitem"])


def within(spark, seconds, job):
    """What job gives, if it does in that time."""
    with ThreadPoolExecutor(1) as pool:
        run = pool.submit(job)
        try:
            return run.result(timeout=seconds)
        except TimeoutError:
            spark.sparkContext.cancelAllJobs()
            raise


#: 40,000 points at one place, orders even and odd in turn, and three a step away.
CROWD = "SELECT CAST(k AS BIGINT) AS l_orderkey, CAST(50 AS BIGINT) AS l_partkey, CAST(CASE WHEN k < 40000 THEN 50 ELSE 51 END AS BIGINT) AS l_suppkey, 20.0::DOUBLE AS l_quantity, 0.0::DOUBLE AS l_discount, 0.0::DOUBLE AS l_tax, o.* EXCLUDE (l_orderkey, l_partkey, l_suppkey, l_quantity, l_discount, l_tax) FROM range(40003) t(k), (SELECT * FROM old_lineitem LIMIT 1) o"


@pytest.mark.parametrize(
    "name, rows, told",
    [
        ("covariance_normals", 40003, "n = 40003"),
        ("cloud_normals", 40003, "nz = 1 and planarity is null"),
        ("radius_neighbours", 40003, "n = 40002 and nearest = 0"),
        ("cloud_distance", 20002, "distance = 0"),
        ("outlier_filter", 40000, "pid < 40000 * 64"),
        ("filter_chain", 40000, "pid < 40000 * 64"),
    ],
)
def test_a_crowded_place_is_not_a_square_of_pairs(spark, made, name, rows, told):
    where = made(lineitem=CROWD)
    out = within(spark, 60, lambda: catalog.QUERIES[name](spark, where).selectExpr("pid", f"{told} AS told").collect())
    assert len(out) == len({r.pid for r in out}) == rows and all(r.told for r in out)


@pytest.mark.parametrize("name", ["covariance_normals", "radius_neighbours", "cloud_distance", "outlier_filter", "filter_chain"])
def test_copies_of_points_equal_sql(spark, made, name):
    where = made(lineitem="SELECT l_orderkey + k * 20000 AS l_orderkey, * EXCLUDE (l_orderkey, k) FROM (SELECT * FROM old_lineitem WHERE l_partkey % 100 < 60 LIMIT 1500), range(9) t(k) WHERE k <= l_partkey % 9")
    equals_sql(spark, name, where, ["lineitem"])


def test_customers_of_one_position(spark, made):
    # Positions repeat every 991 * 953 ids. The four smallest ids are the nearest of all others.
    crowd = "SELECT CAST(7 + 944423 * k AS BIGINT) AS c_custkey FROM range(20000) t(k)"
    where = made(customer=crowd)
    got = within(spark, 60, lambda: catalog.QUERIES["preselect_positions"](spark, where).collect())
    assert len(got) == 6 + 4 * 19996 and all(r.id_a <= 7 + 944423 * 3 for r in got)


def test_some_customers_of_equal_positions_equal_sql(spark, made):
    where = made(customer="SELECT CAST(id * 7 + 944423 * k AS BIGINT) AS c_custkey FROM range(400) s(id), range(9) t(k) WHERE k <= id % 9")
    equals_sql(spark, "preselect_positions", where, ["customer"])


@pytest.mark.parametrize("name", ["topk_similar", "topk_everywhere", "pairs_symmetric"])
def test_equal_and_near_vectors_equal_sql(spark, made, name):
    # Copies, and vectors whose products differ in the last digits only.
    where = made(embeddings="SELECT vec_id + k * 100000 AS vec_id, list_transform(embedding, lambda x: CASE WHEN k % 3 = 2 THEN (x * (1 + 1e-7::FLOAT))::FLOAT ELSE x END) AS embedding, label FROM (SELECT * FROM old_embeddings WHERE vec_id < 150), range(9) t(k) WHERE k <= vec_id % 9")
    equals_sql(spark, name, where, ["embeddings"])


@pytest.mark.parametrize("name, n", [("topk_similar", 5), ("topk_everywhere", 3)])
def test_copies_of_a_vector_are_not_a_square_of_products(spark, made, name, n):
    where = made(embeddings="SELECT CAST(k AS BIGINT) AS vec_id, embedding, label FROM (SELECT * FROM old_embeddings LIMIT 1), range(60000) t(k)")
    got = within(spark, 60, lambda: catalog.QUERIES[name](spark, where).where(f"other <= {n}").count())
    assert got == 60000 * n


def test_null_and_short_vectors_have_null_scores(spark):
    rows = [(1, [1.0, 2.0]), (2, [2.0, 1.0]), (3, None), (4, [1.0]), (5, [None, 1.0])]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    got = {(r.id, r.rank): (r.other, r.score) for r in match.top_similar(df, 2).collect()}
    assert got[1, 1] == (2, 4.0) and got[1, 2] == (3, None) and got[3, 1] == (1, None) and got[4, 2] == (2, None) and len(got) == 10


@pytest.mark.parametrize("name", ["ortho_best", "ortho_average"])
def test_exploded_pixels_are_not_sent_to_the_driver(spark, name):
    # Whatever the estimate says: pixels come of an explode of a small table.
    tree = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    join = next(x for x in tree.splitlines() if "Join" in x and "image_id" in x and "pu" in x)
    assert "SortMergeJoin" in join


@pytest.mark.parametrize("name", ["nadir_captures", "ortho_best", "ortho_average"])
def test_exploded_photographs_are_not_sent_to_the_driver(spark, name):
    # Photographs are told to blocks by an explode as well.
    tree = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [bx" in tree and "Broadcast" not in tree


def test_crowded_cameras_over_a_crowded_place(spark, made):
    # All cameras stand at (0, 0, 55), the points at (0, 0, 45) and (0, 1, 45).
    points = CROWD.replace("CAST(50 AS BIGINT) AS l_partkey", "CAST(0 AS BIGINT) AS l_partkey").replace("THEN 50 ELSE 51", "THEN 0 ELSE 1").replace("20.0::DOUBLE", "45.0::DOUBLE")
    where = made(lineitem=points, supplier="SELECT CAST(k * 909 AS BIGINT) AS s_suppkey FROM range(40000) t(k)")
    got = within(spark, 40, lambda: catalog.QUERIES["cone_visibility"](spark, where).collect())
    assert len(got) == 40000 and {r.n for r in got} == {40003}


def test_photographs_of_one_view_are_met_once(spark, made):
    # Views repeat every 505 photographs: 6,000 of one view, each with all others by id.
    where = made(supplier="SELECT CAST(k * 505 AS BIGINT) AS s_suppkey FROM range(6000) t(k)")
    got = within(spark, 40, lambda: catalog.QUERIES["view_candidates"](spark, where).selectExpr("count(*) AS n", "count_if(rank = other div 505 + if(other < image_id, 1, 0)) AS ok").first())
    assert got.n == got.ok == 6000 * 5999


def test_views_in_copies_equal_sql(spark, made):
    where = made(supplier="SELECT CAST(id * 3 + 505 * k AS BIGINT) AS s_suppkey FROM range(40) s(id), range(4) t(k) WHERE k <= id % 4")
    equals_sql(spark, "view_candidates", where, ["supplier"])


@pytest.mark.parametrize("name", ["cloud_normals", "covariance_normals"])
def test_normals_are_rounded_once_a_place(spark, name):
    # After the join with the points each copy of a place would be rounded again.
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "round(" not in plan


#: 25,650 places in tenths, some with copies: hundreds of neighbours each, many at the reach itself.
LATTICE = "SELECT CAST(row_number() OVER () AS BIGINT) AS l_orderkey, CAST(a AS BIGINT) AS l_partkey, CAST(b AS BIGINT) AS l_suppkey, c::DOUBLE AS l_quantity, d / 100.0::DOUBLE AS l_discount, e / 100.0::DOUBLE AS l_tax, o.* EXCLUDE (l_orderkey, l_partkey, l_suppkey, l_quantity, l_discount, l_tax) FROM range(5) p(a), range(5) q(b), range(9) r(c), range(10) s(d), range(9) t(e), range(3) u(k), (SELECT * FROM old_lineitem LIMIT 1) o WHERE (a * 7 + b * 5 + c * 3 + d + e) % 19 < 18 AND k <= (a + b + d) % 3 % 2"


def test_a_crowded_lattice_equals_sql(spark, made):
    equals_sql(spark, "covariance_normals", made(lineitem=LATTICE), ["lineitem"])


@pytest.mark.parametrize("run", [(0, 1, 2), (2, 0, 1), (1, 2, 0)])
def test_sums_on_lines_equal_pairs(run):
    axes = [np.arange(40) * 0.1, np.arange(20) * 0.2, np.arange(6) * 1.0]
    o = np.stack([x.ravel() for x in np.meshgrid(*axes)], axis=1)[:, run]
    o = o[np.arange(len(o)) % 7 < 6]
    w = np.arange(len(o)) % 3 + 1
    q = o[::2]
    n, c = near.on_lines(q, o, w, 1.0)
    x = q[:, None] - o[None]
    met = np.where((x[..., 0] ** 2 + x[..., 1] ** 2) + x[..., 2] ** 2 < 1.0, w[None], 0)
    assert (n == met.sum(axis=1)).all()
    mean = (met[..., None] * x).sum(axis=1) / n[:, None]
    for (i, j), got in zip([(i, j) for i in range(3) for j in range(i, 3)], c, strict=True):
        assert np.allclose(got, (met * x[..., i] * x[..., j]).sum(axis=1) / n - mean[:, i] * mean[:, j], rtol=0, atol=1e-12)
    # Scattered places have no lines, and heavy ones would lose digits.
    assert near.on_lines(q + np.random.default_rng(0).random(q.shape), o + np.random.default_rng(1).random(o.shape), w, 1.0) is None
    assert near.on_lines(q, o, w * 1000, 1.0) is None


def test_tiles_of_one_hash_are_told_apart():
    key, tile, row = np.array([5, 5, 5, 5, 9]), np.array([1, 2, 1, 2, 1]), np.arange(5)
    g, (_, __, got) = near.numbered([key, tile, row], 1)
    assert g.tolist() == [0, 0, 1, 1, 2] and got.tolist() == [0, 2, 1, 3, 4]


def test_places_meet_by_value(spark):
    rows = [(1, 0.0, 1.0, 2.0), (2, -0.0, 1.0, 2.0), (3, None, 1.0, 2.0), (4, float("nan"), 1.0, 2.0), (5, 0.0, 1.0, 3.0)]
    points = spark.createDataFrame(rows, "pid long, x double, y double, z double")
    found = spark.createDataFrame([(0.0, 1.0, 2.0, 7)], "x double, y double, z double, v long")
    got = {r.pid: r.v for r in near.at_places(points, found, how="left").collect()}
    assert got == {1: 7, 2: 7, 3: None, 4: None, 5: None}
    assert sorted(r.pid for r in near.at_places(points, found, how="left_semi").collect()) == [1, 2]
