"""Image copies against all pairs of images, compared corner by corner."""

import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.llm import media
from terrafold.llm.simhash import forest


def pgm(a):
    a = np.clip(np.rint(a), 0, 255).astype(np.uint8)
    return b"P5\n%d %d\n255\n" % (a.shape[1], a.shape[0]) + a.tobytes()


def png(a):
    a = np.clip(np.rint(a), 0, 255).astype(np.uint8)
    chunk = lambda k, d: len(d).to_bytes(4, "big") + k + d + zlib.crc32(k + d).to_bytes(4, "big")
    rows = bytearray()
    for y in range(len(a)):
        kind = y % 3
        row = a[y].astype(int)
        before = np.concatenate(([0], row[:-1])) if kind == 1 else (a[y - 1].astype(int) if kind == 2 else 0)
        rows += bytes([kind]) + ((row - before) & 255).astype(np.uint8).tobytes()
    head = a.shape[1].to_bytes(4, "big") + a.shape[0].to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(bytes(rows))) + chunk(b"IEND", b"")


def test_decoders():
    a = np.random.default_rng(0).integers(0, 256, (17, 23))
    assert (media.decode(pgm(a)) == a).all() and (media.decode(png(a)) == a).all()
    assert media.decode(b"junk") is None and media.decode(None) is None and media.decode(b"P5\n9 9\n255\n") is None


def test_copies_are_found_and_others_left(spark):
    rng = np.random.default_rng(0)
    rows = []
    for k in range(20):
        s = np.kron(rng.normal(128, 60, (40, 40)), np.ones((4, 4)))
        for _ in range(2):
            s = (s + np.roll(s, 1, 0) + np.roll(s, 1, 1) + np.roll(s, -1, 0) + np.roll(s, -1, 1)) / 5
        edited = s.copy()
        edited[30:60, 40:70] = 128
        copies = [s, s[20:140, 10:150], edited, s + rng.normal(0, 2, s.shape), np.rot90(s)]
        rows += [(100 * k + i, pgm(c)) for i, c in enumerate(copies)] + [(100 * k + 9, png(s))]
    rows += [(5000, None), (5001, b"junk"), (5002, pgm(np.zeros((30, 30))))]
    df = spark.createDataFrame(rows, "id long, image binary").withColumn("cls", F.lit("clash")).repartition(4)
    got = media.find_copies(df).toPandas()
    own = got[got.id < 5000]
    assert (own.component_id == own.id // 100 * 100).mean() > 0.98
    assert (own.component_id // 100 == own.id // 100).all()
    assert (own[own.id % 100 == 9].image_class == own[own.id % 100 == 9].id - 9).all()
    odd = got[got.id >= 5000].set_index("id")
    assert odd.loc[[5000, 5001]].component_id.isna().all() and odd.loc[5002].component_id == 5002
    assert media.find_copies(df.where("false")).count() == 0


def test_seams_lose_no_meeting(spark):
    """The same matches whatever the number of ranges."""
    rng = np.random.default_rng(3)
    s = np.kron(rng.normal(128, 60, (30, 30)), np.ones((4, 4)))
    rows = [(k, pgm(np.roll(s, k, axis=0)[:100])) for k in range(0, 20, 4)]
    df = spark.createDataFrame(rows, "id long, image binary")
    got = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append(sorted(map(tuple, media.find_copies(df).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[0] == got[1]


def brute_copies(one, two, votes=4, share=0.3, budget=12):
    """The rule, pair of corners by pair of corners."""
    cells = {}
    for i, a in enumerate(one.tolist()):
        for j, b in enumerate(two.tolist()):
            if not any(x == y for x, y in zip(a[4:], b[4:])) or sum((x ^ y).bit_count() for x, y in zip(a[4:], b[4:])) > budget:
                continue
            turn, scale = (b[2] - a[2]) % media.TURNS, b[3] - a[3]
            angle, grow = 2 * np.pi * turn / media.TURNS, 2.0**scale
            dx = b[0] - grow * (np.cos(angle) * a[0] - np.sin(angle) * a[1])
            dy = b[1] - grow * (np.sin(angle) * a[0] + np.cos(angle) * a[1])
            for sx in (0, 0.5):
                for sy in (0, 0.5):
                    left, right = cells.setdefault((turn, scale, sx, sy, np.floor(dx / 6 + sx), np.floor(dy / 6 + sy)), (set(), set()))
                    left.add(i)
                    right.add(j)
    need = max(votes, int(np.ceil(share * min(len(one), len(two)) - 1e-9)))
    return any(min(len(x), len(y)) >= need for x, y in cells.values())


def brute_components(images):
    """{id: smallest id reachable} by all pairs of distinct images."""
    found = [(k, g) for k, g in ((k, media.decode(raw)) for k, raw in images) if g is not None]
    corners = {k: np.concatenate(media.corners(g), axis=1) for k, g in found}
    ids = sorted(corners)
    same = {k: media.pixel_class(g) for k, g in found}
    pairs = [(a, b) for a in range(len(ids)) for b in range(a) if same[ids[a]] == same[ids[b]] or brute_copies(corners[ids[a]], corners[ids[b]])]
    label = forest(len(ids), np.array([a for a, _ in pairs], dtype=np.int64), np.array([b for _, b in pairs], dtype=np.int64))
    return {ids[k]: ids[int(r)] for k, r in enumerate(label)}


def picture(rng, h=160, w=160):
    s = np.kron(rng.normal(128, 60, (-(-h // 4), -(-w // 4))), np.ones((4, 4)))[:h, :w]
    for _ in range(2):
        s = (s + np.roll(s, 1, 0) + np.roll(s, 1, 1) + np.roll(s, -1, 0) + np.roll(s, -1, 1)) / 5
    return s


def banners():
    """Pictures of their own below a banner that all share; some are nearly the banner alone, some have copies."""
    rng = np.random.default_rng(8)
    banner = picture(rng, 60, 160)
    rows = []
    for k in range(24):
        body = picture(rng, 200 if k % 3 else 20, 160)
        whole = np.concatenate((banner, body))
        rows.append((10 * k, pgm(whole)))
        if k % 4 == 1:
            edited = whole.copy()
            edited[100:140, 20:60] = 90
            rows.append((10 * k + 1, pgm(edited)))
            rows.append((10 * k + 2, pgm(whole[70:])))
    return rows


@pytest.mark.parametrize("hot,side", [(32, 512), (3, 512), (3, 8)])
def test_images_that_share_a_banner_equal_brute_force(spark, hot, side):
    rows = banners()
    want = brute_components(rows)
    assert 2 < len(set(want.values())) < len(want) - 8
    df = spark.createDataFrame(rows, "id long, image binary").repartition(3)
    assert {r.id: r.component_id for r in media.find_copies(df, hot=hot, side=side).collect()} == want


def test_many_edits_of_one_picture_are_one_component(spark):
    rng = np.random.default_rng(4)
    base = picture(rng)
    rows = []
    for k in range(90):
        edited = base.copy()
        y, x = rng.integers(0, 110, 2)
        edited[y : y + 40, x : x + 40] = 20 + 2 * k
        rows.append((k, pgm(edited)))
    got = media.find_copies(spark.createDataFrame(rows, "id long, image binary")).collect()
    assert {r.component_id for r in got} == {0} and len({r.image_class for r in got}) == 90


def test_query_equals_brute_force_on_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").orderBy("page_id").limit(60)
    images = media.page_images(pages)
    want = brute_components([(r.id, bytes(r.image)) for r in images.collect() if r.image is not None])
    got = {r.id: r.component_id for r in media.find_copies(images, hot=4).collect()}
    assert {k: got[k] for k in want} == want


def test_long_and_odd_pages(spark):
    page = "<p>" + "many words of one long page, again and again. " * 20_000 + "</p>"
    schema = "page_id long, html string, cls string, image string, key string"
    df = spark.createDataFrame([(1, page, "x", "x", "x"), (2, page + "<p>end</p>", "x", "x", "x"), (2, page + "<p>end</p>", "x", "x", "x"), (3, None, None, None, None), (4, "", "", "", ""), (None, "<b>no id</b>", "", "", "")], schema)
    got = media.find_copies(media.page_images(df)).collect()
    assert len(got) == 6
    assert {r.component_id for r in got if r.id in (1, 2)} == {1}
    assert all(r.component_id is None for r in got if r.id == 3)


def test_hidden_parts_go_in_linear_time():
    assert media.without_hidden("a<!-- x --><b>c</b><SCRIPT>var t='</p>';</script>d<style>e") == "a\n<b>c</b>\nd<style>e"
    times = []
    for n in (20_000, 80_000):
        start = time.perf_counter()
        media.render_page("<script>x" * n + "<" * n + "<!--" * n)
        times.append(time.perf_counter() - start)
    assert times[1] < 12 * times[0] + 0.5
