"""Match, graph, track, series and evaluation queries on the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrafold.functions import color, geom, text
from terrafold.functions import stats as S
from terrafold.operators import evaluate as E
from terrafold.operators import graph as G
from terrafold.operators import match as M
from terrafold.operators import series as T
from terrafold.plans import views as V
from terrafold.plans.register import Catalog

catalog = Catalog()
query = catalog.query

_DOT = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda t: CAST(t[1] AS DOUBLE) * t[2]))"
_D2 = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda t: (CAST(t[1] AS DOUBLE) - t[2]) * (CAST(t[1] AS DOUBLE) - t[2])))"


def r6(*names: str, n: int = 6):
    return {c: F.round(F.col(c), n) for c in names}


_TWO = f"l AS (SELECT label img, vec_id ia, embedding FROM embeddings WHERE vec_id % 2 = 0), r AS (SELECT label img, vec_id ib, embedding FROM embeddings WHERE vec_id % 2 = 1), m AS (SELECT a.img, a.ia, b.ib, {_D2} d FROM l a JOIN r b USING (img)), f AS (SELECT *, row_number() OVER (PARTITION BY img, ia ORDER BY d, ib) rn FROM m), g AS (SELECT *, row_number() OVER (PARTITION BY img, ib ORDER BY d, ia) rn FROM m), fa AS (SELECT img, ia, max(CASE WHEN rn=1 THEN ib END) ib, max(CASE WHEN rn=1 THEN d END) d1, max(CASE WHEN rn=2 THEN d END) d2 FROM f GROUP BY 1,2), ga AS (SELECT img, ib, max(CASE WHEN rn=1 THEN ia END) ia, max(CASE WHEN rn=1 THEN d END) d1, max(CASE WHEN rn=2 THEN d END) d2 FROM g GROUP BY 1,2)"


def _sides(spark, d):
    v = V.table(spark, d, "embeddings")
    left = v.where("vec_id % 2 = 0").select(F.col("label").alias("img"), F.col("vec_id").alias("ia"), F.col("embedding").alias("da"))
    right = v.where("vec_id % 2 = 1").select(F.col("label").alias("img"), F.col("vec_id").alias("ib"), F.col("embedding").alias("db"))
    return left, right


@query(f"WITH {_TWO} SELECT img, ia, ib, round(d1,6) d1, round(d2,6) d2 FROM fa")
def best_two(spark, d):
    left, right = _sides(spark, d)
    return M.best_two(left, right, ["img"]).withColumns(r6("d1", "d2"))


@query(f"WITH {_TWO} SELECT fa.img, fa.ia, fa.ib, round(fa.d1,6) d1 FROM fa JOIN ga ON fa.img=ga.img AND fa.ia=ga.ia AND fa.ib=ga.ib WHERE fa.d1 < 0.95*0.95*coalesce(fa.d2,1e300) AND ga.d1 < 0.95*0.95*coalesce(ga.d2,1e300)")
def match_ratio_mutual(spark, d):
    left, right = _sides(spark, d)
    return M.ratio_matches(left, right, ["img"], 0.95).select("img", "ia", "ib", F.round("d1", 6).alias("d1"))


_TOP = f"s AS (SELECT a.label \"group\", a.vec_id id, b.vec_id other, {_DOT} score FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id), t AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, other) rank FROM s)"


def _top(spark, d):
    v = V.descriptors(spark, d).withColumnRenamed("image", "group")
    return M.top_similar(v, 5, ["group"])


@query(f"WITH {_TOP} SELECT id, rank, other, round(score,6) score FROM t WHERE rank <= 5")
def topk_similar(spark, d):
    return _top(spark, d).select("id", "rank", "other", F.round("score", 6).alias("score"))


@query(f"WITH s AS (SELECT a.vec_id id, b.vec_id other, {_DOT} score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id), t AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, other) rank FROM s) SELECT id, rank, other, round(score,6) score FROM t WHERE rank <= 3")
def topk_everywhere(spark, d):
    return M.top_similar(V.descriptors(spark, d).select("id", "v"), 3, blocks=4).withColumns(r6("score"))


@query(f"WITH {_TOP} SELECT DISTINCT least(id,other) id_a, greatest(id,other) id_b FROM t WHERE rank <= 5")
def pairs_symmetric(spark, d):
    return M.symmetric_pairs(_top(spark, d))


@query(f"WITH {V.CAPTURES}, n AS (SELECT seq, id, row_number() OVER (PARTITION BY seq ORDER BY t, id) i, count(*) OVER (PARTITION BY seq) n FROM captures) SELECT DISTINCT a.seq, least(a.id,b.id) id_a, greatest(a.id,b.id) id_b FROM n a JOIN n b ON a.seq=b.seq AND a.id<>b.id AND ((b.i-a.i BETWEEN 1 AND least(a.n-1, 3)) OR (b.i+a.n-a.i BETWEEN 1 AND least(a.n-1, 3)))")
def sequential_pairs(spark, d):
    items = V.captures(spark, d).select("seq", "id", F.struct("t", "id").alias("ord"))
    return M.sequential_pairs(items, 3, loop=True)


@query("WITH p AS (SELECT c_custkey id, (c_custkey*37 % 991)/10.0 x, (c_custkey*53 % 953)/10.0 y FROM customer), k AS (SELECT a.id, b.id other, (a.x-b.x)**2+(a.y-b.y)**2 d2 FROM p a JOIN p b ON a.id<>b.id AND (a.x-b.x)**2+(a.y-b.y)**2 <= 64), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, other) rn FROM k) SELECT DISTINCT least(id,other) id_a, greatest(id,other) id_b FROM r WHERE rn <= 4")
def preselect_positions(spark, d):
    k = F.col("c_custkey")
    items = V.table(spark, d, "customer").select(k.alias("id"), ((k * 37 % 991) / 10.0).alias("x"), ((k * 53 % 953) / 10.0).alias("y"))
    return M.nearest_positions(items, 4, 8.0)


_CASES = "SELECT l_orderkey*8+l_linenumber k, CAST(l_quantity AS INT) inl, CAST(l_quantity AS INT) + l_suppkey % 90 raw, l_partkey % 11 = 0 deg, l_partkey % 13 <> 0 model FROM lineitem"


@query(f"WITH c AS ({_CASES}), v AS (SELECT *, inl/greatest(1,raw) ratio, deg AND inl >= 8 sp FROM c) SELECT verdict, count(*) n FROM (SELECT CASE WHEN inl >= 15 AND (ratio >= 0.25 OR inl >= 60) AND NOT sp THEN 'accept' WHEN NOT model THEN 'reject' WHEN sp THEN 'reject' WHEN inl >= 8 THEN 'weak' ELSE 'reject' END verdict FROM v) GROUP BY 1")
def pair_verdict(spark, d):
    li = V.table(spark, d, "lineitem")
    inl = F.col("l_quantity").cast("int")
    v = M.pair_verdict(inl, inl + F.col("l_suppkey") % 90, F.col("l_partkey") % 11 == 0, F.col("l_partkey") % 13 != 0)
    return li.select(v.alias("verdict")).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@query("WITH m AS (SELECT l_suppkey pair, l_partkey ia, l_orderkey % 50 ib, l_extendedprice score FROM lineitem), a AS (SELECT *, row_number() OVER (PARTITION BY pair, ia ORDER BY score, ib) rn FROM m), b AS (SELECT *, row_number() OVER (PARTITION BY pair, ib ORDER BY score, ia) r2 FROM a WHERE rn = 1) SELECT pair, ia, ib, score FROM b WHERE r2 = 1")
def guided_dedupe(spark, d):
    m = V.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("pair"), F.col("l_partkey").alias("ia"), (F.col("l_orderkey") % 50).alias("ib"), F.col("l_extendedprice").alias("score"))
    return M.dedupe_guided(m, ["pair"])


@query("SELECT image_id, kp, rank FROM (SELECT l_suppkey image_id, l_orderkey*8+l_linenumber kp, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey*8+l_linenumber) rank FROM lineitem) WHERE rank <= 20")
def cap_keypoints(spark, d):
    k = V.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("image_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("kp"), F.col("l_extendedprice").alias("response"))
    return M.cap_keypoints(k, 20).select("image_id", "kp", "rank")


_WORDS = "w AS (SELECT vec_id word, embedding FROM embeddings WHERE vec_id < 16)"


def _words(spark, d):
    return V.table(spark, d, "embeddings").where("vec_id < 16").select(F.col("vec_id").alias("word"), F.col("embedding").alias("c"))


@query(f"WITH {_WORDS}, k AS (SELECT a.vec_id id, b.word, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_D2}, b.word) rn FROM embeddings a, w b) SELECT id, word FROM k WHERE rn = 1")
def kmeans_assign(spark, d):
    return M.assign_words(V.descriptors(spark, d), _words(spark, d))


@query(f"WITH {_WORDS}, k AS (SELECT a.vec_id id, b.word, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_D2}, b.word) rn FROM embeddings a, w b), p AS (SELECT e.label image, k.word, unnest(range(64)) d, unnest(e.embedding)::DOUBLE - unnest(w.embedding) x FROM k JOIN embeddings e ON e.vec_id = k.id JOIN w ON w.word = k.word WHERE rn = 1), s AS (SELECT image, word, d, sum(x) x FROM p GROUP BY 1,2,3), u AS (SELECT *, sqrt(sum(x*x) OVER (PARTITION BY image, word)) n FROM s), q AS (SELECT image, word, d, CASE WHEN n > 0 THEN sign(x)*sqrt(abs(x/n)) ELSE 0 END x FROM u) SELECT image, word, CAST(d AS INT) d, round(x/sqrt(sum(x*x) OVER (PARTITION BY image)),5)+0.0 \"value\" FROM q")
def vlad_encode(spark, d):
    out = M.vlad(V.descriptors(spark, d), _words(spark, d))
    return out.withColumn("value", F.round("value", 5) + 0.0)


def _lloyd(k: int, rounds: int) -> str:
    """Lloyd's rounds, written out one after the other."""
    apart = "list_sum(list_transform(list_zip(v.v, w.c), lambda t: (t[1] - t[2]) * (t[1] - t[2])))"
    parts = ["v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)", f"w0 AS (SELECT row_number() OVER (ORDER BY id) - 1 AS word, v AS c FROM (SELECT * FROM v ORDER BY id LIMIT {k}))"]
    for n in range(rounds):
        parts.append(f"a{n} AS (SELECT id, v, word FROM (SELECT v.id, v.v, w.word, row_number() OVER (PARTITION BY v.id ORDER BY {apart}, w.word) AS rn FROM v, w{n} w) WHERE rn = 1)")
        parts.append(f"e{n} AS (SELECT word, unnest(v) AS x, unnest(range(len(v))) AS d FROM a{n})")
        parts.append(f"m{n} AS (SELECT word, d, avg(x) AS x FROM e{n} GROUP BY 1, 2)")
        parts.append(f"w{n + 1} AS (SELECT word, list(x ORDER BY d) AS c FROM m{n} GROUP BY 1)")
    return f"WITH {', '.join(parts)} SELECT word, d AS dim, round(x, 6) AS value FROM m{rounds - 1}"


@query(_lloyd(8, 4))
def kmeans_codebook(spark, d):
    """Lloyd's rounds over all vectors (none of these words is left empty)."""
    words = M.train_codebook(V.descriptors(spark, d), 8, 4)
    return words.select("word", F.posexplode("c").alias("dim", "value")).select("word", F.col("dim").cast("bigint").alias("dim"), F.round("value", 6).alias("value"))


_BASE = "regexp_extract({0}, '([^/\\\\]*)$', 1)"
_STEM = "regexp_replace(" + _BASE + ", '(.)\\.[^.]*$', '\\1')"


def _name_forms(c: str) -> list[str]:
    return [c, _BASE.format(c), f"lower({_BASE.format(c)})", f"lower({_STEM.format(c)})"]


_ENTRY = "e AS (SELECT page_id ord, page_id AS key, split_part(split_part(url, '?', 1), '#', 1) || '/img' || (page_id % 40) || '.JPG' AS name FROM pages WHERE page_id % 3 <> 0)"
_WANT = "w AS (SELECT DISTINCT CASE page_id % 4 WHEN 0 THEN 'IMG' || (page_id % 60) || '.tif' WHEN 1 THEN 'img' || (page_id % 60) || '.JPG' WHEN 2 THEN 'img' || (page_id % 60) || '.jpg' ELSE split_part(split_part(url, '?', 1), '#', 1) || '/img' || (page_id % 40) || '.JPG' END AS name FROM pages)"
_TIERS = " UNION ALL ".join(f"SELECT {k} tier, {f} form, ord, key FROM e" for k, f in enumerate(_name_forms("name")))
_ASKS = " UNION ALL ".join(f"SELECT name, {k} tier, {f} form FROM w" for k, f in enumerate(_name_forms("name")))


@query(f"WITH {_ENTRY}, {_WANT}, t AS ({_TIERS}), a AS ({_ASKS}), j AS (SELECT a.name, a.tier, t.key, row_number() OVER (PARTITION BY a.name ORDER BY a.tier, t.ord) rn FROM a JOIN t USING (tier, form)) SELECT w.name, j.key, j.tier FROM w LEFT JOIN (SELECT * FROM j WHERE rn = 1) j USING (name)")
def name_resolver(spark, d):
    p = V.table(spark, d, "pages")
    url = F.substring_index(F.substring_index("url", "?", 1), "#", 1)
    own = F.concat(url, F.lit("/img"), (F.col("page_id") % 40).cast("string"), F.lit(".JPG"))
    entries = p.where("page_id % 3 <> 0").select(F.col("page_id").alias("ord"), F.col("page_id").alias("key"), own.alias("name"))
    n = (F.col("page_id") % 60).cast("string")
    pick = F.col("page_id") % 4
    want = F.when(pick == 0, F.concat(F.lit("IMG"), n, F.lit(".tif"))).when(pick == 1, F.concat(F.lit("img"), n, F.lit(".JPG"))).when(pick == 2, F.concat(F.lit("img"), n, F.lit(".jpg"))).otherwise(own)
    return M.resolve_names(entries, p.select(want.alias("name")))


@query("SELECT ord, name, size FROM (SELECT doc_id ord, source AS name, n_chars // 100 AS size, row_number() OVER (PARTITION BY source, n_chars // 100 ORDER BY doc_id) n FROM documents) WHERE n > 1")
def duplicate_files(spark, d):
    f = V.table(spark, d, "documents").select(F.col("doc_id").alias("ord"), F.col("source").alias("name"), F.floor(F.col("n_chars") / 100).alias("size"))
    return M.duplicate_files(f)


@query("SELECT a.vec_id id, bit_count(xor(CAST(a.vec_id*2654435761 % 68719476736 AS BIGINT), CAST(a.label*40503 % 68719476736 AS BIGINT))) distance FROM embeddings a")
def tag_hamming(spark, d):
    e = V.table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), M.hamming(F.col("vec_id") * 2654435761 % 68719476736, F.col("label").cast("bigint") * 40503 % 68719476736).alias("distance"))


@query(f"WITH {V.EDGES} SELECT s_suppkey id, (SELECT count(*) FROM edges WHERE id_a = s_suppkey OR id_b = s_suppkey) degree FROM supplier")
def graph_degree(spark, d):
    return G.degrees(V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id")), V.edges(spark, d))


_WAYS = "ways AS (SELECT id_a a, id_b b FROM edges UNION SELECT id_b, id_a FROM edges)"
_REACH = "reach AS (SELECT s_suppkey id, s_suppkey AS node FROM supplier UNION SELECT r.id, b.b FROM reach r JOIN ways b ON b.a = r.node)"


@query(f"WITH RECURSIVE {V.EDGES}, {_WAYS}, {_REACH} SELECT id, min(node) component FROM reach GROUP BY 1")
def graph_components(spark, d):
    return G.components(V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id")), V.edges(spark, d))


@query(f"WITH RECURSIVE {V.EDGES}, {_WAYS}, {_REACH}, c AS (SELECT id, min(node) component FROM reach GROUP BY 1), g AS (SELECT s_suppkey id, (SELECT count(*) FROM edges WHERE id_a = s_suppkey OR id_b = s_suppkey) degree FROM supplier), h AS (SELECT component, count(*) size, count(*) FILTER (degree = 0) isolated, count(*) FILTER (degree = 1) weakly FROM c JOIN g USING (id) GROUP BY 1) SELECT *, row_number() OVER (ORDER BY size DESC, component) rank FROM h")
def graph_health(spark, d):
    return G.graph_health(V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id")), V.edges(spark, d))


_PARTED = "cut AS (SELECT e.id_a, e.id_b, e.id_a AS node FROM edges e UNION SELECT c.id_a, c.id_b, b.b FROM cut c JOIN ways b ON b.a = c.node AND NOT (b.a = c.id_a AND b.b = c.id_b) AND NOT (b.a = c.id_b AND b.b = c.id_a))"


@query(f"WITH RECURSIVE {V.TERRITORIES}, {_WAYS}, {_PARTED} SELECT id_a, id_b FROM edges WHERE NOT EXISTS (SELECT 1 FROM cut WHERE cut.id_a = edges.id_a AND cut.id_b = edges.id_b AND cut.node = edges.id_b)")
def graph_bridges(spark, d):
    return G.bridges(V.territories(spark, d))


@query(f"WITH RECURSIVE {V.TERRITORIES}, {_WAYS}, n AS (SELECT DISTINCT a AS id FROM ways), reach AS (SELECT id, id AS node FROM n UNION SELECT r.id, b.b FROM reach r JOIN ways b ON b.a = r.node) SELECT id, min(node) component FROM reach GROUP BY 1")
def territory_components(spark, d):
    e = V.territories(spark, d)
    return G.components(e.select(F.col("id_a").alias("id")), e)


@query(f"WITH {V.OBSERVATIONS} SELECT a.image_id image_a, b.image_id image_b, count(*) shared FROM observations a JOIN observations b ON a.pt = b.pt AND a.image_id < b.image_id GROUP BY 1, 2")
def used_pairs(spark, d):
    return G.used_pairs(V.observations(spark, d))


@query("WITH o AS (SELECT l_orderkey pt, count(DISTINCT l_suppkey) v FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) >= 2), b AS (SELECT k, (SELECT count(*) FROM o WHERE least(v, 8) = k) n FROM range(2, 9) t(k)) SELECT CASE WHEN k = 8 THEN '8+' ELSE CAST(k AS VARCHAR) END bin, n, round(n * 100.0 / (SELECT count(*) FROM o), 6) pct FROM b")
def track_hist(spark, d):
    o = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("pt"), F.col("l_suppkey").alias("image_id"))
    return G.track_histogram(o).withColumns(r6("pct"))


@query("SELECT s_suppkey image_id, count(l_tax) n, round(sqrt(avg((l_tax+0.0)*(l_tax+0.0))),6) rms, list_sort(list(l_tax+0.0) FILTER (l_tax IS NOT NULL))[count(l_tax)//2+1] median, max(l_tax+0.0) worst FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1")
def residuals_by_image(spark, d):
    e = V.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("image_id"), (F.col("l_tax") + 0.0).alias("e"))
    return G.residuals_by_image(V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("image_id")), e).withColumns(r6("rms"))


_SHORT = "o AS (SELECT l_orderkey pt, l_suppkey image_id, CAST(floor((l_partkey % 97)/97.0*16) AS BIGINT) cu, CAST(floor((l_partkey % 89)/89.0*16) AS BIGINT) cv FROM lineitem), v AS (SELECT pt, count(DISTINCT image_id) views FROM o GROUP BY 1), cov AS (SELECT DISTINCT image_id, cu, cv FROM o JOIN v USING (pt) WHERE views >= 3), need AS (SELECT DISTINCT pt FROM o JOIN v USING (pt) ANTI JOIN cov USING (image_id, cu, cv) WHERE views < 3)"


@query(f"WITH {_SHORT} SELECT pt, count(*) n FROM o JOIN v USING (pt) WHERE views >= 3 OR pt IN (SELECT pt FROM need) GROUP BY 1")
def prune_short_tracks(spark, d):
    li = V.table(spark, d, "lineitem")
    o = li.select(F.col("l_orderkey").alias("pt"), F.col("l_suppkey").alias("image_id"), ((F.col("l_partkey") % 97) / 97.0).alias("u"), ((F.col("l_partkey") % 89) / 89.0).alias("v"))
    return G.prune_short_tracks(o).groupBy("pt").agg(F.count(F.lit(1)).alias("n"))


@query("WITH RECURSIVE r AS (SELECT s_suppkey id, s_suppkey * 7919 % 1009 built, s_suppkey - 1 - s_suppkey % 5 AS input FROM supplier), stale AS (SELECT r.id FROM r JOIN r i ON i.id = r.input WHERE i.built > r.built UNION SELECT r.id FROM r JOIN stale s ON r.input = s.id) SELECT DISTINCT id FROM stale")
def outdated_products(spark, d):
    k = F.col("s_suppkey")
    r = V.table(spark, d, "supplier").select(k.alias("id"), (k * 7919 % 1009).alias("built"), F.array(k - 1 - k % 5).alias("based_on"))
    return G.outdated(r)


@query(f"WITH {V.CAPTURES}, m AS (SELECT *, quantile_cont(sharpness, 0.5) OVER (PARTITION BY seq ORDER BY t, id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) m FROM captures) SELECT seq, id, round(CASE WHEN m > 0 AND sharpness IS NOT NULL THEN sharpness/m ELSE 1 END,6) relative FROM m")
def rel_sharpness(spark, d):
    return T.relative_sharpness(V.captures(spark, d), 5).select("seq", "id", F.round("relative", 6).alias("relative"))


_RUNS = f"{V.CAPTURES}, g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY seq ORDER BY t, id) > 86400 THEN 1 ELSE 0 END new FROM captures), runs AS (SELECT *, CAST(sum(new) OVER (PARTITION BY seq ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS BIGINT) run FROM g)"


@query(f"WITH {_RUNS} SELECT seq, run, count(*) n, round(max(t)-min(t),3) AS seconds FROM runs GROUP BY 1, 2")
def gap_runs(spark, d):
    return T.runs(V.captures(spark, d), 86400).groupBy("seq", "run").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("t") - F.min("t"), 3).alias("seconds"))


@query(f"WITH {_RUNS.replace('epoch_us(ts) / 1e6 AS t', 'epoch_us(ts) / 1e6 - 1704067200 AS t')}, v AS (SELECT seq, id, CASE WHEN var_pop(t) OVER w > 0 THEN regr_slope(sharpness, t) OVER w END s FROM runs WINDOW w AS (PARTITION BY seq, run ORDER BY t, id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) SELECT seq, id, round(s*86400, 4) per_day FROM v")
def velocity_slope(spark, d):
    c = V.captures(spark, d).withColumn("t", F.col("t") - 1704067200)
    return T.velocities(c, ["sharpness"], gap=86400).select("seq", "id", F.round(F.col("v_sharpness") * 86400, 4).alias("per_day"))


@query("WITH s AS (SELECT user_id seq, CAST(event_id AS DOUBLE) t FROM events), g AS (SELECT seq, t - lag(t) OVER (PARTITION BY seq ORDER BY t) gap FROM (SELECT DISTINCT seq, t/30.0 t FROM s)), l AS (SELECT seq, list_sort(list(gap)) g FROM g WHERE gap > 1e-4 GROUP BY 1 HAVING count(*) >= 3), q AS (SELECT seq, 1.0/g[CAST(floor(len(g)*0.25) AS BIGINT)+1] f FROM l) SELECT seq, coalesce(" + ", ".join(f"CASE WHEN abs(f-{r}) <= 0.01*{r} THEN CAST({r} AS DOUBLE) END" for r in T.COMMON_FPS) + ", floor(f*100+0.5)/100) fps FROM q")
def estimate_fps(spark, d):
    times = V.table(spark, d, "events").select(F.col("user_id").alias("seq"), (F.col("event_id").cast("double") / 30.0).alias("t"))
    return T.estimate_fps(times)


@query("WITH s AS (SELECT user_id seq, CAST(count(*) AS DOUBLE) duration FROM events GROUP BY 1) SELECT seq, k, round(k*1.7, 6) t FROM (SELECT seq, unnest(range(CAST(floor(duration/1.7+1e-9) AS BIGINT)+1)) k FROM s)")
def interval_samples(spark, d):
    spans = V.table(spark, d, "events").groupBy(F.col("user_id").alias("seq")).agg(F.count(F.lit(1)).cast("double").alias("duration"))
    return T.interval_times(spans, 1.7)


@query()
def keyframes(spark, d):
    """Greedy by sequence; held against plain Python in the tests."""
    from pyspark.sql import Window

    c = V.captures(spark, d)
    travel = F.sum(F.abs("sharpness") / 100).over(Window.partitionBy("seq").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0))
    return T.select_keyframes(c.withColumn("travel", travel), 2.0, 20)


_MONTH = "SELECT date_trunc('month', o_orderdate) AS run, count(*) n, round(avg(o_totalprice),2) mean FROM orders GROUP BY 1"


@query(f"WITH m AS ({_MONTH}), p AS (SELECT strftime(run, '%Y-%m') AS run, mean cur, lag(mean) OVER (ORDER BY run) prev, row_number() OVER (ORDER BY run) k FROM m) SELECT run, prev, cur, round(cur-prev,2) delta, CASE WHEN cur-prev < -(abs(prev)*1e-6+1e-9) THEN 'better' WHEN cur-prev > abs(prev)*1e-6+1e-9 THEN 'worse' ELSE 'same' END verdict FROM p WHERE k > 1")
def run_diff(spark, d):
    o = V.table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("run")).agg(F.round(F.avg("o_totalprice"), 2).alias("mean"))
    return T.run_diff(o, "mean", higher_is_better=False).withColumn("delta", F.round("delta", 2))


@query("WITH q AS (SELECT d.doc_id, d.source, CAST(n_chars AS DOUBLE) sharp, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)), m AS (SELECT *, quantile_cont(sharp, 0.5) OVER (PARTITION BY source) m FROM q) SELECT doc_id, round(sharp/m,6) relative, CASE WHEN sharp/m < 0.6 THEN 'blurry' WHEN toxic > 0.05 THEN 'over' WHEN 1-quality > 0.05 THEN 'under' ELSE 'ok' END verdict FROM m")
def quality_verdict(spark, d):
    q = V.table(spark, d, "documents").select("doc_id", "source", F.col("n_chars").cast("double").alias("sharp")).join(V.table(spark, d, "labels"), "doc_id", "left")
    # The median of a source is an aggregate joined back: no window over a source's rows.
    m = q.groupBy("source").agg(S.median("sharp").alias("m"))
    rel = F.col("sharp") / F.col("m")
    return q.join(m, "source").select("doc_id", F.round(rel, 6).alias("relative"), T.verdict(rel, F.col("toxic"), 1 - F.col("quality")).alias("verdict"))


_SUM = "count(*) n, round(avg(v),6) mean, round(median(v),6) median, round(sqrt(avg(v*v)),6) rms, round(quantile_cont(v,0.95),6) p95, round(min(v),6) min, round(max(v),6) max, round(avg(abs(v)),6) mean_abs, round(quantile_cont(abs(v),0.95),6) p95_abs"


@query(f"WITH {V.RESIDUALS} SELECT {_SUM} FROM (SELECT dz v FROM residuals WHERE dz IS NOT NULL)")
def distance_stats(spark, d):
    out = E.distance_stats(V.residuals(spark, d), "dz")
    return out.withColumns(r6(*[c for c in out.columns if c != "n"]))


@query(f"WITH {V.RESIDUALS}, v AS (SELECT segment, dz v, quantile_cont(dz,0.5) OVER (PARTITION BY segment) m FROM residuals WHERE dz IS NOT NULL) SELECT segment, count(*) n, round(avg(v),6) mean, round(stddev_samp(v),6) std, round(sqrt(avg(v*v)),6) rmse, round(median(v),6) median, round(quantile_cont(abs(v),0.9),6) le90, round(quantile_cont(abs(v),0.95),6) le95, round(quantile_cont(v,0.02),6) q02, round(quantile_cont(v,0.98),6) q98, round(1.4826*quantile_cont(abs(v-m),0.5),6) nmad FROM v GROUP BY 1")
def diff_summary(spark, d):
    out = E.summarize_differences(V.residuals(spark, d), "dz", ["segment"])
    return out.withColumns(r6(*[c for c in out.columns if c not in ("n", "segment")]))


@query(f"WITH {V.RESIDUALS} SELECT CAST(CASE WHEN dz < -0.4 THEN -1 WHEN dz > 0.4 THEN 20 ELSE least(19, floor((dz+0.4)/0.04)) END AS BIGINT) bin, count(*) n FROM residuals WHERE dz IS NOT NULL GROUP BY 1")
def diff_histogram(spark, d):
    return E.difference_histogram(V.residuals(spark, d), -0.4, 0.4, 20)


@query(f"WITH {V.RESIDUALS}, s AS (SELECT segment, count(*) n, avg(dx) mean, stddev_samp(dx) sd, sqrt(avg(dx*dx)) rmse, max(abs(dx)) w FROM residuals GROUP BY 1) SELECT segment, n, round(mean,6) mean, round(sd,6) sd, round(rmse,6) rmse, n > 1 AND abs(mean) > 0.25*rmse mean_flag, n > 2 AND w > 3*rmse blunder FROM s")
def asprs_axis(spark, d):
    return E.axis_stats(V.residuals(spark, d), "dx", ["segment"]).withColumns(r6("mean", "sd", "rmse"))


@query(f"WITH {V.RESIDUALS}, s AS (SELECT segment, count(*) n_h, count(dz) n_v, sqrt(avg(dx*dx)+avg(dy*dy)) h, sqrt(avg(dz*dz)) v FROM residuals GROUP BY 1) SELECT segment, n_h, n_v, round(h,6) rmse_h, round(v,6) rmse_v, round(sqrt(h*h+0.02*0.02),6) product_h, round(sqrt(v*v+0.03*0.03),6) product_v, greatest(n_h,n_v) >= 30 enough FROM s")
def asprs_accuracy(spark, d):
    return E.asprs(V.residuals(spark, d), ["segment"], 0.02, 0.03).withColumns(r6("rmse_h", "rmse_v", "product_h", "product_v"))


_SCALE = "p AS (SELECT p_brand brand, p_retailprice dm, p_retailprice*1.02 + p_size/100.0 dk, CASE WHEN p_size % 5 = 0 THEN 0 ELSE p_size END weight FROM part), s AS (SELECT brand, count(*) n, sum(CASE WHEN weight > 0 THEN weight ELSE 1.0 END) sw, sum(CASE WHEN weight > 0 THEN weight ELSE 1.0 END*dm*dk) mk, sum(CASE WHEN weight > 0 THEN weight ELSE 1.0 END*dm*dm) mm FROM p GROUP BY 1)"


@query(f"WITH {_SCALE} SELECT s.brand, any_value(s.n) n, round(any_value(mk/mm),8) scale, round(sqrt(sum(CASE WHEN weight > 0 THEN weight ELSE 1.0 END*(dk-mk/mm*dm)**2)/any_value(sw)),4) rms FROM s JOIN p USING (brand) GROUP BY 1")
def fit_scale(spark, d):
    p = V.table(spark, d, "part").select(F.col("p_brand").alias("brand"), F.col("p_retailprice").alias("dm"), (F.col("p_retailprice") * 1.02 + F.col("p_size") / 100.0).alias("dk"), F.when(F.col("p_size") % 5 == 0, 0).otherwise(F.col("p_size")).alias("weight"))
    return E.fit_scale(p, ["brand"]).select("brand", "n", F.round("scale", 8).alias("scale"), F.round("rms", 4).alias("rms"))


@query(f"WITH {V.POINTS}, s AS (SELECT classification, count(*) n, avg(x) mx, avg(y) my, avg(z) mz, var_pop(x) sxx, var_pop(y) syy, covar_pop(x,y) sxy, covar_pop(x,z) sxz, covar_pop(y,z) syz FROM points GROUP BY 1), t AS (SELECT *, (sxz*syy-syz*sxy)/(sxx*syy-sxy*sxy) a, (syz*sxx-sxz*sxy)/(sxx*syy-sxy*sxy) b FROM s) SELECT classification, n, round(a,8) a, round(b,8) b, round(mz-a*mx-b*my,6) c FROM t")
def base_plane(spark, d):
    return E.fit_plane(V.points(spark, d), ["classification"]).select("classification", "n", F.round("a", 8).alias("a"), F.round("b", 8).alias("b"), F.round("c", 6).alias("c"))


@query("SELECT c_custkey id, CASE WHEN c_acctbal IS NULL THEN 'missing' WHEN c_acctbal < 0 THEN 'bad' WHEN c_acctbal < 2000 THEN 'warn' ELSE 'ok' END high, CASE WHEN c_acctbal >= 8000 THEN 'bad' WHEN c_acctbal >= 5000 THEN 'warn' ELSE 'ok' END low, CASE WHEN abs(c_acctbal) >= 8000 THEN 'bad' WHEN abs(c_acctbal) >= 500 THEN 'warn' ELSE 'ok' END low_abs, CASE WHEN c_acctbal >= 100 THEN 'pass' ELSE 'fail' END gate FROM customer")
def health_rows(spark, d):
    v = F.col("c_acctbal")
    return V.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), E.classify(v, "high", 2000, 0).alias("high"), E.classify(v, "low", 5000, 8000).alias("low"), E.classify(v, "low-abs", 500, 8000).alias("low_abs"), E.gate(v, ">=", 100).alias("gate"))


@query("SELECT l_returnflag flag, round(median(l_extendedprice),4) m, round(quantile_cont(l_extendedprice,0.9),4) q90, list_sort(list(l_extendedprice))[count(*)//2+1] upper, list_sort(list(l_extendedprice))[CAST(floor((count(*)-1)*0.9+0.5) AS BIGINT)+1] nearest, list_sort(list(l_extendedprice))[CAST(least(floor(count(*)*0.9), count(*)-1) AS BIGINT)+1] rank FROM lineitem GROUP BY 1")
def quantile_conventions(spark, d):
    x = "l_extendedprice"
    li = V.table(spark, d, "lineitem")
    return li.groupBy(F.col("l_returnflag").alias("flag")).agg(F.round(S.median(x), 4).alias("m"), F.round(S.quantile(x, 0.9), 4).alias("q90"), S.upper_median(x).alias("upper"), S.quantile_nearest(x, 0.9).alias("nearest"), S.quantile_rank(x, 0.9).alias("rank"))


@query("SELECT l_returnflag flag, round(avg((l_extendedprice-l_quantity*1000)/nullif(l_extendedprice+l_quantity*1000,0)),6) ndvi, count(*) n FROM lineitem GROUP BY 1")
def ndvi(spark, d):
    v = color.index("NDVI", {"nir": F.col("l_extendedprice"), "red": F.col("l_quantity") * 1000})
    return V.table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.round(F.avg(v), 6).alias("ndvi"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {V.POINTS} SELECT pid, round(CASE WHEN r+g+b = 0 THEN 0 ELSE (2*g-r-b)/(r+g+b) END,6) exg, round(r*256.0+g+b/256.0-32768.0,6) height, CAST(floor(255*pow(greatest(0.0,least(1.0,(z-2)/43.0)),0.5)+0.5) AS INT) stretched, round(CASE WHEN r/255.0 <= 0.04045 THEN r/255.0/12.92 ELSE pow((r/255.0+0.055)/1.055,2.4) END,6) linear FROM points")
def colour_functions(spark, d):
    p = V.points(spark, d)
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    return p.select("pid", F.round(color.excess_green(r, g, b), 6).alias("exg"), F.round(color.terrarium(r, g, b), 6).alias("height"), color.stretch(F.col("z"), 2, 45, 2.0).alias("stretched"), F.round(color.srgb_to_linear(r), 6).alias("linear"))


_LL = "p AS (SELECT c_custkey id, (c_custkey*37 % 3599)/10.0-180 lon, (c_custkey*53 % 1600)/10.0-80 lat FROM customer)"


def _lonlat(spark, d):
    k = F.col("c_custkey")
    return V.table(spark, d, "customer").select(k.alias("id"), ((k * 37 % 3599) / 10.0 - 180).alias("lon"), ((k * 53 % 1600) / 10.0 - 80).alias("lat"))


@query(f"WITH {_LL}, n AS (SELECT *, {geom.A}/sqrt(1-{geom.E2}*sin(radians(lat))**2) n FROM p) SELECT id, round((n+100)*cos(radians(lat))*cos(radians(lon)),3) x, round((n+100)*cos(radians(lat))*sin(radians(lon)),3) y, round((n*(1-{geom.E2})+100)*sin(radians(lat)),3) z FROM n")
def geodetic_ecef(spark, d):
    x, y, z = geom.geodetic_to_ecef(F.col("lon"), F.col("lat"), F.lit(100.0))
    return _lonlat(spark, d).select("id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"), F.round(z, 3).alias("z"))


@query(f"WITH {_LL} SELECT id, CAST(CASE WHEN lat >= 56 AND lat < 64 AND lon >= 3 AND lon < 12 THEN 32 WHEN lat >= 72 AND lat < 84 AND lon >= 0 AND lon < 42 THEN CASE WHEN lon < 9 THEN 31 WHEN lon < 21 THEN 33 WHEN lon < 33 THEN 35 ELSE 37 END ELSE least(60, floor((lon+180)/6)+1) END AS INT) zone, round((lon+180)/360*4096,6) tx, round((0.5-ln((1+sin(radians(lat)))/(1-sin(radians(lat))))/(4*pi()))*4096,6) ty FROM p")
def map_tiles(spark, d):
    lon, lat = F.col("lon"), F.col("lat")
    tx, ty = geom.lonlat_to_tile(lon, lat, 12)
    return _lonlat(spark, d).select("id", geom.utm_zone(lon, lat).alias("zone"), F.round(tx, 6).alias("tx"), F.round(ty, 6).alias("ty"))


@query(f"WITH {V.POINTS}, k AS (SELECT pid, x-50 cx, y-50 cy, z+100 cz FROM points) SELECT pid, round(1000*(0.8*cx-0.6*cy)/cz+640,5) u, round(1000*(0.6*cx+0.8*cy)/cz+480,5) v, cz depth FROM k")
def project_points(spark, d):
    r = [F.lit(float(v)) for v in (0.8, -0.6, 0, 0.6, 0.8, 0, 0, 0, 1)]
    t = tuple(F.lit(v) for v in (0.8 * -50 + 0.6 * 50, 0.6 * -50 + 0.8 * -50, 100.0))
    k = tuple(F.lit(v) for v in (1000.0, 1000.0, 640.0, 480.0))
    u, v, depth = geom.project(r, t, k, (F.col("x"), F.col("y"), F.col("z")))
    return V.points(spark, d).select("pid", F.round(u, 5).alias("u"), F.round(v, 5).alias("v"), F.round(depth, 9).alias("depth"))


@query("SELECT l_orderkey*8+l_linenumber id, min(l_suppkey*2147483647+l_partkey) pair, min(CASE WHEN (l_linenumber % 100) BETWEEN 11 AND 13 THEN l_linenumber || 'th' WHEN l_linenumber % 10 = 1 THEN l_linenumber || 'st' WHEN l_linenumber % 10 = 2 THEN l_linenumber || 'nd' WHEN l_linenumber % 10 = 3 THEN l_linenumber || 'rd' ELSE l_linenumber || 'th' END) line FROM lineitem WHERE l_suppkey <= l_partkey GROUP BY 1")
def text_codes(spark, d):
    li = V.table(spark, d, "lineitem").where("l_suppkey <= l_partkey")
    return li.groupBy((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id")).agg(F.min(text.pair_id(F.col("l_suppkey"), F.col("l_partkey"))).alias("pair"), F.min(text.ordinal(F.col("l_linenumber"))).alias("line"))


@query("SELECT page_id id, regexp_extract(url, '([^/\\\\]*)$', 1) base, regexp_replace(regexp_extract(url, '([^/\\\\]*)$', 1), '(.)\\.[^.]*$', '\\1') stem, regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g') safe FROM pages")
def path_names(spark, d):
    u = F.col("url")
    return V.table(spark, d, "pages").select(F.col("page_id").alias("id"), text.basename(u).alias("base"), text.stem(u).alias("stem"), text.file_safe(u).alias("safe"))
