"""Queries over pictures of 8 x 8 whole samples made of the embeddings, over titles, reports and regressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.functions import scores
from lumenframe.operators import filters, kernels, metrics, regression, segments
from lumenframe.plans.queries import events, query, r6, rounded
from lumenframe.session import table
from lumenframe.sources import render

#: Pictures in SQL: d holds 64 whole numbers from 0 to 255, row by row.
_V = "v AS (SELECT vec_id, list_transform(embedding, lambda x: least(greatest(floor(x::DOUBLE * 256) + 128, 0), 255)) AS d FROM embeddings)"
#: Each picture with those of the ids next to it.
_THREE = f"{_V}, t AS (SELECT c.vec_id, c.d AS c, p.d AS p, n.d AS n FROM v c JOIN v p ON p.vec_id = c.vec_id - 1 JOIN v n ON n.vec_id = c.vec_id + 1)"
WIDTH = 8


def _pictures(spark, sf_dir):
    clipped = lambda x: F.least(F.greatest(F.floor(x.cast("double") * 256) + 128, F.lit(0)), F.lit(255)).cast("double")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", clipped).alias("d"))


def _neighbours(spark, sf_dir):
    own = _pictures(spark, sf_dir)
    before, after = (own.select((F.col("vec_id") + k).alias("vec_id"), F.col("d").alias(name)) for k, name in ((1, "p"), (-1, "n")))
    return own.withColumnRenamed("d", "c").join(before, "vec_id").join(after, "vec_id")


def r4(c):
    return F.transform(c, lambda x: F.round(x, 4))


def _row(y: str) -> str:
    return f"least(greatest({y}, 0), 7) * 8"


_BLUR = f"list_sum(list_transform(range(9), lambda k: d[{_row('i // 8 + k // 3 - 1')} + least(greatest(i % 8 + k % 3 - 1, 0), 7) + 1])) / 9"
_NEAR = f"d[{_row('i // 8 + k // 5 - 2')} + least(greatest(i % 8 + k % 5 - 2, 0), 7) + 1]"
_WEIGHT = f"exp(-((k // 5 - 2) ** 2 + (k % 5 - 2) ** 2) / 8.0::DOUBLE - ({_NEAR} - d[i + 1]) ** 2 / 1800.0::DOUBLE)"


@query(f"""
WITH {_V}
SELECT vec_id, list_transform(range(64), lambda i: round(least(greatest(d[i + 1] + 0.7 * (d[i + 1] - {_BLUR}), 0), 255), 4)) AS sharp,
  list_transform(range(64), lambda i: round(list_sum(list_transform(range(25), lambda k: {_WEIGHT} * {_NEAR})) / list_sum(list_transform(range(25), lambda k: {_WEIGHT})), 4)) AS smooth,
  list_transform(range(64), lambda i: CASE WHEN i // 8 % 2 = 0 THEN d[i + 1] ELSE (d[i - 7] + d[CASE WHEN i >= 56 THEN i - 7 ELSE i + 9 END]) / 2 END) AS field,
  list_transform(list_transform(range(25), lambda i: {{'y': greatest((i // 5 + 0.5::DOUBLE) * 8 / 5 - 0.5, 0), 'x': greatest((i % 5 + 0.5::DOUBLE) * 8 / 5 - 0.5, 0)}}), lambda q: round(
    (d[floor(q.y)::INTEGER * 8 + floor(q.x)::INTEGER + 1] * (1 - q.x + floor(q.x)) + d[floor(q.y)::INTEGER * 8 + least(floor(q.x)::INTEGER + 1, 7) + 1] * (q.x - floor(q.x))) * (1 - q.y + floor(q.y))
    + (d[least(floor(q.y)::INTEGER + 1, 7) * 8 + floor(q.x)::INTEGER + 1] * (1 - q.x + floor(q.x)) + d[least(floor(q.y)::INTEGER + 1, 7) * 8 + least(floor(q.x)::INTEGER + 1, 7) + 1] * (q.x - floor(q.x))) * (q.y - floor(q.y)), 4)) AS small
FROM v""")
def picture_kernels(spark, sf_dir):
    """Unsharp mask, bilateral filter, one field's lines and a smaller size."""
    d, kernel = F.col("d"), kernels.picture_kernel
    return _pictures(spark, sf_dir).select(
        "vec_id", r4(kernel(lambda a: kernels.unsharp(a, 0.7))(d, F.lit(WIDTH))).alias("sharp"), r4(kernel(lambda a: kernels.bilateral(a, 2.0, 30.0))(d, F.lit(WIDTH))).alias("smooth"),
        kernel(kernels.deinterlaced)(d, F.lit(WIDTH)).alias("field"), r4(kernel(lambda a: kernels.scaled(a, 5, 5))(d, F.lit(WIDTH))).alias("small"),
    )


_FIRST = "i < 8"
_ABOVE, _BELOW = f"CASE WHEN i // 8 >= 2 THEN i - 16 ELSE i % 8 END", f"CASE WHEN i // 8 + 2 < 8 THEN i + 16 ELSE 56 + i % 8 END"


@query(f"""
WITH {_THREE}, e AS (SELECT vec_id, unnest(range(64)) AS i, c, p, n FROM t),
a AS (SELECT vec_id, i, c, c[i + 1] AS o, p[i + 1] AS p, n[i + 1] AS n, i % 8 AS x, {_ABOVE} AS u, {_BELOW} AS w, c[CASE WHEN i < 8 THEN i ELSE i - 8 END + 1] AS d, c[CASE WHEN i >= 56 THEN i ELSE i + 8 END + 1] AS f FROM e),
b AS (SELECT *, floor((p + n + 1) / 2) AS t, c[u + 1] AS u0, c[w + 1] AS w0, c[u - x + greatest(x - 1, 0) + 1] AS u1, c[w - x + least(x + 1, 7) + 1] AS w1, c[u - x + least(x + 1, 7) + 1] AS u2, c[w - x + greatest(x - 1, 0) + 1] AS w2 FROM a),
g AS (SELECT *, floor(CASE WHEN abs(u0 - w0) <= least(abs(u1 - w1), abs(u2 - w2)) THEN u0 + w0 + 1 WHEN abs(u1 - w1) < abs(u2 - w2) THEN u1 + w1 + 1 ELSE u2 + w2 + 1 END / 2) AS s FROM b),
r AS (SELECT vec_id, i, t, o, CASE WHEN i // 8 % 2 = 0 THEN o WHEN abs(floor((d + f) / 2) - s) > greatest(abs(d - p), abs(f - n), abs(o - t)) THEN s ELSE least(greatest(t, least(d, f, p, n)), greatest(d, f, p, n)) END AS made FROM g)
SELECT vec_id, list(made::BIGINT ORDER BY i) AS edges, list(CASE WHEN i // 8 % 2 = 0 THEN o ELSE t END::BIGINT ORDER BY i) AS time_only FROM r GROUP BY vec_id""")
def edge_deinterlaced(spark, sf_dir):
    """The lines of the other field from the pictures before and after and along edges, and from time alone."""
    made = lambda spatial: kernels.picture_kernel(lambda c, p, n: kernels.edge_directed(c, p, n, True, spatial), "array<bigint>")(F.col("c"), F.col("p"), F.col("n"), F.lit(WIDTH))
    return _neighbours(spark, sf_dir).select("vec_id", made(True).alias("edges"), made(False).alias("time_only"))


_SHIFT = "{'x': k % 2 * 4, 'y': k // 2 * 4, 'dx': s // 5 - 2, 'dy': s % 5 - 2}"
_APART = "list_sum(list_transform(range(16), lambda j: abs(c[(q.y + j // 4) * 8 + q.x + j % 4 + 1] - n[(q.y + q.dy + j // 4) * 8 + q.x + q.dx + j % 4 + 1])))"


@query(f"""
WITH {_THREE}
SELECT vec_id, flatten(list_transform(range(4), lambda k: list_transform([list_sort(list_transform(
  list_filter(list_transform(range(25), lambda s: {_SHIFT}), lambda q: q.x + q.dx BETWEEN 0 AND 4 AND q.y + q.dy BETWEEN 0 AND 4),
  lambda q: {{'apart': {_APART}, 'far': abs(q.dx) + abs(q.dy), 'dx': q.dx, 'dy': q.dy}}))[1]], lambda b: [b.dx, b.dy])[1]))::INTEGER[] AS vectors FROM t""")
def motion_vectors(spark, sf_dir):
    """The shift of each quarter of a picture to the next one, dx and dy in turn."""
    field = kernels.picture_kernel(lambda a, b: kernels.motion_field(a, b, 4, 2), "array<int>")
    return _neighbours(spark, sf_dir).select("vec_id", field(F.col("c"), F.col("n"), F.lit(WIDTH)).alias("vectors"))


_GX = " + ".join(f"{n} * d[i // 6 * 8 + i % 6 + {10 + k}]" for n, k in ((1, -7), (2, 1), (1, 9), (-1, -9), (-2, -1), (-1, 7)))
_GY = " + ".join(f"{n} * d[i // 6 * 8 + i % 6 + {10 + k}]" for n, k in ((1, 7), (2, 8), (1, 9), (-1, -9), (-2, -8), (-1, -7)))


def _bits(first: int) -> str:
    return f"list_sum(list_transform(range(32), lambda i: CASE WHEN d[i + {first + 1}] * 64 > list_sum(d) THEN 1::BIGINT << (31 - i) ELSE 0::BIGINT END))::BIGINT"


@query(f"""
WITH {_V}, h AS (SELECT vec_id, d, {_bits(0)} AS high, {_bits(32)} AS low FROM v)
SELECT vec_id, round(list_sum(d) / 64, 6) AS luma, round(list_sum(list_transform(range(36), lambda i: sqrt(({_GX}) ** 2 + ({_GY}) ** 2))) / 36, 6) AS edge,
  (CASE WHEN high >= 2147483648 THEN high - 4294967296 ELSE high END) * 4294967296 + low AS hash, list_transform(range(256), lambda x: len(list_filter(d, lambda y: y = x))::BIGINT) AS histogram FROM h""")
def frame_features(spark, sf_dir):
    own = _pictures(spark, sf_dir).select("vec_id", kernels.frame_features()(F.col("d"), F.lit(WIDTH)).alias("f")).select("vec_id", "f.*")
    return rounded(own, "luma", "edge")


@query(f"""
WITH {_V}
SELECT vec_id, list_transform(list_transform(range(58), lambda i: i * 48000 / 44100::DOUBLE), lambda p: round(d[floor(p)::INTEGER + 1] * (1 - p + floor(p)) + d[least(floor(p)::INTEGER + 2, 64)] * (p - floor(p)), 4)) AS resampled,
  list_transform(range(33), lambda k: round(sqrt(list_sum(list_transform(range(64), lambda i: d[i + 1] * cos(2 * pi() * (i * k % 64) / 64))) ** 2 + list_sum(list_transform(range(64), lambda i: d[i + 1] * sin(2 * pi() * (i * k % 64) / 64))) ** 2), 4)) AS spectrum
FROM v""")
def signal_kernels(spark, sf_dir):
    """A signal of 64 samples at another rate, and the sizes of its spectrum."""
    d, kernel = F.col("d"), kernels.picture_kernel
    resampled, spectrum = kernel(lambda a: kernels.resampled(a.ravel(), 48_000, 44_100)), kernel(lambda a: kernels.spectrum(a.ravel()))
    return _pictures(spark, sf_dir).select("vec_id", r4(resampled(d, F.lit(WIDTH))).alias("resampled"), r4(spectrum(d, F.lit(WIDTH))).alias("spectrum"))


def _tiles(a):
    return [float(v) for x, y, tile in kernels.tiles(a, 5, 2) for v in (x, y, tile.sum())]


@query(f"""
WITH {_V}
SELECT vec_id, flatten(list_transform([[0, 0], [3, 0], [0, 3], [3, 3]], lambda t: [t[1], t[2], list_sum(list_transform(range(25), lambda j: d[(t[2] + j // 5) * 8 + t[1] + j % 5 + 1]))]))::DOUBLE[] AS tiles,
  list_transform(d, lambda x: round(x / 2 + 1, 4)) AS merged FROM v""")
def tiled_pictures(spark, sf_dir):
    """Corners and sums of overlapping tiles, and the picture put together again from changed tiles."""
    whole = lambda a: kernels.merged_tiles([(x, y, tile / 2 + 1) for x, y, tile in kernels.tiles(a, 5, 2)], 8, 8, 2)
    d = F.col("d")
    return _pictures(spark, sf_dir).select("vec_id", kernels.picture_kernel(_tiles)(d, F.lit(WIDTH)).alias("tiles"), r4(kernels.picture_kernel(whole)(d, F.lit(WIDTH))).alias("merged"))


def _moments_sql(size: int, windows: int, step: int) -> str:
    """Means of contrast-structure and of SSIM over the windows of a and b, pictures of the given row length."""
    place = f"(w // {step} + j // 8) * {size} + w % {step} + j % 8 + 1"
    mean = lambda x: f"list_sum(list_transform(range(64), lambda j: {x})) / 64"
    a, b = f"a[{place}]", f"b[{place}]"
    return f"list_transform(range({windows}), lambda w: {{'ma': {mean(a)}, 'mb': {mean(b)}, 'aa': {mean(f'{a} * {a}')}, 'bb': {mean(f'{b} * {b}')}, 'ab': {mean(f'{a} * {b}')}}})"


_STRUCTURE = "(2 * (q.ab - q.ma * q.mb) + 58.5225::DOUBLE) / (q.aa - q.ma * q.ma + q.bb - q.mb * q.mb + 58.5225::DOUBLE)"
_LIGHT = "(2 * q.ma * q.mb + 6.5025::DOUBLE) / (q.ma * q.ma + q.mb * q.mb + 6.5025::DOUBLE)"


@query(f"""
WITH {_V}, l AS (SELECT vec_id, list_transform(range(256), lambda i: d[(i * 7 + i // 16 * 3) % 64 + 1]) AS a, list_transform(range(256), lambda i: d[(i * 7 + i // 16 * 3 + i % 3) % 64 + 1]) AS b FROM v),
f AS (SELECT vec_id, a, b, list_avg(list_transform({_moments_sql(16, 81, 9)}, lambda q: {_STRUCTURE})) AS first FROM l),
h AS (SELECT vec_id, first, list_transform(range(64), lambda i: (a[i // 8 * 32 + i % 8 * 2 + 1] + a[i // 8 * 32 + i % 8 * 2 + 2] + a[i // 8 * 32 + i % 8 * 2 + 17] + a[i // 8 * 32 + i % 8 * 2 + 18]) / 4) AS a,
  list_transform(range(64), lambda i: (b[i // 8 * 32 + i % 8 * 2 + 1] + b[i // 8 * 32 + i % 8 * 2 + 2] + b[i // 8 * 32 + i % 8 * 2 + 17] + b[i // 8 * 32 + i % 8 * 2 + 18]) / 4) AS b FROM f),
z AS (SELECT vec_id, first, list_avg(list_transform({_moments_sql(8, 1, 1)}, lambda q: {_STRUCTURE} * {_LIGHT})) AS last FROM h)
SELECT vec_id, round(pow(greatest(first, 0), 0.0448::DOUBLE) * pow(greatest(last, 0), (0.2856 + 0.3001 + 0.2363 + 0.1333)::DOUBLE), 6) AS ms_ssim FROM z""")
def multiscale_ssim(spark, sf_dir):
    """MS-SSIM of two pictures of 16 x 16, both laid out from one vector."""
    at = lambda shifted: F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.get("d", ((i * 7 + F.floor(i / 16) * 3 + (i % 3 if shifted else 0)) % 64).cast("int")))
    own = _pictures(spark, sf_dir).select("vec_id", at(False).alias("a"), at(True).alias("b"))
    return own.select("vec_id", r6(kernels.pair_metric(kernels.ms_ssim)("a", "b", F.lit(16))).alias("ms_ssim"))


# Titles


@query("""
WITH e AS (SELECT event_id, least(value / 100, 1) AS s, (event_id % 4000)::INTEGER + 1 AS w, (event_id % 4000 * 9 // 16)::INTEGER + 1 AS h, ['h264', 'HEVC', 'av1', 'vp9', 'vp8', 'mpeg2', 'x'][event_id % 7 + 1] AS codec, 80.0::DOUBLE + event_id % 20 AS target FROM events),
c AS (SELECT *, least(greatest(s * 0.3::DOUBLE + s * 0.3::DOUBLE + 0.5::DOUBLE * 0.15::DOUBLE + s * 0.15::DOUBLE + 0.25::DOUBLE * 0.1::DOUBLE, 0), 1) AS complexity,
  CASE WHEN w * h >= 8294400 THEN [22, 15000, 10000, 40000] WHEN w * h >= 2073600 THEN [23, 5000, 3000, 10000] WHEN w * h >= 921600 THEN [24, 3000, 1500, 5000] WHEN w * h >= 409920 THEN [26, 1500, 500, 2000] ELSE [28, 500, 200, 800] END AS r,
  [1, 1.3, 1.4, 1.25, 0.9, 0.6, 1][event_id % 7 + 1]::DOUBLE AS factor FROM e),
f AS (SELECT *, least(greatest(r[1] - (complexity - 0.5) * 4 - (target - 93) * 0.5, 15), 35) AS crf FROM c),
k AS (SELECT *, greatest(trunc(r[2] * pow(2, (r[1] - crf) / 6) / factor), 100) AS kbps FROM f)
SELECT event_id, round(crf, 6) AS crf, least(greatest(kbps, r[3]), r[4])::BIGINT AS kbps, least(greatest(trunc(kbps * 0.6::DOUBLE), r[3]), r[4])::BIGINT AS min_kbps, least(greatest(trunc(kbps * 1.5), r[3]), r[4])::BIGINT AS max_kbps,
  round(least(greatest(70 + least(kbps * 1000 / (w::BIGINT * h * 25.0::DOUBLE) * 500, 25) - complexity * 5, 40), 100), 6) AS vmaf FROM k""")
def encoding_predictions(spark, sf_dir):
    k, s = F.col("event_id"), F.least(F.col("value") / 100, F.lit(1.0))
    width, height = (k % 4000).cast("int") + 1, F.call_function("div", k % 4000 * 9, F.lit(16)).cast("int") + 1
    codec = F.get(F.array(*[F.lit(c) for c in ("h264", "HEVC", "av1", "vp9", "vp8", "mpeg2", "x")]), (k % 7).cast("int"))
    complexity = scores.content_complexity(s, s, F.lit(0.5), s, F.lit(0.25))
    made = regression.with_encoding_prediction(events(spark, sf_dir), width, height, F.lit(25.0), codec, 80.0 + k % 20, complexity)
    return rounded(made.select("event_id", "crf", "kbps", "min_kbps", "max_kbps", "vmaf"), "crf", "vmaf")


@query("""
SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 WHEN 2 THEN 2 / 3.0 ELSE 1.0 END::DOUBLE AS share FROM part""")
def filter_support(spark, sf_dir):
    texts = F.array(*[F.lit(t) for t in ("scale=640:-1,fps=30", "hflip,warp=a", "[a]crop=10:10[b]; vflip, drawtext=text='a,b'", "")])
    return table(spark, sf_dir, "part").select("p_partkey", filters.supported_share_of(F.get(texts, F.col("p_size") % 4)).alias("share"))


# Streams and reports


@query("""
SELECT p_partkey + 1 AS file_index, k AS stream_index, CASE k WHEN 0 THEN 'codec' WHEN 1 THEN 'resolution' ELSE 'channels' END AS problem, CASE k WHEN 0 THEN 'h264' WHEN 1 THEN '640x480' ELSE '2' END AS expected,
  CASE k WHEN 0 THEN 'hevc' WHEN 1 THEN '640x360' ELSE '6' END AS found
FROM (SELECT p_partkey, unnest([0, 1, 2]) AS k FROM part) WHERE p_partkey % 4 <> 0 AND (p_partkey + k) % 3 = 0
UNION ALL SELECT p_partkey + 1, NULL, 'stream count', '3', '2' FROM part WHERE p_partkey % 4 = 0""")
def stream_mismatches(spark, sf_dir):
    """Files of three streams against file 0; every fourth file lacks one."""
    own = table(spark, sf_dir, "part").select((F.col("p_partkey") + 1).alias("file_index"), "p_partkey", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("stream_index"))
    wrong, k = (F.col("p_partkey") + F.col("stream_index")) % 3 == 0, F.col("stream_index")
    columns = lambda bad: [F.when(k == 2, "audio").otherwise("video").alias("track_type"), F.when(bad & (k == 0), "hevc").otherwise("h264").alias("codec"), F.when(k < 2, 640).alias("width"), F.when(k < 2, F.when(bad & (k == 1), 360).otherwise(480)).alias("height"), F.when(k == 2, 48_000).alias("sample_rate"), F.when(k == 2, F.when(bad, 6).otherwise(2)).alias("channels")]
    rest = own.where((F.col("p_partkey") % 4 != 0) | (k < 2)).select("file_index", "stream_index", *columns(wrong))
    first = spark.range(3).select(F.lit(0).cast("long").alias("file_index"), F.col("id").cast("int").alias("stream_index")).select("file_index", "stream_index", *columns(F.lit(False)))
    return segments.incompatible_streams(first.unionAll(rest), strict=True)


_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'passed' WHEN 'O' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'failed' ELSE 'skipped' END ELSE 'error' END"


@query(f"""
WITH t AS (SELECT o_orderkey, o_orderpriority AS p, o_orderkey % 1000 AS ms, {_STATUS} AS s FROM orders),
c AS (SELECT count(*) AS n, count(*) FILTER (s = 'passed') AS ok, count(*) FILTER (s = 'failed') AS bad, count(*) FILTER (s = 'skipped') AS sk, count(*) FILTER (s = 'error') AS er, sum(ms)::BIGINT AS ms FROM t),
g AS (SELECT p, count(*) AS n, count(*) FILTER (s = 'passed') AS ok, count(*) FILTER (s = 'failed') AS bad FROM t GROUP BY p)
SELECT 0 AS section, '' AS profile, unnest(['0', '1', '2', '3', '4', '5']) AS place, unnest(['Total: ' || n, printf('Passed: %d (%.1f%%)', ok, ok / n * 100), 'Failed: ' || bad, 'Skipped: ' || sk, 'Errors: ' || er, 'Duration: ' || ms || 'ms']) AS line FROM c
UNION ALL SELECT 1, p, '', printf('%s: %d of %d passed (%.1f%%), %d failed', p, ok, n, ok / n * 100, bad) FROM g
UNION ALL SELECT 2, p, o_orderkey::VARCHAR, CASE s WHEN 'passed' THEN '[PASS]' WHEN 'failed' THEN '[FAIL]' WHEN 'skipped' THEN '[SKIP]' ELSE '[ERR]' END || ' ' || o_orderkey || ' ' || ms || 'ms' FROM t""")
def conformance_report(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "passed").when(F.col("o_orderstatus") == "O", F.when(F.col("o_orderkey") % 2 == 0, "failed").otherwise("skipped")).otherwise("error")
    own = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", (F.col("o_orderkey") % 1000).alias("ms"), status.alias("status"))
    return render.report_lines(own, "o_orderpriority", "o_orderkey", "status", "ms")


@query("""
WITH s AS (SELECT user_id, count(*) AS n, user_id % 50 + 0.5::DOUBLE AS p, user_id % 8 / 8.0::DOUBLE AS s, CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id % 100 END::DOUBLE AS v FROM events GROUP BY user_id)
SELECT user_id, unnest(range(-8, 0)) AS place, unnest(['<!DOCTYPE html><html><head><title>Quality</title></head><body>', printf('<div class="card"><b>Frames</b> %d</div>', n), printf('<div class="card"><b>Avg PSNR</b> %.2f dB</div>', p),
  printf('<div class="card"><b>Avg SSIM</b> %.4f</div>', s), printf('<div class="card"><b>Avg VMAF</b> %.1f</div>', v), printf('<div class="card"><b>PSNR</b> %.1f to %.1f dB</div>', p, p),
  printf('<div class="card"><b>SSIM</b> %.4f to %.4f</div>', s, s), '<table><tr><th>Frame</th><th>PSNR</th><th>SSIM</th><th>VMAF</th></tr>']) AS line FROM s
UNION ALL SELECT user_id, event_id, printf('<tr><td>%d</td><td>%.2f</td><td>%.4f</td><td>%s</td></tr>', event_id, p, s, CASE WHEN user_id % 3 = 0 THEN '' ELSE printf('%.2f', v) END) FROM events JOIN s USING (user_id)
UNION ALL SELECT user_id, NULL, '</table></body></html>' FROM s""")
def dashboard_pages(spark, sf_dir):
    """Values are the same in all frames of a user and short, so that formatting rounds none."""
    u = F.col("user_id")
    frames = events(spark, sf_dir).select("user_id", F.col("event_id").alias("frame"), (u % 50 + 0.5).alias("psnr"), (u % 8 / 8).alias("ssim"), F.when(u % 3 != 0, (u % 100).cast("double")).alias("vmaf"))
    summary = metrics.summary(frames, ["user_id"], ["psnr", "ssim", "vmaf"]).join(frames.groupBy("user_id").agg(F.count("*").alias("total_frames")), "user_id")
    return render.dashboard_page(frames, summary, ["user_id"])


# Regression


@query("""
WITH RECURSIVE e AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS k, count(*) OVER () AS n, (event_id % 50) / 50.0::DOUBLE AS q, value / 100 AS y FROM events),
x AS (SELECT least(k // greatest(n // 4, 1), 3) AS fold, q, y FROM e), f AS (SELECT unnest([0, 1, 2, 3]) AS fold),
m AS (SELECT f.fold, count(*)::DOUBLE AS n, sum(q) AS q, sum(y) AS y, sum(q * q) AS qq, sum(q * y) AS qy FROM f JOIN x ON x.fold <> f.fold GROUP BY f.fold),
g AS (SELECT fold, 0 AS i, 0::DOUBLE AS a, 0::DOUBLE AS b FROM f UNION ALL
  SELECT g.fold, i + 1, a - (n * a + q * b - y) / n / 10, b - ((q * a + qq * b - qy) / n + b / 1000) / 10 FROM g JOIN m ON m.fold = g.fold WHERE i < 200)
SELECT x.fold::INTEGER AS fold, round(avg(abs(a + q * b - y)), 6) AS mae FROM x JOIN g ON g.fold = x.fold AND g.i = 200 GROUP BY x.fold""")
def cross_validation(spark, sf_dir):
    own = events(spark, sf_dir).select("event_id", (F.col("event_id") % 50 / 50).alias("q"), (F.col("value") / 100).alias("y"))
    errors = regression.cross_validated(own, ["event_id"], ["q"], "y", 4, rounds=200)
    return spark.createDataFrame([(i, round(e, 6)) for i, e in enumerate(errors)], "fold int, mae double")
