"""Queries over the test tables by name, and for each the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from montage.functions import scalars, vectors
from montage.operators import clusters, radius, series, shots, speakers
from montage.plans import keyframes
from montage.sources import results, sinks
from montage.sources.tables import frames, motion, read, segments

Query = Callable[[SparkSession, str], DataFrame]
#: A gap that gives the short test videos several shots.
GAP = 5
EPS = 0.7

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_FRAMES = "f AS (SELECT label AS media_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_idx, embedding AS clip FROM embeddings)"
_SERIES = "s AS (SELECT user_id AS media_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, value AS score FROM events)"
_SEGMENTS = """g AS (SELECT conv_id AS media_id, turn AS seg_index, a / 10 AS start, a / 10 + n / 10 AS "end", text, role AS speaker FROM (
  SELECT *, length(text) AS n, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM conversations))"""
_DIFFS = f"""{_FRAMES}, p AS (SELECT media_id, frame_idx, clip, lag(clip) OVER (PARTITION BY media_id ORDER BY frame_idx) AS b FROM f),
e AS (SELECT media_id, frame_idx, CAST(unnest(clip) AS DOUBLE) AS x, CAST(unnest(b) AS DOUBLE) AS y FROM p WHERE b IS NOT NULL),
d AS (SELECT media_id, frame_idx AS idx, round(1 - coalesce(corr(x, y), 1), 6) AS diff FROM e GROUP BY ALL)"""
_LIMIT = """t AS (SELECT media_id, round(CASE WHEN avg(diff) + 2.5 * stddev_pop(diff) > quantile_cont(diff, 0.98) THEN quantile_cont(diff, 0.95)
  ELSE avg(diff) + 2.5 * stddev_pop(diff) END, 6) AS threshold FROM d GROUP BY media_id)"""
_FLOW = f"""{_SERIES}, d AS (SELECT * FROM (SELECT media_id, idx, round(abs(score - lag(score) OVER (PARTITION BY media_id ORDER BY idx)), 6) AS diff FROM s) WHERE diff IS NOT NULL),
t AS (SELECT media_id, round(quantile_cont(diff, 0.95), 6) AS threshold FROM d GROUP BY media_id)"""


def _bounds(gap: int) -> str:
    return f"""h AS (SELECT media_id, list_concat([[0]], coalesce(list([idx] ORDER BY idx) FILTER (diff > threshold), [])) AS l FROM d JOIN t USING (media_id) GROUP BY media_id),
b AS (SELECT media_id, unnest(list_reduce(l, lambda a, x: CASE WHEN x[1] - a[len(a)] > {gap} THEN list_concat(a, x) ELSE a END)) AS boundary FROM h)"""


def _shots(base: str, total: str) -> str:
    return f"""n AS (SELECT media_id, count(*) AS total FROM {total} GROUP BY media_id),
i AS (SELECT media_id, row_number() OVER w - 1 AS shot_id, boundary AS start_frame, coalesce(lead(boundary) OVER w, total) AS end_frame
  FROM {base} JOIN n USING (media_id) WINDOW w AS (PARTITION BY media_id ORDER BY boundary)),
k AS (SELECT *, end_frame - start_frame AS duration_frames FROM i)"""


_HIST = f"{_DIFFS}, {_LIMIT}, {_bounds(GAP)}, {_shots('b', 'f')}"
_PAIRS = f"""{_FRAMES}, q AS (SELECT x.media_id, x.frame_idx AS a, y.frame_idx AS b,
  round(1 - greatest(-1, least(1, list_cosine_similarity(x.clip::DOUBLE[], y.clip::DOUBLE[]))), 6) AS dist FROM f x JOIN f y ON x.media_id = y.media_id AND x.frame_idx < y.frame_idx)"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name, with its SQL if it has one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"WITH {_DIFFS} SELECT media_id, idx, diff FROM d")
def shot_diffs(spark: SparkSession, sf: str) -> DataFrame:
    return shots.changes(frames(spark, sf))


@query(f"WITH {_DIFFS}, {_LIMIT} SELECT * FROM t")
def shot_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return shots.histogram_threshold(shots.changes(frames(spark, sf)))


@query(f"WITH {_DIFFS}, {_LIMIT}, {_bounds(GAP)} SELECT media_id, boundary FROM b")
def shot_boundaries(spark: SparkSession, sf: str) -> DataFrame:
    diffs = shots.changes(frames(spark, sf))
    return shots.boundaries(diffs, shots.histogram_threshold(diffs), GAP)


@query(f"""WITH {_HIST} SELECT k.media_id, shot_id, start_frame, end_frame, duration_frames,
  round(coalesce(greatest(0.1, least(1, 1 - avg(diff))), 0.5), 4) AS confidence
  FROM k LEFT JOIN d ON k.media_id = d.media_id AND d.idx >= start_frame AND d.idx < end_frame GROUP BY ALL""")
def shots_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return shots.histogram_shots(frames(spark, sf), GAP)


@query(f"WITH {_FLOW}, {_bounds(GAP)}, {_shots('b', 's')} SELECT *, 0.7::DOUBLE AS confidence FROM k")
def shots_flow(spark: SparkSession, sf: str) -> DataFrame:
    return shots.flow_shots(motion(spark, sf), GAP)


def _usable_sql(least: int, most: int) -> str:
    return f"""WITH {_HIST}, r AS (SELECT *, duration_frames BETWEEN {least} AND {most} AS fit,
  count(*) FILTER (duration_frames BETWEEN {least} AND {most}) OVER p AS fits, count(*) OVER p AS n, max(end_frame) OVER p AS total,
  row_number() OVER (PARTITION BY media_id ORDER BY duration_frames DESC, shot_id) AS rank FROM k WINDOW p AS (PARTITION BY media_id)),
u AS (SELECT *, CASE WHEN fits > 0 THEN shot_id ELSE rank END AS place FROM r WHERE CASE WHEN fits > 0 THEN fit ELSE rank <= greatest(1, n // 2) END)
SELECT media_id, shot_id, CASE WHEN place = min(place) OVER p THEN 0 ELSE start_frame END AS start_frame,
  CASE WHEN place = max(place) OVER p THEN total ELSE end_frame END AS end_frame, duration_frames FROM u WINDOW p AS (PARTITION BY media_id)"""


@query(_usable_sql(10, 3000))
def shots_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return shots.usable(shots.histogram_shots(frames(spark, sf), GAP), 10, 3000)


@query(_usable_sql(3001, 9000))
def longest_half_fallback(spark: SparkSession, sf: str) -> DataFrame:
    return shots.usable(shots.histogram_shots(frames(spark, sf), GAP), 3001, 9000)


@query(f"WITH {_HIST} SELECT k.media_id, shot_id, frame_idx FROM k JOIN f ON k.media_id = f.media_id AND frame_idx BETWEEN start_frame AND end_frame")
def frames_in_shots(spark: SparkSession, sf: str) -> DataFrame:
    rows = frames(spark, sf)
    return shots.frames_in_shots(rows, shots.histogram_shots(rows, GAP))


@query(f"""WITH {_HIST}, o AS (SELECT k.media_id, shot_id, frame_idx, abs(frame_idx - (start_frame + end_frame) // 2) AS off FROM k JOIN f USING (media_id))
SELECT media_id, shot_id, frame_idx, off FROM o QUALIFY row_number() OVER (PARTITION BY media_id, shot_id ORDER BY off, frame_idx) = 1""")
def nearest_frame(spark: SparkSession, sf: str) -> DataFrame:
    rows = frames(spark, sf)
    return shots.nearest_frame(rows, shots.histogram_shots(rows, GAP))


@query(f"WITH {_HIST} SELECT k.media_id, shot_id FROM k WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.media_id = k.media_id AND frame_idx BETWEEN start_frame AND end_frame AND frame_idx % 20 = 0)")
def shots_without_frames(spark: SparkSession, sf: str) -> DataFrame:
    rows = frames(spark, sf)
    found = shots.histogram_shots(rows, GAP)
    return found.join(shots.frames_in_shots(rows.filter(F.col("frame_idx") % 20 == 0), found), ["media_id", "shot_id"], "left_anti").select("media_id", "shot_id")


@query("""SELECT o.o_custkey AS media_id, o.o_orderpriority AS shot_id, o.o_orderkey AS frame_idx, 90 AS duration_frames, o.o_totalprice AS confidence,
  row_number() OVER (PARTITION BY o.o_custkey, o.o_orderpriority ORDER BY o.o_totalprice DESC, o.o_orderkey)::INTEGER AS rank FROM orders o QUALIFY rank <= 3""")
def topk_per_shot(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "orders").select(
        F.col("o_custkey").alias("media_id"), F.col("o_orderpriority").alias("shot_id"), F.col("o_orderkey").alias("frame_idx"),
        F.lit(90).alias("duration_frames"), F.col("o_totalprice").alias("confidence"),
    )
    return shots.best_per_shot(rows, 5)


@query(f"WITH {_FLOW} SELECT media_id, idx, diff FROM d")
def motion_delta(spark: SparkSession, sf: str) -> DataFrame:
    return shots.deltas(motion(spark, sf))


def _smooth_sql() -> str:
    at = lambda k: f"lag(score, {-k}) OVER w" if k <= 0 else f"lead(score, {k}) OVER w"
    cases = "WHEN n < 5 THEN score"
    for k, weights in enumerate(series.EDGE):
        for place, turn in ((f"idx = {k}", 1), (f"n - 1 - idx = {k}", -1)):
            cases += f" WHEN {place} THEN (" + " + ".join(f"{c}.0 * ({at(turn * (j - k))})" for j, c in enumerate(weights)) + ") / 35"
    inner = " + ".join(f"{c}.0 * ({at(j - 2)})" for j, c in enumerate(series.SMOOTH))
    return f"m AS (SELECT media_id, idx, n, round(CASE {cases} ELSE ({inner}) / 35 END, 6) AS smooth FROM (SELECT *, count(*) OVER (PARTITION BY media_id) AS n FROM s) WINDOW w AS (PARTITION BY media_id ORDER BY idx))"


_PEAKS = f"""{_SERIES}, {_smooth_sql()}, z AS (SELECT *, lag(smooth) OVER w AS before, lead(smooth) OVER w AS after,
  quantile_cont(smooth, 0.7) OVER (PARTITION BY media_id) AS low FROM m WINDOW w AS (PARTITION BY media_id ORDER BY idx)),
pk AS (SELECT media_id, idx, smooth FROM z WHERE n < 3 OR (smooth > before AND smooth > after AND smooth >= low))"""


@query(f"WITH {_SERIES}, {_smooth_sql()} SELECT media_id, idx, smooth FROM m")
def motion_smooth(spark: SparkSession, sf: str) -> DataFrame:
    return series.smoothed(motion(spark, sf))


@query(f"WITH {_PEAKS} SELECT * FROM pk")
def motion_peaks(spark: SparkSession, sf: str) -> DataFrame:
    return series.peaks(motion(spark, sf))


@query(f"WITH {_SERIES} SELECT media_id, idx, round(score + stddev_pop(score) OVER (PARTITION BY media_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS rolled FROM s")
def rolling_motion_score(spark: SparkSession, sf: str) -> DataFrame:
    return series.rolling(motion(spark, sf))


@query(f"""WITH {_SERIES}, c AS (SELECT *, count(*) OVER (PARTITION BY media_id) AS n FROM s)
SELECT media_id, idx, score FROM c WHERE list_contains(list_transform(range(0, least(n, 3)), lambda i: i * (n - 1) // greatest(least(n, 3) - 1, 1)), idx)""")
def uniform_pick(spark: SparkSession, sf: str) -> DataFrame:
    return series.uniform_pick(motion(spark, sf))


@query(f"""WITH {_PEAKS}, c AS (SELECT *, count(*) OVER (PARTITION BY media_id) AS n FROM s),
u AS (SELECT media_id, idx FROM c WHERE idx = 0 OR idx = n - 1 OR (n > 5 AND (idx = n // 3 OR idx = 2 * n // 3)) UNION SELECT media_id, idx FROM pk),
v AS (SELECT media_id, count(*) AS have FROM u GROUP BY media_id)
SELECT * FROM u UNION SELECT media_id, idx FROM c JOIN v USING (media_id) WHERE have < 3 AND n > 3 AND idx > 0 AND idx % greatest(n // 5, 1) = 0 AND idx <= 4 * (n // 5)""")
def candidates(spark: SparkSession, sf: str) -> DataFrame:
    return series.candidates(motion(spark, sf))


@query("""SELECT event_id, date_trunc('day', ts) AS bucket, row_number() OVER (PARTITION BY date_trunc('day', ts) ORDER BY md5(event_id::VARCHAR), event_id)::INTEGER AS rank
FROM events QUALIFY rank <= 3""")
def random_per_bucket(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "events")
    return series.sampled(rows, F.date_trunc("day", "ts").cast("timestamp_ntz"), F.col("event_id"), 3).select("event_id", "bucket", "rank")


@query(f"WITH {_FRAMES}, n AS (SELECT media_id, count(*) AS total FROM f GROUP BY media_id) SELECT media_id, frame_idx FROM f JOIN n USING (media_id) WHERE frame_idx % greatest(1, total // 10) = 0")
def frame_stride_sample(spark: SparkSession, sf: str) -> DataFrame:
    rows = frames(spark, sf)
    stride = F.greatest(F.lit(1), F.floor(F.col("total") / 10))
    return rows.join(shots.totals(rows), "media_id").filter(F.col("frame_idx") % stride == 0).select("media_id", "frame_idx")


@query(f"WITH {_PAIRS} SELECT * FROM q")
def pairwise_cosine(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.pairs(frames(spark, sf))


@query(f"""WITH {_PAIRS}, z AS (SELECT media_id, a, min(dist) AS near FROM (SELECT media_id, a, dist FROM q UNION ALL SELECT media_id, b, dist FROM q) GROUP BY ALL)
SELECT media_id, round(greatest(0.05, least(0.3, 1.5 * median(near))), 6) AS eps FROM z WHERE near < 2 GROUP BY media_id""")
def adaptive_eps(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.eps_of(radius.nearest(frames(spark, sf)))


@query(f"WITH {_PAIRS} SELECT media_id, a, b, dist FROM q WHERE dist <= {EPS}")
def near_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return radius.near_pairs(frames(spark, sf), EPS)


_DENSITY = f"""{_PAIRS}, e AS (SELECT media_id, a, b FROM q WHERE dist <= {EPS} UNION ALL SELECT media_id, b, a FROM q WHERE dist <= {EPS}),
r AS (SELECT media_id, a AS v, a AS label FROM e UNION SELECT e.media_id, e.b, r.label FROM r JOIN e ON r.media_id = e.media_id AND r.v = e.a),
c AS (SELECT media_id, v AS frame_idx, dense_rank() OVER (PARTITION BY media_id ORDER BY min(label)) - 1 AS cluster_id FROM r GROUP BY media_id, v),
cl AS (SELECT f.media_id, f.frame_idx, coalesce(cluster_id, -1) AS cluster_id FROM f LEFT JOIN c ON f.media_id = c.media_id AND f.frame_idx = c.frame_idx)"""


def _clustered(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = frames(spark, sf)
    return rows, clusters.labelled(rows, radius.links(rows, EPS))


@query(f"WITH RECURSIVE {_DENSITY} SELECT * FROM cl")
def density_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return _clustered(spark, sf)[1]


_CENTRES = f"""{_DENSITY}, x AS (SELECT cl.media_id, cluster_id, cl.frame_idx, CAST(unnest(clip) AS DOUBLE) / sqrt(list_inner_product(clip::DOUBLE[], clip::DOUBLE[])) AS x, generate_subscripts(clip, 1) AS i FROM cl JOIN f USING (media_id, frame_idx) WHERE cluster_id >= 0),
ce AS (SELECT media_id, cluster_id, i, avg(x) AS m FROM x GROUP BY ALL)"""


@query(f"WITH RECURSIVE {_CENTRES} SELECT media_id, cluster_id, count(*) AS dims, round(sum(m), 6) AS total FROM ce GROUP BY ALL")
def cluster_centroids(spark: SparkSession, sf: str) -> DataFrame:
    found = clusters.centroids(*_clustered(spark, sf))
    return found.select("media_id", "cluster_id", F.size("centroid").cast("long").alias("dims"), F.round(vectors.total(F.col("centroid")), 6).alias("total"))


@query(f"""WITH RECURSIVE {_CENTRES}, di AS (SELECT media_id, cluster_id, frame_idx, sqrt(sum((x - m) * (x - m))) AS d FROM x JOIN ce USING (media_id, cluster_id, i) GROUP BY ALL),
w AS (SELECT *, max(d) OVER p AS most, count(*) OVER p AS n, row_number() OVER (PARTITION BY media_id, cluster_id ORDER BY round(d, 9), frame_idx) AS rank FROM di WINDOW p AS (PARTITION BY media_id, cluster_id))
SELECT media_id, cluster_id, frame_idx, round(greatest(0.3, least(1, 1 - d / (CASE WHEN n = 1 THEN 1 ELSE most END + 1e-8))), 4) AS confidence FROM w WHERE rank = 1
UNION ALL SELECT media_id, cluster_id, frame_idx, 0.6 FROM cl WHERE cluster_id < 0""")
def cluster_representatives(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.representatives(*_clustered(spark, sf))


@query()
def speaker_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.speaker_clusters(frames(spark, sf))


@query(f"""WITH {_SEGMENTS} SELECT media_id, seg_index, round(greatest(0, start - 0.1), 4) AS cut_start, round("end" - start + 0.2, 4) AS cut_duration,
  printf('segment_%04d', seg_index) AS name FROM g""")
def segment_cut_interval(spark: SparkSession, sf: str) -> DataFrame:
    return speakers.cut_intervals(segments(spark, sf))


@query(f"WITH {_SEGMENTS} SELECT media_id, seg_index, t AS text FROM (SELECT *, regexp_replace(replace(text, chr(10), ' '), '^\\s+|\\s+$', '', 'g') AS t FROM g) WHERE t <> ''")
def segment_text_clean(spark: SparkSession, sf: str) -> DataFrame:
    return speakers.cleaned(segments(spark, sf))


@query(f"""WITH {_SEGMENTS} SELECT media_id, speaker, seg_index, printf('%s_%03d', speaker, row_number() OVER (PARTITION BY media_id, speaker ORDER BY start, seg_index) - 1) AS file,
  round("end" - start, 4) AS duration FROM g""")
def speaker_export(spark: SparkSession, sf: str) -> DataFrame:
    return speakers.exported(segments(spark, sf))


@query(f"""WITH {_SEGMENTS}, a AS (SELECT media_id, speaker, count(*) AS segments, round(sum("end" - start), 4) AS seconds, round(avg("end" - start), 4) AS mean_seconds,
  list(text ORDER BY start, seg_index) AS t FROM g GROUP BY ALL)
SELECT media_id, speaker, segments, seconds, mean_seconds, array_to_string(t[1:3], ' / ') AS first_texts, greatest(0, segments - 3) AS more,
  printf('%02d:%05.2f', CAST(floor(seconds / 60) AS INTEGER), seconds % 60) AS clock FROM a""")
def speaker_summary(spark: SparkSession, sf: str) -> DataFrame:
    return speakers.summary(segments(spark, sf))


@query(f"""WITH {_SEGMENTS} SELECT CASE WHEN grouping(speaker) = 1 THEN '(all)' ELSE speaker END AS speaker, count(*) AS segments, round(sum("end" - start), 3) AS seconds FROM g GROUP BY ROLLUP (speaker)""")
def speaker_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return speakers.rollup(segments(spark, sf))


@query("SELECT source AS method, count(*) AS n, count(DISTINCT lang) AS kinds FROM documents GROUP BY source")
def method_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").groupBy(F.col("source").alias("method")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("lang").alias("kinds"))


@query("SELECT event_type, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, round(stddev_pop(value), 6) AS deviation FROM events GROUP BY event_type")
def confidence_stats(spark: SparkSession, sf: str) -> DataFrame:
    agg = F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"), F.round(F.stddev_pop("value"), 6).alias("deviation")
    return read(spark, sf, "events").groupBy("event_type").agg(*agg)


@query("""SELECT label AS media_id, round(avg(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 6) AS mean_norm,
  round(sum(list_sum(embedding::DOUBLE[])) / sum(len(embedding)), 8) AS mean_cell FROM embeddings GROUP BY label""")
def feature_summary(spark: SparkSession, sf: str) -> DataFrame:
    clip = vectors.doubles(F.col("embedding"))
    return read(spark, sf, "embeddings").groupBy(F.col("label").alias("media_id")).agg(
        F.round(F.avg(vectors.norm(clip)), 6).alias("mean_norm"), F.round(F.sum(vectors.total(clip)) / F.sum(F.size("embedding")), 8).alias("mean_cell")
    )


@query("SELECT event_type, CAST(least(15, floor(value * 16 / 512)) AS BIGINT) AS bin, count(*) AS n FROM events GROUP BY ALL")
def value_histogram(spark: SparkSession, sf: str) -> DataFrame:
    place = F.least(F.lit(15), F.floor(F.col("value") * 16 / 512)).cast("long").alias("bin")
    return read(spark, sf, "events").groupBy("event_type", place).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT p_partkey, CASE WHEN d > 3600 THEN least(5, f // 4) WHEN d > 1800 THEN least(8, f // 3) ELSE least(12, f // 2) END AS target_fps,
  CASE WHEN d > 1800 THEN greatest(3, 8) ELSE 10 END AS keyframes FROM (SELECT p_partkey, p_size + 10 AS f, p_retailprice * 2 AS d FROM part)""")
def config_optimise(spark: SparkSession, sf: str) -> DataFrame:
    f, d = F.col("p_size") + 10, F.col("p_retailprice") * 2
    target = F.when(d > 3600, F.least(F.lit(5), F.floor(f / 4))).when(d > 1800, F.least(F.lit(8), F.floor(f / 3))).otherwise(F.least(F.lit(12), F.floor(f / 2)))
    return read(spark, sf, "part").select("p_partkey", target.alias("target_fps"), F.when(d > 1800, 8).otherwise(10).alias("keyframes"))


@query("SELECT p_partkey, CAST(floor(w * s) AS BIGINT) AS w, CAST(floor(h * s) AS BIGINT) AS h FROM (SELECT *, least(1.0::DOUBLE, 512 / w, 384 / h) AS s FROM (SELECT p_partkey, CAST(p_size * 40 AS DOUBLE) AS w, p_retailprice AS h FROM part))")
def bounded_resize(spark: SparkSession, sf: str) -> DataFrame:
    w, h = scalars.bounded((F.col("p_size") * 40).cast("double"), F.col("p_retailprice"), 512, 384)
    return read(spark, sf, "part").select("p_partkey", w.alias("w"), h.alias("h"))


@query("SELECT page_id, regexp_replace(url, '[^\\p{L}\\p{N}._-]', '', 'g') AS name, contains(url, '.') AND lower(list_last(string_split(url, '.'))) IN ('mp4', 'html') AS listed FROM pages")
def safe_filename(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "pages").select("page_id", scalars.safe_name(F.col("url")).alias("name"), scalars.has_kind(F.col("url"), ("mp4", "html")).alias("listed"))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_discount), 6) AS mean, round(count(*) * avg(l_discount), 3) AS efficiency,
  row_number() OVER (ORDER BY count(*) DESC, l_returnflag, l_linestatus)::INTEGER AS rank FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def efficiency_rank(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    rows = read(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.avg("l_discount").alias("mean"))
    # one row per flag and status is left here
    rank = F.row_number().over(Window.orderBy(F.col("n").desc(), "l_returnflag", "l_linestatus"))
    return rows.select("l_returnflag", "l_linestatus", "n", F.round("mean", 6).alias("mean"), F.round(F.col("n") * F.col("mean"), 3).alias("efficiency"), rank.alias("rank"))


def _spaced_sql() -> str:
    def kept(name: str, share: float, least: int, part: int, source: str) -> str:
        return f"""{name}h AS (SELECT media_id, n, quantile_cont(smooth, {share}) OVER (PARTITION BY media_id) AS low, idx, smooth, before, after FROM z),
{name}l AS (SELECT media_id, CASE WHEN n < 3 THEN 0 ELSE greatest({least}, n // {part}) END AS apart, list([idx] ORDER BY smooth DESC, idx) AS l FROM {name}h
  WHERE (n < 3 OR (smooth > before AND smooth > after AND smooth >= low)) {source} GROUP BY ALL),
{name} AS (SELECT media_id, unnest(list_reduce(l, lambda a, x: CASE WHEN len(list_filter(a, lambda k: abs(k - x[1]) < apart)) = 0 THEN list_concat(a, x) ELSE a END)) AS idx FROM {name}l)"""

    return f"WITH {_PEAKS}, {kept('hi', 0.7, 3, 20, '')}, {kept('lo', 0.5, 2, 30, 'AND media_id NOT IN (SELECT media_id FROM hi)')} SELECT * FROM hi UNION ALL SELECT * FROM lo"


@query(_spaced_sql())
def motion_peaks_spaced(spark: SparkSession, sf: str) -> DataFrame:
    return series.spaced_peaks(motion(spark, sf))


@query(f"""WITH {_SERIES}, c AS (SELECT *, count(*) OVER (PARTITION BY media_id) AS n, lag(score) OVER w AS b, lead(score) OVER w AS a FROM s WINDOW w AS (PARTITION BY media_id ORDER BY idx)),
i AS (SELECT * FROM c WHERE idx >= 2 AND idx < n - 2)
SELECT media_id, idx, 'turn' AS kind FROM i WHERE abs((score - b) - (a - score)) > 0.5
UNION ALL SELECT media_id, idx, 'peak' FROM i WHERE score > b AND score > a AND score > 0.8
UNION ALL SELECT media_id, idx, 'valley' FROM i WHERE score < b AND score < a AND b > 1.0""")
def motion_pattern_changes(spark: SparkSession, sf: str) -> DataFrame:
    return series.pattern_changes(motion(spark, sf))


@query(f"""WITH {_FRAMES}, c AS (SELECT media_id, frame_idx, round(list_cosine_similarity(clip::DOUBLE[], (lag(clip) OVER (PARTITION BY media_id ORDER BY frame_idx))::DOUBLE[]), 6) AS similarity FROM f)
SELECT * FROM c WHERE similarity < 0.85""")
def semantic_changes(spark: SparkSession, sf: str) -> DataFrame:
    return shots.semantic_changes(frames(spark, sf))


_FIRST = f"""{_HIST}, hs AS (SELECT k.media_id, shot_id, start_frame, end_frame, duration_frames, round(coalesce(greatest(0.1, least(1, 1 - avg(diff))), 0.5), 4) AS confidence
  FROM k LEFT JOIN d ON k.media_id = d.media_id AND d.idx >= start_frame AND d.idx < end_frame GROUP BY ALL),
fs AS (WITH {_FLOW}, {_bounds(GAP)}, {_shots('b', 's')} SELECT *, 0.7::DOUBLE AS confidence FROM k)"""


@query(f"""WITH {_FIRST} SELECT *, 'histogram' AS method FROM hs UNION ALL SELECT *, 'flow' FROM fs WHERE media_id NOT IN (SELECT media_id FROM hs)
UNION ALL SELECT c_custkey, 0, 0, c_nationkey, c_nationkey, 0.5, 'whole' FROM customer WHERE c_custkey NOT IN (SELECT media_id FROM hs UNION ALL SELECT media_id FROM fs)
  AND c_custkey NOT IN (SELECT label FROM embeddings UNION ALL SELECT user_id FROM events)""")
def shots_first_found(spark: SparkSession, sf: str) -> DataFrame:
    customers = read(spark, sf, "customer").select(F.col("c_custkey").alias("media_id"), F.col("c_nationkey").cast("long").alias("total"))
    clips, scores = frames(spark, sf), motion(spark, sf)
    return shots.first_found(customers, ("histogram", shots.histogram_shots(clips, GAP)), ("flow", shots.flow_shots(scores, GAP)))


@query("""SELECT l_linenumber, CAST(floor(l_linenumber * 100 / 7) AS BIGINT) AS percent, CASE WHEN p < 15 THEN 0 WHEN p < 30 THEN 1 WHEN p < 45 THEN 2 WHEN p < 60 THEN 3 WHEN p < 75 THEN 4
  WHEN p < 90 THEN 5 ELSE 6 END AS step, count(*) AS n FROM (SELECT l_linenumber, floor(l_linenumber * 100 / 7) AS p FROM lineitem) GROUP BY ALL""")
def progress_steps(spark: SparkSession, sf: str) -> DataFrame:
    percent, step = scalars.progress(F.col("l_linenumber"), 7)
    return read(spark, sf, "lineitem").groupBy("l_linenumber", percent.alias("percent"), step.alias("step")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN event_id END AS keyframes, CASE event_type WHEN 'view' THEN event_id END AS shots,
  CASE WHEN event_type NOT IN ('click', 'view') THEN round(value, 2) END AS confidence FROM events""")
def log_figures(spark: SparkSession, sf: str) -> DataFrame:
    kind, number = F.col("event_type"), F.col("event_id").cast("string")
    line = F.when(kind == "click", F.concat(F.lit("成功提取 "), number, F.lit(" 个关键帧"))).when(kind == "view", F.concat(F.lit("覆盖镜头数: "), number))
    line = line.otherwise(F.concat(F.lit("平均置信度: "), F.format_string("%.2f", F.round("value", 2))))
    return read(spark, sf, "events").select("event_id", *(c.alias(name) for name, c in results.log_figures(line).items()))


@query("SELECT p_partkey, TRY_CAST(split_part(t, 'x', 1) AS INTEGER) AS w, TRY_CAST(split_part(t, 'x', 2) AS INTEGER) AS h FROM (SELECT p_partkey, p_size || CASE WHEN p_size % 3 = 0 THEN '*' ELSE 'x' END || p_partkey AS t FROM part)")
def parsed_sizes(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.col("p_size").cast("string"), F.when(F.col("p_size") % 3 == 0, "*").otherwise("x"), F.col("p_partkey").cast("string"))
    w, h = scalars.parsed_size(text)
    return read(spark, sf, "part").select("p_partkey", w.alias("w"), h.alias("h"))


@query("""SELECT p_partkey, rate, rate <= p_size AND p_retailprice * rate <= 10000 AS suits FROM part, (SELECT unnest([2, 5, 8, 10]) AS rate)""")
def config_suits(spark: SparkSession, sf: str) -> DataFrame:
    rate = F.col("rate")
    rows = read(spark, sf, "part").withColumn("rate", F.explode(F.array(*map(F.lit, (2, 5, 8, 10)))))
    return rows.select("p_partkey", "rate", ((rate <= F.col("p_size")) & (F.col("p_retailprice") * rate <= 10000)).alias("suits"))


@query("""SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS succeeded, count(*) FILTER (o_orderstatus <> 'F') AS failed,
  arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS best FROM orders GROUP BY o_orderpriority""")
def run_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    ok = F.col("o_orderstatus") == "F"
    best = F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey")))
    return read(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"), best.alias("best"))


@query(f"""WITH {_SEGMENTS} SELECT media_id, count(DISTINCT speaker) AS speakers, count(*) AS segments, round(sum("end" - start), 4) AS seconds,
  round(count(*) / count(DISTINCT speaker), 4) AS mean_segments FROM g GROUP BY media_id""")
def speaker_totals(spark: SparkSession, sf: str) -> DataFrame:
    return speakers.totals(segments(spark, sf))


@query(f"WITH {_FRAMES} SELECT media_id, least(8, greatest(2, count(*) // 15)) AS k FROM f GROUP BY media_id")
def auto_cluster_count(spark: SparkSession, sf: str) -> DataFrame:
    return frames(spark, sf).groupBy("media_id").agg(F.least(F.lit(8), F.greatest(F.lit(2), F.floor(F.count(F.lit(1)) / 15))).alias("k"))


@query()
def threshold_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.threshold_clusters(frames(spark, sf))


def _keyframes(spark: SparkSession, sf: str) -> DataFrame:
    rows = frames(spark, sf)
    return keyframes.keyframes(rows, motion(spark, sf), shots.histogram_shots(rows, GAP))


@query()
def keyframe_plan(spark: SparkSession, sf: str) -> DataFrame:
    return keyframes.described(_keyframes(spark, sf))


@query()
def keyframe_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return keyframes.statistics(_keyframes(spark, sf))


@query()
def keyframe_summary(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.keyframe_text(keyframes.described(_keyframes(spark, sf)))


_CLOCK = "printf('%02d:%05.2f', CAST(floor(seconds / 60) AS INTEGER), seconds % 60)"


@query(f"""WITH {_SEGMENTS}, a AS (SELECT media_id, speaker, count(*) AS n, round(sum("end" - start), 4) AS seconds, list(text ORDER BY start, seg_index) AS t FROM g GROUP BY ALL),
b AS (SELECT *, concat_ws(chr(10), speaker || ':', '  segments: ' || n, '  duration: ' || {_CLOCK}, '  mean: ' || CAST(CAST(round(seconds / n, 4) AS DECIMAL(18, 4)) AS DECIMAL(18, 2)) || ' s',
  array_to_string(list_transform(t[1:3], lambda x, i: '    ' || i || '. ' || CASE WHEN length(x) > 50 THEN x[1:50] || '...' ELSE x END), chr(10)), CASE WHEN n > 3 THEN '    ... ' || (n - 3) || ' more' END) AS block FROM a),
m AS (SELECT media_id, count(*) AS k, sum(n) AS n, round(sum(seconds), 4) AS seconds, string_agg(block, chr(10) || chr(10) ORDER BY speaker) AS blocks FROM b GROUP BY media_id)
SELECT media_id, concat_ws(chr(10), blocks || chr(10), '{sinks.RULE}', 'speakers: ' || k, 'segments: ' || n, 'duration: ' || {_CLOCK},
  'segments per speaker: ' || CAST(CAST(round(n / k, 4) AS DECIMAL(18, 4)) AS DECIMAL(18, 1))) AS value FROM m""")
def speaker_text(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.speaker_text(segments(spark, sf))
