"""More queries by name with their SQL: sampling, settings, joins by place, odd vectors, the dialogue plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from montage.catalogue import _FRAMES, _SEGMENTS, _SERIES, query
from montage.functions import scalars, vectors
from montage.operators import clusters, places, sampling, series, shots, vector_sums
from montage.plans import dialogue, settings
from montage.sources.tables import frames, motion, read, segments

#: A video per order: its frames, rate (some unknown) and size.
_VIDEOS = """v AS (SELECT o_orderkey AS media_id, [0, 12, 24, 25, 30, 60][o_orderkey % 6 + 1]::DOUBLE AS fps, CAST(floor(o_totalprice / 1000) AS BIGINT) AS total,
  320 + o_custkey % 9 * 320 AS width, 180 + o_custkey % 9 * 180 AS height FROM orders)"""
STRATEGIES = {"fps": settings.Settings(), "seconds": settings.Settings(sampling_strategy="seconds", frames_per_second=2),
              "fps_ratio": settings.Settings(sampling_strategy="fps_ratio", fps_ratio=4.0), "random_seconds": settings.Settings(sampling_strategy="random_seconds")}


def videos(spark: SparkSession, sf: str) -> DataFrame:
    """media_id, fps, total, width, height."""
    rates = F.array(*map(F.lit, (0.0, 12.0, 24.0, 25.0, 30.0, 60.0)))
    return read(spark, sf, "orders").select(
        F.col("o_orderkey").cast("long").alias("media_id"), F.get(rates, (F.col("o_orderkey") % 6).cast("int")).alias("fps"), F.floor(F.col("o_totalprice") / 1000).cast("long").alias("total"),
        (320 + F.col("o_custkey") % 9 * 320).alias("width"), (180 + F.col("o_custkey") % 9 * 180).alias("height"),
    )


@query(f"WITH {_VIDEOS} SELECT media_id, round(CASE WHEN fps > 0 THEN total / fps ELSE 0 END, 6) AS seconds FROM v")
def media_duration(spark: SparkSession, sf: str) -> DataFrame:
    return videos(spark, sf).select("media_id", F.round(sampling.duration(F.col("total"), F.col("fps")), 6).alias("seconds"))


@query(f"""WITH {_VIDEOS} SELECT media_id, CAST(greatest(1, floor(fps / 10)) AS BIGINT) AS fps, CAST(greatest(1, floor(fps / 2)) AS BIGINT) AS seconds,
  CAST(greatest(1, CASE WHEN fps > 0 THEN floor(fps / (fps / 4)) ELSE 0 END) AS BIGINT) AS fps_ratio, 1 AS random_seconds FROM v""")
def frame_interval(spark: SparkSession, sf: str) -> DataFrame:
    return videos(spark, sf).select("media_id", *(sampling.interval(F.col("fps"), how).alias(name) for name, how in STRATEGIES.items()))


@query(f"""WITH {_VIDEOS}, s AS (SELECT media_id, fps, unnest(range(0, total, CAST(greatest(1, floor(fps / 2)) AS BIGINT))) AS original_idx FROM v)
SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY original_idx) - 1 AS sampled_idx, original_idx, round(CASE WHEN fps > 0 THEN original_idx / fps ELSE 0 END, 6) AS timestamp FROM s""")
def sampled_frames(spark: SparkSession, sf: str) -> DataFrame:
    rows = videos(spark, sf)
    return sampling.sampled_info(rows, sampling.interval(F.col("fps"), STRATEGIES["seconds"]))


@query(f"""WITH {_VIDEOS} SELECT media_id, 'histogram' AS method, unnest(range(0, total, greatest(1, total // 50))) AS frame_idx FROM v
UNION ALL SELECT media_id, 'flow', unnest(range(0, total, greatest(1, total // 30))) FROM v""")
def seek_strides(spark: SparkSession, sf: str) -> DataFrame:
    rows = videos(spark, sf)
    kinds = [sampling.strided(rows, sampling.seek_step(most)).withColumn("method", F.lit(name)) for name, most in (("histogram", 50), ("flow", 30))]
    return kinds[0].unionByName(kinds[1]).select("media_id", "method", "frame_idx")


@query(f"""WITH {_VIDEOS}, s AS (SELECT media_id, fps, total, unnest(range(0, CAST(floor(total / fps) AS BIGINT))) AS second FROM v WHERE fps > 0),
r AS (SELECT media_id, second, unnest(range(CAST(floor(second * fps) AS BIGINT), CAST(least(floor((second + 1) * fps), total) AS BIGINT))) AS frame_idx FROM s)
SELECT media_id, second, frame_idx FROM r QUALIFY row_number() OVER (PARTITION BY media_id, second ORDER BY md5(media_id || ':' || frame_idx), frame_idx) <= 3""")
def random_per_second(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.random_frames(videos(spark, sf), STRATEGIES["random_seconds"].random_select_count)


@query("""WITH l AS (SELECT l_orderkey AS media_id, l_linenumber % 2 AS shot_id, l_linenumber AS frame_idx FROM lineitem)
SELECT media_id, shot_id, frame_idx FROM l QUALIFY (row_number() OVER (PARTITION BY media_id, shot_id ORDER BY frame_idx) - 1) % greatest(1, count(*) OVER (PARTITION BY media_id, shot_id) // 8) = 0""")
def stride_fallback(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("media_id"), (F.col("l_linenumber") % 2).alias("shot_id"), F.col("l_linenumber").alias("frame_idx"))
    return sampling.eighths(rows)


@query(f"""WITH {_SERIES}, w AS (SELECT *, lag(score) OVER p AS b, lead(score) OVER p AS a, quantile_cont(score, 0.75) OVER (PARTITION BY media_id) AS high FROM s WINDOW p AS (PARTITION BY media_id ORDER BY idx))
SELECT media_id, idx, score FROM w WHERE score > b AND score > a AND score > high""")
def raw_peaks(spark: SparkSession, sf: str) -> DataFrame:
    return series.raw_peaks(motion(spark, sf))


@query(f"""WITH {_VIDEOS}, c AS (SELECT media_id, unnest([0, 3, 5000]) AS sampled_idx FROM v),
i AS (SELECT media_id, fps, unnest(range(0, total, CAST(greatest(1, floor(fps / 10)) AS BIGINT))) AS original_idx FROM v),
n AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY original_idx) - 1 AS sampled_idx FROM i)
SELECT media_id, sampled_idx, original_idx, round(CASE WHEN fps > 0 THEN original_idx / fps ELSE 0 END, 6) AS timestamp FROM c JOIN n USING (media_id, sampled_idx)""")
def keyframe_info(spark: SparkSession, sf: str) -> DataFrame:
    rows = videos(spark, sf)
    chosen = rows.select("media_id", F.explode(F.array(*(F.lit(i).cast("long") for i in (0, 3, 5000)))).alias("sampled_idx"))
    return sampling.with_frame_info(chosen, rows, sampling.interval(F.col("fps"), STRATEGIES["fps"]))


_FITTED = """CASE WHEN d > 3600 THEN least(5, f // 4) WHEN d > 1800 THEN least(8, f // 3) ELSE least(12, f // 2) END"""


@query(f"""WITH {_VIDEOS}, x AS (SELECT *, CAST(floor(fps) AS BIGINT) AS f, CASE WHEN fps > 0 THEN total * 100 / fps ELSE 0 END AS d FROM v),
p(name, target_fps, side, k) AS (VALUES ('fast', 5, 512, 3), ('balanced', 10, 512, 5), ('quality', 15, 768, 8), ('detailed', 20, 1024, 10), ('original', 10, 512, 5))
SELECT media_id, name, {_FITTED} AS target_fps, CASE WHEN width * height > 1920 * 1080 THEN 768 WHEN width * height < 640 * 480 THEN 256 ELSE side END AS side,
  CASE WHEN d > 1800 THEN greatest(3, k - 2) ELSE k END AS max_keyframes_per_shot, {_FITTED} <= fps AND d * {_FITTED} <= 10000 AS suits FROM x, p""")
def settings_sweep(spark: SparkSession, sf: str) -> DataFrame:
    presets = {name: settings.preset(name) for name in settings.PRESETS}
    seconds = sampling.duration(F.col("total") * 100, F.col("fps"))
    rows = videos(spark, sf).withColumn("how", F.explode(settings.sweep(presets)))
    fitted = settings.fitted(F.col("how"), F.col("fps"), seconds, F.col("width"), F.col("height"))
    return rows.select("media_id", "how.name", *(c.alias(n) for n, c in fitted.items()), settings.suits(fitted["target_fps"], F.col("fps"), seconds).alias("suits"))


@query("""SELECT o_custkey AS media_id, o_orderpriority AS shot_id, o_orderkey AS frame_idx, o_orderkey % 200 AS duration_frames, o_totalprice AS confidence,
  row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_totalprice DESC, o_orderkey)::INTEGER AS rank FROM orders QUALIFY rank <= least(5, greatest(1, o_orderkey % 200 // 30))""")
def topk_by_length(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "orders").select(
        F.col("o_custkey").alias("media_id"), F.col("o_orderpriority").alias("shot_id"), F.col("o_orderkey").alias("frame_idx"),
        (F.col("o_orderkey") % 200).alias("duration_frames"), F.col("o_totalprice").alias("confidence"),
    )
    return shots.best_per_shot(rows, 5)


_STEADY = "list_transform(c, lambda x: CASE WHEN isnan(x) THEN 0 WHEN isinf(x) THEN CASE WHEN x > 0 THEN 1 ELSE -1 END ELSE x END)"
_ODD = f"""{_FRAMES}, o AS (SELECT media_id, frame_idx, CASE frame_idx % 5 WHEN 0 THEN list_transform(clip, lambda x: 0::DOUBLE)
  WHEN 1 THEN list_prepend('nan'::DOUBLE, clip[2:]::DOUBLE[]) WHEN 2 THEN list_prepend('infinity'::DOUBLE, clip[2:]::DOUBLE[])
  WHEN 3 THEN list_prepend('-infinity'::DOUBLE, clip[2:]::DOUBLE[]) ELSE clip::DOUBLE[] END AS c FROM f),
t AS (SELECT media_id, frame_idx, {_STEADY} AS c FROM o), u AS (SELECT media_id, frame_idx, c, sqrt(list_inner_product(c, c)) AS n FROM t),
w AS (SELECT media_id, frame_idx, CASE WHEN n = 0 THEN c ELSE list_transform(c, lambda x: x / n) END AS u FROM u)"""


def odd_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Frames some of whose vectors are zero or hold NaN or an infinity."""
    kind, rest = F.col("frame_idx") % 5, F.slice(vectors.doubles(F.col("clip")), 2, 100_000)
    first = F.when(kind == 1, float("nan")).when(kind == 2, float("inf")).when(kind == 3, float("-inf"))
    odd = F.when(kind == 0, F.transform("clip", lambda x: F.lit(0.0))).when(first.isNotNull(), F.concat(F.array(first), rest)).otherwise(vectors.doubles(F.col("clip")))
    return frames(spark, sf).select("media_id", "frame_idx", odd.alias("clip"))


@query(f"""WITH {_ODD} SELECT media_id, frame_idx, round(list_sum(u), 6) AS total, round(sqrt(list_inner_product(u, u)), 6) AS length,
  round(greatest(-1, least(1, list_inner_product(u, lag(u) OVER (PARTITION BY media_id ORDER BY frame_idx)))), 6) AS similarity FROM w""")
def odd_vectors(spark: SparkSession, sf: str) -> DataFrame:
    before = F.lag("clip").over(Window.partitionBy("media_id").orderBy("frame_idx"))
    rows = odd_frames(spark, sf).withColumn("before", before)
    unit = vectors.unit(F.col("clip"))
    return rows.select("media_id", "frame_idx", F.round(vectors.total(unit), 6).alias("total"), F.round(vectors.norm(unit), 6).alias("length"), F.round(vectors.cosine(F.col("clip"), F.col("before")), 6).alias("similarity"))


@query(f"""WITH {_ODD}, x AS (SELECT media_id, frame_idx % 4 AS cluster_id, unnest(u) AS x, generate_subscripts(u, 1) AS i FROM w),
m AS (SELECT media_id, cluster_id, i, avg(x) AS m FROM x GROUP BY ALL) SELECT media_id, cluster_id, round(sum(m), 6) AS total FROM m GROUP BY ALL""")
def odd_centroids(spark: SparkSession, sf: str) -> DataFrame:
    rows = odd_frames(spark, sf)
    found = clusters.centroids(rows, rows.select("media_id", "frame_idx", (F.col("frame_idx") % 4).alias("cluster_id")))
    return found.select("media_id", "cluster_id", F.round(vectors.total(F.col("centroid")), 6).alias("total"))


@query(f"""WITH {_FRAMES}, p AS (SELECT media_id, frame_idx AS idx, clip, lag(clip) OVER (PARTITION BY media_id ORDER BY frame_idx) AS b FROM f)
SELECT media_id, idx, round(CASE WHEN b IS NULL THEN 0 ELSE list_distance(clip::DOUBLE[], b::DOUBLE[]) END, 6) AS motion FROM p""")
def vector_motion(spark: SparkSession, sf: str) -> DataFrame:
    return shots.vector_motion(frames(spark, sf))


@query(f"""WITH {_SERIES} SELECT media_id, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS deviation, round(max(score), 6) AS highest FROM s GROUP BY media_id""")
def motion_summary(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("score")
    return motion(spark, sf).groupBy("media_id").agg(F.round(F.avg(x), 6).alias("mean"), F.round(F.stddev_pop(x), 6).alias("deviation"), F.round(F.max(x), 6).alias("highest"))


@query("""WITH b AS (SELECT l_returnflag AS media_id, CAST(floor(l_quantity * 50 / 51) AS BIGINT) AS h, CAST(least(59, floor(l_discount * 600)) AS BIGINT) AS s, CAST(least(59, floor(l_tax * 600)) AS BIGINT) AS v FROM lineitem),
c AS (SELECT media_id, h, s, v, count(*) AS n FROM b GROUP BY ALL) SELECT media_id, h, s, v, n, round(n / sqrt(sum(n * n) OVER (PARTITION BY media_id)), 8) AS share FROM c""")
def colour_bins(spark: SparkSession, sf: str) -> DataFrame:
    """Bins over three dimensions, 50 x 60 x 60, scaled to length 1."""
    place = lambda c, n, most: F.least(F.lit(n - 1), F.floor(F.col(c) * n / most)).cast("long")
    rows = read(spark, sf, "lineitem").select(F.col("l_returnflag").alias("media_id"), place("l_quantity", 50, 51).alias("h"), F.least(F.lit(59), F.floor(F.col("l_discount") * 600)).cast("long").alias("s"), F.least(F.lit(59), F.floor(F.col("l_tax") * 600)).cast("long").alias("v"))
    counts = rows.groupBy("media_id", "h", "s", "v").agg(F.count(F.lit(1)).alias("n"))
    lengths = counts.groupBy("media_id").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("length"))
    return counts.join(lengths, "media_id").withColumn("share", F.round(F.col("n") / F.col("length"), 8)).drop("length")


@query("""WITH r AS (SELECT l_orderkey AS media_id, l_linenumber AS shot_id, l_returnflag AS method, CAST(l_quantity AS BIGINT) % 4 AS keyframes FROM lineitem)
SELECT media_id, count(*) AS shots, CAST(sum(keyframes) AS BIGINT) AS keyframes, round(sum(keyframes) / count(*), 6) AS keyframes_per_shot, string_agg(DISTINCT method, ',' ORDER BY method) AS methods FROM r GROUP BY media_id""")
def run_ratios(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("media_id"), F.col("l_returnflag").alias("method"), (F.col("l_quantity").cast("long") % 4).alias("keyframes"))
    n, k = F.count(F.lit(1)), F.sum("keyframes")
    return rows.groupBy("media_id").agg(n.alias("shots"), k.alias("keyframes"), F.round(k / n, 6).alias("keyframes_per_shot"), F.array_join(F.array_sort(F.collect_set("method")), ",").alias("methods"))


@query("""WITH e AS (SELECT user_id AS media_id, value AS x, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events)
SELECT media_id, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS deviation, round(coalesce(avg(x - b), 0), 6) AS mean_delta FROM e GROUP BY media_id""")
def clip_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics of a clip over the values of its frames, as a voice vector takes them."""
    rows = motion(spark, sf).withColumn("b", F.lag("score").over(Window.partitionBy("media_id").orderBy("idx")))
    x = F.col("score")
    return rows.groupBy("media_id").agg(F.round(F.avg(x), 6).alias("mean"), F.round(F.stddev_pop(x), 6).alias("deviation"), F.round(F.coalesce(F.avg(x - F.col("b")), F.lit(0.0)), 6).alias("mean_delta"))


@query(f"""WITH {_FRAMES}, e AS (SELECT media_id, frame_idx, generate_subscripts(clip, 1) - 1 AS i, unnest(clip)::DOUBLE AS x FROM f), s AS (SELECT *, lag(x) OVER (PARTITION BY media_id, i ORDER BY frame_idx) AS b FROM e WHERE i < 13)
SELECT media_id, CAST(i AS INTEGER) AS i, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS deviation, round(coalesce(avg(x - b), 0), 6) AS mean_delta FROM s GROUP BY media_id, i""")
def clip_vector_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """Means, deviations and mean steps of 13 components per clip, in one pass."""
    found = vector_sums.statistics(frames(spark, sf), ["media_id"], "clip", "frame_idx", 13)
    each = found.select("media_id", F.posexplode(F.arrays_zip("mean", "deviation", "mean_delta")).alias("i", "s"))
    return each.select("media_id", "i", *(F.round(F.col(f"s.{c}"), 6).alias(c) for c in ("mean", "deviation", "mean_delta")))


@query("""WITH g AS (SELECT conv_id AS media_id, turn AS seg_index, row_number() OVER (ORDER BY conv_id, turn) - 1 AS place FROM conversations),
l AS (SELECT quality AS label, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM labels) SELECT place, media_id, seg_index, label FROM g JOIN l USING (place)""")
def zipped_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Segments beside labels that share no key with them, by place; the longer table's rest is left out."""
    left = read(spark, sf, "conversations").orderBy("conv_id", "turn").select(F.col("conv_id").alias("media_id"), F.col("turn").alias("seg_index"))
    return places.zipped(left, read(spark, sf, "labels").orderBy("doc_id").select(F.col("quality").alias("label")))


@query(f"""WITH {_FRAMES}, s AS (SELECT user_id AS media_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx, value AS score FROM events)
SELECT media_id, frame_idx, len(clip) AS clip_size, coalesce(score, 0) AS motion, 0::DOUBLE AS colour FROM f LEFT JOIN s USING (media_id, frame_idx)""")
def all_features(spark: SparkSession, sf: str) -> DataFrame:
    """Every frame with all its features; zeros stand in for those that are missing."""
    rows = shots.all_features(frames(spark, sf), motion(spark, sf).withColumnRenamed("idx", "frame_idx"))
    return rows.select("media_id", "frame_idx", F.size("clip").cast("long").alias("clip_size"), "motion", vectors.total(F.col("colour")).alias("colour"))


@query("""WITH k AS (SELECT n_nationkey, unnest(['vocals/' || n_name, 'vocals/model_' || n_name, n_name]) AS name, unnest([0, 1, 2]) AS turn FROM nation),
have AS (SELECT 'vocals/model_' || n_name AS name FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT n_name FROM nation WHERE n_nationkey % 3 = 0)
SELECT n_nationkey, arg_min(name, turn) AS name FROM k JOIN have USING (name) GROUP BY n_nationkey""")
def first_existing(spark: SparkSession, sf: str) -> DataFrame:
    """The first of several names that a listing holds; rows without any are dropped."""
    rows = read(spark, sf, "nation")
    n = F.col("n_name")
    have = rows.filter("n_nationkey % 2 = 0").select(F.concat(F.lit("vocals/model_"), n).alias("name")).union(rows.filter("n_nationkey % 3 = 0").select("n_name"))
    tried = rows.select("n_nationkey", F.posexplode(F.array(F.concat(F.lit("vocals/"), n), F.concat(F.lit("vocals/model_"), n), n)).alias("turn", "name"))
    return tried.join(have, "name", "left_semi").groupBy("n_nationkey").agg(F.min_by("name", "turn").alias("name"))


@query(f"""WITH {_SEGMENTS} SELECT media_id, seg_index, CAST(floor(start / 60) AS BIGINT) || ':' || lpad(CAST(CAST(floor(start % 60) AS BIGINT) AS VARCHAR), 2, '0') AS at,
  seg_index % 8 AS colour, upper(regexp_replace('speaker_' || speaker || '_x', '_', ' ')) AS title FROM g ORDER BY media_id, seg_index LIMIT 5 OFFSET 5""")
def result_page(spark: SparkSession, sf: str) -> DataFrame:
    """The second page of five rows."""
    rows = segments(spark, sf).select(
        "media_id", "seg_index", scalars.minutes(F.col("start")).alias("at"), scalars.colour(F.col("seg_index")).cast("long").alias("colour"),
        scalars.title(F.concat(F.lit("speaker_"), F.col("speaker"), F.lit("_x"))).alias("title"),
    )
    return rows.orderBy("media_id", "seg_index").offset(5).limit(5)


@query("""SELECT CASE WHEN contains(p_type, 'PROMO') THEN 'promo' WHEN contains(p_type, 'ECONOMY') THEN 'economy' ELSE 'other' END AS kind, count(*) AS n FROM part GROUP BY ALL""")
def named_kinds(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("p_type").contains("PROMO"), "promo").when(F.col("p_type").contains("ECONOMY"), "economy").otherwise("other")
    return read(spark, sf, "part").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def voices(spark: SparkSession, sf: str) -> DataFrame:
    """A voice vector for some segments: media_id, seg_index, vector (some null)."""
    numbered = segments(spark, sf).select("media_id", "seg_index", (F.col("media_id") * 7 + F.col("seg_index")).cast("long").alias("vec_id"))
    vector = F.when(F.col("vec_id") % 11 != 0, F.col("embedding"))
    return numbered.join(read(spark, sf, "embeddings"), "vec_id").select("media_id", "seg_index", vector.alias("vector"))


@query(f"""WITH {_SEGMENTS}, c AS (SELECT *, trim(replace(text, chr(10), ' ')) AS t FROM g)
SELECT c.media_id, seg_index, t AS text, len(embedding) AS size FROM c JOIN embeddings e ON e.vec_id = c.media_id * 7 + seg_index
WHERE t <> '' AND "end" - start >= 0.5 AND e.vec_id % 11 <> 0 AND embedding IS NOT NULL""")
def voiced_segments(spark: SparkSession, sf: str) -> DataFrame:
    rows = dialogue.voiced(segments(spark, sf), voices(spark, sf))
    return rows.select("media_id", "seg_index", "text", F.size("vector").cast("long").alias("size"))


@query()
def dialogue_plan(spark: SparkSession, sf: str) -> DataFrame:
    return dialogue.exports(segments(spark, sf), voices(spark, sf))
