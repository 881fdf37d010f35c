"""Whole output documents as rows of lines, for `named_files.write_files`: exports by speaker, metadata, summaries, reports.

Every document is a table (file, a, b, c, line): lines of a file by a, b, c. A document of any length is never one row or
one value in a task. Segments: media_id, seg_index, start, end, text, speaker; keyframes: media_id, filename, frame_idx,
timestamp, shot_id, cluster_id, confidence, selection_method, as `plans.keyframes.described` gives them, and what else
they have.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from montage.functions.scalars import clock, preview
from montage.plans.settings import Settings
from montage.sources.named_files import write_files

ORDER = ("a", "b", "c")
# Names of files, and the words of the documents in their language.
EXPORT_INFO, SPEAKER_SUMMARY, METADATA, KEYFRAMES, KEYFRAME_SUMMARY = "export_info.json", "summary.txt", "metadata.json", "keyframes.csv", "summary.txt"
SWEEP_RESULTS, SWEEP_REPORT = "test_results.json", "test_report.md"


def _lines(rows: DataFrame, line: Column, a: Column | int, b: Column | str = "", c: Column | int = 0) -> DataFrame:
    """Rows (with a column file) as lines at the place a, b, c."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return rows.select("file", lit(a).cast("long").alias("a"), lit(b).cast("string").alias("b"), lit(c).cast("long").alias("c"), line.alias("line"))


def _all(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _quoted(text: Column) -> Column:
    """A text as a JSON string."""
    array = F.to_json(F.array(text))
    return F.substring(array, F.lit(2), F.length(array) - 2)


def _text(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


# ---- exports by speaker ---------------------------------------------------------------------------------------------


def _numbered(segments: DataFrame) -> DataFrame:
    """Segments with their number in their speaker's order. Those whose column has_audio is false keep the number and are not written."""
    number = F.row_number().over(Window.partitionBy("media_id", "speaker").orderBy("start", "seg_index")) - 1
    rows = segments.withColumns({"i": number, "seconds": F.col("end") - F.col("start"), "text": _text(F.col("text"))})
    return rows if "has_audio" in segments.columns else rows.withColumn("has_audio", F.lit(True))


def speaker_files(segments: DataFrame) -> DataFrame:
    """A file <media>/<speaker>/<speaker>_<i>.txt per segment: its number, times, length, text and place in the subtitles."""
    rows = _numbered(segments).filter("has_audio")
    name = F.format_string("%s/%s/%s_%03d.txt", F.col("media_id").cast("string"), F.col("speaker"), F.col("speaker"), F.col("i"))
    line = F.concat_ws(
        "\n", F.concat(F.lit("片段: "), F.col("i") + 1), F.concat(F.lit("时间: "), clock(F.col("start")), F.lit(" - "), clock(F.col("end"))),
        F.format_string("时长: %.2f秒", F.col("seconds")), F.concat(F.lit("字幕: "), F.col("text")), F.concat(F.lit("原始索引: "), F.col("seg_index")),
    )
    return _lines(rows.withColumn("file", name), line, 0)


def export_info(segments: DataFrame, when: str) -> DataFrame:
    """<media>/export_info.json: speakers with their files and texts, and the totals; `when` is its time stamp."""
    rows = _numbered(segments).withColumn("file", F.concat(F.col("media_id").cast("string"), F.lit(f"/{EXPORT_INFO}")))
    of = rows.groupBy("file", "speaker").agg(F.count(F.lit(1)).alias("n"), F.round(F.coalesce(F.sum(F.when(F.col("has_audio"), F.col("seconds"))), F.lit(0.0)), 4).alias("total"))
    first = F.row_number().over(Window.partitionBy("file").orderBy("speaker")) == 1
    of = of.withColumn("comma", F.when(first, "").otherwise(","))
    whole = of.groupBy("file").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 4).alias("total"))
    said = rows.filter("has_audio")
    # numbers leave gaps where audio is missing: the first that is written has no comma before it
    ahead = F.when(F.row_number().over(Window.partitionBy("file", "speaker").orderBy("i")) == 1, "").otherwise(",")
    said = said.withColumn("comma", ahead)
    name = F.format_string("%s_%03d", F.col("speaker"), F.col("i"))
    entry = F.to_json(F.struct(
        F.concat(name, F.lit(".wav")).alias("audio"), F.concat(name, F.lit(".txt")).alias("subtitle"), "text",
        F.col("start").alias("start_time"), F.col("end").alias("end_time"), F.col("seconds").alias("duration"),
    ))
    # by speaker: its head, its files, what stands between, its texts, its end
    at = lambda part: F.concat(F.col("speaker"), F.lit(f"\t{part}"))
    return _all(
        _lines(whole, F.lit(f'{{"timestamp": {json.dumps(when)}, "speakers": {{'), 0),
        _lines(of, F.concat("comma", _quoted(F.col("speaker")), F.lit(': {"segment_count": '), "n", F.lit(', "files": [')), 1, at(0)),
        _lines(said, F.concat("comma", entry), 1, at(1), F.col("i")),
        _lines(of, F.concat(F.lit('], "total_duration": '), "total", F.lit(', "subtitles": [')), 1, at(2)),
        _lines(said, F.concat("comma", _quoted(F.col("text"))), 1, at(3), F.col("i")),
        _lines(of, F.lit("]}"), 1, at(4)),
        _lines(whole, F.concat(F.lit('}, "total_segments": '), "n", F.lit(', "total_duration": '), "total", F.lit("}")), 2),
    )


def speaker_summary(segments: DataFrame, when: str) -> DataFrame:
    """<media>/summary.txt: a block per speaker with up to three texts, and the totals."""
    rows = _numbered(segments).withColumn("file", F.concat(F.col("media_id").cast("string"), F.lit(f"/{SPEAKER_SUMMARY}")))
    of = rows.groupBy("file", "speaker").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("seconds"), 4).alias("seconds"))
    whole = of.groupBy("file").agg(F.count(F.lit(1)).alias("speakers"), F.sum("n").alias("n"), F.round(F.sum("seconds"), 4).alias("seconds"))
    at = lambda part: F.concat(F.col("speaker"), F.lit(f"\t{part}"))
    head = F.concat_ws(
        "\n", F.concat("speaker", F.lit(":")), F.format_string("  片段数量: %d", F.col("n")), F.concat(F.lit("  总时长: "), clock(F.col("seconds"))),
        F.format_string("  平均片段长度: %.2f秒", F.col("seconds") / F.col("n")), F.lit("  示例字幕:"),
    )
    total = F.concat_ws(
        "\n", F.lit("-" * 50), F.lit("总计:"), F.format_string("  说话人数量: %d", F.col("speakers")), F.format_string("  总片段数量: %d", F.col("n")),
        F.concat(F.lit("  总时长: "), clock(F.col("seconds"))), F.format_string("  平均每个说话人: %.1f 个片段", F.col("n") / F.col("speakers")),
    )
    return _all(
        _lines(whole, F.lit("动漫角色对话提取结果\n" + "=" * 50 + f"\n\n处理时间: {when}\n"), 0),
        _lines(of, head, 1, at(0)),
        _lines(rows.filter("i < 3"), F.concat(F.lit("    "), F.col("i") + 1, F.lit(". "), preview(F.col("text"))), 1, at(1), F.col("i")),
        _lines(of, F.concat(F.when(F.col("n") > 3, F.format_string("    ... 还有 %d 个片段\n", F.col("n") - 3)).otherwise("")), 1, at(2)),
        _lines(whole, total, 2),
    )


# ---- keyframes ------------------------------------------------------------------------------------------------------


def _of_media(keyframes: DataFrame, videos: DataFrame, name: str, plain: bool) -> DataFrame:
    """Keyframes with path, stem and file: <stem>/<stem>_<name>, or <stem>/<name> where `plain`."""
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(?<=.)\.[^.]*$", "")
    named = videos.select("media_id", "path", stem.alias("stem"))
    file = F.concat("stem", F.lit("/"), *([] if plain else [F.col("stem"), F.lit("_")]), F.lit(name))
    return keyframes.join(named, "media_id").withColumn("file", file)


def _fields(keyframes: DataFrame) -> list[str]:
    first = ["filename", "frame_idx", "timestamp", "shot_id", "cluster_id", "confidence", "selection_method"]
    return first + [c for c in keyframes.columns if c not in ("media_id", *first)]


def metadata(keyframes: DataFrame, videos: DataFrame, how: Settings, when: str, info: DataFrame | None = None, plain: bool = False) -> DataFrame:
    """The metadata of each media with keyframes: video, processing and configuration, and its keyframes by frame.

    videos: media_id, path. info: media_id and whatever tells of the processing, such as `plans.keyframes.processing`.
    """
    fields = _fields(keyframes)
    rows = _of_media(keyframes, videos, METADATA, plain)
    one = rows.groupBy("file", "media_id", "path", "stem").agg(F.count(F.lit(1)).alias("n"))
    told = F.lit("{}")
    if info is not None:
        names = [c for c in info.columns if c != "media_id"]
        one = one.join(info.select("media_id", F.to_json(F.struct(*names)).alias("told")), "media_id", "left")
        told = F.coalesce("told", F.lit("{}"))
    video = F.to_json(F.struct("path", F.col("stem").alias("name")))
    config = json.dumps(how.as_dict(), ensure_ascii=False)
    head = F.concat(
        F.lit('{"video_info": '), video, F.lit(', "processing_info": '), told, F.lit(f', "extraction_time": {json.dumps(when)}, "config": {config}, "total_keyframes": '), "n", F.lit(', "keyframes": ['),
    )
    first = F.row_number().over(Window.partitionBy("file").orderBy("frame_idx", "shot_id")) == 1
    entry = F.concat(F.when(first, "").otherwise(","), F.to_json(F.struct(*fields)))
    return _all(_lines(one, head, 0), _lines(rows.withColumn("line", entry), F.col("line"), 1, "", F.col("frame_idx")), _lines(one, F.lit("]}"), 2))


def keyframes_csv(keyframes: DataFrame, videos: DataFrame, plain: bool = False) -> DataFrame:
    """A row per keyframe, with a head; values with commas, quotes or line ends are quoted."""
    fields = _fields(keyframes)
    rows = _of_media(keyframes, videos, KEYFRAMES, plain)
    value = lambda c: F.when(_text(F.col(c)).rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(_text(F.col(c)), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(_text(F.col(c)))
    line = F.concat_ws(",", *(value(c) for c in fields))
    return _all(_lines(rows.select("file").distinct(), F.lit(",".join(fields)), 0), _lines(rows, line, 1, "", F.col("frame_idx")))


def keyframe_summary(keyframes: DataFrame, videos: DataFrame, when: str, info: DataFrame | None = None) -> DataFrame:
    """<stem>/<stem>_summary.txt: the keyframes by shot, with time, confidence, method and cluster."""
    rows = _of_media(keyframes, videos, KEYFRAME_SUMMARY, False)
    one = rows.groupBy("file", "media_id", "path").agg(F.count(F.lit(1)).alias("n"))
    shot = rows.groupBy("file", "shot_id").agg(F.count(F.lit(1)).alias("n"))
    rule = "=" * 60
    head = F.concat(F.lit(f"{rule}\n视频关键帧提取摘要\n{rule}\n\n视频文件: "), "path", F.lit(f"\n处理时间: {when}\n总关键帧数: "), "n", F.lit("\n"))
    parts = [_lines(one, head, 0), _lines(one, F.lit("按镜头分组:\n" + "-" * 40), 2)]
    if info is not None:
        names = [c for c in info.columns if c != "media_id"]
        told = one.join(info, "media_id")
        parts.append(_lines(told, F.concat(F.lit("处理信息:\n"), *(F.concat(F.lit(f"  {c}: "), _text(F.col(c)), F.lit("\n")) for c in names)), 1))
    place = F.lpad(F.col("shot_id").cast("string"), 12, "0")
    block = F.concat_ws(
        "\n", F.concat(F.lit("  "), "filename"), F.format_string("    时间戳: %.2fs", F.col("timestamp")), F.format_string("    置信度: %.3f", F.col("confidence")),
        F.concat(F.lit("    方法: "), "selection_method"), F.concat(F.lit("    聚类ID: "), F.col("cluster_id"), F.lit("\n")),
    )
    parts.append(_lines(shot, F.format_string("\n镜头 %d (%d 个关键帧):", F.col("shot_id"), F.col("n")), 3, F.concat(place, F.lit("\t0"))))
    parts.append(_lines(rows, block, 3, F.concat(place, F.lit("\t1")), F.col("frame_idx")))
    return _all(*parts)


# ---- sweeps ---------------------------------------------------------------------------------------------------------


def _ranked(results: DataFrame) -> DataFrame:
    """Successful runs by keyframes, then name: a sweep has as many rows as configurations, so one window serves."""
    return results.filter("success").withColumn("r", F.row_number().over(Window.orderBy(F.col("keyframes_count").desc(), "name")))


def _constant(results: DataFrame, file: str, line: str, a: int, where: DataFrame | None = None) -> DataFrame:
    """A line that stands once if `where` (by default anything) has rows."""
    n = (where if where is not None else results).agg(F.count(F.lit(1)).alias("n"))
    n = n if where is None else n.filter("n > 0")
    return _lines(n.select(F.lit(file).alias("file")), F.lit(line), a)


def sweep_results(results: DataFrame, file: str = SWEEP_RESULTS) -> DataFrame:
    """Runs (name, description, params map, success, keyframes_count, shots_covered, avg_confidence, processing_time, error) as a JSON array."""
    rows = results.withColumns({"file": F.lit(file), "r": F.row_number().over(Window.orderBy("name"))})
    entry = F.concat(F.when(F.col("r") == 1, "").otherwise(","), F.to_json(F.struct(*results.columns)))
    return _all(_constant(results, file, "[", 0), _lines(rows, entry, 1, "", F.col("r")), _constant(results, file, "]", 2))


def sweep_report(results: DataFrame, video: str, when: str, file: str = SWEEP_REPORT) -> DataFrame:
    """The report of a sweep: counts, the ranked table, what lengths and limits did, the best run, the failed ones."""
    fine, failed = _ranked(results).withColumn("file", F.lit(file)), results.filter(~F.col("success")).withColumn("file", F.lit(file))
    short, most = fine.filter(F.col("name").contains("min_shot")), fine.filter(F.col("name").contains("max_frames"))
    best = fine.filter("r = 1")
    count = results.agg(F.count(F.lit(1)).alias("n"), F.count_if("success").alias("ok")).withColumn("file", F.lit(file))
    param = lambda name: F.coalesce(F.element_at("params", name), F.lit("unknown"))
    head = F.format_string(f"# 镜头参数测试报告\n\n**测试视频**: %s\n**测试时间**: {when}\n**总测试数**: %d\n**成功**: %d, **失败**: %d\n", F.lit(video), F.col("n"), F.col("ok"), F.col("n") - F.col("ok"))
    table = "## 📊 测试结果对比\n\n| 测试名称 | 描述 | 关键帧数 | 镜头数 | 平均置信度 | 处理时间(秒) |\n|---------|------|----------|--------|------------|-------------|"
    row = F.concat(F.lit("| "), F.concat_ws(" | ", "name", "description", _text(F.col("keyframes_count")), _text(F.col("shots_covered")), _text(F.col("avg_confidence")), _text(F.col("processing_time"))), F.lit(" |"))
    params = F.concat_ws("\n", F.transform(F.array_sort(F.map_entries("params")), lambda e: F.concat(F.lit("- `"), e["key"], F.lit("`: "), e["value"])))
    praise = F.concat(
        F.lit("## 🏆 推荐配置\n\n**最佳测试**: "), "name", F.lit("\n**描述**: "), "description", F.lit("\n**参数**: \n"), params,
        F.format_string("\n\n**结果**: %d个关键帧, %d个镜头, 处理时间%s秒", F.col("keyframes_count"), F.col("shots_covered"), _text(F.col("processing_time"))),
    )
    return _all(
        _lines(count, head, 0), _constant(fine, file, table, 1, fine), _lines(fine, row, 2, "", F.col("r")), _constant(results, file, "\n## 🔍 参数影响分析\n", 3),
        _constant(short, file, "### 最小镜头长度影响", 4, short),
        _lines(short, F.format_string("- **%s帧**: %d个关键帧, %d个镜头", param("min_shot_duration"), F.col("keyframes_count"), F.col("shots_covered")), 5, "", F.col("r")), _constant(short, file, "", 6, short),
        _constant(most, file, "### 每镜头最大关键帧数影响", 7, most),
        _lines(most, F.format_string("- **%s帧/镜头**: %d个关键帧, 平均置信度%s", param("max_keyframes_per_shot"), F.col("keyframes_count"), _text(F.col("avg_confidence"))), 8, "", F.col("r")), _constant(most, file, "", 9, most),
        _lines(best, praise, 10), _constant(failed, file, "\n## ❌ 失败的测试\n", 11, failed),
        _lines(failed, F.concat(F.lit("- **"), "name", F.lit("**: "), F.coalesce("error", F.lit("未知错误"))), 12, F.col("name")),
    )


def comparison_report(runs: DataFrame, place: str, file: str = "analysis_report.md") -> DataFrame:
    """The report over finished runs (name, keyframes_count, shots_covered, avg_confidence, file_size_mb): table, best three, groups by name."""
    score = F.col("keyframes_count") * F.col("avg_confidence")
    valid = runs.filter("keyframes_count > 0").withColumns({"file": F.lit(file), "score": score})
    valid = valid.withColumn("r", F.row_number().over(Window.orderBy(F.col("keyframes_count").desc(), "name")))
    row = F.concat(F.lit("| "), F.concat_ws(" | ", "name", *(_text(F.col(c)) for c in ("keyframes_count", "shots_covered", "avg_confidence", "file_size_mb")), F.format_string("%.1f", F.col("score"))), F.lit(" |"))
    top = lambda by: valid.orderBy(F.col(by).desc(), "r").limit(1)
    like = lambda *words: valid.filter(F.col("name").rlike("|".join(words)))
    both = lambda rows: rows.withColumn("of", F.count(F.lit(1)).over(Window.partitionBy("file"))).filter("of >= 2")
    length, alike = both(like("short", "long", "baseline")), both(like("similar", "baseline"))
    title = f"# 镜头参数测试结果分析\n\n**分析时间**: {place}\n\n## 📊 结果对比\n\n| 测试名称 | 关键帧数 | 镜头覆盖 | 平均置信度 | 文件大小(MB) | 效率评分* |\n|---------|----------|----------|------------|-------------|----------|"
    advice = "## 💡 使用建议\n\n1. **追求数量**: 使用关键帧数最多的配置\n2. **追求质量**: 使用平均置信度最高的配置\n3. **平衡考虑**: 使用综合效率最佳的配置\n4. **存储考虑**: 注意文件大小，选择适合的配置\n"
    return _all(
        _constant(runs, file, title, 0), _lines(valid, row, 1, "", F.col("r")), _constant(runs, file, "\n*效率评分 = 关键帧数 × 平均置信度\n", 2), _constant(valid, file, "## 🏆 推荐配置\n", 3, valid),
        _lines(top("keyframes_count"), F.format_string("### 关键帧数量最多\n- **%s**: %d个关键帧\n", F.col("name"), F.col("keyframes_count")), 4),
        _lines(top("avg_confidence"), F.format_string("### 置信度最高\n- **%s**: 平均置信度%s\n", F.col("name"), _text(F.col("avg_confidence"))), 5),
        _lines(top("score"), F.format_string("### 综合效率最佳\n- **%s**: 效率评分%.1f\n", F.col("name"), F.col("score")), 6), _constant(runs, file, "## 🔍 参数影响分析\n", 7),
        _constant(length, file, "### 镜头长度设置影响", 8, length),
        _lines(length, F.format_string("- **%s**: %d个关键帧, %d个镜头", F.col("name"), F.col("keyframes_count"), F.col("shots_covered")), 9, "", F.col("r")), _constant(length, file, "", 10, length),
        _constant(alike, file, "### 相似度阈值影响", 11, alike),
        _lines(alike, F.format_string("- **%s**: %d个关键帧, 置信度%s", F.col("name"), F.col("keyframes_count"), _text(F.col("avg_confidence"))), 12, "", F.col("r")), _constant(alike, file, "", 13, alike),
        _constant(runs, file, advice, 14),
    )


def write(path: str, *documents: DataFrame, overwrite: bool = False) -> None:
    """Documents below `path`, all of them or none."""
    write_files(_all(*documents), path, *ORDER, overwrite=overwrite)


def batch_outcomes(subtitles: DataFrame) -> DataFrame:
    """media, segments, error of every file of `read_subtitles`: a broken file has none of the former and the reason."""
    return subtitles.groupBy("media").agg(F.count("seg_index").alias("segments"), F.max("error").alias("error"))


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    """total, succeeded, failed of a batch: one row."""
    return outcomes.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("error").isNull()).alias("succeeded"), F.count_if(F.col("error").isNotNull()).alias("failed"))

