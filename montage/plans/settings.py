"""Parameters of the keyframe plan: defaults, presets, checks, and what they become for a video."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: sampled frames above which a setting does not suit a video.
MOST_SAMPLED = 10_000


@dataclass(frozen=True)
class Settings:
    """Names and defaults. Unknown names raise TypeError, values out of range ValueError.

    target_fps, sampling_strategy, frames_per_second, fps_ratio and random_select_count say which frames are looked at;
    enable_shot_filtering, min_shot_duration and max_shot_duration which shots; cluster_eps is the radius where none can be
    told from the frames; max_keyframes_per_shot bounds what is kept; preserve_original_resolution, max_resolution,
    output_resolution and image_quality say how its pictures are to be written.
    """

    target_fps: int = 10
    output_resolution: tuple[int, int] = (512, 512)
    sampling_strategy: str = "fps"
    frames_per_second: int = 1
    fps_ratio: float = 3.0
    random_select_count: int = 3
    preserve_original_resolution: bool = False
    max_resolution: tuple[int, int] = (1920, 1080)
    min_shot_duration: int = 10
    max_shot_duration: int = 3000
    enable_shot_filtering: bool = True
    cluster_eps: float = 0.15
    max_keyframes_per_shot: int = 30
    image_quality: int = 95

    def __post_init__(self) -> None:
        ranges = {
            "target_fps": self.target_fps > 0, "cluster_eps": self.cluster_eps > 0,
            "max_keyframes_per_shot": self.max_keyframes_per_shot > 0, "image_quality": 1 <= self.image_quality <= 100,
        }
        if wrong := [name for name, fine in ranges.items() if not fine]:
            raise ValueError(f"out of range: {', '.join(wrong)}")

    def changed(self, **values: Any) -> Settings:
        return replace(self, **values)

    def as_dict(self) -> dict[str, Any]:
        return {f.name: getattr(self, f.name) for f in fields(self)}


# What each preset changes.
PRESETS: dict[str, dict[str, Any]] = {
    "fast": {"target_fps": 5, "cluster_eps": 0.2, "max_keyframes_per_shot": 3},
    "balanced": {"target_fps": 10, "cluster_eps": 0.15, "max_keyframes_per_shot": 5},
    "quality": {"target_fps": 15, "cluster_eps": 0.12, "max_keyframes_per_shot": 8, "output_resolution": (768, 768)},
    "detailed": {"target_fps": 20, "cluster_eps": 0.1, "max_keyframes_per_shot": 10, "output_resolution": (1024, 1024)},
    "original": {"target_fps": 10, "cluster_eps": 0.15, "max_keyframes_per_shot": 5, "preserve_original_resolution": True, "image_quality": 100},
}


def preset(name: str) -> Settings:
    if name not in PRESETS:
        raise ValueError(f"no such preset: {name}; there are {', '.join(PRESETS)}")
    return Settings().changed(**PRESETS[name])


# The lengths, rates and sizes of the rule for a video.
def fitted(how: Column, fps: Column, seconds: Column, width: Column, height: Column) -> dict[str, Column]:
    """target_fps, side of the output and max_keyframes_per_shot for a video; `how` is a struct of the last two."""
    whole = F.floor(fps)
    rate = F.when(seconds > 3600, F.least(F.lit(5), F.floor(whole / 4))).when(seconds > 1800, F.least(F.lit(8), F.floor(whole / 3))).otherwise(F.least(F.lit(12), F.floor(whole / 2)))
    side = F.when(width * height > 1920 * 1080, 768).when(width * height < 640 * 480, 256).otherwise(how["side"])
    most = F.when(seconds > 1800, F.greatest(F.lit(3), how["max_keyframes_per_shot"] - 2)).otherwise(how["max_keyframes_per_shot"])
    return {"target_fps": rate.cast("long"), "side": side.cast("long"), "max_keyframes_per_shot": most.cast("long")}


def suits(target_fps: Column, fps: Column, seconds: Column) -> Column:
    return (target_fps <= fps) & (seconds * target_fps <= MOST_SAMPLED)


def sweep(settings: dict[str, Settings]) -> Column:
    """Named settings as an array column of structs, to be exploded over videos: a sweep tries every one on each."""
    return F.array(*(
        F.struct(F.lit(name).alias("name"), F.lit(s.target_fps).alias("target_fps"), F.lit(s.output_resolution[0]).alias("side"), F.lit(s.max_keyframes_per_shot).alias("max_keyframes_per_shot"))
        for name, s in settings.items()
    ))
