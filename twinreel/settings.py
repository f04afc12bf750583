"""Comparison settings and the whole-number budgets that follow from them in float32."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields

import numpy as np

# Entry flag bits and result flag bits.
IS_IMAGE, MANUALLY_EXCLUDED, THUMBNAIL_ERROR, METADATA_ERROR, TOO_DARK = 1, 2, 4, 8, 16
NO_AUDIO_TRACK, AUDIO_ERROR, SILENT_AUDIO, REPARSE_POINT, REPARSE_CHECKED = 32, 64, 128, 256, 512
FLIPPED, PARTIAL_CLIP = 1, 2

VIDEO_EXTENSIONS = (
    "mp4 wmv avi mkv flv mov mpg mpeg m4v asf f4v webm divx m2t m2ts vob ts rmvb rm".split()
)
IMAGE_EXTENSIONS = "jpg jpeg png gif bmp tiff webp heic heif".split()


@dataclass(frozen=True)
class Settings:
    include_list: tuple[str, ...] = ()
    black_list: tuple[str, ...] = ()
    include_images: bool = True
    include_subdirectories: bool = True
    ignore_reparse_points: bool = False
    exclude_hard_links: bool = False
    ignore_black_pixels: bool = False
    ignore_white_pixels: bool = False
    compare_flipped: bool = False
    include_missing: bool = False
    scan_entire_catalog: bool = False
    folder_match: str = "none"  # none, same, different
    folder_depth: int = 1
    use_phash: bool = False
    percent: float = 96.0
    duration_percent: float = 20.0
    duration_min_s: float = 0.0
    duration_max_s: float = 0.0
    max_sampling_s: float = 0.0
    thumbnail_count: int = 1
    path_contains: tuple[str, ...] = ()
    path_not_contains: tuple[str, ...] = ()
    size_filter: bool = False
    max_size_mb: int = 0
    min_size_mb: int = 0
    partial_clips: bool = False
    partial_min_ratio: float = 0.10
    partial_similarity: float = 0.80
    partial_require_visual: bool = True
    partial_visual_similarity: float = 0.85
    criteria: tuple[str, ...] = field(default=("duration", "resolution", "fps", "bitrate", "audio_sample_rate", "size"))

    @classmethod
    def from_json(cls, text: str | None) -> Settings:
        """Settings from a JSON object: names in any case, unset ones keep their defaults; text
        that is no JSON object gives the defaults."""
        try:
            given = json.loads(text or "{}")
            given = {k.lower().replace("_", ""): v for k, v in given.items()}
        except (ValueError, AttributeError):
            return cls()
        known = {f.name.replace("_", ""): f.name for f in fields(cls)}
        return cls(**{known[k]: tuple(v) if isinstance(v, list) else v for k, v in given.items() if k in known and v is not None})

    @property
    def gray_limit(self) -> float:
        """Greatest difference of two gray frames, in float32: 0.04000002 for 96."""
        return float(np.float32(1) - np.float32(self.percent) / np.float32(100))

    @property
    def phash_bits(self) -> int:
        """Most differing bits of two 64-bit hashes: 2 for 96, 6 for 90."""
        return int((1.0 - float(np.float32(self.percent) / np.float32(100))) * 64)


def clip_bits(similarity: float, blocks: int) -> int:
    """Most differing bits of two runs of 32-bit blocks, truncated in float32: 63 of 320 for 0.8."""
    return int((np.float32(1) - np.float32(similarity)) * np.float32(blocks * 32))
