"""Scalar functions: paths, text, scrubbing and report values."""

from .paths import detect_language, extension, is_ignored_path
from .scrub import mask_code, strip_comments
from .text import count_code_lines, split_lines, strip
from .values import clamp_score, exact_round, grade_columns, human_size, impact_columns, location

__all__ = [
    "clamp_score", "count_code_lines", "detect_language", "exact_round", "extension", "grade_columns", "human_size",
    "impact_columns", "is_ignored_path", "location", "mask_code", "split_lines", "strip", "strip_comments",
]
