"""Structured Streaming: running totals, scans of arriving files, and scores of files that change."""

from .jobs import current_totals, scan_stream, start_scan, start_usage_totals, usage_totals
from .revisions import Revisions, current_counts, current_files, current_scores, start_scores

__all__ = [
    "Revisions", "current_counts", "current_files", "current_scores", "current_totals", "scan_stream", "start_scan",
    "start_scores", "start_usage_totals", "usage_totals",
]
