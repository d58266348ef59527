"""Whole-corpus plans: scan, scores and reports."""

from .profiles import profile_scores, scan_profiles
from .reports import (
    catalog_integrity,
    label_violations,
    report_documents,
    report_findings,
    rule_catalog,
    sorted_violations,
    top_per_rule,
    top_rules,
    top_violations,
    violations_with_fix,
    write_report,
    write_run,
)
from .scan import errors, file_stats, python_nodes, scan_files, scan_sources, violations, write_tables
from .scoring import (
    category_scores,
    grade_scores,
    impact_estimate,
    language_breakdown,
    quality_gate,
    repo_scores,
    repo_stats,
    rule_scores,
    scan_scores,
)

__all__ = [
    "catalog_integrity", "category_scores", "errors", "file_stats", "grade_scores", "impact_estimate",
    "label_violations", "language_breakdown", "profile_scores", "python_nodes", "quality_gate", "repo_scores", "repo_stats",
    "report_documents", "report_findings", "rule_catalog", "rule_scores", "scan_files", "scan_profiles", "scan_scores",
    "scan_sources", "sorted_violations", "top_per_rule", "top_rules", "top_violations", "violations",
    "violations_with_fix", "write_report", "write_run", "write_tables",
]
