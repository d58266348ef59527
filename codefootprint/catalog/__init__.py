"""Rules, fix guides and lookup dimensions."""

from .dimensions import (
    CATEGORIES,
    GRADE_BANDS,
    HEAVY_DEPENDENCIES,
    SEVERITIES,
    categories_df,
    fix_guides_df,
    grade_bands_df,
    heavy_dependencies_df,
    rules_df,
    severities_df,
)
from .guides import FIX_GUIDES, FixGuide
from .rules import C_LIKE, CODE_LANGUAGES, DEFAULT_RULES, QUERY_LANGUAGES, Rule, select_rules
from .table import rules_from_table

__all__ = [
    "C_LIKE", "CATEGORIES", "CODE_LANGUAGES", "DEFAULT_RULES", "FIX_GUIDES", "FixGuide", "GRADE_BANDS",
    "HEAVY_DEPENDENCIES", "QUERY_LANGUAGES", "Rule", "SEVERITIES", "categories_df", "fix_guides_df",
    "grade_bands_df", "heavy_dependencies_df", "rules_df", "rules_from_table", "select_rules", "severities_df",
]
