"""File names: extension, language, ignored folders.

Functions named ``*_sql`` write an expression over a column name or expression; the others wrap it in a Column.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sqltext import map_of, regex

# Extensions by language and the folders no scan enters.
EXTENSION_LANGUAGE = {
    ".py": "python", ".pyw": "python",
    ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".ts": "typescript", ".tsx": "typescript",
    ".java": "java",
    ".c": "c", ".h": "c",
    ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp",
    ".cs": "csharp", ".go": "go", ".rb": "ruby", ".php": "php", ".rs": "rust", ".kt": "kotlin",
    ".swift": "swift", ".scala": "scala", ".sql": "sql",
    ".html": "html", ".htm": "html", ".vue": "html",
    ".css": "css", ".scss": "css", ".sass": "css", ".less": "css",
    ".yml": "yaml", ".yaml": "yaml", ".json": "json", ".toml": "toml",
    ".ini": "ini", ".cfg": "ini", ".env": "ini",
}
IGNORED_DIRS = (
    ".git", ".hg", ".svn", "node_modules", "bower_components", "venv", ".venv", "env", ".env", "__pycache__",
    ".mypy_cache", ".pytest_cache", ".ruff_cache", ".tox", "dist", "build", "out", ".next", ".nuxt", "target",
    "vendor", ".idea", ".vscode", "coverage", ".gradle", "Pods", ".terraform", "site-packages",
)


def base_name_sql(path: str) -> str:
    return f"substring_index({path}, '/', -1)"


def extension_sql(path: str) -> str:
    """Lower-cased last extension with its dot; leading dots of a name do not start an extension."""
    name = f"trim(LEADING '.' FROM {base_name_sql(path)})"
    return f"lower(IF(contains({name}, '.'), concat('.', substring_index({name}, '.', -1)), ''))"


def language_of_name_sql(name: str, ext: str) -> str:
    """Language from a lower-cased base name and its extension, null when unknown. The three Dockerfile name forms
    win over the extension."""
    return (
        f"CASE WHEN {name} = 'dockerfile' OR endswith({name}, '.dockerfile') OR startswith({name}, 'dockerfile.') "
        f"THEN 'dockerfile' ELSE try_element_at({map_of(EXTENSION_LANGUAGE.items())}, {ext}) END"
    )


def detect_language_sql(path: str) -> str:
    return language_of_name_sql(f"lower({base_name_sql(path)})", extension_sql(path))


def is_ignored_path_sql(path: str, ignored_dirs: Iterable[str] | None = None) -> str:
    """True when any parent folder is hidden or in the ignore set. An empty set means the default one."""
    ignored = sorted(set(ignored_dirs or ()) or set(IGNORED_DIRS))
    names = "|".join(re.escape(name) for name in ignored)
    return f"(contains({path}, '/') AND {regex(path, rf'(?:^|/)(?:[.][^/]*|{names})/')})"


def extension(path: str) -> Column:
    return F.expr(extension_sql(path))


def detect_language(path: str) -> Column:
    return F.expr(detect_language_sql(path))


def is_ignored_path(path: str, ignored_dirs: Iterable[str] | None = None) -> Column:
    return F.expr(is_ignored_path_sql(path, ignored_dirs))
