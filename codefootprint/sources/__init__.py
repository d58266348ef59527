"""Inputs: corpora of files, single files, snippets, requested repositories and targets."""

from .admission import admit_repos, admit_snippets, admitted_files, missing_repo_errors
from .commits import Commits, read_committed
from .corpus import (
    FILES_SCHEMA,
    decode_text,
    files_from_binary,
    prune_ignored_dirs,
    read_corpus,
    requested_files,
    with_text,
)
from .listing import files_from_listing
from .targets import normalize_targets
from .tree import files_from_tree, list_tree, packed

__all__ = [
    "Commits", "FILES_SCHEMA", "admit_repos", "admit_snippets", "admitted_files", "decode_text", "files_from_binary", "files_from_listing",
    "files_from_tree", "list_tree",
    "missing_repo_errors", "normalize_targets", "packed", "prune_ignored_dirs", "read_committed", "read_corpus", "requested_files",
    "with_text",
]
