"""Size rules on binary assets and bundles; they look at names and lengths only."""

from __future__ import annotations

from collections.abc import Sequence

from ..catalog.rules import Rule
from ..functions.sqltext import in_list
from ..functions.values import human_size_sql
from .finding import NO_FINDINGS, finding_sql, keep_hits_sql

# Extensions and size limits in bytes.
IMAGE_EXTENSIONS = (".png", ".jpg", ".jpeg", ".gif", ".bmp", ".tiff", ".ico", ".psd")
MEDIA_EXTENSIONS = (".mp4", ".mov", ".avi", ".webm", ".mp3", ".wav", ".zip", ".tar", ".gz")
BUNDLE_EXTENSIONS = (".js", ".mjs", ".cjs", ".css")
IMAGE_LIMIT = 500 * 1024
MEDIA_LIMIT = 2 * 1024 * 1024
BUNDLE_LIMIT = 150 * 1024


IS_ASSET = in_list("_ext", IMAGE_EXTENSIONS + MEDIA_EXTENSIONS)


def asset_columns(rules: Sequence[Rule]) -> dict[str, str]:
    """``_assets`` from ``_name``, ``_ext`` and ``length``."""
    enabled = {r.id for r in rules}
    size = human_size_sql("length")
    limit = f"CAST(IF({in_list('_ext', IMAGE_EXTENSIONS)}, {IMAGE_LIMIT}, {MEDIA_LIMIT}) AS BIGINT)"
    label = f"concat(_ext, ' \u2022 ', {size})"
    extra = "map('bytes', CAST(length AS STRING))"
    large = finding_sql(
        "'GC070'", "0", "0", label, f"concat('Asset of ', {size}, ', limit ', {human_size_sql(limit)})", extra
    )
    bundle = finding_sql("'GC072'", "0", "0", label, f"concat('Bundle not minified, ', {size})", extra)
    hits = {
        "GC072": f"IF({in_list('_ext', BUNDLE_EXTENSIONS)} AND NOT contains(_name, '.min.') AND length > {BUNDLE_LIMIT}, "
                 f"{bundle}, NULL)",
        "GC070": f"IF({IS_ASSET} AND length > {limit}, {large}, NULL)",
    }
    active = [value for rule_id, value in hits.items() if rule_id in enabled]
    return {"_assets": keep_hits_sql(f"array({', '.join(active)})") if active else NO_FINDINGS}
