"""Resource-waste analytics over corpora of source repositories, on Spark.

Typical use::

    from codefootprint import read_corpus, scan_files, scan_scores, violations

    scanned = scan_files(read_corpus(spark, "s3a://lake/files"))
    scanned.write.parquet("s3a://lake/scanned")          # one pass over the sources
    scan_scores(spark.read.parquet("s3a://lake/scanned"))
"""

from .catalog import DEFAULT_RULES, FIX_GUIDES, FixGuide, Rule, rules_from_table, select_rules
from .plans import *  # noqa: F403
from .plans import __all__ as _plans
from .sources import *  # noqa: F403
from .sources import __all__ as _sources
from .streaming import *  # noqa: F403
from .streaming import __all__ as _streaming

__all__ = [
    "DEFAULT_RULES", "FIX_GUIDES", "FixGuide", "Rule", "rules_from_table", "select_rules", *_plans, *_sources, *_streaming,
]
