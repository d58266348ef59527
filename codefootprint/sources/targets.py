"""Repository targets as users type them: ``owner/repo`` or a URL on an allowed host."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import WHITESPACE

# Hosts, name characters and URL schemes that have ``;`` parameters.
ALLOWED_HOSTS = ("github.com", "www.github.com")
NAME = r"\A[A-Za-z0-9_.-]+\n?\z"
PARAMETER_SCHEMES = (
    "ftp", "hdl", "prospero", "http", "https", "shttp", "rtsp", "rtsps", "rtspu", "sip", "sips", "mms", "sftp", "tel",
)


def normalize_targets(targets: DataFrame, column: str = "target", hosts: Sequence[str] = ALLOWED_HOSTS) -> DataFrame:
    """Adds ``owner`` and ``repo``, both null when the target is not accepted."""
    target = F.btrim(F.coalesce(column, F.lit("")), F.lit(WHITESPACE))
    df = targets.withColumn("_target", target)
    t = F.col("_target")
    short = ~t.contains("://") & ~t.contains("@") & (F.length(t) - F.length(F.replace(t, F.lit("/"))) == 1)
    url = F.regexp_replace(F.when(t.contains("://"), t).otherwise(F.concat(F.lit("https://"), t)), r"[\t\r\n]", "")
    df = df.withColumns({"_short": short, "_url": url})
    split_url = r"\A([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)"
    scheme, network, path = (F.regexp_extract("_url", split_url, i) for i in (1, 2, 3))
    host = F.lower(F.regexp_extract(F.regexp_extract(network, r"[^@]*\z", 0), r"\A[^:]*", 0))
    plain = F.when(F.lower(scheme).isin(*PARAMETER_SCHEMES), F.regexp_replace(path, r";[^/]*\z", "")).otherwise(path)
    parts = F.when(F.col("_short"), F.split(t, "/")).when(
        host.isin(*hosts), F.filter(F.split(plain, "/"), lambda p: p != "")
    )
    df = df.withColumn("_parts", parts)
    owner = F.get("_parts", F.lit(0))
    repo = F.get("_parts", F.lit(1))
    bare = F.when(repo.endswith(".git"), F.left(repo, F.length(repo) - 4)).otherwise(repo)
    accepted = owner.rlike(NAME) & bare.rlike(NAME)
    return df.select(
        *targets.columns, F.when(accepted, owner).alias("owner"), F.when(accepted, bare).alias("repo")
    )
