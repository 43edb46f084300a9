"""URL filters: host-suffix and path-prefix expressions joined on short hashes."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.unhex(F.sha2(F.concat(host, F.lit("\n"), path), 256))


def url_filter(
    pages: DataFrame,
    rules: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    prefix_bytes: int = 4,
) -> DataFrame:
    """One row per input row: id, ``host``, ``path``, ``rule``, ``verdict``.

    ``rules`` has ``host``, ``path`` and ``verdict`` (``allow`` or ``block``). A rule fits
    its host and all subdomains when the URL's path starts with the rule's path.
    Each URL is expanded into every host suffix times every path prefix of a
    length that some rule has. The expressions meet the rules in an equi-join on
    the first ``prefix_bytes`` of a SHA-256; the full digest is compared after that.
    The longest rule (host and path) wins, ``block`` before ``allow`` among equals.
    All expressions of a row are made in one task and combined there, so one row
    per URL is shuffled. Spark broadcasts the rules only below its own size limit.

    * a null URL, or one without ``://``, has empty host and path and gets ``default``.
    * rules with a null or empty host or a null verdict never fit; a null path is empty.
    * repeated rows are judged one by one; an empty table gives an empty result.
    * columns of ``pages`` other than the two named are not read.

    The only thing collected is the set of distinct rule path lengths, at most as
    many as the longest rule path has characters.
    """
    wanted = rules.filter("host IS NOT NULL AND host <> '' AND verdict IS NOT NULL").select(
        F.translate("host", string.ascii_uppercase, string.ascii_lowercase).alias("r_host"),
        F.coalesce("path", F.lit("")).alias("r_path"),
        F.col("verdict").alias("r_verdict"),
    )
    lengths = sorted(r[0] for r in wanted.select(F.length("r_path")).distinct().collect())
    keyed = wanted.distinct().select(
        _digest(F.col("r_host"), F.col("r_path")).alias("r_digest"),
        F.concat("r_host", "r_path").alias("rule"),
        (F.length("r_host") + F.length("r_path")).alias("r_len"),
        "r_verdict",
    ).withColumn("short", F.substring("r_digest", 1, prefix_bytes))

    url = F.col(url_col)
    rows = pages.select(
        F.monotonically_increasing_id().alias("_row"),
        F.col(id_col).alias("_id"),
        url_host(url).alias("host"),
        url_path(url).alias("path"),
    )
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))),
    )
    starts = F.array(*[F.lit(n) for n in lengths]) if lengths else F.array().cast("array<int>")
    prefixes = F.transform(
        F.filter(starts, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n)
    )
    spread = (
        rows.withColumn("_host", F.explode(suffixes))
        .withColumn("_path", F.explode_outer(prefixes))
        .withColumn("digest", _digest(F.col("_host"), F.col("_path")))
        .withColumn("short", F.substring("digest", 1, prefix_bytes))
        .select("_row", "_id", "host", "path", "digest", "short")
    )
    best = F.max(
        F.when(
            F.col("r_digest") == F.col("digest"),
            F.struct("r_len", (F.col("r_verdict") == "block").alias("hard"), "rule", "r_verdict"),
        )
    )
    return (
        spread.join(keyed, "short", "left")
        .groupBy("_row")
        .agg(F.first("_id").alias(id_col), F.first("host").alias("host"), F.first("path").alias("path"), best.alias("b"))
        .select(
            id_col,
            "host",
            "path",
            F.col("b.rule").alias("rule"),
            F.coalesce("b.r_verdict", F.lit(default)).alias("verdict"),
        )
    )
