"""Mixing sources to target weights: Sainte-Laguë quotas of equal-token blocks, then seeded blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from framelark.functions.partitioned import prefix_aggregate
from framelark.functions.storage import write_through

#: A word is a run of characters other than these: blank, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
_WIDE = "decimal(38,0)"


def in_order(df: DataFrame, keys: list[str], order: list, sums: dict[str, Column], name: str) -> DataFrame:
    """Running totals per key (own row included), for any order, with no task that holds a whole key.

    The rows are sorted over all tasks and numbered; the parts of that sort are the blocks
    whose totals are carried.
    """
    placed = df.orderBy(*keys, *order).withColumn("_at", F.monotonically_increasing_id())
    placed = write_through(placed, name)
    block = F.shiftright("_at", 33)
    return prefix_aggregate(placed, keys, block, ["_at"], {k: ("sum", v) for k, v in sums.items()}).drop("_at")


def share_targets(sources: DataFrame, weights: list[int], percent: int = 150, most: int = 2) -> DataFrame:
    """Add ``weight`` and ``target`` (double) to ``(source, source_size)`` rows, one per source.

    Sources take the weights in turn, by code point, null last. ``percent`` of all sizes is
    shared by weight; a target stops at ``most`` times its source, and the excess is
    shared among the others by weight until none is above. In order of size to weight, the capped
    sources are a prefix: one is capped if its share of what the prefix leaves is
    at least its cap. All sums are of whole numbers, so reruns agree to the bit.
    """
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    ranked = in_order(sources, [], [F.asc_nulls_last("source")], {"_rank": F.lit(1)}, "ranks")
    turn = F.pmod(F.col("_rank") - 1, F.lit(len(weights))).cast("int")
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1).cast("bigint"))
    by_ratio = [F.col("source_size") / F.col("weight"), "_rank"]
    sums = {"_sizes": F.col("source_size").cast(_WIDE), "_weights": F.col("weight").cast(_WIDE)}
    rows = write_through(in_order(ranked, [], by_ratio, sums, "ratios"), "shares")
    all_weights = rows.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    # In hundredths of a word: what is left for this source and those after it, and their weights.
    size, weight = F.col("source_size").cast(_WIDE), F.col("weight").cast(_WIDE)
    left = F.lit(percent * total).cast(_WIDE) - (F.col("_sizes") - size) * (100 * most)
    later = F.lit(all_weights).cast(_WIDE) - F.col("_weights") + weight
    rows = rows.withColumn("_capped", left * weight >= size * later * (100 * most))
    capped, kept = rows.agg(
        F.coalesce(F.sum(F.when(F.col("_capped"), F.col("source_size"))), F.lit(0)),
        F.coalesce(F.sum(F.when(~F.col("_capped"), F.col("weight"))), F.lit(0)),
    ).first()
    share = F.lit(float(percent * total - 100 * most * capped)) * F.col("weight") / F.lit(float(100 * kept or 1))
    target = F.when(F.col("_capped"), (F.col("source_size") * most).cast("double")).otherwise(share)
    return rows.select(*sources.columns, F.col("_rank").alias("source_rank"), "weight", target.alias("target"))


def sainte_lague(claims: DataFrame, keys: list[str], share: str, total: str, rivals: str, seats: str, cap: str, tie: str) -> DataFrame:
    """Add ``quota``: the seats of each claim among those with equal ``keys``, by highest quotients.

    A claim's k-th seat has the quotient ``share / (2k - 1)``; the ``seats`` highest quotients of a
    group win, ties by ``tie``; no claim gets more than ``cap``, which must not lie under its
    proportional part. The columns ``total`` (of the shares), ``rivals`` (claims) and ``seats`` of the group
    stand on every row. Rounding moves a claim's seats from its proportional part by at most its part
    of half the number of claims, and a half. So the seats below that are given at once, and only
    those around it compete: a few quotients per claim, not one per seat.
    """
    part = F.coalesce(F.try_divide(F.col(share).cast("double"), F.col(total).cast("double")), F.lit(0.0))
    slack = F.col(rivals) * 2 + 2
    within = lambda x: F.least(F.greatest(x, F.lit(0)), F.col(cap)).cast("bigint")
    low = within(F.floor(part * F.greatest(F.col(seats) - slack, F.lit(0))) - 1)
    high = within(F.ceil(part * (F.col(seats) + slack)) + 1)
    rows = claims.select(*keys, tie, F.col(share).cast("double").alias("_share"), F.col(seats).alias("_seats"), low.alias("_low"), high.alias("_high"))
    certain = F.struct(F.lit(float("inf")).alias("quotient"), F.col("_low").alias("n"))
    rival = lambda k: F.struct((F.col("_share") / (2 * k - 1)).alias("quotient"), F.lit(1).cast("bigint").alias("n"))
    ladder = F.when(F.col("_low") < F.col("_high"), F.transform(F.expr("sequence(_low + 1, _high)"), rival)).otherwise(F.array().cast("array<struct<quotient:double,n:bigint>>"))
    offers = rows.select(*keys, tie, "_seats", F.explode(F.concat(F.array(certain), ladder)).alias("o")).select(*keys, tie, "_seats", "o.*")
    ranked = in_order(offers, keys, [F.desc("quotient"), tie], {"_upto": F.col("n")}, "quotients")
    won = ranked.filter("_upto <= _seats").groupBy(*keys, tie).agg(F.sum("n").alias("quota"))
    return claims.join(won, [*keys, tie], "left").withColumn("quota", F.coalesce("quota", F.lit(0)))


def _spread_join(many: DataFrame, few: DataFrame, keys: list[str], salt: Column, salts: int = 32) -> DataFrame:
    """Inner join whose ``few`` side is copied to every salt, so that a hot key is split over ``salts`` tasks."""
    copies = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return many.withColumn("_salt", F.pmod(salt, F.lit(salts)).cast("int")).join(copies, [*keys, "_salt"]).drop("_salt")


def _draw(text: Column, first: int) -> Column:
    """A number from eight hex digits of an MD5 digest in hex."""
    return F.conv(F.substring(text, first, 8), 16, 10).cast("bigint")


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    percent: int = 150,
    most: int = 2,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    block_words: int = 32,
    shard_words: int = 1 << 20,
    shard_rows: int = 1 << 16,
    seed: int = 11,
) -> DataFrame:
    """One row per input row: id, ``source``, ``size``, ``source_size``, ``target``, ``taken``, ``copies``, ``spans``.

    Targets as in :func:`share_targets`. A source is dealt into shards of about
    ``shard_words`` words and ``shard_rows`` rows by a seeded hash of the id, and a shard, in seeded order, is
    cut into equal blocks of about ``block_words`` words. Blocks go to sources by their targets and
    then to the shards of each source by their blocks, both by Sainte-Laguë quotients. A shard with quota
    q and n blocks takes every block q div n times, and a run of q mod n blocks from a seeded one on,
    past the end and on from the front, once more: rows stand in seeded order, so a run is
    a random choice that leaves most documents whole. ``taken = copies * size +`` the words of
    ``spans`` (word ranges of the document), at most ``most`` times the size.

    * null text has no words; empty and blank texts neither: they take nothing, and are kept with zeros.
    * null sources are one source, after all others; null ids are one id.
    * repeated ids are separate rows; rows of one id and source share a shard.
    * an empty table gives an empty result; other columns are not read, whatever their names.

    Only built-in functions; no task holds a whole source.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint")
    sized = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"))
    sized = write_through(sized, "sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    targets = share_targets(write_through(sources, "sources"), list(weights), percent, most)
    shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words), F.ceil(F.col("_rows") / shard_rows))
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("_key")
    targets = write_through(targets.select(key, "source_size", "source_rank", "target", shards.alias("_shards")), "targets")

    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit(""))))
    dealt = _spread_join(sized.select("*", key, digest.alias("_h")), targets, ["_key"], F.xxhash64("_h", "size"))
    dealt = dealt.withColumn("_shard", F.pmod(_draw(F.col("_h"), 1), F.col("_shards")))
    dealt = write_through(dealt.drop("_shards", "source_rank"), "dealt")

    words = dealt.groupBy("_key", "_shard").agg(F.sum("size").alias("_words"))
    words = write_through(words.withColumn("_blocks", F.ceil(F.col("_words") / block_words)), "shards")
    whole = words.groupBy("_key").agg(F.sum("_blocks").alias("_all"), F.count(F.lit(1)).alias("_rivals"))
    rows = targets.join(whole, "_key")
    want = F.coalesce(F.try_divide(F.col("target") * F.col("_all"), F.col("source_size").cast("double")), F.lit(0.0))
    rows = write_through(rows.withColumn("_want", want), "wanted")
    exact = F.sum(F.col("_want").cast("decimal(38,6)"))
    total, rivals, seats = rows.agg(F.coalesce(F.sum("_all"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.round(exact).cast("bigint"), F.lit(0))).first()
    wanted_all = rows.agg(exact.cast("double")).first()[0] or 0.0
    rows = rows.select(
        "_key", "source_rank", "_want", "_all", "_rivals", (F.col("_all") * most).alias("_cap"),
        F.lit(wanted_all).alias("_wanted"), F.lit(rivals).alias("_sources"), F.lit(seats).alias("_seats"),
    )
    by_source = sainte_lague(rows, [], "_want", "_wanted", "_sources", "_seats", "_cap", "source_rank")
    by_source = write_through(by_source.select("_key", "_all", "_rivals", F.col("quota").alias("_seats")), "source-quotas")

    claims = _spread_join(words, by_source, ["_key"], F.col("_shard")).withColumn("_cap", F.col("_blocks") * most)
    quotas = sainte_lague(claims, ["_key"], "_blocks", "_all", "_rivals", "_seats", "_cap", "_shard")
    start = _draw(F.md5(F.concat(F.lit(f"{seed}:"), "_key", F.lit(":"), F.col("_shard").cast("string"))), 1)
    n, s = F.col("_blocks"), F.col("_words")
    quotas = quotas.select(
        "_key", "_shard", "_words", "_blocks",
        F.coalesce(F.try_divide(F.col("quota") - F.col("quota") % n, n), F.lit(0)).cast("bigint").alias("_copies"),
        F.when(n > 0, F.col("quota") % n).otherwise(0).cast("bigint").alias("_extra"),
        F.when(n > 0, F.pmod(start, n)).otherwise(0).cast("bigint").alias("_from"),
    )
    lo, hi, wrapped = "_from * _words div _blocks", "least(_from + _extra, _blocks) * _words div _blocks", "greatest(_from + _extra - _blocks, 0) * _words div _blocks"
    bounds = [F.when(n > 0, F.expr(e)).otherwise(0).alias(c) for c, e in (("_lo", lo), ("_hi", hi), ("_wrap", wrapped))]
    quotas = quotas.select("_key", "_shard", "_copies", *bounds)

    placed = dealt.join(quotas, ["_key", "_shard"])
    row = W.partitionBy("_key", "_shard").orderBy("_h", "_id", "size").rowsBetween(W.unboundedPreceding, 0)
    placed = placed.withColumn("_end", F.sum("size").over(row)).withColumn("_begin", F.col("_end") - F.col("size"))

    def span(low: Column, high: Column) -> Column:
        return F.struct(
            (F.greatest(low, F.col("_begin")) - F.col("_begin")).alias("from_word"), (F.least(high, F.col("_end")) - F.col("_begin")).alias("to_word")
        )

    both = F.array(span(F.lit(0).cast("bigint"), F.col("_wrap")), span(F.col("_lo"), F.col("_hi")))
    spans = F.filter(both, lambda x: x["from_word"] < x["to_word"])
    placed = placed.withColumn("spans", spans)
    more = F.aggregate("spans", F.lit(0).cast("bigint"), lambda total, x: total + x["to_word"] - x["from_word"])
    return placed.select(
        F.col("_id").alias(id_col), "source", "size", "source_size", "target",
        (F.col("_copies") * F.col("size") + more).alias("taken"), F.col("_copies").alias("copies"), "spans",
    )
