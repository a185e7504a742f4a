"""Top N of every group by simultaneous bisection (problem 5).

All groups are refined at once.  A row's code is order preserving: the sign-corrected
64 bits of its score, in two halves, and then, for groups whose cutoff falls among
equal scores, its identifier six bytes at a time; so the passes over the score are
bounded by its bits however it is spread.  A pass divides each open group's code range at 63 midpoints (six bisection
steps), counts rows between midpoints with map-side combining, and keeps only the
one interval that holds the cutoff open; intervals above it are wholly in, those
below wholly out.  A group is closed when exactly N of its rows lie above the
cutoff.  No group is ever sorted or gathered: what travels per group and pass is 64
counts, and rows of large groups are salted, one salt for so many rows, wherever they
meet their group's cutoff.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut, table

BINS = 64
#: Rows that one salt of a group holds: a group has as many salts as its rows need.
ROWS_PER_SALT = 100_000
#: Groups above ROWS_PER_SALT that are broadcast; more are joined.
BROADCAST_GROUPS = 100_000
_LOW = 0xFFFFFFFF


def _bits(score):
    """The 64 bits of a double as a number that has its order."""
    raw = F.call_function("reflect", F.lit("java.lang.Double"), F.lit("doubleToLongBits"), score).cast("long")
    return F.when(raw < 0, raw.bitwiseXOR(F.lit(0x7FFFFFFFFFFFFFFF))).otherwise(raw)


def _code(level, bits, item):
    """Code of a row at its group's level; larger is better.  Halves of the score's bits, then six bytes of the identifier each."""
    at = (level - 2) * 6
    chunk = F.substring(F.encode(item, "UTF-8"), at + 1, F.lit(6))
    prefix = -F.conv(F.rpad(F.hex(chunk), 12, "0"), 16, 10).cast("long")
    # After the last byte only trailing NULs can tell two identifiers apart: the shorter comes first.
    past = F.octet_length(item) < at + 1
    return F.when(level == 0, F.shiftright(bits, 32)).when(level == 1, bits.bitwiseAND(F.lit(_LOW))).when(past, -F.octet_length(item).cast("long")).otherwise(prefix)


def top_n(df: DataFrame, group: str, item: str, score: str, n: int) -> DataFrame:
    """(group, top_rank, item): the n items of highest score of each group, equal scores by item ascending in code-point order.

    Rows with a null group or item, or a null or NaN score, are ignored; an item
    with several rows in a group counts once with its highest score, so repeated
    rows change nothing; infinite scores are above or below all others.
    Groups with fewer than n items give all of them; an empty table gives no rows;
    other columns are ignored whatever their names.
    """
    s = F.col(score).cast("double") + F.lit(0.0)  # -0.0 becomes 0.0
    rows = (
        df.where(F.col(group).isNotNull() & F.col(item).isNotNull() & F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
        .select(F.col(group).alias("g"), F.col(item).alias("i"), s.alias("s"))
        .groupBy("g", "i").agg(F.max("s").alias("s")).select("g", "i", _bits(F.col("s")).alias("s"))
    )
    rows = cut(rows)
    sizes = cut(rows.groupBy("g").agg(F.count("*").alias("size"), F.shiftright(F.min("s"), 32).alias("lo"), F.shiftright(F.max("s"), 32).alias("hi")))
    sizes = sizes.withColumn("salts", F.ceil(F.col("size") / ROWS_PER_SALT).cast("int"))
    # At most one group for every ROWS_PER_SALT rows; broadcast only while they are few.
    hot = sizes.where("salts > 1").select("g", "salts")
    few = hot.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    open_ = rows.join(F.broadcast(hot) if few else hot, "g", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("i"), "salts"), F.lit(0)).cast("int")).drop("salts")
    salted = lambda t: t.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    state = sizes.select("g", "salts", (F.col("size") <= n).alias("whole"), F.lit(0).alias("level"), F.lit(n).cast("long").alias("need"), "lo", "hi")
    chosen = None

    while True:
        x = open_.join(salted(state), ["g", "salt"])
        x = x.withColumn("code", _code(F.col("level"), F.col("s"), F.col("i")))
        # Groups that are chosen whole need no counting: all of them lie in one interval.
        span = F.when(~F.col("whole") & (F.col("hi") > F.col("lo")), F.col("hi") - F.col("lo"))
        x = x.withColumn("bin", F.coalesce(F.floor((F.col("code") - F.col("lo")) * (BINS - 1) / span), F.lit(0)).cast("int"))
        x = cut(x.select("g", "salt", "i", "s", "salts", "whole", "level", "need", "code", "bin"))
        bins = x.groupBy("g", "bin").agg(F.count("*").alias("c"), F.min("code").alias("lo"), F.max("code").alias("hi"), *[F.first(c).alias(c) for c in ("salts", "whole", "level", "need")])
        w = Window.partitionBy("g").orderBy(F.col("bin").desc())
        bins = bins.withColumn("through", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        # The interval in which the cutoff lies: the first to reach what is needed.
        reached = (F.col("through") >= F.col("need")) & (F.col("through") - F.col("c") < F.col("need"))
        at = cut(bins.where(F.col("whole") | reached).select(
            "g", "salts", F.col("bin").alias("at"), "lo", "hi", "level", (F.col("need") - F.col("through") + F.col("c")).alias("need"), (F.col("whole") | (F.col("through") == F.col("need"))).alias("closed"),
        ))
        y = x.select("g", "salt", "i", "s", "bin").join(salted(at.select("g", "at", "closed", "salts")).drop("salts"), ["g", "salt"])
        kept = y.where((F.col("bin") > F.col("at")) | (F.col("closed") & (F.col("bin") == F.col("at")))).select("g", "i", "s")
        chosen = kept if chosen is None else chosen.unionByName(kept)
        # The range of the next level is not known yet: all of a half, or of six bytes or lengths, covers it.
        over = F.col("lo") == F.col("hi")
        state = at.where(~F.col("closed")).select(
            "g", "salts", F.lit(False).alias("whole"), F.when(over, F.col("level") + 1).otherwise(F.col("level")).alias("level"), "need",
            F.when(over, F.when(F.col("level") == 0, F.lit(0).cast("long")).otherwise(F.lit(-(2**48)))).otherwise(F.col("lo")).alias("lo"),
            F.when(over, F.when(F.col("level") == 0, F.lit(_LOW)).otherwise(F.lit(0).cast("long"))).otherwise(F.col("hi")).alias("hi"),
        )
        if state.isEmpty():
            break
        open_ = y.where((F.col("bin") == F.col("at")) & ~F.col("closed")).select("g", "salt", "i", "s")
    # At most n rows of a group are left, so ordering them is bounded.
    rank = F.row_number().over(Window.partitionBy("g").orderBy(F.col("s").desc(), F.col("i")))
    return chosen.select(F.col("g").alias(group), rank.alias("top_rank"), F.col("i").alias(item))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best chunks of every query of the dense run."""
    return top_n(table(spark, sf_dir, "retrieval_results"), "query_id", "retrieved_chunk_id", "score", 10)


P5_SQL = """
WITH best AS (
  SELECT query_id, retrieved_chunk_id, max(score) AS score FROM retrieval_results
  WHERE query_id IS NOT NULL AND retrieved_chunk_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)
  GROUP BY ALL),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, retrieved_chunk_id) AS INTEGER) AS top_rank, retrieved_chunk_id FROM best)
SELECT query_id, top_rank, retrieved_chunk_id FROM ranked WHERE top_rank <= 10
"""
