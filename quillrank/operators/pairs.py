"""Organizations held against opportunities.

The organizations are a stated set of profiles. They are broadcast in blocks of at most MOST rows, each with all opportunities, so the large side is neither
shuffled nor multiplied by more than the set's own size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST = 1000
CLASSES = ("nonprofit", "small_business", "university", "government", "tribal", "research_institution", "contractor", "international_ngo", "other")
MOST_WORDS = 2000


def spread(rows: DataFrame) -> DataFrame:
    """Rows that one default split per core would hold, dealt over all cores: a small file may be a single piece, and what is derived from it and paired would stay there. Larger tables stay as they are read."""
    spark = rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(cores) if size < cores * (128 << 20) else rows


def said_by(orgs: DataFrame, column: str) -> list[str] | None:
    """The distinct words of all organizations' lists; None if there are more than MOST_WORDS."""
    rows = orgs.select(F.explode(column).alias("w")).where("w is not null").distinct().limit(MOST_WORDS + 1).collect()
    return sorted(r["w"] for r in rows) if len(rows) <= MOST_WORDS else None


def only(words: str, known: list[str] | None) -> Column:
    """The words of a list that some organization says, repeated ones included: the others can't match any. All of them where the organizations say too many."""
    return F.filter(words, lambda t: t.isin(known)) if known is not None else F.col(words)


def prefixed(orgs: DataFrame) -> DataFrame:
    """The organizations as a pair has them: their columns get the prefix `org_`."""
    return orgs.select(*[F.col(c).alias(c if c.startswith("org_") else f"org_{c}") for c in orgs.columns])


def pair_up(opps: DataFrame, orgs: DataFrame) -> DataFrame:
    """Every opportunity with every organization, whose columns get the prefix `org_`."""
    named = prefixed(orgs)
    n = named.count()
    if n <= MOST:
        return opps.crossJoin(F.broadcast(named))
    blocks = -(-n // MOST)
    parts = [named.where(F.pmod(F.xxhash64("org_id"), F.lit(blocks)) == i) for i in range(blocks)]
    return reduce(DataFrame.unionByName, [opps.crossJoin(F.broadcast(p)) for p in parts])
