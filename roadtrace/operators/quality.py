"""Data-quality operators: validation, conflicts, nationality repair, reports.

Skew notes (one key may hold a third of all rows):

* every aggregation here is decomposable, so Spark combines map-side before
  the shuffle; the distinct-plate count plans a first exchange on
  ``(gate, lane, ts, plate)``, which spreads a hot instant over its plates;
* ``collect_set`` of nationalities is bounded by the nationality domain, not
  by the number of sightings, and merges map-side as well;
* the joins back to the sightings are shuffle joins; AQE's skew-join rule
  splits an oversized partition of the sightings side.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadtrace.functions.time import year_month

CONFLICT_KEYS = ["gate", "lane", "ts"]
UNKNOWN = "?"          # fixed value: nationality meaning "unknown"
MAX_NAT_LEN = 3        # fixed value: longest valid nationality code


# --------------------------------------------------------------- predicates
def valid_sightings(df: DataFrame, max_len: int = MAX_NAT_LEN) -> DataFrame:
    """Keep rows whose nationality is present and at most ``max_len`` chars."""
    nat = F.col("nationality")
    return df.filter(nat.isNotNull() & (F.length(nat) <= max_len))


def any_null(cols: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols])


def null_rows(df: DataFrame) -> DataFrame:
    """Rows with a null in any column."""
    return df.filter(any_null(df.columns))


def drop_null_rows(df: DataFrame) -> DataFrame:
    """Rows without nulls (``na.drop``)."""
    return df.na.drop()


# --------------------------------------------------------------- conflicts
def spatial_conflicts(df: DataFrame) -> DataFrame:
    """A1: ``(gate, lane, ts)`` instants read with more than one distinct plate."""
    return (df.groupBy(*CONFLICT_KEYS)
            .agg(F.count_distinct("plate").alias("plates"))
            .filter(F.col("plates") > 1))


def conflict_keys(df: DataFrame) -> DataFrame:
    """Keys of the A1 conflicts without counting plates.

    ``count(DISTINCT plate) > 1`` holds exactly when the smallest and the
    largest non-null plate differ, which needs two fixed-size partial
    aggregates instead of a distinct aggregation.
    """
    return (df.groupBy(*CONFLICT_KEYS)
            .agg(F.min("plate").alias("_lo"), F.max("plate").alias("_hi"))
            .filter(F.col("_lo") < F.col("_hi"))
            .select(*CONFLICT_KEYS))


def remove_conflicts(df: DataFrame, conflicts: DataFrame | None = None,
                     dedupe: bool = True) -> DataFrame:
    """``df EXCEPT (df LEFT SEMI JOIN conflicts)``.

    Written as one anti join.  Rows with a null key never match and are kept,
    as in the set difference.  ``dedupe`` adds the set semantics of EXCEPT;
    callers whose input is already a set (ingest de-duplicates) pass False
    and save a shuffle.
    """
    keys = conflict_keys(df) if conflicts is None else conflicts.select(*CONFLICT_KEYS)
    out = df.join(keys, CONFLICT_KEYS, "left_anti")
    return out.distinct() if dedupe else out


def conflicts_by_month(conflicts: DataFrame) -> DataFrame:
    """A10: number of conflicting instants per ``yyyy-MM``."""
    return (conflicts.groupBy(year_month("ts").alias("yearMonth"))
            .agg(F.count(F.lit(1)).alias("count")))


def top_conflicts(conflicts: DataFrame, n: int = 10) -> DataFrame:
    """O1: the ``n`` conflicts with most plates (ties by key, deterministic)."""
    return conflicts.orderBy(F.desc("plates"), *CONFLICT_KEYS).limit(n)


# ------------------------------------------------------------ nationalities
def nationality_counts(df: DataFrame) -> DataFrame:
    """A3: sightings per nationality."""
    return df.groupBy("nationality").agg(F.count(F.lit(1)).alias("count"))


def multinat_plates(df: DataFrame) -> DataFrame:
    """A2: plates seen with more than one nationality.

    ``nats`` is the sorted set; ``num_nat`` its size (equal to the distinct
    count: both ignore nulls), computed in a single map-side-combined aggregate.
    """
    return (df.groupBy("plate")
            .agg(F.sort_array(F.collect_set("nationality")).alias("nats"))
            .withColumn("num_nat", F.size("nats").cast("long"))
            .filter(F.col("num_nat") > 1))


def fixable_multinat(multinat: DataFrame) -> DataFrame:
    """Plates with exactly two nationalities, one of them unknown.

    ``real_nat`` is the known one.  (Taking the second element of the sorted
    pair gives the same value as long as ``?`` sorts first, which it does for
    letter codes; picking the non-``?`` element does not rely on it.)
    """
    nats = F.col("nats")
    return (multinat
            .filter((F.col("num_nat") == 2) & F.array_contains(nats, UNKNOWN))
            .select("plate",
                    F.get(F.filter(nats, lambda x: x != F.lit(UNKNOWN)), 0).alias("real_nat")))


def fix_nationality(df: DataFrame, fixable: DataFrame) -> DataFrame:
    """Replace the nationality of fixable plates by their known one."""
    cols = df.columns
    joined = df.join(fixable.select("plate", "real_nat"), "plate", "left")
    return joined.select(*[F.coalesce("real_nat", "nationality").alias(c) if c == "nationality"
                           else F.col(c) for c in cols])


def multinat_by_num(multinat: DataFrame) -> DataFrame:
    """Multi-nationality plates per number of nationalities."""
    return multinat.groupBy("num_nat").agg(F.count(F.lit(1)).alias("count"))


def multinat_by_set(multinat: DataFrame, as_text: bool = True) -> DataFrame:
    """Multi-nationality plates per nationality set.

    Groups by the sorted array; ``as_text`` renders the set as ``?,HR,I``.
    """
    key = F.array_join("nats", ",").alias("nats") if as_text else F.col("nats")
    return multinat.groupBy(key).agg(F.count(F.lit(1)).alias("count"))


def top_multinat(multinat: DataFrame, n: int = 10) -> DataFrame:
    """O2: the ``n`` plates with most nationalities (ties by plate)."""
    return multinat.orderBy(F.desc("num_nat"), "plate").limit(n)


def fixable_count(multinat: DataFrame) -> DataFrame:
    """Number of fixable plates, as a one-row frame."""
    return fixable_multinat(multinat).agg(F.count(F.lit(1)).alias("fixable"))


def unknown_before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """Unknown nationalities before and after the repair, out of the total."""
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.lit(name).alias("stage"),
                      F.count_if(F.col("nationality") == UNKNOWN).alias("unknown"),
                      F.count(F.lit(1)).alias("total"))
    return side(before, "before").unionByName(side(after, "after"))


# ------------------------------------------------------------- dimensions
def unmapped_gates(sightings: DataFrame, gates: DataFrame) -> DataFrame:
    """Gates read in the sightings but absent from the map."""
    seen = sightings.select("gate").distinct()
    return seen.join(gates.select(F.col("gateid").alias("gate")), "gate", "left_anti")


def stage_counts(stages: dict[str, DataFrame]) -> DataFrame:
    """Rows and plates of each stage, by name."""
    return reduce(DataFrame.unionByName, [
        df.agg(F.lit(name).alias("stage"), F.count(F.lit(1)).alias("rows"), F.count_distinct("plate").alias("plates"))
        for name, df in stages.items()])


def plate_day_counts(df: DataFrame, month: int | None = None, max_count: int | None = None,
                     plate: int | None = None) -> DataFrame:
    """Sightings per (plate, day of month); ``month``, ``plate`` and ``count <= max_count`` on request."""
    if plate is not None:
        df = df.filter(F.col("plate") == plate)
    if month is not None:
        df = df.filter(F.month("ts") == month)
    out = (df.groupBy("plate", F.dayofmonth("ts").alias("day"))
           .agg(F.count(F.lit(1)).alias("count")))
    if max_count is not None:
        out = out.filter(F.col("count") <= max_count)
    return out


def plate_trace(df: DataFrame, plate: DataFrame | int) -> DataFrame:
    """One plate's sightings in time order.

    ``plate`` is an id or a one-column frame holding the plate(s) to trace
    (then applied as a semi join, no driver round trip).
    """
    if isinstance(plate, int):
        picked = df.filter(F.col("plate") == plate)
    else:
        picked = df.join(plate.select("plate"), "plate", "left_semi")
    return picked.orderBy("plate", "ts", "gate", "lane", "nationality")


def busiest_plate(df: DataFrame) -> DataFrame:
    """The plate with most sightings (ties: smallest id) as a one-row frame."""
    counts = df.groupBy("plate").agg(F.count(F.lit(1)).alias("_n"))
    return counts.orderBy(F.desc("_n"), "plate").limit(1).select("plate")
