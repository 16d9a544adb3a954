"""Join helpers: broadcast only behind a proven size bound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadtrace.session import app_id

# Dimension tables of a road network are bounded by (#gates)^2 pairs; a
# highway system has at most a few thousand gates, so 4M rows is a generous
# ceiling for a dimension to ride in a broadcast.
DIM_BROADCAST_MAX_ROWS = 4_000_000


# Bounds by (application, plan hash); frames of one hash are told apart by their plans.
_BOUNDS: dict[tuple[str, int], list[tuple[DataFrame, int]]] = {}


def _bound(df: DataFrame) -> int | None:
    key = (app_id(df.sparkSession), df.semanticHash())
    return next((n for other, n in _BOUNDS.get(key, ()) if df.sameSemantics(other)), None)


def record_bound(df: DataFrame, max_rows_of_df: int) -> DataFrame:
    """Register a proven upper bound on ``df``'s rows (e.g. counted while the table it
    reads was written), so ``bounded_broadcast`` need not count it.  For rows that hold
    arrays the bound is on the arrays' elements."""
    key = (app_id(df.sparkSession), df.semanticHash())
    if _bound(df) is None:
        _BOUNDS.setdefault(key, []).append((df, max_rows_of_df))
    return df


def bounded_broadcast(df: DataFrame, max_rows: int = DIM_BROADCAST_MAX_ROWS,
                      known_rows: int | None = None) -> DataFrame:
    """Hint ``df`` for broadcast only when its row count is at most ``max_rows``.

    Meant for narrow rows (a few numbers and flags: 4M rows are some hundred MB).
    ``known_rows`` or a recorded bound answers at once; a frame without one is
    counted, once per application.  Above the bound the frame is returned unhinted
    and Spark plans a shuffle join (AQE may still switch to a broadcast at run time
    from real statistics).
    """
    if known_rows is None:
        known_rows = _bound(df)
    if known_rows is None:
        known_rows = df.count()
        record_bound(df, known_rows)
    return F.broadcast(df) if known_rows <= max_rows else df
