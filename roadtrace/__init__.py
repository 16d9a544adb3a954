"""roadtrace: sightings analytics on Spark.

Batch analytics for timestamped sightings of vehicles at the gates of a
road network: ingest, cleaning, network closure, trip sessionization,
gate-to-gate segments, per-vehicle features and clustering.  Every operator
is a plain ``DataFrame -> DataFrame`` function built from Spark's own joins,
windows and aggregates; no Python UDF runs in a hot path.
"""

from roadtrace.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
