"""End-to-end runs, as the original's two entry points.

* ``run_closure``: arcs CSV -> network closure -> one CSV report (G1, G3).
* ``run_analysis``: raw sightings CSV + map CSVs -> cleaning -> trips ->
  features -> vectors -> clustering sweep -> anomalies per (algo, k), written
  as Parquet plus a CSV report without vectors (S6), the sweep's elbow/fit
  data, the arc-frequency report (A4), the stage tables and the quality
  report (counts per stage, nationalities, conflicts by month).

Everything between the inputs and the sinks is the same lazy pipeline the
registered queries use; the outputs go under ``out_dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from roadtrace.operators import clustering as cl
from roadtrace.operators import network as net
from roadtrace.operators import segments as segm
from roadtrace.operators import trips as tr
from roadtrace.plans.pipeline import Pipeline
from roadtrace.sources.files import read_sightings_csv
from roadtrace.sources.network import read_arcs_csv, read_gates_csv
from roadtrace.sources.stages import save_report_csv


def run_closure(spark: SparkSession, arcs_csv: str, out_csv: str) -> DataFrame:
    closure = net.arc_closure(read_arcs_csv(spark, arcs_csv))
    net.export_closure(closure, out_csv)
    return closure


def run_analysis(spark: SparkSession, sightings_csv: str, gates_csv: str, arcs_csv: str,
                 out_dir: str, algo: str = "gmm", ks: list[int] | None = None,
                 policy: str = "as_coded", cut_minutes: int = tr.CUT_MINUTES,
                 model_dir: str | None = None) -> dict[str, str]:
    """Run the whole analysis; returns the output paths by name.

    The stages (raw, conflicts, multinat, fixed, windowed, plate features,
    vectorized) are Parquet tables under ``out_dir``, each written once and
    read by everything after it, so the sightings file is parsed once.
    """
    out = out_dir.rstrip("/")
    network = net.build_network(read_gates_csv(spark, gates_csv), read_arcs_csv(spark, arcs_csv))
    pipe = Pipeline(spark, raw=read_sightings_csv(spark, sightings_csv, distinct=False), network=network,
                    policy=policy, cut_minutes=cut_minutes, materialize_stages=True, stage_dir=out)
    paths = {"arc_frequency": f"{out}/arcs_{cut_minutes}m",
             "sweep": f"{out}/{algo}_sweep"}
    for name, report in pipe.quality_report().items():
        # one row per stage, nationality (set), number of nationalities or month
        paths[name] = f"{out}/report_{name}"
        save_report_csv(report, paths[name])
    save_report_csv(segm.arc_frequency(pipe.segments, network.oriented), paths["arc_frequency"])
    vectors = pipe.vectorized   # the fits iterate over this table
    for name in ("raw", "conflicts", "multinat", "fixed", "windowed"):
        paths[name] = f"{out}/{name}.parquet"
    paths["plate_features"] = f"{out}/plate_features_{policy}.parquet"
    paths["vectorized"] = f"{out}/vectorized_{policy}.parquet"

    models, sweep = cl.cluster_sweep(vectors, algo, ks, model_dir=model_dir)
    save_report_csv(sweep, paths["sweep"])
    for k, model in models:
        anoms = cl.anomalies(model.transform(vectors))
        base = f"{out}/anomalies_{algo}_{k}"
        cl.save_anomalies(anoms, f"{base}.parquet", f"{base}_csv")
        paths[f"anomalies_{k}"] = f"{base}.parquet"
    return paths
