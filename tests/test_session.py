"""Where intermediate tables go: the configured shared folder, per application."""

import pytest

from roadtrace.session import app_id, checkpoint_dir
from roadtrace.sources.stages import stage_path


def test_app_id_matches_context(spark):
    assert app_id(spark) == spark.sparkContext.applicationId


def test_checkpoint_dir_is_configured_folder_per_app(spark):
    d = checkpoint_dir(spark)
    assert d.endswith("/" + app_id(spark))
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if configured:
        assert d.startswith(configured.rstrip("/"))


def test_stage_paths_are_app_scoped_unless_reused(spark):
    scoped = stage_path(spark, "fixed", ("x",))
    shared = stage_path(spark, "fixed", ("x",), scope_to_app=False)
    assert app_id(spark) in scoped and app_id(spark) not in shared
    assert scoped.rsplit("/", 1)[1] == shared.rsplit("/", 1)[1]


class FakeSession:
    """A session with the given settings and no checkpoint folder set on its context."""

    def __init__(self, context_dir=None, **settings):
        values = {k.replace("_", "."): v for k, v in settings.items()} | {"spark.app.id": "app-1"}
        self.conf = type("Conf", (), {"get": staticmethod(lambda key, *default: values.get(key, *default))})
        self.sparkContext = type("Context", (), {"getCheckpointDir": staticmethod(lambda: context_dir)})


def test_a_cluster_without_a_shared_folder_is_an_error():
    with pytest.raises(RuntimeError):
        checkpoint_dir(FakeSession(spark_master="spark://host:7077"))
    assert checkpoint_dir(FakeSession(spark_master="local[2]")).endswith("/app-1")


def test_the_context_checkpoint_folder_counts():
    s = FakeSession(context_dir="hdfs://store/ckpt/some-uuid", spark_master="yarn")
    assert checkpoint_dir(s) == "hdfs://store/ckpt/app-1"
    s = FakeSession(context_dir="hdfs://x/y", spark_master="yarn", spark_checkpoint_dir="s3://shared/")
    assert checkpoint_dir(s) == "s3://shared/app-1"
