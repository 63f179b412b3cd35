"""Guards that fail the job instead of producing empty or wrong rows."""

import pytest

from tidemark.sources.artifacts import check_model_shape
from tidemark.sources.dictionary import driver_dictionary, with_driver_info


def test_unknown_driver_fails(spark):
    ok = spark.createDataFrame([("price",)], "driver string")
    assert with_driver_info(ok, driver_dictionary(spark)).first().business_name
    bad = spark.createDataFrame([("no_such_driver",)], "driver string")
    with pytest.raises(Exception, match="unknown driver"):
        with_driver_info(bad, driver_dictionary(spark)).collect()


def test_model_shape_mismatch_fails(spark):
    m = spark.createDataFrame([(1, [0.1] * 6, 0.0, 6)], "days_ahead int, weights array<double>, intercept double, dim int")
    assert check_model_shape(m, 6).count() == 1
    with pytest.raises(Exception, match="does not match"):
        check_model_shape(m, 8).collect()



def test_empty_model_set_fails(spark):
    none = spark.createDataFrame([], "days_ahead int, weights array<double>, intercept double, dim int")
    with pytest.raises(Exception, match="no model"):
        check_model_shape(none, 6).collect()


def test_cluster_needs_a_shared_folder():
    from tidemark.session import checkpoint_dir

    class Cluster:
        """A session whose master is no local one and that names no folder."""
        master = "spark://host:1"
        conf = sparkContext = property(lambda self: self)

        def get(self, *a):
            return None

        def getConf(self):
            return self

    with pytest.raises(ValueError, match="shared folder"):
        checkpoint_dir(Cluster())
