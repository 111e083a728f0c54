"""rivulet: declarative data-flow operators on Spark.

Every operator is a function ``DataFrame -> DataFrame`` (or a dict of
DataFrames for routing) so that planning, optimisation and parallel
execution stay with Spark's optimizer and scheduler.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# functions of this package travel to Python workers by value (no install needed there)
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

from rivulet.session import get_spark, shared_dir, scratch_path  # noqa: E402

__all__ = ["get_spark", "shared_dir", "scratch_path"]
