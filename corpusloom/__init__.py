"""Spark jobs for preparing, searching and evaluating text and source-code corpora."""

import sys

from pyspark import cloudpickle

from corpusloom.session import build_session, scratch_path

# Functions and stream processors of the package travel to Python workers by value, so a session
# works without --py-files, also in the workers that plan a stream next to the driver.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session", "scratch_path"]
