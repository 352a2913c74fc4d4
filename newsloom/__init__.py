"""newsloom: a news-intelligence pipeline written as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

from newsloom.config import Settings
from newsloom.tables import NewsTables

# Functions sent to Python workers travel with their code, so executors need no
# installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["NewsTables", "Settings"]
