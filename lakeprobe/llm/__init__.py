"""Operators of a training-data pipeline, and their queries (``queries.py``).

The functions that run inside Python tasks are sent to the executors by value, so
the package has to be installed on the driver only.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
