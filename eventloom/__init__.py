"""eventloom: log-event datasets, rendering, routing and metrics as Spark DataFrame operators.

Every public function is either ``Column -> Column`` (a pure expression that stays
inside whole-stage codegen) or ``DataFrame -> DataFrame`` (a lazy plan that Catalyst
optimizes). Nothing collects rows to the driver; the only driver-side values are
small configuration literals (templates, weights, field specs) and size checks.
"""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel by value, so the executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
