"""roadlog: vehicle-recording analytics written as Spark jobs.

Every operator is a function from DataFrame to DataFrame, keyed by entity columns
(`by`), a numeric event time (`t`) and tie-break columns (`tie`), so one job covers
all recordings.
"""

import sys

from pyspark import cloudpickle

# the few Python functions that run in tasks travel with the job, so executors need no installation
cloudpickle.register_pickle_by_value(sys.modules[__name__])
