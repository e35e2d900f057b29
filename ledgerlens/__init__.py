"""Transaction auditing on Apache Spark: DataFrame in, DataFrame out."""

import sys

from pyspark import cloudpickle

# the few Python functions that run in tasks travel with the job, so executors need no installed copy
cloudpickle.register_pickle_by_value(sys.modules[__name__])
