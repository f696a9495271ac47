"""Operations of a training-data pipeline. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# functions that run on executors travel with the job: workers need not have this package on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])
