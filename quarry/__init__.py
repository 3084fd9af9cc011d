"""quarry: search, browse and corpus preparation as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# functions sent to executors carry their code, so workers need no installed package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
