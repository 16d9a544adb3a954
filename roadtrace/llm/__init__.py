"""Operations of a training-data pipeline (text quality, de-duplication, mixing ...).

Nothing else in the library imports this subpackage.
"""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to the executors by value: they need no copy of the package there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
