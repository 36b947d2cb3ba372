"""Loomery: curation and analytics of message corpora as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Python workers need no installed copy of this package: its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
