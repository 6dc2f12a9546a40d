"""Document-graph analytics on Spark: reports to sections, concepts, graphs and manifests."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the workers as values, so that these need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
