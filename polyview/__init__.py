"""polyview: multi-expert text classification as Spark jobs.

Corpora become one schema, each expert sees its own view of a row, experts are
weighted by how sure they are, and their log-probabilities are fused into one
prediction.  Every operator takes DataFrames or Columns and returns the same.
"""

import sys

from pyspark import cloudpickle

# Executors need no copy of this package: its few Python functions travel with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
