"""Training-data operators: cleaning, deduplication, scoring and mixing of text corpora.

Nothing else in the package imports this one. Functions that run on executors are pickled by
value, so executors need PySpark, numpy, pyarrow, xxhash and, for decontamination, ahocorasick,
but not this repository on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
