"""nearline: Spark-native data engine for dense and lexical text retrieval.

All operators are lazy ``DataFrame -> DataFrame`` functions or ``Column``
helpers; nothing is collected to the driver except model-sized results
(centroids, a d x d matrix, per-partition counts).
"""

__version__ = "0.1.0"
