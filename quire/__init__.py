"""quire: Spark-native analytics over structured text collections.

``sources`` read and shape inputs, ``functions`` are pure column expressions,
``operators`` compose DataFrames, ``plans`` bind operators to tables as named
queries, ``streaming`` runs the same plans over file streams.
"""

__version__ = "0.1.0"
