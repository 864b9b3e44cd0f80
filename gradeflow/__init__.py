"""gradeflow: evaluate and label datasets with generative models on Spark.

Every operator is a function from DataFrame(s) to DataFrame.  Scalar rules are
native Column expressions; Python runs only where an external model, embedder
or byte decoder is called, and then in Arrow batches.
"""

__version__ = "0.1.0"
