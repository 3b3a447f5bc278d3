"""loomflow: a PySpark-native dataflow and job-history analytics engine.

Every operator is a function from DataFrames to a DataFrame; a dataflow is a
DataFrame plan and Catalyst picks the physical strategy.
"""

__version__ = "0.1.0"
