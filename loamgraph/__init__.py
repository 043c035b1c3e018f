"""loamgraph: an ordered change-log store and a property graph as Spark plans.

Every operator takes and returns DataFrames.  Nothing here holds a whole table
in one process; state that has to outlive a plan is written as Parquet below the
folder that ``spark.checkpoint.dir`` names.
"""

__version__ = "0.1.0"
