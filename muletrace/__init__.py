"""muletrace: money-flow investigation on Spark DataFrames.

Every public function takes DataFrames and returns DataFrames; nothing here collects data to the driver
except single control values (iteration counts, validation totals).
"""

__version__ = "0.1.0"
