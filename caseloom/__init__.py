"""caseloom: case-log analytics as Spark DataFrame operators.

Every public function takes DataFrames (and plain Python parameters) and
returns a DataFrame or a Column.  Nothing is collected to the driver except
bounded scalars (partition counts, size checks).
"""

__version__ = "0.1.0"
