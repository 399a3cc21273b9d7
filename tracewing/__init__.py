"""Air-cargo milestone analytics as Spark jobs.

Every public function takes and returns DataFrames or Columns; nothing here
holds a global session.  See README.md for the map of operators.
"""

__version__ = "0.1.0"
