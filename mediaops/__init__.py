"""Media library operations as Spark DataFrame transformations.

Every public operator is a plain function that takes DataFrames (or Columns)
and returns a DataFrame (or a Column), so it composes with ordinary Spark SQL.

* ``functions``  - Column expressions: paths, codecs, presets, probe text, progress
* ``sources``    - inventory, probe text, programs, the append-only ledger
* ``operators``  - rules, planning, settings, capability, runs, history
* ``plans``      - compositions of operators into whole library and program runs
* ``streaming``  - watching a library and following job state continuously
"""

import sys

from pyspark import cloudpickle

# The few functions that run inside Python tasks travel with the plan, so the
# executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
