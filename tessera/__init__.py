"""tessera: tabular machine-learning analysis on Spark DataFrames.

Every operator is a function from DataFrames to DataFrames built on Spark SQL
expressions and Spark ML.  Sub-packages:

* ``sources``    - table, CSV, run-history and model readers / writers
* ``functions``  - column-expression helpers and the distributed prefix-sum primitive
* ``operators``  - profiling, correlation, feature preparation, splitting,
                   evaluation, distribution data and run-history queries
* ``plans``      - estimator catalogue, tuning and the end-to-end training plan
* ``streaming``  - applying a fitted preparation / model to a streaming DataFrame
"""

__version__ = "0.1.0"
