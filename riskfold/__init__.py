"""riskfold: fraud-feature fitting, applying and model evaluation as Spark jobs.

Layout
  sources/    scans, sinks, the fixture views derived from the driver tables
  functions/  column expressions (time, amount, null-flag, ratio features)
  operators/  reusable DataFrame operators (lookups, splits, order statistics,
              prefix sums, encoders, validation, metrics, profiling, Spark ML)
  plans/      composed jobs (base build, feature fit/apply, prep, evaluation)
  streaming/  the same apply functions over Structured Streaming
"""

__version__ = "0.1.0"
