"""sparkmend: machine-health tables on Spark.

Raw machine tables (telemetry, errors, failures, maintenance, machines) are
checked against declared contracts, merged into one row per machine and hour,
audited, turned into window features, scored and streamed, all with built-in
DataFrame, Window, ML and Structured Streaming operators.
"""

__version__ = "0.1.0"
