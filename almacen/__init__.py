"""almacen: a Spark-native retail warehouse.

Raw e-commerce invoice lines are profiled, cleaned and loaded into an
audited star schema (date, customer, product, geography, sales fact); a
fixed set of business questions runs on it as DataFrame plans.

Sub-packages: ``sources`` (feed, CSV scan, sinks), ``functions`` (column
expressions, fixed values), ``operators`` (stage, clean, profile, dims,
fact, audits, scale helpers), ``plans`` (the build and the queries),
``streaming`` (none: the source is a batch job).
"""

__version__ = "0.1.0"
