"""portfold: portfolio-snapshot analytics on Spark DataFrames.

Layers, lowest first:

* ``functions``  column expressions (text, numbers, dates)
* ``operators``  DataFrame -> DataFrame building blocks
* ``sources``    CSV scans and the month-partitioned store
* ``plans``      the composed tables: snapshot, report tables, pages
* ``catalog``    the registered queries over the shared test tables
"""
