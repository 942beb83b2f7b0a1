"""glossa: multilingual embedding analytics as Spark DataFrame jobs.

Sub-packages:

* ``sources``   - readers and writers (line files, TSV, JSON shapes, Parquet)
* ``functions`` - column expressions (text, prefixes, vectors, run names)
* ``operators`` - DataFrame -> DataFrame jobs (SAE, masks, retrieval, corpus, sweep)
* ``streaming`` - Structured Streaming forms of the SAE jobs
* ``plans``     - the query catalogue over the test tables and its SQL twins
"""

__version__ = "0.1.0"
