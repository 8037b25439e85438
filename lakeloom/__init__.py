"""lakeloom: Spark DataFrame operators for lake-catalog, document and job-history data.

Modules: ``functions`` (Column functions), ``operators`` (DataFrame operators),
``sources`` (readers and writers), ``streaming`` (Structured Streaming
operators with batch twins), ``plans`` (composite jobs and registered queries).
``session`` holds the session settings the operators expect.
"""

__version__ = "0.1.0"
