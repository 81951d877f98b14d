"""quillframe: everyday analysis of large tables, expressed as Spark jobs.

Every public operator takes a ``DataFrame`` and returns a ``DataFrame`` (or a few scalars that
are bounded by the number of columns).  Nothing that grows with the rows reaches the driver.
"""

__version__ = "0.1.0"
