"""Siltstone: document retrieval and text analytics on Spark DataFrames.

Every operator takes DataFrames and returns DataFrames; nothing in the data
plane collects rows to the driver.
"""

__version__ = "0.1.0"
