"""Access-log analytics on Spark: parsing, counts, top-K, summaries, windows, snapshots, reports, streams."""

from pyspark import cloudpickle

from loglark.operators import task_summaries
from loglark.sources import tail
from loglark.streaming import state

# Code that runs in the Python workers travels with the query, so executors need no copy of the package.
for _module in (task_summaries, tail, state):
    cloudpickle.register_pickle_by_value(_module)
