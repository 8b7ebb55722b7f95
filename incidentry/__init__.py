"""incidentry: event-coding analytics as Spark jobs.

DataFrame in, DataFrame out: ingest of incident pages, recodes of hand-coded
tables, place-name matching, parsing of model output, evaluation and reporting.
"""

import sys

from pyspark import cloudpickle

from incidentry.session import build_session, durable, maybe_broadcast

# The few Python functions travel with the tasks, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session", "durable", "maybe_broadcast"]
