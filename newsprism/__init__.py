"""newsprism: clickstream analytics for news exposure logs, on Spark.

Reports are plain ``DataFrame -> DataFrame`` functions (:mod:`newsprism.plans.reports`,
:mod:`newsprism.plans.querylog`, :mod:`newsprism.plans.bi`); ingestion lives in
:mod:`newsprism.sources`, :mod:`newsprism.operators` and :mod:`newsprism.sinks`; streaming
monitors in :mod:`newsprism.streaming`.
"""

from .session import get_session, shared_dir

__all__ = ["get_session", "shared_dir"]
__version__ = "0.1.0"
