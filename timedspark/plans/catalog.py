"""Importing this module registers every query."""

from timedspark.plans import interval_queries  # noqa: F401
from timedspark.plans import sequence_queries  # noqa: F401
from timedspark.plans import frame_queries  # noqa: F401
from timedspark.plans import reply_queries  # noqa: F401
from timedspark.plans import store_queries  # noqa: F401
from timedspark.plans import source_queries  # noqa: F401
from timedspark.plans import stream_queries  # noqa: F401
