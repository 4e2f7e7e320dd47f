"""DuckDB statements that recompute each registered query from the driver tables."""

from oracle.base import ORACLE
import oracle.intervals  # noqa: E402,F401
import oracle.sequences  # noqa: E402,F401
import oracle.frames  # noqa: E402,F401
import oracle.replies  # noqa: E402,F401
import oracle.store  # noqa: E402,F401
import oracle.sources  # noqa: E402,F401
import oracle.streams  # noqa: E402,F401
