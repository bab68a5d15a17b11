"""Analytics over streams of short public posts, as plain Spark DataFrames."""

from postpulse.session import build_session, shared_dir

__all__ = ["build_session", "shared_dir"]
