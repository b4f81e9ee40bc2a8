"""wirefold: text-intelligence jobs for news-like records on Spark DataFrames."""

from wirefold.session import build_session

__all__ = ["build_session"]
