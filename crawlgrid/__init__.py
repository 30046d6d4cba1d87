"""crawlgrid: set-based DataFrame operators over crawl-fleet operations data.

Every operator is a pure function from DataFrames to DataFrames. Time is
always an explicit ``as_of`` argument; nothing reads the wall clock.
"""

from crawlgrid.session import get_spark, prepare_session, scratch_dir

__all__ = ["get_spark", "prepare_session", "scratch_dir"]
