"""gridloom: table discovery, cleaning, validation and insight jobs as Spark DataFrames."""

from gridloom.session import cut_lineage, get_session, scratch_path
from gridloom.tables import table

__all__ = ["cut_lineage", "get_session", "scratch_path", "table"]
