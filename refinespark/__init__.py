"""refinespark: dense retrieval and retrieve-and-refine data sets on Spark."""

from .session import get_session, shared_dir

__version__ = "0.1.0"
__all__ = ["get_session", "shared_dir"]
