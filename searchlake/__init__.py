"""searchlake: a PySpark-native search-analytics engine."""

from searchlake.session import get_session, load

__all__ = ["get_session", "load"]
