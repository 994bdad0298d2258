"""ringside: knowledge-capture and event-report data work as Spark jobs."""

from ringside.session import build_session

__all__ = ["build_session"]
