"""brindle: a DataFrame-first analytics engine on public PySpark APIs."""

from brindle.session import get_session, load_tables

__all__ = ["get_session", "load_tables"]
