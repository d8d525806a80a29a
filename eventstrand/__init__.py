"""Event-sequence analytics as Spark DataFrame operators."""

from eventstrand.session import configure, materialise, shared_dir

__all__ = ["configure", "materialise", "shared_dir"]
