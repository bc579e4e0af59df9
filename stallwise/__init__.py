"""Mall sales and footfall analytics as plain PySpark DataFrame operators."""

from stallwise.session import checkpointed, prepare

__all__ = ["checkpointed", "prepare"]
