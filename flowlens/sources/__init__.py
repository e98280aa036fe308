"""Sources and sinks."""

from flowlens.sources.tables import read_table  # noqa: F401
