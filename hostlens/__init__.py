"""hostlens: Spark analytics for organism–host observation tables.

Subpackages: ``sources`` (scans and sinks), ``operators`` (table jobs),
``functions`` (column expressions), ``plans`` (registered queries with their
DuckDB oracle SQL), ``streaming`` (Structured Streaming jobs); ``api`` has
the tool-shaped entry points and ``session`` the engine session.
"""

__version__ = "0.1.0"
