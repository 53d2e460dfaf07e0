"""marlstone: claim-graph, rule and prose analytics expressed as Spark plans."""

__version__ = "0.1.0"
