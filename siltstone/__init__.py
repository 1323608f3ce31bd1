"""siltstone: a Spark-first engine for network-flow signature mining, clustering and evaluation."""

__version__ = "0.1.0"
