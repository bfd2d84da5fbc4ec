"""Message screening and hybrid retrieval as composable PySpark DataFrame transforms."""

__version__ = "0.1.0"
