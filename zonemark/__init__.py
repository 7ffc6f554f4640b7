"""zonemark: postal codes as order-preserving integer columns, on Spark."""

__version__ = "0.2.0"
