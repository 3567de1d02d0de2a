"""postloom: corpus analytics, de-identification and evaluation of message text on Spark."""

__version__ = "0.1.0"
