"""lexigrid: document retrieval, question answering and text analytics on Spark."""

__version__ = "0.1.0"
