"""quillgrid: structured facts from recognised agreements, and corpus preparation, on Spark."""

__version__ = "0.1.0"
