"""lexspark: weighted string rewriting and statistical language models as Spark DataFrame plans."""

__version__ = "0.1.0"
