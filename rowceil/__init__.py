"""Row ceilings: guaranteed upper bounds on join sizes, approximate answers, and planning with both, on Spark."""

__version__ = "0.1.0"
