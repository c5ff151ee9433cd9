"""riskweave — credit-risk analytics as Spark DataFrame jobs.

Layers (clean -> features -> rule segments -> portfolio roll-ups), data
profiling, PD model training/evaluation with Spark ML and bulk applicant
scoring, each a lazy DataFrame transformation.
"""

__version__ = "0.1.0"
