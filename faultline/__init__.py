"""faultline: tabular risk analytics on Spark DataFrames.

Feature-table preparation, scaling, density/centroid clustering,
cluster-quality and group-risk metrics, balanced classification with
stratified cross-validation, and feature-ranking comparison.
"""

__version__ = "0.1.0"
