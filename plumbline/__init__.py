"""Data quality on Spark: profile, detect, score, repair and track tables of any size."""

from .operators.fixes import Context, apply_fix
from .operators.rule import Rule, measure, samples, violations
from .operators.table import Table
from .plans.analysis import Analysis, analyze
from .plans.history import Store
from .plans.remediation import apply_all, apply_low_risk, remediate
from .sources.readers import read_file

__all__ = ["Analysis", "Context", "Rule", "Store", "Table", "analyze", "apply_all", "apply_fix",
           "apply_low_risk", "measure", "read_file", "remediate", "samples", "violations"]
