"""Assessment-score analytics as Spark batch jobs."""

from gradeweave.plans.report_job import JobOptions, run
from gradeweave.plans.validate import validate_scores

__all__ = ["JobOptions", "run", "validate_scores"]
