"""Page-layout analytics and corpus preparation on Spark."""

from .api import EvaluateParams, ProjectParams, RepairParams, evaluate, project, repair, replace_original, replace_page, replace_text

__all__ = ["EvaluateParams", "ProjectParams", "RepairParams", "evaluate", "project", "repair", "replace_original", "replace_page", "replace_text"]
