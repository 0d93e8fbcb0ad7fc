"""Find and repair messy data in tables of any size, on Spark."""

from .config import Config, Rule
from .operators.profile import observe
from .plans.cleaning import (CleaningPlan, CleanResult, analyze, clean, decide, fix_broken_entries,
                             fix_column_names, fix_duplicates, fix_formats, fix_missing,
                             fix_text_consistency)
from .plans.decisions import identify
from .plans.validation import before_after, validate
from .session import build_session

__all__ = [
    "CleanResult", "CleaningPlan", "Config", "Rule", "analyze", "before_after", "build_session",
    "clean", "decide", "fix_broken_entries", "fix_column_names", "fix_duplicates",
    "fix_formats", "fix_missing", "fix_text_consistency", "identify", "observe", "validate",
]
