"""Directory in, cleaned table and documents out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..config import DEFAULT, Config
from ..operators.rows import with_row_id
from ..session import write_table
from ..sources.files import FILE_TYPES, LoadedTables, combine, infer_types, load_directory
from ..sources.sinks import save
from .cleaning import CleanResult, analyze, clean


def _stored(loaded: LoadedTables):
    """All files as one Parquet table with fixed row ids, typed afterwards.

    Text is parsed once; type inference and the workflow scan stored columns.
    """
    return infer_types(write_table(with_row_id(combine(loaded.frames()))))


def _load(spark: SparkSession, directory: str, file_types, multi_line) -> tuple[LoadedTables, DataFrame | None]:
    loaded = load_directory(spark, directory, file_types, infer=False, multi_line=multi_line)
    if not loaded.tables:
        raise ValueError(f"no readable files in {directory}: {loaded.failures}")
    rejected = loaded.quarantine()
    return loaded, None if rejected is None else write_table(rejected)


def clean_directory(spark: SparkSession, directory: str, output: str | None = None,
                    config: Config = DEFAULT, file_types=FILE_TYPES, as_of=None,
                    formats=("csv",), multi_line: bool | None = None) -> CleanResult:
    """Load every file, combine them, clean the whole and save the results.

    Files that could not be read and lines that did not fit are counted in the
    summary and saved beside the result.
    """
    loaded, rejected = _load(spark, directory, file_types, multi_line)
    result = clean(_stored(loaded), config, as_of=as_of, files=loaded.n_files, failures=loaded.failures, rejected=rejected)
    if output is not None:
        save(result, output, formats)
    return result


def analyze_directory(spark: SparkSession, directory: str, config: Config = DEFAULT,
                      file_types=FILE_TYPES, as_of=None, multi_line: bool | None = None):
    """Issues and report over all files of a directory; nothing is changed."""
    loaded, rejected = _load(spark, directory, file_types, multi_line)
    issues, report = analyze(_stored(loaded), config, as_of)
    lost = rejected.count() if rejected is not None else 0
    if loaded.failures or lost:
        report += "\n".join(["", "## Not loaded", *[f"- {p}: {e}" for p, e in loaded.failures], f"- rejected lines: {lost}", ""])
    return issues, report
