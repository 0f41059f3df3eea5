"""Queries over the test tables, each next to the SQL it must agree with."""


def all_entries():
    from salmoura.checks import (  # noqa: F401
        cleaning_queries,
        job_queries,
        model_queries,
        platform_queries,
        raw_files,
        registry,
    )

    return registry.ENTRIES
