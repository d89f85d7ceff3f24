"""Schemas of the catalogue's tables, and a gate for stage boundaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_D = "host string, full_name string, description string, language string, topics array<string>, stars int, stars_90d int, forks int, open_issues int"
TABLES: dict[str, str] = {
    "repo": f"id bigint, {_D}, pushed_at timestamp, created_at timestamp, license string, is_fork boolean, is_archived boolean, criticality double, readme_raw string, clean_text string, embedding_input string, low_signal boolean, non_english boolean, clean_reduction double, dropped_sections array<string>, content_hash string, fetched_at timestamp",
    "package": "ecosystem string, name string, repo_id bigint",
    "edge": "src bigint, dst bigint, kind int, weight double, ppmi double, observations int",
    "star_event": "actor string, repo_id bigint, starred_at date",
    "relatedness": "repo_id bigint, depends_on_n int, dependents_n int, used_with_n int, similar_n int, rank double",
    "cluster": "id int, label string, domain int, size bigint, centroid array<double>, theta double, phi double, top_languages array<string>, top_topics array<string>",
    "score": "repo_id bigint, source int, maintenance double, production_readiness double, specificity double, learning_value double, onboarding_ease double, canonicity double, summary string, flags array<string>, scored_hash string, model string, scored_at timestamp",
    "star_scale": "thresholds array<bigint>, counts array<bigint>, total_repos bigint, repaired int, measured_at timestamp",
    "global_rank": "repo_id bigint, score double, star_rank bigint, star_percentile double, components string, scale_id bigint, computed_at timestamp",
    "ingest_state": "shard string, cursor string, rows_seen bigint, completed boolean",
}


class SchemaDrift(ValueError):
    """A table lacks columns that a stage reads, or has them in another type."""


def assert_schema(df: DataFrame, expected: T.StructType | str) -> DataFrame:
    """Return ``df`` if it has all expected columns in types that widen to the expected ones, else raise ``SchemaDrift``."""
    expected = T.StructType.fromDDL(expected) if isinstance(expected, str) else expected
    have = {f.name: f.dataType for f in df.schema}
    missing = [f.name for f in expected if f.name not in have]
    widths = ["tinyint", "smallint", "int", "bigint", "float", "double"]

    def fits(a: T.DataType, b: T.DataType) -> bool:
        x, y = a.simpleString().replace("_ntz", ""), b.simpleString()
        return x == y or (x in widths and y in widths and widths.index(x) <= widths.index(y))

    wrong = [f.name for f in expected if f.name in have and not fits(have[f.name], f.dataType)]
    if missing or wrong:
        raise SchemaDrift(f"missing columns: {missing}; other types: {wrong}")
    return df
