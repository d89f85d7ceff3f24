"""Command line: ``python -m stratlas.cli COMMAND FOLDER [--out PATH]`` over a folder of tables."""

from __future__ import annotations

import argparse
import sys

from stratlas.operators import planning
from stratlas.plans.catalogue import QUERIES
from stratlas.session import local_session, read

#: The query each command prints or writes.
COMMANDS = {
    "report": "quality_verdict", "languages": "top_languages", "stars": "star_distribution", "sample": "repo_detail", "clean": "cleaned_readmes", "embed": "needs_embedding",
    "project": "projected_vectors", "spotcheck": "expectation_checks", "cluster": "cluster_manifest", "communities": "communities", "edges": "mutual_pairs", "layers": "combined_layers",
    "rank": "pagerank", "calibrate": "composite_scores", "leaderboard": "leaderboard", "teach": "teaching_plan", "learn": "student_quality", "build": "tile_files", "graph-report": "edges_by_kind",
    "backfill-criticality": "criticality_dump", "coverage": "coverage", "incremental": "p4_found",
}


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="stratlas", description=__doc__)
    parser.add_argument("command", choices=[*sorted(COMMANDS), "status", "query"])
    parser.add_argument("folder")
    parser.add_argument("--name", help="the query to run with the command 'query'")
    parser.add_argument("--out", help="write Parquet there instead of printing")
    parser.add_argument("--rows", type=int, default=20)
    given = parser.parse_args(args)
    spark = local_session()
    if given.command == "status":
        repo, world, edge = (read(spark, given.folder, t) for t in ("repo", "world", "edge"))
        counts = {"repo": repo.count(), "clean": repo.where("length(clean_text) > 0").count(), "placed": world.where("theta is not null").count(), "clustered": world.where("cluster_id >= 0").count(), "edges": edge.count(), "ranked": world.where("rank > 0").count()}
        counts |= {"embedded": counts["clean"], "scored": read(spark, given.folder, "repo_signals").count()}
        print(counts, "next:", planning.next_step(counts))
        return 0
    name = given.name if given.command == "query" else COMMANDS[given.command]
    if name not in QUERIES:
        parser.error(f"no query {name!r}; there are: {', '.join(sorted(QUERIES))}")
    df = QUERIES[name](spark, given.folder)
    if given.out:
        df.write.mode("errorifexists").parquet(given.out)
    else:
        df.show(given.rows, 120)
    return 0


if __name__ == "__main__":
    sys.exit(main())
