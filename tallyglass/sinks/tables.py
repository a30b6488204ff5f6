"""The estate as Parquet, for other Spark jobs: one folder for each table."""

from __future__ import annotations

from ..plans.engine import Estate


def write(estate: Estate, folder: str, mode: str = "errorifexists") -> None:
    for name in ("metrics", "assets", "visuals", "references", "usage", "notes"):
        getattr(estate, name).write.mode(mode).parquet(f"{folder}/{name}")
    estate.decided().write.mode(mode).parquet(f"{folder}/findings")
