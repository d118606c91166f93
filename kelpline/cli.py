"""Command line: ``python -m kelpline.cli LAYER [options]`` with a layer of bronze, silver, snapshot,
gmv or quality; ``tables`` lists the tables, ``sql FILE`` runs a script, ``console`` opens a prompt with ``spark`` and ``store``."""

from __future__ import annotations

import argparse
import code
import uuid

from .plans import loads
from .plans.dates import FULL, INCREMENTAL, target_day
from .sources.csv_files import folder_loads
from .sources.scripts import run_script
from .sources.session import session
from .sources.staged import StagedStore


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="kelpline", description=__doc__)
    p.add_argument("layer", choices=["bronze", "silver", "snapshot", "gmv", "quality", "tables", "sql", "console"])
    p.add_argument("file", nargs="?", help="the script of sql")
    p.add_argument("--data-dir", default="data")
    p.add_argument("--warehouse")
    p.add_argument("--namespace", default="kelpline")
    p.add_argument("--mode", choices=[FULL, INCREMENTAL], default=FULL)
    p.add_argument("--process-date", help="the run's day; it publishes the day before")
    p.add_argument("--batch-id")
    p.add_argument("--ingestion-ts")
    p.add_argument("--snapshot-created-at")
    p.add_argument("--reset", action="store_true", help="full refresh, or empty ops tables first")
    return p


def main(argv: list[str] | None = None) -> int:
    """0, or 1 after publishing quality outputs of a failed run."""
    a = parser().parse_args(argv)
    mode = FULL if a.reset else a.mode
    day = target_day(a.process_date) if mode == INCREMENTAL else None
    store = StagedStore(session(warehouse=a.warehouse), a.namespace)
    if a.layer == "tables":
        print("\n".join(store.tables()))
        return 0
    if a.layer == "sql":
        for df in run_script(store.spark, a.file):
            if df.columns:
                df.show(50, truncate=False)
        return 0
    if a.layer == "console":
        store.spark.sql(f"CREATE DATABASE IF NOT EXISTS `{a.namespace}`")
        store.spark.catalog.setCurrentDatabase(a.namespace)
        code.interact(banner="\n".join(store.tables()), local={"spark": store.spark, "store": store}, exitmsg="")
        return 0
    if a.layer == "quality":
        store.prepare("ops", reset=a.reset)
        summary = loads.load_quality(store, str(uuid.uuid4()))
        print(summary)
        return int(summary.run_status == "failed")
    store.prepare(a.layer, reset=mode == FULL)
    if a.layer == "bronze" and mode == FULL:
        store.prepare("keys", reset=True)
    if a.layer == "bronze":
        print(loads.load_bronze(store, folder_loads(store.spark, a.data_dir, day), a.batch_id or str(uuid.uuid4()), a.ingestion_ts))
    elif a.layer == "silver":
        print(loads.load_silver(store, mode, day))
    elif a.layer == "snapshot":
        print(loads.load_snapshot(store, mode, day, a.snapshot_created_at))
    else:
        print(loads.load_gmv(store, mode, day))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
