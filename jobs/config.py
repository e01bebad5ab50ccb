"""Command line of a job: a JSON config and settings that override it."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from dataclasses import MISSING, fields, replace

from pyspark.sql import SparkSession


def read_config(spark: SparkSession, kind: type, path: str, changes: list[str] = ()):
    """``kind`` from a JSON object that Spark reads; ``changes`` are ``name=value``, values in JSON or as text."""
    given = json.loads(spark.read.text(path, wholetext=True).first()[0])
    for change in changes:
        name, _, value = change.partition("=")
        try:
            given[name] = json.loads(value)
        except json.JSONDecodeError:
            given[name] = value
    known = {f.name: f for f in fields(kind)}
    unknown = sorted(set(given) - set(known))
    missing = sorted(n for n, f in known.items() if f.default is MISSING and f.default_factory is MISSING and n not in given)
    if unknown or missing:
        raise ValueError(f"config {path}: unknown {unknown}, missing {missing}")
    made = kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})
    return replace(made, **{k: getattr(made, k).rstrip("/") for k in ("source", "out", "checkpoint") if getattr(made, k, None)})


def run(name: str, kind: type, work: Callable) -> None:
    """The command line: creates a session, works, stops the session."""
    parser = argparse.ArgumentParser(prog=name, description=work.__doc__)
    parser.add_argument("config", help="path of a JSON config; may be remote")
    parser.add_argument("changes", nargs="*", help="name=value, instead of the config's")
    given = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        work(spark, read_config(spark, kind, given.config, given.changes))
    finally:
        spark.stop()
