"""What the jobs share: configuration files, logging, and the session of a command line."""

from __future__ import annotations

import argparse
import json
import logging
import sys
from collections.abc import Callable
from dataclasses import fields

from lodestone.errors import EnvironmentFailure, UsageError
from lodestone.session import get_spark


def configured(kind: type, path: str | None):
    """A configuration of this dataclass with the values of a JSON file; an unknown name is an error."""
    if path is None:
        return kind()
    with open(path) as f:
        values = json.load(f)
    unknown = sorted(set(values) - {x.name for x in fields(kind)})
    if unknown:
        raise UsageError(f"{path} has unknown settings: {', '.join(unknown)}")
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})


def command_line(name: str, about: str, paths: dict[str, str], kind: type, run: Callable, argv: list[str] | None = None) -> int:
    """Parses paths and --config, runs run(spark, *paths, config) in a session of its own, and returns the exit code."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=about)
    for path, text in paths.items():
        parser.add_argument(path, help=text)
    parser.add_argument("--config", help="a JSON file of settings")
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s", stream=sys.stderr)
    logging.getLogger("py4j").setLevel(logging.WARNING)
    spark = None
    try:
        config = configured(kind, args.config)
        spark = get_spark(app=name)
        run(spark, *[getattr(args, p) for p in paths], config)
    except (UsageError, EnvironmentFailure) as e:
        print(e, file=sys.stderr)
        return e.exit_code
    finally:
        if spark is not None:
            spark.stop()
    return 0
