"""python -m cairn.cli IN [ACTIONS] [IN ...] OUT: converts scenes. Actions after a file are that file's, in order."""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys
import time

from pyspark.sql import SparkSession

from cairn.operators.combine import combine
from cairn.operators.filters import surroundings_and_scene
from cairn.operators.table import with_row_id
from cairn.plans import actions as A
from cairn.schema import ROW_ID, validate
from cairn.sources import registry

VERSION = "0.1.0"
log = logging.getLogger("cairn")


def _numbers(text: str) -> tuple[float, ...]:
    return tuple(float(x) for x in text.split(","))


def _value(text: str) -> A.Action:
    column, comparison, value = text.split(",")
    return A.FilterByValue(column, comparison, float(value))


ACTIONS = {
    "--translate": lambda t: A.Translate(_numbers(t)), "--rotate": lambda t: A.Rotate(_numbers(t)), "--scale": lambda t: A.Scale(float(t)), "--filter-nan": None,
    "--filter-value": _value, "--filter-bands": lambda t: A.FilterBands(int(t)), "--filter-box": lambda t: A.FilterBox(_numbers(t)[:3], _numbers(t)[3:]),
    "--filter-sphere": lambda t: A.FilterSphere(_numbers(t)[:3], _numbers(t)[3]), "--params": lambda t: A.Param(*t.split("=", 1)), "--lod": lambda t: A.Lod(float(t)),
}


def parse(argv: list[str]) -> tuple[argparse.Namespace, list[tuple[str, A.Plan]]]:
    """The options, and each file with its actions; the last file is the output."""
    p = argparse.ArgumentParser(prog="cairn", description=__doc__)
    for name in ("overwrite", "quiet", "unbundled"):
        p.add_argument(f"--{name}", action="store_true")
    p.add_argument("--version", action="version", version=VERSION)
    p.add_argument("--iterations", type=int, default=10)
    p.add_argument("--lod-chunk-count", type=int, default=64, help="thousands of rows in a file")
    p.add_argument("--lod-chunk-extent", type=float, default=16.0)
    p.add_argument("--lod-select", default="", help="levels of .lcc inputs, with commas")
    p.add_argument("--viewer-settings", default=None, help="a JSON file for a viewer; no output here holds one, so it is only checked")
    p.add_argument("--gpu", default="-1", help="accepted; executors' processors do all work")
    p.add_argument("--list-gpus", action="store_true")
    p.add_argument("--master", default=None)
    own, files, k = [], [], 0
    options = {"--iterations", "--lod-chunk-count", "--lod-chunk-extent", "--lod-select", "--viewer-settings", "--gpu", "--master"}
    while k < len(argv):
        word = argv[k]
        name, _, value = word.partition("=")
        if name in ACTIONS:
            if not files:
                p.error(f"{name} needs a file before it")
            if ACTIONS[name] is None:
                files[-1][1].actions.append(A.FilterNaN())
            else:
                if "=" not in word:
                    k += 1
                    value = argv[k] if k < len(argv) else p.error(f"{name} needs a value")
                files[-1][1].actions.append(ACTIONS[name](value))
        elif word.startswith("--"):
            own.append(word)
            if word in options and k + 1 < len(argv):
                k += 1
                own.append(argv[k])
        else:
            files.append((word, A.Plan()))
        k += 1
    args = p.parse_args(own)
    if args.viewer_settings:
        with open(args.viewer_settings, encoding="utf-8") as f:
            json.load(f)
    if args.gpu != "cpu" and not args.gpu.lstrip("-").isdigit():
        p.error("--gpu takes a number or cpu")
    if args.list_gpus:
        print("No GPU adapters: executors' processors do all work.")
        raise SystemExit(0)
    if len(files) < 2:
        p.error("an input and an output are needed")
    return args, files


def main(argv: list[str] | None = None) -> int:
    args, files = parse(sys.argv[1:] if argv is None else argv)
    logging.basicConfig(level=logging.ERROR if args.quiet else logging.INFO, format="%(message)s")
    *inputs, (out, plan) = files
    registry.by_suffix(out, registry.WRITE)
    if os.path.exists(out) and not args.overwrite:
        log.error("%s is there; --overwrite replaces it", out)
        return 1
    began = time.time()
    builder = SparkSession.builder.appName("cairn")
    spark = (builder.master(args.master) if args.master else builder).getOrCreate()
    lods = [int(x) for x in args.lod_select.split(",") if x.strip()]
    tables = [p(validate(registry.read(spark, path, lods))) for path, p in inputs]
    env, scene = surroundings_and_scene(tables)
    together = lambda ts: with_row_id(combine([t.drop(ROW_ID) for t in ts])) if ts else None
    table = together(scene)
    if table is None:
        log.error("no scene to write")
        return 1
    registry.write(plan(table), out, together(env), args.iterations, not args.unbundled, args.lod_chunk_count, args.lod_chunk_extent, args.overwrite)
    log.info("done in %.1f s", time.time() - began)
    return 0


if __name__ == "__main__":
    sys.exit(main())
