"""Command line over the six commands."""

from __future__ import annotations

import argparse
import logging
import re
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from lociweave import __version__, commands
from lociweave.options import ClusterOptions, MatchOptions, name_list, parse_priority
from lociweave.plans.runtime import drop_all_staged


def chunk_size(text: str) -> int:
    """A number of bases with an optional K or M. Kept for scripts; results do not depend on it."""
    found = re.fullmatch(r"(\d+)([KM]?)", text)
    if not found or not int(found[1]):
        raise argparse.ArgumentTypeError(f"not a positive size: {text}")
    return int(found[1]) * {"": 1, "K": 1_000, "M": 1_000_000}[found[2]]


def named_path(text: str) -> tuple[str, str]:
    """Name:path, or a path named by its base name without extension."""
    found = re.fullmatch(r"([^:/]+):(?!//)(.+)", text)
    if found:
        return found[1], found[2]
    return re.sub(r"\.(vcf\.gz|vcf|bcf)$", "", Path(text).name), text


def _shared(p: argparse.ArgumentParser) -> None:
    either = p.add_mutually_exclusive_group()
    either.add_argument("--min-overlap", type=float)
    either.add_argument("--min-jaccard", type=float)
    p.add_argument("--bnd-slop", type=int, default=50)
    p.add_argument("--ins-slop", type=int, default=50)
    p.add_argument("--min-ins-sim", type=float, default=0.75)
    p.add_argument("--threads", type=int, default=1, help="cores of a local session")
    p.add_argument("--tmp-dir", help="folder for intermediate tables")
    p.add_argument("--use-shm", action="store_true", help="accepted; Spark places its own blocks")
    p.add_argument("--chrs")
    p.add_argument("--chr-set")
    p.add_argument("--chunk-size", type=chunk_size, default=50_000_000, help="accepted; joins are tiled by size class")
    p.add_argument("--require-index", action="store_true", help="stop if an input has no .csi or .tbi beside it")
    p.add_argument("-v", "--verbose", action="store_true")


def _written(p: argparse.ArgumentParser) -> None:
    p.add_argument("-o", "--output", default="-")
    p.add_argument("--write-index", action="store_true")


def _clustered(p: argparse.ArgumentParser) -> None:
    p.add_argument("--linkage", choices=("average", "single", "complete"), default="average")
    p.add_argument("--priority", type=parse_priority, default=("PASS", "CENTRE", "ORDER"))
    p.add_argument("--format", default="GT")
    p.add_argument("--info")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lociweave", description="Match, annotate, collapse and merge structural-variant callsets.")
    top.add_argument("--version", action="version", version=__version__)
    top.add_argument("--license", action="version", version="No license has been chosen for this software.", help="print the license and stop")
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("match", help="pairs of similar records")
    p.add_argument("inputs", nargs="+")
    p.add_argument("--self", dest="own", action="store_true")
    p.add_argument("--info")
    p.add_argument("--output", "-o", default="-")
    _shared(p)
    p = sub.add_parser("anno", help="fields of a database aggregated over matches")
    p.add_argument("inputs", nargs=2)
    p.add_argument("-a", dest="expressions", action="append", required=True, metavar="OUT=FUNC(SRC)")
    p.add_argument("--overwrite", action="store_true")
    _written(p)
    _shared(p)
    for name in ("intersect", "setdiff"):
        p = sub.add_parser(name, help=f"fuzzy {name}")
        p.add_argument("inputs", nargs=2)
        _written(p)
        _shared(p)
    p = sub.add_parser("collapse", help="one record per cluster of several callers' records")
    p.add_argument("inputs", nargs="+", type=named_path, metavar="[NAME:]PATH")
    _written(p)
    _clustered(p)
    _shared(p)
    p = sub.add_parser("merge", help="cohort table of single-sample files")
    p.add_argument("inputs", nargs="+")
    p.add_argument("--missing-to-ref", action="store_true")
    _written(p)
    _clustered(p)
    _shared(p)
    return top


def match_options(args: argparse.Namespace) -> MatchOptions:
    names = lambda text, what: None if text is None else tuple(name_list(text, what))
    return MatchOptions(args.min_jaccard, args.min_overlap, args.bnd_slop, args.ins_slop, args.min_ins_sim, names(args.chrs, "--chrs"), names(args.chr_set, "--chr-set"))


def session(args: argparse.Namespace) -> SparkSession:
    if args.threads < 1:
        raise ValueError("--threads must be at least 1")
    builder = SparkSession.builder.appName("lociweave").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
    if SparkSession.getActiveSession() is None:
        builder = builder.master(f"local[{args.threads}]").config("spark.sql.shuffle.partitions", str(max(2, args.threads))).config("spark.ui.enabled", "false")
        if args.tmp_dir:
            builder = builder.config("spark.checkpoint.dir", f"file://{Path(args.tmp_dir).resolve()}")
    return builder.getOrCreate()


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    top = parser()
    args = top.parse_args(argv)
    logging.basicConfig(level=logging.INFO if args.verbose else logging.WARNING, format="%(levelname)s %(message)s")
    command = " ".join(["lociweave", *argv])
    try:
        options = match_options(args)
        if args.command == "match":
            if len(args.inputs) != (1 if args.own else 2):
                raise ValueError("match takes two inputs, or one with --self")
            commands.run_match(session(args), args.inputs[0], None if args.own else args.inputs[1], args.output, options, name_list(args.info, "--info"), args.verbose, args.require_index)
        elif args.command == "anno":
            commands.run_annotate(session(args), *args.inputs, args.expressions, args.output, options, args.overwrite, args.write_index, args.verbose, args.require_index)
        elif args.command in ("intersect", "setdiff"):
            commands.run_setop(session(args), args.command, *args.inputs, args.output, options, args.write_index, args.verbose, args.require_index)
        else:
            chosen = ClusterOptions(args.linkage, args.priority, options)
            info, formats = name_list(args.info, "--info"), [] if args.format == "" else name_list(args.format, "--format")
            if args.command == "collapse":
                commands.run_collapse(session(args), args.inputs, args.output, chosen, info, formats, args.write_index, command, args.verbose, index_needed=args.require_index)
            else:
                if any(re.match(r"[^:/]+:(?!//)", x) for x in args.inputs):
                    raise ValueError("merge takes plain paths; samples are named by their headers")
                commands.run_merge(session(args), args.inputs, args.output, chosen, info, formats, args.missing_to_ref, args.write_index, command, args.verbose, index_needed=args.require_index)
    except (ValueError, FileNotFoundError) as e:
        print(f"lociweave: {e}", file=sys.stderr)
        return 1
    finally:
        active = SparkSession.getActiveSession()
        if active is not None:
            drop_all_staged(active)
    return 0


if __name__ == "__main__":
    sys.exit(main())
