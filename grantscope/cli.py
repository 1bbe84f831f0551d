"""Command line: analyse a project folder, or serve the analysis over HTTP."""

from __future__ import annotations

import os
import sys
import webbrowser
from dataclasses import dataclass
from pathlib import Path

USAGE = """grantscope PROJECT [--out DIR] [--fail-on CRITICAL|HIGH|MEDIUM|LOW] [--include-tests]
                   [--no-html] [--no-json] [--open] [--quiet]
grantscope --serve [--port 1..65535]
"""
PORT, LEVELS = 7473, ("CRITICAL", "HIGH", "MEDIUM", "LOW")


class UsageError(ValueError):
    """A command line that cannot be followed."""


@dataclass
class Options:
    project: str = ""
    out: str = ""
    include_tests: bool = False
    html: bool = True
    json: bool = True
    open: bool = False
    quiet: bool = False
    fail_on: str | None = None
    serve: bool = False
    port: int = PORT
    help: bool = False


def parse(args: list[str]) -> Options:
    """Options of a command line; :class:`UsageError` says what is wrong with it."""
    if not args or "-h" in args or "--help" in args:
        return Options(help=True)
    found, rest, paths = Options(), iter(args), []

    def value(name: str) -> str:
        got = next(rest, None)
        if got is None:
            raise UsageError(f"{name} requires a value")
        return got

    switches = {"--serve": ("serve", True), "--include-tests": ("include_tests", True), "--no-html": ("html", False), "--no-json": ("json", False), "--open": ("open", True), "--quiet": ("quiet", True)}
    for arg in rest:
        if arg in switches:
            setattr(found, *switches[arg])
        elif arg == "--out":
            found.out = value(arg)
        elif arg == "--fail-on":
            level = value(arg)
            if level.upper() not in LEVELS:
                raise UsageError(f"Invalid --fail-on value: {level}")
            found.fail_on = level.upper()
        elif arg == "--port":
            port = value(arg)
            if not port.lstrip("+-").isascii() or not port.lstrip("+-").isdigit():
                raise UsageError(f"Invalid --port value: {port}")
            if not 1 <= int(port) <= 65535:
                raise UsageError("Port must be between 1 and 65535")
            found.port = int(port)
        elif arg.startswith("--"):
            raise UsageError(f"Unknown option: {arg}")
        else:
            paths.append(arg)
            if len(paths) > 1:
                raise UsageError("More than one project path was given")
    if found.serve:
        return found
    if not paths:
        raise UsageError("No project path was given")
    if not os.path.isdir(paths[0]):
        raise UsageError(f"Project path not found: {os.path.abspath(paths[0])}")
    if not found.html and not found.json:
        raise UsageError("--no-html and --no-json cannot be used together")
    found.project = os.path.abspath(paths[0])
    found.out = os.path.abspath(found.out or os.path.join(found.project, "grantscope-report"))
    return found


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("grantscope").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def main(args: list[str] | None = None, spark=None) -> int:
    """Exit code: 0, 1 for a wrong command line, 2 for findings at the level of --fail-on."""
    try:
        options = parse(sys.argv[1:] if args is None else args)
    except UsageError as wrong:
        print(wrong, file=sys.stderr)
        print(USAGE, file=sys.stderr)
        return 1
    if options.help:
        print(USAGE)
        return 0
    spark = spark or session()
    if options.serve:
        from .server import serve

        return serve(spark, options.port)
    from .functions.shared import discard
    from .plans import report
    from .plans.analyze import analyze

    found = report.document(analyze(spark, options.project, options.include_tests))
    discard(spark)
    written = []
    os.makedirs(options.out, exist_ok=True)
    for wanted, name, made in ((options.json, "report.json", report.pretty_json), (options.html, "report.html", report.html_page)):
        if wanted:
            path = Path(options.out, name)
            path.write_text(made(found), encoding="utf-8")
            written.append(path)
    if not options.quiet:
        print(report.console_text(found))
        for path in written:
            print(f"Report: {path}")
    if options.open and options.html:
        webbrowser.open(written[-1].as_uri())
    if options.fail_on and (n := report.breaches(found, options.fail_on)):
        print(f"{n} finding(s) at {options.fail_on} severity or above.", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
