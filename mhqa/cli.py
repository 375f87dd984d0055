"""Commands: validate, evaluate, expand, import-legacy, generate, judge, release, upload (dry run), preflight. The exit code is 1 where the data fail a check or units failed."""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Sequence
from pathlib import Path


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="mhqa")
    commands = top.add_subparsers(dest="command", required=True)
    c = commands.add_parser("validate")
    c.add_argument("instances")
    c.add_argument("--strict", action="store_true")
    c.add_argument("--expected", type=int)
    c = commands.add_parser("evaluate")
    c.add_argument("gold")
    c.add_argument("predictions")
    c.add_argument("--protocol", default="unicode_script_aware", choices=("unicode_script_aware", "legacy_hotpot"))
    c = commands.add_parser("expand")
    for name in ("bases", "translations", "output"):
        c.add_argument(name)
    c = commands.add_parser("import-legacy")
    c.add_argument("source")
    c.add_argument("output")
    c.add_argument("shards", nargs="+")
    c.add_argument("--split", required=True, choices=("train", "validation"))
    c.add_argument("--corrections")
    c = commands.add_parser("generate")
    for name in ("config", "sources", "output"):
        c.add_argument(name)
    c.add_argument("--split", required=True, choices=("train", "validation"))
    c.add_argument("--difficulty")
    c.add_argument("--seed", type=int, default=42)
    c.add_argument("--manifest")
    c.add_argument("--prompt", required=True, help="a file with the system prompt")
    c = commands.add_parser("judge")
    for name in ("config", "instances", "sources", "output"):
        c.add_argument(name)
    c = commands.add_parser("release")
    for name in ("instances", "sources", "output"):
        c.add_argument(name)
    c.add_argument("--split", required=True, choices=("train", "validation"))
    c.add_argument("--prefix", required=True, help="of the release's own flags, as set:")
    c = commands.add_parser("upload")
    c.add_argument("card")
    c.add_argument("files", nargs="+", help="NAME=PATH")
    c.add_argument("--dry-run", action="store_true", required=True)
    c = commands.add_parser("preflight")
    c.add_argument("card")
    return top


def main(argv: Sequence[str] | None = None, spark=None, make_client=None) -> int:  # noqa: ANN001
    args = parser().parse_args(argv)
    from mhqa.plans import pipelines

    if args.command == "preflight":
        problems = pipelines.card_problems(Path(args.card).read_text(encoding="utf-8"))
        print(json.dumps({"problems": problems}))
        return int(bool(problems))
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("mhqa").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    from mhqa.runtime import ship

    ship(spark)
    ok = True
    if args.command == "validate":
        out, ok = pipelines.validate(spark, args.instances, strict=args.strict, expected=args.expected)
    elif args.command == "evaluate":
        out = pipelines.evaluate(spark, args.gold, args.predictions, protocol=args.protocol)
    elif args.command == "expand":
        out = {"views": pipelines.expand(spark, args.bases, args.translations, args.output)}
    elif args.command == "generate":
        config = pipelines.ModelConfig.of(pipelines.load_config(args.config))
        prompt = Path(args.prompt).read_text(encoding="utf-8")
        out = pipelines.generate(spark, config, args.sources, args.output, split=args.split, seed=args.seed, manifest=args.manifest, system=prompt, key=os.environ.get("MODEL_API_KEY"), difficulty=args.difficulty, make_client=make_client)
        ok = not out["failed"]
    elif args.command == "judge":
        out = pipelines.judge(spark, pipelines.JudgeConfig.of(pipelines.load_config(args.config)), args.instances, args.sources, args.output, key=os.environ.get("MODEL_API_KEY"), make_client=make_client)
        ok = not any(r["failed"] for r in out)
    elif args.command == "release":
        out = pipelines.release(spark, args.instances, args.sources, args.output, own=args.prefix, split=args.split)
        ok = not out.get("quarantined")
    elif args.command == "upload":
        out = pipelines.upload_plan(spark, args.card, dict(f.split("=", 1) for f in args.files))
    else:
        out = pipelines.import_legacy(spark, args.shards, args.source, args.output, split=args.split, corrections=args.corrections)
        ok = not out["quarantined"]
    print(json.dumps(out, ensure_ascii=False, default=str))
    return int(not ok)


if __name__ == "__main__":
    sys.exit(main())
