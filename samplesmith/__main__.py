"""Command line: ``python -m samplesmith <command> [options]``.

One entry point for the data flows of the source project; each command runs a
Spark job from ``samplesmith.plans.jobs``.  ``--master`` is for local runs
only; on a cluster the launcher sets it.
"""

from __future__ import annotations

import argparse
import json

from samplesmith.plans import jobs
from samplesmith.sources import registry as REG


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="samplesmith")
    p.add_argument("--master", default=None, help="Spark master for local runs (e.g. local[8])")
    sub = p.add_subparsers(dest="command", required=True)

    m = sub.add_parser("merge", help="W1: merge registered datasets into one de-duplicated file")
    m.add_argument("--list", action="store_true", help="list registered datasets with line counts")
    m.add_argument("--groups", nargs="+", choices=list(REG.DATASET_GROUPS))
    m.add_argument("--datasets", nargs="+")
    m.add_argument("--all", action="store_true")
    m.add_argument("--limit", type=int, default=None)
    m.add_argument("--no-dedup", action="store_true")
    m.add_argument("--data-dir", default="data")
    m.add_argument("--output", default="data/combined_final")

    r = sub.add_parser("reasoning", help="W5/W6: add step-by-step reasoning (and tools)")
    r.add_argument("--input", required=True)
    r.add_argument("--output", required=True)
    r.add_argument("--version", choices=["v1", "v2"], default="v2")
    r.add_argument("--tools", action="store_true", help="v2: add the tool prompt where relevant")
    r.add_argument("--no-cot", action="store_true", help="v1: skip the reasoning")
    r.add_argument("--no-tools", action="store_true", help="v1: skip the tool block")
    r.add_argument("--limit", type=int, default=None)

    t = sub.add_parser("repo", help="W3: source tree -> four-task samples")
    t.add_argument("--repo", required=True, help="local directory")
    t.add_argument("--output", required=True)
    t.add_argument("--discussion-items", default=None, help="issue/PR dump (JSONL) to append as W4 samples")
    t.add_argument("--discussion-comments", default=None)
    t.add_argument("--max-items", type=int, default=50)

    cv = sub.add_parser("convert", help="P12-P21, P25: convert a local dump (JSONL or parquet)")
    cv.add_argument("--kind", required=True, choices=sorted(jobs.CONVERTERS))
    cv.add_argument("--input", required=True)
    cv.add_argument("--output", required=True)
    cv.add_argument("--format", choices=["jsonl", "parquet"], default="jsonl")
    cv.add_argument("--limit", type=int, default=None, help="cap on rows scanned or kept, per converter")

    pt = sub.add_parser("python-tree", help="S8/P29: .py files -> 20-line chunks with line ranges")
    pt.add_argument("--root", required=True)
    pt.add_argument("--name", required=True)
    pt.add_argument("--output", required=True)

    s = sub.add_parser("snippets", help="W10: repositories -> explain-snippet samples")
    s.add_argument("--root", required=True)
    s.add_argument("--variant", choices=["a", "b", "c", "d"], default="a")
    s.add_argument("--output", required=True)
    s.add_argument("--append", action="store_true")

    th = sub.add_parser("threads", help="W4: issue/PR and comment dumps -> samples")
    th.add_argument("--items", required=True)
    th.add_argument("--comments", required=True)
    th.add_argument("--output", required=True)
    th.add_argument("--max-items", type=int, default=None)

    pr = sub.add_parser("process", help="W2: route JSONL files by name, dedup, cap")
    pr.add_argument("--inputs", nargs="+", required=True)
    pr.add_argument("--output", required=True)
    pr.add_argument("--limit", type=int, default=None)

    ap = sub.add_parser("convert-problems", help="W9: problem sets -> samples (train + test, combined)")
    ap.add_argument("--train", required=True)
    ap.add_argument("--test", required=True)
    ap.add_argument("--output-dir", required=True)
    ap.add_argument("--limit", type=int, default=None)

    ts = sub.add_parser("train-set", help="W7: prompt rendering, fixed-length rows, shuffle, split")
    ts.add_argument("--samples", required=True, help="JSONL samples with an id matching the tokens table")
    ts.add_argument("--tokens", required=True, help="parquet (id, tokens array<int>)")
    ts.add_argument("--output-dir", required=True)
    ts.add_argument("--max-seq", type=int, default=2048)
    ts.add_argument("--prompt-style", default="inst")
    ts.add_argument("--seed", type=int, default=42)

    ev = sub.add_parser("evaluate", help="W8: score generation outcomes")
    ev.add_argument("--generations", required=True)
    ev.add_argument("--tests", required=True)
    ev.add_argument("--output-dir", required=True)

    g = sub.add_parser("generate", help="G1/G2/G3: synthetic samples")
    g.add_argument("--kind", choices=["grid", "bank", "variants"], default="grid")
    g.add_argument("--count", type=int, default=10000)
    g.add_argument("--seed", type=int, default=42)
    g.add_argument("--output", required=True)
    return p


def main(argv: list[str] | None = None) -> dict:
    args = build_parser().parse_args(argv)
    from samplesmith.session import get_spark
    spark = get_spark("samplesmith-" + args.command, master=args.master)
    c = args.command
    if c == "merge":
        if args.list:
            res = {"datasets": [r.asDict() for r in REG.inventory(spark, args.data_dir).collect()]}  # 22 rows
        else:
            keys = REG.select_keys(args.all, args.groups, args.datasets)
            res = jobs.merge_files(spark, keys, args.output, args.data_dir, args.limit, not args.no_dedup)
    elif c == "reasoning":
        res = {"written": jobs.reasoning_files(spark, args.input, args.output, args.version, args.tools, args.limit,
                                               add_cot=not args.no_cot, add_tools=not args.no_tools)}
    elif c == "repo":
        res = {"written": jobs.tree_to_samples(spark, args.repo, args.output, discussion_items=args.discussion_items,
                                               discussion_comments=args.discussion_comments,
                                               max_items=args.max_items)}
    elif c == "convert":
        res = {"written": jobs.convert_dump(spark, args.kind, args.input, args.output, args.format, args.limit)}
    elif c == "python-tree":
        res = {"written": jobs.python_tree_chunks(spark, args.root, args.name, args.output)}
    elif c == "snippets":
        res = {"written": jobs.repo_snippets(spark, args.root, args.output, args.variant,
                                             "append" if args.append else "overwrite")}
    elif c == "threads":
        res = {"written": jobs.threads_to_samples(spark, args.items, args.comments, args.output, args.max_items)}
    elif c == "process":
        res = {"written": jobs.process_files(spark, args.inputs, args.output, args.limit)}
    elif c == "convert-problems":
        res = jobs.problems_to_samples(spark, args.train, args.test, args.output_dir, args.limit)
    elif c == "train-set":
        res = jobs.training_set(spark, args.samples, args.tokens, args.output_dir, args.max_seq, args.prompt_style,
                                args.seed)
    elif c == "evaluate":
        res = jobs.score(spark, args.generations, args.tests, args.output_dir)
    else:
        from samplesmith.operators import generate as G
        from samplesmith.sources.jsonl import write_jsonl
        if args.kind == "variants":
            df = G.variant_samples(spark)
        else:
            ids = spark.range(args.count)
            df = G.template_grid(ids, "id", args.seed) if args.kind == "grid" else G.example_bank(ids, "id", args.seed)
        res = {"written": write_jsonl(df, args.output)}
    print(json.dumps(res, default=str))
    return res


if __name__ == "__main__":
    main()
