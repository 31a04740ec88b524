"""Command line: one JSON report on standard output, exit code 0, or an error's code and 1."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable, Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sievework import schemas as S
from sievework.plans import workflows as W
from sievework.session import session
from sievework.sources import migrations
from sievework.sources.acquisition import git_lineage
from sievework.sources.documents import SourceError, read_document, read_manifest
from sievework.sources.tables import IdentityConflict, Store


def _rows(spark: SparkSession, args: argparse.Namespace):
    return spark.read.parquet(args.rows)


#: Commands by name: help, further arguments, and what runs.
COMMANDS: dict[str, tuple[str, tuple[str, ...], Callable]] = {
    "profile-fields": ("types and nulls of the fields of search responses", ("path",), lambda s, a: W.profile_fields(s, a.path)),
    "ingest-raw-batch": ("store a verified export", ("root", "manifest", "files"), lambda s, a: W.ingest(Store(s, a.root), read_manifest(a.manifest, "."), a.files)),
    "stage-raw-batch": ("cleanse a raw batch", ("root", "batch"), lambda s, a: W.stage_batch(Store(s, a.root), a.batch)),
    "report-population": ("assess a staged batch", ("root", "batch"), lambda s, a: W.report_population(Store(s, a.root), a.batch)),
    "report-real-run": ("reconcile all layers", ("root",), lambda s, a: W.report_layers(Store(s, a.root))),
    "build-temporal-split": ("isolate duplicates and split by date; repository: the clean checkout that runs; manifest: the run's", ("root", "run", "repository", "manifest"), lambda s, a: W.build_split_here(Store(s, a.root), a.run, a.repository, a.manifest)),
    "evaluate-majority-baseline": ("metrics of the majority label; rows: split_assignment, label", ("rows",), lambda s, a: W.majority_baseline(_rows(s, a), "split_assignment", "label")),
    "analyze-errors": ("slices of errors; rows: actual, predicted, received, chars; training: label, n", ("rows", "training"), lambda s, a: W.error_analysis(_rows(s, a), list(S.LABELS), s.read.parquet(a.training))),
    "profile-tokens": ("length quantiles and truncation; rows: length, label", ("rows",), lambda s, a: W.token_profile(_rows(s, a), "length", "label")),
    "validate-dataset": ("shapes of padded batches; rows: key, length", ("rows",), lambda s, a: W.dataset_shapes(_rows(s, a), "key", "length")),
    "calibrate": ("fit a temperature; rows: scores, label_id, partition (fit or evaluation)", ("rows",), lambda s, a: W.calibrate(_rows(s, a), F.col("scores"), F.col("label_id"), len(S.LABELS), F.col("partition") == "fit")),
    "analyze-abstention": ("coverage and risk by threshold; rows: actual, predicted, confidence", ("rows",), lambda s, a: W.analyse_abstention(_rows(s, a), list(range(len(S.LABELS))))),
    "compare-models": ("per-class wins of two models; each: label, support, f1", ("rows", "other"), lambda s, a: W.compare_models(_rows(s, a), s.read.parquet(a.other))),
    "profile-taxonomy": ("labels by month of an aggregate response", ("path",), lambda s, a: W.taxonomy(s, a.path)),
    "fetch-taxonomy": ("labels by month of an aggregate response over HTTPS", ("url",), lambda s, a: W.fetch_taxonomy(s, a.url)),
    "draw-figures": ("reliability and risk-coverage figures; rows: scores, label_id, partition (fit or evaluation)", ("rows", "root"), lambda s, a: W.draw_figures(_rows(s, a), F.col("scores"), F.col("label_id"), list(range(len(S.LABELS))), F.col("partition") == "fit", a.root)),
    "migrate": ("bring a store's tables to a revision, or to base", ("root", "revision"), lambda s, a: W.migrate(Store(s, a.root), a.revision)),
    "migration-sql": ("the statements between two revisions; nothing is run", ("root", "start", "revision"), lambda s, a: {"statements": migrations.statements(a.start, a.revision, a.root)}),
    "publish-shard": ("a downloaded file as an artifact named by its content", ("path", "root"), lambda s, a: W.publish_shard(a.path, a.root)),
    "acquire-run": ("download every month; counts: a JSON file of records by month", ("root", "run", "base", "counts"), lambda s, a: W.acquire(s, a.root, a.run, a.base, read_document(a.counts, ".", {}))),
    "retention-checkpoint": ("whether raw data is due for removal", ("deadline", "now"), lambda s, a: W.retention_checkpoint(s, a.deadline, a.now)),
    "inventory-run": ("what a cleanup of a run would remove", ("root", "run_manifest"), lambda s, a: W.cleanup_run(a.root, read_document(a.run_manifest, a.root, {}))),
    "cleanup-run": ("remove a run's artifacts; confirmation: the run's id", ("root", "run_manifest", "confirmation"), lambda s, a: W.cleanup_run(a.root, read_document(a.run_manifest, a.root, {}), True, a.confirmation)),
    "lineage": ("the commit that is checked out", ("root",), lambda s, a: dict(zip(("commit", "clean"), git_lineage(a.root), strict=True))),
    "train": ("search and save a text model; rows: text, label, split_assignment", ("rows", "model"), lambda s, a: W.train(_rows(s, a), "text", "label", list(S.LABELS), a.model)),
    "smoke-train": ("the training on a few made-up rows", ("model",), lambda s, a: W.smoke(s, a.model)),
    "select-model": ("the operational model by evidence and CPU gates", ("rows",), lambda s, a: W.select_model(_rows(s, a))),
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sievework")
    commands = top.add_subparsers(dest="command", required=True)
    for name, (text, arguments, _) in COMMANDS.items():
        own = commands.add_parser(name, help=text)
        for argument in arguments:
            own.add_argument(f"--{argument.replace('_', '-')}", required=True)
    return top


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        report = COMMANDS[args.command][2](spark or session(), args)
    except SourceError as error:
        print(json.dumps(error.report(), sort_keys=True))
        return 1
    except IdentityConflict:
        print(json.dumps({"status": "error", "error": {"code": "identity_conflict"}}, sort_keys=True))
        return 1
    print(json.dumps(report, sort_keys=True, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
