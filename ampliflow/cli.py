"""Command line: python -m ampliflow.cli demux | mine | stats | draw | watch | convert ... Each is a Spark job on the session's master."""

from __future__ import annotations

import argparse
import json
import logging
import os
import shlex
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampliflow.operators import convert, demux, events, mining, outputs, stats
from ampliflow.sources import tables
from ampliflow.sources.sequences import parse_range, read_sequences

log = logging.getLogger("ampliflow")


def _reads_options(p: argparse.ArgumentParser) -> None:
    p.add_argument("primers", help="FASTA file of primers")
    p.add_argument("specimens", help="table of specimens, tab-separated")
    p.add_argument("source", help="FASTA or FASTQ, plain or gzip, a file or a folder; for watch the folder to watch")
    p.add_argument("--min-length", type=int, default=-1)
    p.add_argument("--max-length", type=int, default=-1)
    p.add_argument("-n", "--num-seqs", default="-1", help="number of reads of each file, or start,number")
    p.add_argument("-e", "--index-edit-distance", type=int, default=-1, help="edits of a barcode; derived by default")
    p.add_argument("-E", "--primer-edit-distance", type=int, default=-1, help="edits of a primer; derived by default")
    p.add_argument("-l", "--search-len", type=int, default=80, help="bases at each end that are searched")
    p.add_argument("-F", "--output-to-files", action="store_true", help="write a file for each specimen; else to standard output")
    p.add_argument("-O", "--output-dir", default=".")
    p.add_argument("-P", "--output-file-prefix", default="")
    p.add_argument("--color", action="store_true", help="show barcodes in blue, primers in green, bases of low quality in lower case")
    p.add_argument("--trim", choices=demux.TRIMS, default="barcodes")
    p.add_argument("--dereplicate", choices=("best", "none"), default="best")
    p.add_argument("-d", "--diagnostics", nargs="?", const=1, type=int, choices=(1, 2, 3), help="also write the event log: 1 standard, 2 detailed, 3 all")
    p.add_argument("--disable-preorient", action="store_true")
    p.add_argument("--disable-prefilter", action="store_true", help="accepted; there is no prefilter")
    p.add_argument("--sample-topq", type=int, default=0, metavar="N", help="also write the N best reads of each specimen")
    p.add_argument("-t", "--threads", type=int, default=-1, help="cores of a local session; all by default")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="ampliflow", description="Analysis of amplicon reads as Spark jobs.")
    p.add_argument("-v", "--version", action="version", version="ampliflow 0.2")
    p.add_argument("-D", "--debug", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    _reads_options(sub.add_parser("demux", help="reads to specimens"))
    w = sub.add_parser("watch", help="demux each new file of a folder")
    _reads_options(w)
    w.add_argument("--settle-time", type=float, default=30, help="seconds that a file's size must stay the same")
    w.add_argument("--state", "--state-file", help="folder of the status table and the stream's checkpoint; in the watched folder by default")
    w.add_argument("--pattern", default="*.fastq")
    w.add_argument("--daemon", action="store_true", help="log to a file in the output folder")
    w.add_argument("--stop-after", type=int)
    m = sub.add_parser("mine", help="partial reads that resemble a specimen's full ones")
    m.add_argument("--index", required=True, help="table of specimens")
    m.add_argument("--fastq", required=True, help="a specimen's file under full/; <file>.mined is written")
    m.add_argument("--partial-forward", action="store_true")
    m.add_argument("--no-partial-reverse", action="store_true")
    m.add_argument("--min-identity", type=float, default=0.85)
    s = sub.add_parser("stats", help="counts of an event log")
    s.add_argument("trace")
    what = s.add_mutually_exclusive_group(required=True)
    what.add_argument("--hierarchical", nargs="+", metavar="DIMENSION")
    what.add_argument("--sankey-data", nargs="+", metavar="DIMENSION")
    what.add_argument("--list-dimensions", action="store_true")
    s.add_argument("--count-by", choices=("candidate_matches", "sequences"), default="candidate_matches")
    s.add_argument("-o", "--output")
    d = sub.add_parser("draw", help="a page with the diagram of Sankey data")
    d.add_argument("data")
    d.add_argument("page", nargs="?", default="sankey_diagram.html")
    d.add_argument("--width", type=int, default=1200)
    d.add_argument("--height", type=int, default=600)
    d.add_argument("--theme", choices=("light", "dark"), default="light")
    c = sub.add_parser("convert", help="an old table of specimens to the present form")
    c.add_argument("table")
    c.add_argument("--output-specimen", default="specimen_new.txt")
    c.add_argument("--output-primers", default="primers.fasta")
    c.add_argument("--pool-name", default="pool1")
    return p


def options_of(a: argparse.Namespace) -> demux.Options:
    return demux.Options(
        min_length=a.min_length, max_length=a.max_length, index_distance=a.index_edit_distance, primer_distance=a.primer_edit_distance, search_length=a.search_len,
        trim=a.trim, dereplicate=a.dereplicate, preorient=not a.disable_preorient, prefix=a.output_file_prefix,
    )


def _logged_to(folder: str | None) -> None:
    """Logs to a file of the folder, and no longer to one of a call before."""
    for old in [h for h in log.handlers if isinstance(h, logging.FileHandler)]:
        log.removeHandler(old)
        old.close()
    if folder:
        os.makedirs(folder, exist_ok=True)
        file = logging.FileHandler(os.path.join(folder, "log.txt"), mode="w")
        file.setFormatter(logging.Formatter("%(asctime)s - %(levelname)s - %(message)s"))
        log.addHandler(file)


def run_demux(reads: DataFrame, design: tables.Design, a: argparse.Namespace, name: str, batch: str | None = None) -> None:
    """One run over reads with read_id. Files, event log and totals share hits that are written once. batch: files and event log are
    written once under that name, whatever runs again."""
    run = demux.demultiplex(reads, design, options_of(a))
    if not a.output_to_files:
        for text in outputs.console(run, a.color):
            sys.stdout.write(text)
        return
    run = run.with_hits_written(os.path.join(a.output_dir, ".hits"))
    n = outputs.write_files(run.facts, a.output_dir, batch=batch)
    outputs.write_sidecars(design, a.output_dir)
    outputs.write_subsample(run.facts, design, a.output_dir, a.sample_topq, batch)
    if a.diagnostics:
        events.write_trace(events.run_events(run, level=a.diagnostics, source=name), os.path.join(a.output_dir, "trace"), batch)
    total = run.totals().first()
    log.info("%s: %d of %d reads matched (%.1f%%), %d files", name, total["matched"], total["total"], 100 * total["match_rate"], n)
    run.drop_written()


def _numbered(reads: DataFrame) -> DataFrame:
    return reads.withColumn("read_id", F.monotonically_increasing_id())


def _demux(spark: SparkSession, a: argparse.Namespace) -> int:
    _logged_to(a.output_dir if a.output_to_files else None)
    log.info("command line: %s", shlex.join(sys.argv))
    reads = _numbered(read_sequences(spark, a.source, *parse_range(a.num_seqs)))
    run_demux(reads, tables.load_design(a.primers, a.specimens), a, os.path.basename(a.source.rstrip("/")))
    return 0


def _watch(spark: SparkSession, a: argparse.Namespace) -> int:
    from ampliflow.streaming import watch

    _logged_to(a.output_dir if a.daemon or a.output_to_files else None)
    design, state = tables.load_design(a.primers, a.specimens), a.state or os.path.join(a.source, ".ampliflow-watch")

    def process(reads: DataFrame, path: str, batch: str) -> None:
        log.info("new file: %s", path)
        run_demux(_numbered(reads), design, a, os.path.basename(path), f"{os.path.abspath(state)} {batch}")

    watch.watch(spark, a.source, process, os.path.join(state, "checkpoint"), os.path.join(state, "status"), a.pattern, a.settle_time, a.stop_after).awaitTermination()
    return 0


def _mine(spark: SparkSession, a: argparse.Namespace) -> int:
    n = mining.mine_file(spark, a.index, a.fastq, a.partial_forward, not a.no_partial_reverse, a.min_identity)
    log.info("%d reads in %s.mined", n, a.fastq)
    return 0


def _stats(spark: SparkSession, a: argparse.Namespace) -> int:
    cands = events.with_dimensions(events.pivoted(events.read_trace(spark, a.trace)))
    if a.list_dimensions:
        print("\n".join(cands.columns))
    elif a.hierarchical:
        text = stats.report(cands, a.hierarchical, a.count_by)
        if a.output:
            with open(a.output, "w") as f:
                f.write(text + "\n")
        else:
            print(text)
    else:
        if not a.output:
            raise ValueError("--sankey-data needs --output")
        stats.write_json(stats.sankey(cands, a.sankey_data, a.count_by), a.output)
    return 0


def _draw(spark: None, a: argparse.Namespace) -> int:
    with open(a.data) as f:
        stats.render_html(json.load(f), a.page, a.width, a.height, a.theme)
    return 0


def _convert(spark: SparkSession, a: argparse.Namespace) -> int:
    convert.convert(spark, a.table, a.output_specimen, a.output_primers, a.pool_name)
    return 0


def session(a: argparse.Namespace) -> SparkSession:
    builder = SparkSession.builder.appName("ampliflow")
    threads = getattr(a, "threads", -1)
    if not SparkSession.getActiveSession() and "SPARK_REMOTE" not in os.environ and threads > 0:
        builder = builder.master(f"local[{threads}]")
    return builder.getOrCreate()


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    logging.basicConfig(format="%(asctime)s - %(levelname)s - %(message)s")
    log.setLevel(logging.DEBUG if a.debug else logging.INFO)
    try:
        return {"demux": _demux, "watch": _watch, "mine": _mine, "stats": _stats, "draw": _draw, "convert": _convert}[a.command](None if a.command == "draw" else session(a), a)
    except (ValueError, OSError) as e:
        log.error("%s", e)
        return 1


if __name__ == "__main__":
    sys.exit(main())
