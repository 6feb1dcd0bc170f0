"""The event log of a run, derived from its stages, and its way back to candidates.

An event: sequence_id, event_type, ord (its place among the sequence's events), fields (strings, as the type lists them)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ampliflow.functions.dna import sequence_number_id
from ampliflow.operators.demux import BEST, FULL_KINDS, PARTIAL_F, PARTIAL_R, Result, filtered

_EVENTS = "array<struct<event_type:string,ord:struct<stage:int,within:int>,fields:array<string>>>"
BASE = ("timestamp", "worker_id", "event_seq", "sequence_id", "event_type")


def _event(kind: str, stage: int, *fields: Column, within: Column | None = None) -> Column:
    texts = F.array(*[F.coalesce(f.cast("string"), F.lit("none")) for f in fields])
    order = F.struct(F.lit(stage).alias("stage"), (F.lit(0) if within is None else within).cast("int").alias("within"))
    return F.struct(F.lit(kind).alias("event_type"), order.alias("ord"), texts.alias("fields"))


def _if(when: Column, event: Column) -> Column:
    """An array of the event, or of nothing."""
    return F.filter(F.array(event), lambda _: F.coalesce(when, F.lit(False)))


def _decimals(x: Column) -> Column:
    return F.format_string("%.3f", x.cast("double"))


def _searches(result: Result, level: int) -> list[Column]:
    """Primer hits from level 2 on; from level 3 on also what was tried, before its result, and barcodes likewise."""
    primers = result.design.ordered
    names, ways = F.array(*[F.lit(p.name) for p in primers]), F.array(*[F.lit(p.direction) for p in primers])
    low, high, missed = F.greatest(F.lit(0), F.col("length") - result.options.search_length), F.col("length"), (F.lit("false"), F.lit(-1), F.lit(-1))
    at = lambda h: 10_000 * (2 * h["primer"] + h["strand"])

    def hit(h: Column) -> Column:
        return _event("PRIMER_SEARCH", 3, F.get(names, h["primer"]), F.get(ways, h["primer"]), low, high, F.lit("true"), h["dist"], F.get(h["locs"], 0)["s"], within=at(h) + 2)

    parts = [F.transform("hits", hit)]
    if level > 2:
        parts.append(F.array(*[_event("PRIMER_SEARCH", 3, F.lit(p.name), F.lit(p.direction), low, high, *missed, within=F.lit(10_000 * (2 * n + s) + 1)) for n, p in enumerate(primers) for s in (0, 1)]))
        tried = F.array(*[F.array(*[F.lit(b) for b in sorted(map(str, result.design.barcodes[p.name]))]).cast("array<string>") for p in primers])
        bar = lambda h, b, n, *found: _event("BARCODE_SEARCH", 3, b, F.get(ways, h["primer"]), F.get(names, h["primer"]), F.get(h["locs"], 0)["e"] + 1, high, *found, within=at(h) + n)
        parts.append(F.flatten(F.transform("hits", lambda h: F.transform(F.get(tried, h["primer"]), lambda b, n: bar(h, b, 3 + 2 * n, *missed)))))
        place = lambda h, b: 2 + 2 * F.array_position(F.get(tried, h["primer"]), b["bc"])
        parts.append(F.flatten(F.transform("hits", lambda h: F.transform(h["bcs"], lambda b: bar(h, b["bc"], place(h, b), F.lit("true"), b["dist"], F.get(b["locs"], 0)["s"])))))
    return parts


def run_events(result: Result, worker: str = "spark", level: int = 1, source: str | Column = "read") -> DataFrame:
    """Events of a run. level: 1 the course of each read, 2 also primer hits, 3 also all that was tried. source: what a sequence_id
    begins with, such as the file's name. A read's events are made in its row; filtered reads are never searched."""
    best_b = lambda c: F.get(c, 0)["bc"]
    d = lambda c: F.coalesce(c, F.lit(-1))
    side = lambda a, b: F.when(a.isNotNull() & b.isNotNull(), "both").when(a.isNotNull(), "forward_only").when(b.isNotNull(), "reverse_only").otherwise("none")
    cid = lambda c: F.concat_ws("_", F.col("read_id").cast("string"), c["cand_ord"].cast("string"))
    names = lambda c: (c["n1"], c["n2"], best_b(c["b1"]), best_b(c["b2"]))
    total = lambda c: sum((F.coalesce(x, F.lit(0)) for x in (c["p1"]["dist"], c["p2"]["dist"], c["d1"], c["d2"])), F.lit(0))
    top = F.array_max("cands.score")

    def matched(c: Column) -> Column:
        strand = F.when(c["strand"] == 0, "as_is").otherwise("reverse_complement")
        return _event("PRIMER_MATCHED", 4, cid(c), side(c["n1"], c["n2"]), c["n1"], c["n2"], d(c["p1"]["dist"]), d(c["p2"]["dist"]), c["pool"], strand, within=c["cand_ord"])

    def barcodes(c: Column) -> Column:
        _, _, b1, b2 = names(c)
        return _event("BARCODE_MATCHED", 5, cid(c), side(b1, b2), b1, b2, d(c["d1"]), d(c["d2"]), c["n1"], c["n2"], within=c["cand_ord"])

    def scored(c: Column) -> Column:
        return _event("MATCH_SCORED", 6, cid(c), *names(c), total(c), side(*names(c)[2:]), _decimals(c["score"]), within=c["cand_ord"])

    def discarded(c: Column) -> Column:
        return _event("MATCH_DISCARDED", 7, cid(c), *names(c), _decimals(c["score"]), F.lit("lower_score"), within=c["cand_ord"])

    received = _event("SEQUENCE_RECEIVED", 1, F.col("length"), F.col("seq_id"))
    own = [
        F.array(received, _event("ORIENTATION_DETECTED", 3, F.col("orientation"), F.col("forward_score"), F.col("reverse_score"), _decimals(F.col("confidence")))),
        *[F.transform("cands", f) for f in (matched, barcodes, scored)], F.transform(F.filter("cands", lambda c: c["score"] < top), discarded),
    ]
    if level > 1:
        own += _searches(result, level)
    o, known, fact = F.col("cand_ord"), F.col("cand_ord").isNotNull(), lambda n: F.col(f"fact.{n}")
    b1, b2 = best_b(F.col("b1")), best_b(F.col("b2"))
    each = [
        _if(~known, _event("NO_MATCH_FOUND", 4, F.lit("primer_search"), F.lit("No primer matches found"))),
        _if(known, _event("SPECIMEN_RESOLVED", 9, F.col("sample"), F.col("resolution"), F.col("pool"), F.col("n1"), F.col("n2"), b1, b2, within=o)),
        _if(fact("trim_empty"), _event("SEQUENCE_TRIM_EMPTY", 10, F.lit(result.options.trim), fact("start"), fact("end"), F.length(fact("seq")), fact("p1_name"), fact("p2_name"), within=o)),
        F.array(_event("SEQUENCE_OUTPUT", 11, fact("sample"), fact("pool"), fact("primer_pair"), fact("path"), within=F.coalesce(o, F.lit(-1)))),
    ]
    if result.options.dereplicate == "best":
        wide = F.aggregate("best", F.lit(0), lambda n, c: n + F.greatest(F.lit(1), F.size(c["b1"])) * F.greatest(F.lit(1), F.size(c["b2"])))
        own.append(_if((F.size("best") > 1) | (wide > 1), _event("DEREPLICATE_EXPANDED", 7, F.size("best"), wide, within=F.lit(1 << 30))))
        kept = [F.col("alternatives"), F.col("barcode_dist"), F.col("primer_dist"), F.col("file_present")]
        kind, bar = F.col("group_kind"), F.when(F.col("kind") == "forward", b1).otherwise(b2)
        each += [
            _if(kind == "full", _event("DEREPLICATE_SELECTED", 8, F.col("sample"), *kept, within=o)),
            _if(kind == "partial", _event("DEREPLICATE_PARTIAL_SELECTED", 8, F.col("kind"), bar, kept[0], kept[1], F.col("n_primers"), *kept[2:], within=o)),
            _if((kind == "unknown") & (F.col("alternatives") > 1), _event("DEREPLICATE_UNKNOWN_SELECTED", 8, kept[0], F.col("n_primers"), kept[2], F.col("file_penalised"), within=o)),
        ]
    rows = result.outcomes.withColumn("own", F.when(F.coalesce("nth", F.lit(0)) == 0, F.concat(*own)))
    rows = rows.select("read_id", F.explode_outer(F.concat(F.coalesce("own", F.expr("array()").cast(_EVENTS)), *each)).alias("e"), *([source.alias("source")] if isinstance(source, Column) else []))
    gone = filtered(result.reads, result.options).where(F.col("filter_reason").isNotNull())
    gone = gone.select("read_id", F.explode(F.array(received, _event("SEQUENCE_FILTERED", 2, F.col("length"), F.col("filter_reason")))).alias("e"), *([source.alias("source")] if isinstance(source, Column) else []))
    events = rows.unionByName(gone)
    name = F.col("source") if isinstance(source, Column) else source
    return events.select("read_id", "e.*", sequence_number_id(name, F.col("read_id").cast("long"), F.lit(worker)).alias("sequence_id"))


def numbered(events: DataFrame) -> DataFrame:
    """Events as trace rows: timestamp, worker_id, event_seq (from 1 in each sequence), sequence_id, event_type, fields."""
    order = W.partitionBy("sequence_id").orderBy("ord", "event_type", "fields")
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return events.select(stamp.alias("timestamp"), F.lit("spark").alias("worker_id"), F.row_number().over(order).cast("long").alias("event_seq"), "sequence_id", "event_type", "fields")


def write_trace(events: DataFrame, path: str, batch: str | None = None) -> None:
    """Tab-separated text, a file for each partition; the header names the base columns. Tabs in fields become spaces. batch: written to
    a folder of that name, in place of what a run of the same batch has left there; else appended."""
    fields = F.transform("fields", lambda f: F.regexp_replace(f, "[\t\r\n]", " "))
    line = F.concat_ws("\t", "timestamp", "worker_id", F.col("event_seq").cast("string"), "sequence_id", "event_type", fields)
    rows = numbered(events).sortWithinPartitions("sequence_id", "event_seq").select(line.alias("value"))
    if batch is None:
        rows.write.mode("append").text(path)
    else:
        rows.write.mode("overwrite").text(f"{path}/{re.sub('[^A-Za-z0-9]+', '-', batch).strip('-')}")


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """Trace rows of text files. Headers and lines of fewer than five fields are left out; an event_seq that is no number is 0."""
    rows = spark.read.option("recursiveFileLookup", "true").text(path).select(F.split("value", "\t").alias("p"), F.col("_metadata.file_name").alias("file"))
    rows = rows.where((F.size("p") >= 5) & (F.get("p", 0) != "timestamp"))
    number = F.coalesce(F.get("p", 2).try_cast("long"), F.lit(0))
    return rows.select(F.get("p", 0).alias("timestamp"), F.get("p", 1).alias("worker_id"), number.alias("event_seq"), F.get("p", 3).alias("sequence_id"), F.get("p", 4).alias("event_type"), F.slice("p", 6, F.greatest(F.size("p") - 5, F.lit(0))).alias("fields"), "file")


def event_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count("*").alias("n"))


def pivoted(trace: DataFrame, compat: bool = False) -> DataFrame:
    """Candidates from trace rows: one for each PRIMER_MATCHED, or one of unknown outcome for a sequence without any. A candidate that
    wasn't discarded has the strategy of the first MATCH_SELECTED with its primers and barcodes. compat: dereplicated full matches aren't
    resolved, as in older logs, so that their outcome is unknown."""
    order = F.struct(*(["file"] if "file" in trace.columns else []), "event_seq")
    f = lambda i: F.get("fields", i)
    first = lambda kind, value: F.min_by(F.when(F.col("event_type") == kind, value), F.when(F.col("event_type") == kind, F.col("at")))
    rows = trace.withColumn("at", order)
    solved = (F.col("event_type") == "SPECIMEN_RESOLVED") & (F.lit(not compat) | (f(1) != BEST))
    selected = F.when(F.col("event_type") == "MATCH_SELECTED", F.struct("at", f(0).alias("strategy"), F.slice("fields", 2, 4).alias("names")))
    per = rows.groupBy("sequence_id").agg(
        first("ORIENTATION_DETECTED", f(0)).alias("orientation"), F.min_by(F.when(solved, f(1)), F.when(solved, F.col("at"))).alias("resolution"), F.array_sort(F.collect_list(selected)).alias("selected"),
    )
    own = rows.where(F.col("event_type").isin("PRIMER_MATCHED", "BARCODE_MATCHED", "MATCH_DISCARDED"))
    own = own.groupBy("sequence_id", f(0).alias("candidate_match_id")).agg(
        first("PRIMER_MATCHED", F.struct(f(1).alias("match_type"), f(2).alias("fp"), f(3).alias("rp"), f(6).alias("pool"))).alias("p"),
        first("BARCODE_MATCHED", F.struct(f(1).alias("match_type"), f(2).alias("fb"), f(3).alias("rb"))).alias("b"),
        first("MATCH_DISCARDED", f(6)).alias("reason"),
    ).where(F.col("p").isNotNull())
    out = per.join(own, "sequence_id", "left")
    gone = F.col("reason").isNotNull()
    unknown = F.col("candidate_match_id").isNull()
    text = lambda c, other="none": F.coalesce(c, F.lit(other))
    names = F.array(text(F.col("p.fp")), text(F.col("p.rp")), text(F.col("b.fb")), text(F.col("b.rb")))
    strategy = F.get(F.filter("selected", lambda s: F.transform(s["names"], lambda n: F.when(n == "", "none").otherwise(n)) == names), 0)["strategy"]
    done = F.when(F.col("resolution").isin(*FULL_KINDS), "matched").when(F.col("resolution").isin(PARTIAL_F, PARTIAL_R), "partial").otherwise("unknown")
    return out.select(
        text(F.col("candidate_match_id")).alias("candidate_match_id"), "sequence_id", text(F.col("orientation"), "unknown").alias("orientation"),
        text(F.col("p.fp")).alias("forward_primer"), text(F.col("p.rp")).alias("reverse_primer"), text(F.col("p.pool")).alias("pool"), text(F.col("b.fb")).alias("forward_barcode"), text(F.col("b.rb")).alias("reverse_barcode"),
        text(F.coalesce("b.match_type", "p.match_type")).alias("match_type"), F.when(gone | unknown, "none").otherwise(text(F.col("resolution"))).alias("resolution_type"),
        F.when(unknown, "unknown").when(gone, "discarded").otherwise(done).alias("outcome"), F.when(gone, "discarded").when(unknown, "none").otherwise(text(strategy)).alias("selection_strategy"), text(F.col("reason")).alias("discard_reason"),
    )


def with_dimensions(cands: DataFrame) -> DataFrame:
    """The derived dimensions of candidates."""
    fb, rb = F.col("forward_barcode") != "none", F.col("reverse_barcode") != "none"
    n = fb.cast("int") + rb.cast("int")
    detail = F.when(F.col("outcome") == "discarded", F.concat(F.lit("discarded_"), "discard_reason")).when(F.col("outcome") == "partial", F.col("resolution_type")).otherwise(F.col("outcome"))
    return cands.withColumns({
        "forward_barcode_matched": fb, "reverse_barcode_matched": rb, "specimen_matched": F.col("outcome") == "matched", "barcode_count": n,
        "primer_pair": F.concat_ws("-", "forward_primer", "reverse_primer"), "barcode_pair": F.concat_ws("-", "forward_barcode", "reverse_barcode"), "outcome_detailed": detail,
    })
