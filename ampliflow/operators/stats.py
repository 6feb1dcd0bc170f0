"""Counts of candidates over any dimensions: nested groups with shares, and the nodes and links of a Sankey diagram."""

from __future__ import annotations

import html
import json
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MODES = ("candidate_matches", "sequences")


def counted(cands: DataFrame, dimensions: list[str], by: str = "candidate_matches", order: str = "candidate_match_id") -> DataFrame:
    """The rows that count: all candidates, or the first of each sequence. Dimensions as text."""
    if by not in MODES:
        raise ValueError(f"count by {' or '.join(MODES)}, not {by}")
    missing = [d for d in dimensions if d not in cands.columns]
    if missing:
        raise ValueError(f"there is no dimension {', '.join(missing)}; there are {', '.join(sorted(cands.columns))}")
    if by == "sequences":
        cands = cands.withColumn("_nth", F.row_number().over(W.partitionBy("sequence_id").orderBy(order))).where("_nth = 1")
    return cands.select(*[F.col(d).cast("string").alias(d) for d in dimensions])


def nested_counts(cands: DataFrame, dimensions: list[str], by: str = "candidate_matches") -> DataFrame:
    """A row for each group at each depth (0: all): dimensions (null below the depth), depth, count, percent (of the group above)."""
    rows = counted(cands, dimensions, by)
    rolled = rows.rollup(*dimensions).agg(F.count("*").alias("count"), F.grouping_id().alias("gid"))
    depth = len(dimensions) - F.length(F.replace(F.bin("gid"), F.lit("0"), F.lit("")))
    rolled = rolled.withColumn("depth", depth.cast("int"))
    # A group's parent has the dimensions up to the last but one; the whole has none above it.
    above = F.slice(F.array(*dimensions), F.lit(1), F.greatest(F.col("depth") - 1, F.lit(0)))
    total = F.sum("count").over(W.partitionBy("depth", above))
    return rolled.withColumn("percent", F.lit(100.0) * F.col("count") / total).drop("gid")


def report(cands: DataFrame, dimensions: list[str], by: str = "candidate_matches") -> str:
    """The nested counts as indented text."""
    rows = nested_counts(cands, dimensions, by).orderBy(*[F.col(d).asc_nulls_first() for d in dimensions]).collect()
    total = next((r["count"] for r in rows if r["depth"] == 0), 0)
    out = [f"Dimensions: {' → '.join(dimensions)}", f"Count by: {by}", f"Total: {total:,}", ""]
    for r in rows:
        if r["depth"]:
            d = dimensions[r["depth"] - 1]
            out.append(f"{'  ' * (r['depth'] - 1)}{r['percent']:5.1f}% {r['count']:>10,}  {r[d]} ({d})")
    return "\n".join(out)


def sankey_nodes(cands: DataFrame, dimensions: list[str], by: str = "candidate_matches") -> DataFrame:
    """dimension, layer, value, label: the distinct values of each dimension."""
    rows = counted(cands, dimensions, by)
    node = lambda n, d: F.struct(F.lit(d).alias("dimension"), F.lit(n).alias("layer"), F.col(d).alias("value"))
    return rows.select(F.explode(F.array(*[node(n, d) for n, d in enumerate(dimensions)])).alias("n")).select("n.*").distinct().withColumn("label", F.coalesce("value", F.lit("none")))


def sankey_links(cands: DataFrame, dimensions: list[str], by: str = "candidate_matches") -> DataFrame:
    """layer, source, target, count for each two dimensions that follow each other."""
    rows = counted(cands, dimensions, by)
    link = lambda n, a, b: F.struct(F.lit(n).alias("layer"), F.col(a).alias("source"), F.col(b).alias("target"))
    pairs = [link(n, a, b) for n, (a, b) in enumerate(zip(dimensions, dimensions[1:], strict=False))]
    if not pairs:
        return rows.select(F.lit(0).alias("layer"), F.lit("").alias("source"), F.lit("").alias("target"), F.lit(0).cast("long").alias("count")).limit(0)
    return rows.select(F.explode(F.array(*pairs)).alias("l")).select("l.*").groupBy("layer", "source", "target").agg(F.count("*").alias("count"))


def node_flow(links: DataFrame) -> DataFrame:
    """What flows out of each node, or into it where nothing flows out: layer, value, flow."""
    out = links.groupBy("layer", F.col("source").alias("value")).agg(F.sum("count").alias("out"))
    into = links.groupBy((F.col("layer") + 1).alias("layer"), F.col("target").alias("value")).agg(F.sum("count").alias("into"))
    return out.join(into, ["layer", "value"], "full").select("layer", "value", F.coalesce(F.nullif("out", F.lit(0)), "into").alias("flow"))


def sankey(cands: DataFrame, dimensions: list[str], by: str = "candidate_matches") -> dict:
    """The diagram's data: small aggregates, gathered on the driver."""
    nodes = sankey_nodes(cands, dimensions, by).orderBy("layer", "label").collect()
    at = {(r["layer"], r["label"]): n for n, r in enumerate(nodes)}
    links = sankey_links(cands, dimensions, by).orderBy("layer", "source", "target").collect()
    name = lambda v: "none" if v is None else v
    return {
        "dimensions": dimensions, "count_by": by, "total_count": counted(cands, dimensions, by).count(),
        "nodes": [{"id": n, "label": r["label"], "layer": r["layer"], "dimension": r["dimension"], "value": r["value"]} for n, r in enumerate(nodes)],
        "links": [{"source": at[r["layer"], name(r["source"])], "target": at[r["layer"] + 1, name(r["target"])], "value": r["count"]} for r in links],
    }


def write_json(data: dict, path: str) -> None:
    with open(path, "w") as f:
        json.dump(data, f, indent=2)


PALETTES = {"light": ("#ffffff", "#222222"), "dark": ("#16181d", "#e8e8e8")}
#: Fixed colours of values, and of counts of barcodes; names of pools, primers and barcodes keep a hue of their own in every diagram.
VALUES = {
    "matched": "#2a9d55", "partial": "#d9a520", "unknown": "#8a8a8a", "discarded": "#c0504d", "true": "#2a9d55", "false": "#c0504d", "none": "#b5b5b5", "both": "#2a9d55", "forward_only": "#4f81bd",
    "reverse_only": "#8064a2", "forward": "#4f81bd", "reverse": "#8064a2", "full_match": "#2a9d55", "dereplicated_full": "#1f7a42", "partial_forward": "#d9a520", "partial_reverse": "#c98b1b", "multiple_specimens": "#3c8d8d",
}
COUNTS = {"0": "#c0504d", "1": "#d9a520", "2": "#2a9d55"}
NAMED = ("pool", "forward_primer", "reverse_primer", "primer_pair", "forward_barcode", "reverse_barcode", "barcode_pair")


def colour(node: dict) -> str:
    """A node's colour: by its value, where its dimension gives the value a meaning; by its name; or in turn."""
    value, dimension = str(node["value"]).lower() if node["value"] is not None else "none", node["dimension"]
    if dimension == "barcode_count":
        return COUNTS.get(value, "#8a8a8a")
    if value in VALUES and (dimension not in NAMED or value in ("none", "unknown")):
        return VALUES[value]
    if dimension in NAMED:
        return f"hsl({zlib.crc32(value.encode()) % 360} 50% 45%)"
    return f"hsl({(node['id'] * 67 + node['layer'] * 29) % 360} 45% 50%)"


def check_sankey(data: dict) -> None:
    """Raises ValueError unless data is a diagram's: nodes with places and layers, links between nodes of layers that follow each other."""
    for key in ("nodes", "links", "dimensions"):
        if not isinstance(data.get(key), list):
            raise ValueError(f"the diagram's data has no list of {key}")
    for n, node in enumerate(data["nodes"]):
        if missing := {"id", "label", "layer", "dimension", "value"} - set(node):
            raise ValueError(f"node {n} has no {', '.join(sorted(missing))}")
        if node["id"] != n or not 0 <= node["layer"] < len(data["dimensions"]):
            raise ValueError(f"node {n} has the id {node['id']} and the layer {node['layer']}")
    for n, link in enumerate(data["links"]):
        if missing := {"source", "target", "value"} - set(link):
            raise ValueError(f"link {n} has no {', '.join(sorted(missing))}")
        ends = [link[k] for k in ("source", "target")]
        if any(not isinstance(e, int) or not 0 <= e < len(data["nodes"]) for e in ends) or data["nodes"][ends[0]]["layer"] + 1 != data["nodes"][ends[1]]["layer"]:
            raise ValueError(f"link {n} joins {ends[0]} and {ends[1]}")
        if link["value"] < 0:
            raise ValueError(f"link {n} has the value {link['value']}")


def render_html(data: dict, path: str, width: int = 1200, height: int = 600, theme: str = "light") -> None:
    """A self-contained page with the diagram as SVG."""
    check_sankey(data)
    paper, ink = PALETTES[theme]
    out, into = ([0] * len(data["nodes"]) for _ in range(2))
    for link in data["links"]:
        out[link["source"]] += link["value"]
        into[link["target"]] += link["value"]
    flow = [a or b for a, b in zip(out, into, strict=True)]
    layers = max((n["layer"] for n in data["nodes"]), default=0) + 1
    pad, bar = 8, 16
    step = (width - bar - 160) / max(1, layers - 1)
    place, body = {}, []
    for layer in range(layers):
        own = [n["id"] for n in data["nodes"] if n["layer"] == layer]
        scale = (height - 40 - pad * max(0, len(own) - 1)) / max(1, sum(flow[i] for i in own))
        y = 30.0
        for i in own:
            place[i] = [layer * step, y, max(1.0, flow[i] * scale), scale, y, y]
            y += max(1.0, flow[i] * scale) + pad
    for link in data["links"]:
        a, b = place[link["source"]], place[link["target"]]
        ha, hb = link["value"] * a[3], link["value"] * b[3]
        x0, x1, y0, y1 = a[0] + bar, b[0], a[4], b[5]
        mid = (x0 + x1) / 2
        body.append(f'<path d="M{x0:.1f},{y0:.1f} C{mid:.1f},{y0:.1f} {mid:.1f},{y1:.1f} {x1:.1f},{y1:.1f} L{x1:.1f},{y1 + hb:.1f} C{mid:.1f},{y1 + hb:.1f} {mid:.1f},{y0 + ha:.1f} {x0:.1f},{y0 + ha:.1f} Z" fill="{colour(data["nodes"][link["source"]])}" fill-opacity="0.4"><title>{link["value"]:,}</title></path>')
        a[4] += ha
        b[5] += hb
    for n in data["nodes"]:
        x, y, h = place[n["id"]][:3]
        body.append(f'<rect x="{x:.1f}" y="{y:.1f}" width="{bar}" height="{h:.1f}" fill="{colour(n)}"/><text x="{x + bar + 4:.1f}" y="{y + h / 2 + 4:.1f}" fill="{ink}">{html.escape(n["label"])} ({flow[n["id"]]:,})</text>')
    heads = "".join(f'<text x="{k * step:.1f}" y="16" fill="{ink}" font-weight="bold">{html.escape(d)}</text>' for k, d in enumerate(data["dimensions"]))
    page = f'<!doctype html><meta charset="utf-8"><title>Sankey</title><body style="background:{paper}"><svg width="{width}" height="{height}" font-family="sans-serif" font-size="12">{heads}{"".join(body)}</svg></body>'
    with open(path, "w", encoding="utf-8") as f:
        f.write(page)


def pool_match_rates(facts_like: DataFrame, pool: Column, matched: Column) -> DataFrame:
    """pool, n, n_matched, rate."""
    rows = facts_like.groupBy(pool.alias("pool")).agg(F.count("*").alias("n"), F.count_if(matched).alias("n_matched"))
    return rows.withColumn("rate", F.col("n_matched") / F.col("n"))


def processing_times(events: DataFrame, key: Column, time: Column, n: int = 10) -> DataFrame:
    """The n keys whose events lie farthest apart: key, seconds."""
    micros = lambda t: F.unix_micros(t.cast("timestamp"))
    rows = events.groupBy(key.alias("key")).agg((micros(F.max(time)) - micros(F.min(time))).alias("micros"))
    return rows.orderBy(F.desc("micros"), "key").limit(n)
