"""Line dedup by a log-template tree of fixed depth. DataFrame functions only.

A line goes down the tree by its number of tokens and its first LEADING tokens, tokens with a digit counting as "<*>". At a leaf, a
token is part of the template if at least min_docs lines of different documents have it at its position; the other fields are
variable and become "<*>". A template of which at least SAME of the tokens are fixed, and which at least min_docs documents hold, is
recurring, and all its lines are dropped.

In a large corpus every value of a variable field is in min_docs documents. So a node of the tree has at most CHILDREN children: where a
leaf has more such tokens at a position, only those in one of CHILDREN of the leaf's lines count, and the others are variable. A line
whose template changes by that has a second one, of which SAME of the tokens after the leading ones must be fixed; its lines are
dropped if either is recurring.

Only leaves that min_docs documents reach can hold a recurring template, so all other lines stop after the first count. Lines are
counted once for each document and aggregated before each shuffle; equal lines are one row from then on.

Lines meet by two 64-bit hashes, so what is broadcast or shuffled doesn't grow with their length, and lines of very many documents leave
before lines are joined. Lines end at a line feed. Lines without tokens stay. Very long texts are rows as any other. Nulls: a null text has no lines and stays null; a null doc_id is kept. Each row is
a document: repeated rows count as often as they occur. Empty input, empty output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import free, small, table, written

MIN_DOCS, LEADING, SAME, CHILDREN = 3, 2, 0.5, 20
#: Lines of more documents need not be joined to tell whether they recur.
HOT = 1000
GAP = r"[\x20\x09-\x0D]+"


def _tokens(line: Column) -> Column:
    """Split at white space; lines with other white space than spaces take the slower way."""
    other = F.regexp_like(line, F.lit(r"[\x09\x0B-\x0D]"))
    return F.array_remove(F.when(other, F.split(line, GAP)).otherwise(F.split(line, " ")), "")


def _masked(token: Column) -> Column:
    return F.when(token.rlike("[0-9]"), F.lit("<*>")).otherwise(token)


def _leaf_of(tokens: Column) -> Column:
    """Number of tokens and the leading ones; null for a line without tokens."""
    lead = [F.coalesce(_masked(F.get(tokens, i)), F.lit("")) for i in range(LEADING)]
    return F.when(F.size(tokens) > 0, F.concat_ws(" ", F.size(tokens).cast("string"), *lead))


def _leaves(lines: Column) -> Column:
    """The leaf of each line; each is split once."""
    return F.transform(F.transform(lines, _tokens), _leaf_of)


def _key(docs: DataFrame) -> list[Column]:
    return [docs["doc_id"], F.xxhash64(docs["text"]).alias("text_hash")]


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, same: float = SAME) -> DataFrame:
    """A written table: the lines (column line, distinct) that belong to recurring templates, and their template."""
    leaves = docs.select(F.explode(F.array_distinct(_leaves(_lines(docs["text"])))).alias("leaf")).where(F.col("leaf").isNotNull()).groupBy("leaf").count()
    leaves = written(leaves.where(F.col("count") >= min_docs).select("leaf", F.monotonically_increasing_id().alias("leaf_id")), "line-leaves")
    lines = docs.select(*_key(docs), F.array_distinct(_lines(docs["text"])).alias("lines"))
    lines = lines.select("doc_id", "text_hash", F.inline(F.arrays_zip("lines", _leaves(F.col("lines")).alias("leaf"))))
    lines = lines.toDF("doc_id", "text_hash", "line", "leaf")
    lines = written(lines.join(small(leaves), "leaf").drop("leaf"), "line-candidates")
    distinct = lines.groupBy("leaf_id", "line").agg(F.count("*").alias("docs"))
    distinct = written(distinct.select("*", F.monotonically_increasing_id().alias("line_id")), "line-distinct")
    tokens = distinct.select("leaf_id", "line_id", "docs", F.posexplode(F.transform(_tokens(F.col("line")), _masked)).alias("at", "token"))
    fixed = tokens.groupBy("leaf_id", "at", "token").agg(F.sum("docs").alias("times")).where((F.col("times") >= min_docs) & (F.col("token") != "<*>"))
    fixed = written(fixed, "line-fixed")
    # All lines of a leaf have as many tokens, so that a leaf's total is that of each position.
    crowded = fixed.groupBy("leaf_id", "at").count().where(F.col("count") > CHILDREN).select("leaf_id", "at")
    crowded = written(crowded.join(distinct.groupBy("leaf_id").agg(F.sum("docs").alias("total")), "leaf_id"), "line-crowded")
    steady = F.col("total").isNull() | (F.col("times") * CHILDREN >= F.col("total"))
    fixed = fixed.join(small(crowded), ["leaf_id", "at"], "left").select("leaf_id", "at", "token", steady.alias("steady"))
    parts = tokens.drop("docs").join(fixed, ["leaf_id", "at", "token"], "left")
    kept = lambda where: F.when(where, F.col("token")).otherwise(F.lit("<*>"))
    parts = parts.select("line_id", "at", kept(F.col("steady").isNotNull()).alias("one"), kept(F.coalesce("steady", F.lit(False))).alias("two"))
    parts = parts.groupBy("line_id").agg(F.array_sort(F.collect_list(F.struct("at", "one", "two"))).alias("parts"))
    one, two = F.col("parts.one"), F.col("parts.two")
    share = lambda tokens: F.try_divide(F.size(F.filter(tokens, lambda t: t != "<*>")), F.size(tokens))
    after = F.slice(two, LEADING + 1, F.greatest(F.lit(1), F.size(two)))
    ways = F.array(F.when(share(one) >= same, F.concat_ws(" ", one)), F.when((one != two) & (share(after) >= same), F.concat_ws(" ", two)))
    templates = parts.select("line_id", F.explode(F.filter(ways, lambda t: t.isNotNull())).alias("template"))
    templates = written(templates.join(distinct, "line_id").select("line", "docs", "template"), "line-templates")
    most = templates.groupBy("template").agg(F.max("docs").alias("most"))
    sure = most.where(F.col("most") >= min_docs).select("template")
    # No line of the other templates is in min_docs documents; together they may be.
    rare = templates.join(most.where(F.col("most") < min_docs), "template").select(*_hashes("line"), "template")
    hot = written(distinct.where(F.col("docs") > max(HOT, min_docs)).select(*_hashes("line")).distinct(), "line-hot")
    cool = lines.select("doc_id", "text_hash", *_hashes("line")).join(small(hot), ["h1", "h2"], "left_anti")
    spread = cool.join(rare, ["h1", "h2"]).groupBy("template", "doc_id", "text_hash", "h1").agg(F.count("*").alias("equal_rows"))
    spread = spread.groupBy("template", "doc_id", "text_hash").agg(F.max("equal_rows").alias("equal_rows"))
    spread = spread.groupBy("template").agg(F.sum("equal_rows").alias("docs")).where(F.col("docs") >= min_docs).select("template")
    out = templates.join(sure.union(spread), "template").groupBy("line").agg(F.min("template").alias("template"))
    return written(out, "line-recurring")


def _hashes(line: str) -> list[Column]:
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), F.col(line)).alias("h2")]


def drop_lines(docs: DataFrame, min_docs: int = MIN_DOCS, same: float = SAME) -> DataFrame:
    """docs (doc_id, text and any others) with the text's recurring lines dropped; adds n_lines and n_dropped, replacing such columns."""
    recurring = written(recurring_lines(docs.select("doc_id", "text"), min_docs, same).select(*_hashes("line")), "line-recurring-hashes")
    at = docs.select(*_key(docs), F.posexplode(_lines(docs["text"])).alias("at", "line")).select("doc_id", "text_hash", "at", *_hashes("line"))
    dropped = at.join(small(recurring), ["h1", "h2"], "left_semi").groupBy("doc_id", "text_hash").agg(F.collect_set("at").alias("gone"))
    d, h, gone = free(docs, "lt_doc"), free(docs, "lt_hash"), free(docs, "lt_gone")
    dropped = dropped.select(F.col("doc_id").alias(d), F.col("text_hash").alias(h), F.col("gone").alias(gone))
    rows = docs.join(dropped, docs["doc_id"].eqNullSafe(dropped[d]) & F.xxhash64(docs["text"]).eqNullSafe(dropped[h]), "left")
    n = F.coalesce(F.size(_lines(F.col("text"))), F.lit(0))
    kept = F.array_except(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), F.col(gone))
    # Split once for a text: what stands in a function of an array's elements is worked out for each of them.
    once = F.transform(F.array(F.struct(_lines(F.col("text")).alias("lines"), kept.alias("kept"))), lambda t: F.array_join(F.transform(t["kept"], lambda i: F.get(t["lines"], i)), "\n"))
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.get(once, 0))
    n_lines, n_dropped = F.when(F.col("text").isNull(), 0).otherwise(n), F.greatest(F.coalesce(F.size(gone), F.lit(0)), F.lit(0))
    return rows.withColumns({"n_lines": n_lines, "n_dropped": n_dropped, "text": text}).drop(d, h, gone)


def op5_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


_SQL_TOKENS = r"regexp_extract_all(line, '[^\x20\x09-\x0D]+')"
_SQL_MASK = "CASE WHEN regexp_matches({0}, '[0-9]') THEN '<*>' ELSE {0} END"
OP5_SQL = rf"""
WITH split AS (SELECT row_number() OVER () AS row, doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
placed AS (SELECT row, unnest(lines) AS line, unnest(range(0, len(lines))) AS pos FROM split),
tokened AS (SELECT row, pos, line, {_SQL_TOKENS} AS tokens FROM placed),
leafed AS (
  SELECT row, pos, line, tokens, concat(len(tokens), ' ', {_SQL_MASK.format("tokens[1]")}, ' ', coalesce({_SQL_MASK.format("tokens[2]")}, '')) AS leaf
  FROM tokened WHERE len(tokens) > 0),
leaves AS (SELECT leaf FROM leafed GROUP BY leaf HAVING count(DISTINCT row) >= {MIN_DOCS}),
lines AS (SELECT DISTINCT row, leaf, line, tokens FROM leafed SEMI JOIN leaves USING (leaf)),
dist AS (SELECT leaf, line, any_value(tokens) AS tokens, count(*) AS docs FROM lines GROUP BY leaf, line),
tok AS (SELECT leaf, line, docs, unnest(tokens) AS raw, unnest(range(0, len(tokens))) AS pos FROM dist),
masked AS (SELECT leaf, line, docs, pos, {_SQL_MASK.format("raw")} AS token FROM tok),
fixed AS (SELECT leaf, pos, token, sum(docs) AS times FROM masked WHERE token <> '<*>' GROUP BY leaf, pos, token HAVING sum(docs) >= {MIN_DOCS}),
crowded AS (SELECT leaf, pos FROM fixed GROUP BY leaf, pos HAVING count(*) > {CHILDREN}),
totals AS (SELECT leaf, sum(docs) AS total FROM dist GROUP BY leaf),
steady AS (SELECT f.leaf, f.pos, f.token, c.leaf IS NULL OR f.times * {CHILDREN} >= t.total AS steady
  FROM fixed f JOIN totals t USING (leaf) LEFT JOIN crowded c ON c.leaf = f.leaf AND c.pos = f.pos),
parts AS (SELECT m.leaf, m.line, m.pos, CASE WHEN f.token IS NULL THEN '<*>' ELSE m.token END AS one, CASE WHEN f.steady THEN m.token ELSE '<*>' END AS two
  FROM masked m LEFT JOIN steady f ON f.leaf = m.leaf AND f.pos = m.pos AND f.token = m.token),
ways AS (SELECT leaf, line, string_agg(one, ' ' ORDER BY pos) AS one, string_agg(two, ' ' ORDER BY pos) AS two,
  count(*) FILTER (one <> '<*>') / count(*)::DOUBLE AS share_one,
  count(*) FILTER (two <> '<*>' AND pos >= {LEADING}) / nullif(count(*) FILTER (pos >= {LEADING}), 0)::DOUBLE AS share_two FROM parts GROUP BY leaf, line),
templates AS (SELECT leaf, line, one AS template FROM ways WHERE share_one >= {SAME}
  UNION ALL SELECT leaf, line, two FROM ways WHERE one <> two AND share_two >= {SAME}),
recurring AS (SELECT t.template FROM templates t JOIN lines l USING (line) GROUP BY t.template HAVING count(DISTINCT row) >= {MIN_DOCS}),
bad AS (SELECT DISTINCT line FROM templates SEMI JOIN recurring USING (template)),
flagged AS (SELECT a.row, a.pos, a.line, b.line IS NOT NULL AS gone FROM placed a LEFT JOIN bad b ON a.line = b.line),
kept AS (SELECT row, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text FROM flagged GROUP BY row)
SELECT s.doc_id, CASE WHEN s.text IS NOT NULL THEN k.text END AS text, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_dropped, 0) AS n_dropped
FROM split s LEFT JOIN kept k USING (row)"""
