"""Line dedup by a log-template tree, with DataFrame functions only.

A line's tokens are what its spaces separate; tokens with a digit are variable fields. The tree has a fixed depth: the number
of tokens, then the LEAD leading ones, which make a leaf, then SPLITS levels of groups within the leaf:
* A group's template has at each place the token of more than half of its distinct lines, or else a variable field. Lines that
  agree with it in SIMILAR of their tokens are of that template.
* Each other line goes on to a group of the next level, that of those which share its most frequent token at a place where the
  template has a variable field, of equally frequent ones the first. Lines of which too few tokens come in another line of
  the group to be SIMILAR to any go no further.
* What is left after the last level is a template of its own, but for its fields with digits.
So a leaf may hold several templates and any number of lines, and grouping doesn't depend on the order of lines: tokens are
counted by group and place.

Lines of less than LEAST tokens have no variable fields: each is a template as it stands. Blank lines are not counted and stay.

A template that comes in texts that differ is recurring: its lines stay in the document with the least doc_id and are dropped
from all others. A template that only equal texts hold doesn't count, as equal documents are for another operator.

A null text is empty and stays as it is; so do rows with a null doc_id. Of rows with equal doc_id and text the lines are dropped
from each. A document may lose all its lines. Other columns are ignored by `report` and kept by `deduplicate`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberframe.llm.common import Scratch

LEAST = 5
LEAD = 3
SPLITS = 3
SIMILAR = 0.8


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, row (a hash of the text), at, n, lead, masked: all lines but blank ones."""
    each = docs.select("doc_id", F.xxhash64("text").alias("row"), F.posexplode(F.split("text", "\n")).alias("at", "line")).withColumn("line", F.trim("line"))
    each = each.where(F.col("line").rlike(r"\S"))
    each = each.withColumn("n", F.length("line") - F.length(F.replace(F.col("line"), F.lit(" "), F.lit(""))) + 1)
    fields = (F.col("n") >= LEAST) & F.col("line").rlike("[0-9]")
    masked = F.when(fields, F.regexp_replace("line", "(?<![^ ])[^ 0-9]*+[0-9][^ ]*", "<*>")).otherwise(F.col("line"))
    each = each.select("doc_id", "row", "at", "n", masked.alias("masked"))
    return each.select("doc_id", "row", "at", "n", F.substring_index("masked", " ", LEAD).alias("lead"), "masked")


def _templates(told: DataFrame, scratch: Scratch) -> DataFrame:
    """leaf, line, group (the level and group whose template it is of) of the distinct lines (leaf, line, n, masked, lines) that
    are of a template with variable fields. Leading tokens are the same in a leaf, so only others are counted."""
    after = F.posexplode(F.slice(F.split("masked", " "), F.lit(LEAD + 1), F.col("n"))).alias("place", "token")
    tokens = scratch.put(told.select("leaf", "line", F.col("n").cast("int").alias("n"), F.col("leaf").alias("group"), "lines", after).withColumn("token", F.xxhash64("token")), "tokens")
    enough = F.ceil(F.col("n") * F.lit(SIMILAR) - F.lit(1e-9))
    found = []
    for level in range(SPLITS):
        shared = tokens.groupBy("group", "place", "token").agg(F.count("*").cast("int").alias("k"), F.first("lines").alias("lines")).where("k > 1")
        fixed = F.col("k") * 2 > F.col("lines")
        each = tokens.drop("lines").join(shared.select("group", "place", "token", "k", fixed.alias("fixed")), ["group", "place", "token"])
        best = F.max(F.when(~F.col("fixed"), F.struct("k", (-F.col("place")).alias("from_end"), "token")))
        by_line = each.groupBy("leaf", "line", "n", "group").agg((F.count_if("fixed") + LEAD).alias("agree"), (F.count("*") + LEAD).alias("common"), best.alias("best"))
        by_line = scratch.put(by_line.where(F.col("common") >= enough), f"level{level}")
        found.append(by_line.where(F.col("agree") >= enough).select("leaf", "line", F.xxhash64(F.lit(level), "group").alias("group")))
        if level + 1 < SPLITS:
            on = by_line.where((F.col("agree") < enough) & F.col("best").isNotNull()).select("leaf", "line", F.xxhash64("group", "best.from_end", "best.token").alias("group"))
            sized = on.join(on.groupBy("group").agg(F.count("*").alias("lines")).where("lines > 1"), "group")
            tokens = scratch.put(tokens.select("leaf", "line", "n", "place", "token").join(sized, ["leaf", "line"]), "tokens")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def dropped(docs: DataFrame) -> DataFrame:
    """doc_id, row, ats: places of the lines to drop, for the rows that have any."""
    scratch = Scratch(docs.sparkSession)
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    lines = _lines(base).select("doc_id", "row", "at", "n", "masked", F.xxhash64("n", "lead").alias("leaf"), F.xxhash64("masked", F.lit(1)).alias("line"))
    placed = scratch.put(lines.select("doc_id", "row", "at", "leaf", "line"), "placed")
    known = placed.groupBy("leaf", "line").agg(F.min("row").alias("low"), F.max("row").alias("high"), F.min("doc_id").alias("first"))
    known = scratch.put(known, "known")
    several = known.groupBy("leaf").agg(F.count("*").alias("lines")).where("lines > 1")
    told = lines.where(F.col("n") >= LEAST).select("leaf", "line", "n", "masked").join(several, "leaf").dropDuplicates(["leaf", "line"])
    alike = _templates(told, scratch)
    named = known.join(alike, ["leaf", "line"], "left").withColumn("template", F.coalesce("group", "line"))
    counted = named.groupBy("leaf", "template").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("first").alias("first")).where("low != high")
    recurring = scratch.put(named.select("leaf", "line", "template").join(counted.select("leaf", "template", "first"), ["leaf", "template"]).select("leaf", "line", "first"), "recurring")
    gone = placed.join(recurring, ["leaf", "line"]).where("doc_id != first")
    return gone.groupBy("doc_id", "row").agg(F.collect_set("at").alias("ats"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, without the dropped lines. n_chars, where there is such a column, is counted anew."""
    gone = dropped(docs).select(F.col("doc_id").alias("_doc"), F.col("row").alias("_row"), F.col("ats").alias("_ats"))
    text = F.coalesce(F.col("text"), F.lit(""))
    joined = docs.join(gone, (F.col("doc_id") == F.col("_doc")) & (F.xxhash64(text) == F.col("_row")), "left")
    left = F.array_join(F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains("_ats", i)), "\n")
    new = F.when(F.col("_ats").isNull(), F.col("text")).otherwise(left)
    out = [new.alias("text") if c == "text" else F.when(F.col("_ats").isNull(), F.col("n_chars")).otherwise(F.length(left)).cast(dict(docs.dtypes)[c]).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*out)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 (of the text that is left)."""
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = lambda c: F.size(F.split(c, "\n"))
    gone = dropped(base).select(F.col("doc_id").alias("_doc"), F.col("row").alias("_row"), F.col("ats").alias("_ats"))
    joined = base.join(gone, (F.col("doc_id") == F.col("_doc")) & (F.xxhash64("text") == F.col("_row")), "left")
    left = F.when(F.col("_ats").isNull(), F.col("text")).otherwise(F.array_join(F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains("_ats", i)), "\n"))
    return joined.select("doc_id", n("text").cast("long").alias("n_lines"), F.coalesce(F.size("_ats"), F.lit(0)).cast("long").alias("n_dropped"), F.sha2(left, 256).alias("kept_sha256"))


def _levels_sql() -> str:
    """One level of groups after the other; the last one's rest stay as they are."""
    out = f"""
t0 AS (
  SELECT n, lead, masked, '' AS grp, unnest(range({LEAD + 1}, n + 1)) AS place, unnest(tokens[{LEAD + 1}:]) AS token FROM known WHERE lines > 1 AND n >= {LEAST}
)"""
    for i in range(SPLITS):
        out += f""", c{i} AS (
  SELECT n, lead, grp, place, token, count(*) AS k, sum(count(*)) OVER (PARTITION BY n, lead, grp, place) AS m FROM t{i} GROUP BY n, lead, grp, place, token
), p{i} AS (
  SELECT n, lead, grp, masked, {LEAD} + count(*) FILTER (k > 1 AND k * 2 > m) AS agree, {LEAD} + count(*) FILTER (k > 1) AS common,
         arg_max(place || ' ' || token, k * 1000000 - place) FILTER (k > 1 AND k * 2 <= m) AS best
  FROM t{i} JOIN c{i} USING (n, lead, grp, place, token) GROUP BY n, lead, grp, masked
), t{i + 1} AS (
  SELECT t.n, t.lead, t.masked, p.grp || chr(10) || p.best AS grp, t.place, t.token FROM t{i} t JOIN p{i} p USING (n, lead, masked)
  WHERE p.agree < ceil(n * {SIMILAR} - 1e-9) AND p.common >= ceil(n * {SIMILAR} - 1e-9) AND p.best IS NOT NULL
)"""
    return out


#: DuckDB's form of `report`.
SQL = f"""
WITH l AS (
  SELECT doc_id, md5(text) AS digest, generate_subscripts(p, 1) - 1 AS nr, trim(unnest(p)) AS line
  FROM (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS p FROM documents)
), m AS (
  SELECT doc_id, digest, nr, CASE WHEN regexp_matches(line, '[0-9]') AND len(string_split(line, ' ')) >= {LEAST} THEN regexp_replace(line, '[^ ]*[0-9][^ ]*', '<*>', 'g') ELSE line END AS masked
  FROM l WHERE regexp_matches(line, '\\S')
), t AS (
  SELECT *, string_split(masked, ' ') AS tokens, len(string_split(masked, ' ')) AS n FROM m
), s AS (
  SELECT *, array_to_string(tokens[1:{LEAD}], ' ') AS lead FROM t
), known AS (
  SELECT n, lead, masked, tokens, min(digest) AS low, max(digest) AS high, min(doc_id) AS first, count(*) OVER (PARTITION BY n, lead) AS lines
  FROM s GROUP BY n, lead, masked, tokens
),{_levels_sql()}, alike AS (
  {" UNION ALL ".join(f"SELECT n, lead, masked, '{i}' || grp AS template FROM p{i} WHERE agree >= ceil(n * {SIMILAR} - 1e-9)" for i in range(SPLITS))}
), named AS (
  SELECT k.n, k.lead, k.masked, k.low, k.high, k.first, coalesce('of group ' || a.template, 'line ' || k.masked) AS template
  FROM known k LEFT JOIN alike a USING (n, lead, masked)
), counted AS (
  SELECT n, lead, template, min(first) AS first FROM named GROUP BY n, lead, template HAVING min(low) <> max(high)
), gone AS (
  SELECT DISTINCT s.doc_id, s.digest, s.nr FROM s JOIN named USING (n, lead, masked) JOIN counted c USING (n, lead, template) WHERE s.doc_id <> c.first
), counts AS (
  SELECT doc_id, digest, count(*) AS n_dropped FROM gone GROUP BY doc_id, digest
), raw AS (
  SELECT doc_id, md5(text) AS digest, generate_subscripts(p, 1) - 1 AS nr, unnest(p) AS line
  FROM (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS p FROM documents)
), kept AS (
  SELECT r.doc_id, r.digest, string_agg(r.line, chr(10) ORDER BY r.nr) AS text FROM raw r ANTI JOIN gone g USING (doc_id, digest, nr) GROUP BY r.doc_id, r.digest
)
SELECT d.doc_id, len(string_split(coalesce(d.text, ''), chr(10)))::BIGINT AS n_lines, coalesce(c.n_dropped, 0)::BIGINT AS n_dropped, sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN counts c ON c.doc_id = d.doc_id AND c.digest = md5(coalesce(d.text, '')) LEFT JOIN kept k ON k.doc_id = d.doc_id AND k.digest = md5(coalesce(d.text, ''))
"""
