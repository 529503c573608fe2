"""Line deduplication by a log-template tree, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastegraph.llm.spread import join_counted
from tastegraph.llm.storage import written
from tastegraph.plans.lineage import checkpoint

#: Leading tokens of the tree, documents in which a template recurs, most variable fields in a hundred tokens beside
#: numbers, least literal tokens in a hundred.
DEPTH, DOCUMENTS, FREE, LITERAL = 3, 3, 20, 50
#: Tokens from which on a line is long; a template of long lines recurs in two documents already.
LONG, TWO = 20, 2
FIELD = "<*>"


#: Words of 64 bits of the filter that keeps most lines out of the closer look; its size is fixed whatever the input's.
FILTER_WORDS = 1 << 16


def spaced(line: Column) -> Column:
    """The line's tokens with single spaces between."""
    odd = [F.instr(line, x) > 0 for x in ("  ", "\t", "\r", "\f", "\x0b")]
    return F.trim(F.when(odd[0] | odd[1] | odd[2] | odd[3] | odd[4], F.regexp_replace(line, r"[ \t\r\f\x0B]+", " ")).otherwise(line))


def masked(tokens: Column) -> Column:
    """Spaced tokens, those that hold a digit as variable fields."""
    return F.when(tokens.rlike("[0-9]"), F.regexp_replace(tokens, r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*", FIELD)).otherwise(tokens)


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is evaluated once a row: as the item of an array it is not copied into what is made of it later."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _lines(documents: DataFrame, depth: int) -> DataFrame:
    """(d, t, line_no, line, tokens, size, leaf) of every line with a token; d and t name the document.

    Masking a token leaves one token, so the leaf needs the leading tokens masked alone.
    """
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("d"), F.xxhash64("doc_id", "text").alias("t")]
    rows = documents.select(*key, F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    rows = _once(rows, "tokens", spaced(F.col("line"))).where("tokens <> ''")
    rows = rows.withColumn("size", F.length("tokens") - F.length(F.replace("tokens", F.lit(" "), F.lit(""))) + 1)
    return _once(rows, "leaf", F.xxhash64("size", masked(F.substring_index("tokens", " ", depth))))


def _least(long: Column, least: int) -> Column:
    """Documents in which a template of long or of other lines recurs."""
    return F.when(long, min(TWO, least)).otherwise(least)


def _word(leaf: Column) -> Column:
    return F.pmod(leaf, F.lit(FILTER_WORDS)).cast("int")


def _bit(leaf: Column) -> Column:
    return F.pmod(F.shiftright(leaf, 20), F.lit(64)).cast("int")


def recurring_lines(documents: DataFrame, depth: int = DEPTH, least: int = DOCUMENTS, free: int = FREE, literal: int = LITERAL) -> DataFrame:
    """(d, t, line_no) of the lines whose template recurs, but for the first line of each template.

    The tree sorts lines by their number of tokens and then by their leading ``depth`` tokens; only leaves with
    ``least`` lines or more, of long lines two, are looked into. There a token that fewer than ``least`` lines have at its place is a variable field
    too, as long as no more than ``free`` in a hundred tokens are; else the line's own tokens are its template. A line
    less than ``literal`` in a hundred of whose tokens are literal is no template of others and meets its exact repeats only. A
    template recurs if it has lines in ``least`` documents, one of ``LONG`` tokens or more in two; the line of the smallest (doc_id, place) is
    the one that stays.

    Lines travel as hashes. The words of a line are looked at only in busy leaves, which a filter of fixed size tells at the
    scan, before an exact join; equal lines are counted first, so a line that a third of all documents share is one row a task.
    """
    hashed = written(_lines(documents, depth).select(
        "d", "t", "line_no", "leaf", (F.col("size") >= LONG).alias("long"), F.xxhash64(masked(F.col("tokens"))).alias("v"), F.xxhash64("line").alias("own")))
    full = least if (LONG - depth) * 100 >= LONG * literal else min(TWO, least)
    busy = checkpoint(hashed.groupBy("leaf").agg(F.count("*").alias("n"), F.bool_or("long").alias("long")).where(
        F.col("n") >= _least(F.col("long"), least)).select("leaf", (F.col("n") >= full).alias("full")))
    bit = F.expr("shiftleft(1L, cast(pmod(shiftright(leaf, 20), 64) as int))")
    bits = F.broadcast(busy.groupBy(_word(F.col("leaf")).alias("word")).agg(  # at most FILTER_WORDS rows
        F.bit_or(bit).alias("busy"), F.bit_or(F.when(F.col("full"), bit).otherwise(F.lit(0))).alias("full")))

    def likely(lines: DataFrame, which: str) -> DataFrame:
        return lines.withColumn("word", _word(F.col("leaf"))).join(bits.select("word", F.col(which).alias("bits")), "word").where(
            F.getbit("bits", _bit(F.col("leaf"))) == 1).drop("word", "bits")

    found = written(likely(hashed, "busy").join(busy, "leaf").drop("long"))
    counts = found.groupBy("leaf", "v", "full").agg(F.count("*").alias("n"))
    texts = _once(likely(_lines(documents, depth), "full").select("leaf", "tokens", "size"), "masked", masked(F.col("tokens"))).select(
        "leaf", F.xxhash64("masked").alias("v"), "masked", "size").dropDuplicates(["leaf", "v"])
    variants = checkpoint(texts.join(counts.where("full").drop("full"), ["leaf", "v"]))
    tokens = variants.select("leaf", "v", "n", "size", F.posexplode(F.split("masked", " ")).alias("at", "token"))
    common = tokens.where(F.col("at") >= depth).groupBy("leaf", "at", "token").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select(
        "leaf", "at", "token", F.lit(True).alias("common"))
    # the leading tokens are the leaf's own
    judged = tokens.where(F.col("at") >= depth).join(common, ["leaf", "at", "token"], "left").groupBy("leaf", "v").agg(
        F.count(F.when(F.col("common").isNull(), True)).alias("rare"),
        F.count(F.when((F.col("token") == FIELD) | F.col("common").isNull(), True)).alias("fields"),
        F.array_sort(F.collect_list(F.struct("at", F.when(F.col("common"), F.col("token")).otherwise(FIELD).alias("token")))).alias("rest"))
    leading = F.size(F.filter(F.slice(F.split("masked", " "), 1, depth), lambda x: x == FIELD))
    plain = F.col("fields").isNull() | (F.col("rare") == 0) | (F.col("rare") * 100 > F.col("size") * free)
    rest = F.when(plain, F.col("v")).otherwise(F.xxhash64(F.transform("rest", lambda x: x["token"])))
    # how many literal tokens the template keeps
    fields = leading + F.coalesce(F.when(plain, F.col("fields") - F.col("rare")).otherwise(F.col("fields")), F.lit(0))
    general = (F.col("size") - fields) * 100 >= F.col("size") * literal
    templates = variants.join(judged, ["leaf", "v"], "left").select(
        "leaf", "v", "n", (F.col("size") >= LONG).alias("long"), F.when(general, F.xxhash64(plain, rest)).alias("template"))
    # where fewer than ``least`` lines are no token is common, so each is its own template, and a long one is literal enough
    twins = counts.where("not full and n > 1").select("leaf", "v", "n", F.lit(True).alias("long"), F.xxhash64(F.lit(True), "v").alias("template"))
    # a line or a template that stands in a large share of all lines meets its rows where they lie
    named = join_counted(found.drop("full"), templates.unionByName(twins), ["leaf", "v"], "n").select(
        "d", "t", "line_no", "leaf", "long", F.col("template").isNotNull().alias("general"), F.coalesce("template", "own").alias("template"))
    name = ["leaf", "general", "template"]
    held = written(named.groupBy(*name, "d", "t").agg(F.sort_array(F.collect_list("line_no")).alias("lines"), F.bool_or("long").alias("long")))
    recurring = held.groupBy(*name).agg(
        F.count("*").alias("n"), F.bool_or("long").alias("long"), F.min(F.struct("d", "t")).alias("first")).where(
        F.col("n") >= _least(F.col("long"), least)).drop("long")
    kept = F.when(F.struct("d", "t") == F.col("first"), 1).otherwise(0)
    return join_counted(held.drop("long"), recurring, name, "n").select(
        "d", "t", F.explode(F.slice("lines", kept + 1, F.size("lines"))).alias("line_no"))


def drop_lines(documents: DataFrame, depth: int = DEPTH, least: int = DOCUMENTS, free: int = FREE, literal: int = LITERAL) -> DataFrame:
    """The documents with all their columns, ``text`` without the lines of recurring templates, and ``n_lines`` and ``n_dropped`` of it.

    All documents stay, also those that lose every line. Lines without a token stay. A NULL text has no lines and
    stays NULL, a text that loses nothing is unchanged, repeated rows are one document and change alike. Columns of the names
    ``n_lines`` and ``n_dropped`` are replaced.
    """
    dropped = recurring_lines(documents, depth, least, free, literal).groupBy(
        F.col("d").alias("__line_d"), F.col("t").alias("__line_t")).agg(F.collect_set("line_no").alias("__dropped"))
    keyed = documents.withColumns({
        "__d": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "__t": F.xxhash64("doc_id", "text"), "n_lines": F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long")})
    left = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("__dropped", i)), "\n")
    return (
        keyed.join(dropped, (F.col("__d") == F.col("__line_d")) & (F.col("__t") == F.col("__line_t")), "left")
        .withColumns({
            "n_lines": F.greatest("n_lines", F.lit(0)).cast("long"), "n_dropped": F.coalesce(F.size("__dropped"), F.lit(0)).cast("long"),
            "text": F.when(F.col("__dropped").isNull(), F.col("text")).otherwise(left)})
        .select(*[c for c in documents.columns if c not in ("n_lines", "n_dropped")], "n_lines", "n_dropped"))


#: The same in SQL, with texts for hashes.
SQL = """
WITH lines AS (
  SELECT doc_id, i - 1 AS line_no, parts[i] AS line,
         trim(regexp_replace(parts[i], '[ \\t\\r\\f\\v]+', ' ', 'g')) AS spaced
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL) AS d, unnest(range(1, len(parts) + 1)) AS u(i)),
tokens AS (
  SELECT doc_id, line_no, line, list_transform(string_split(spaced, ' '), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS w
  FROM lines WHERE spaced <> ''),
leaves AS (SELECT *, len(w) AS size, w[1:3] AS head, count(*) OVER (PARTITION BY len(w), w[1:3]) AS in_leaf, CASE WHEN len(w) >= 20 THEN 2 ELSE 3 END AS least FROM tokens),
spread AS (SELECT doc_id, line_no, size, head, k, w[k] AS token FROM leaves, unnest(range(4, size + 1)) AS u(k) WHERE in_leaf >= least),
counted AS (SELECT *, count(*) OVER (PARTITION BY size, head, k, token) >= 3 AS common FROM spread),
judged AS (
  SELECT doc_id, line_no, count(*) FILTER (NOT common) AS rare,
         list(CASE WHEN common THEN token ELSE '<*>' END ORDER BY k) AS rest
  FROM counted GROUP BY doc_id, line_no),
shaped AS (
  SELECT l.doc_id, l.line_no, l.line, l.size, l.least,
         CASE WHEN j.rare > 0 AND j.rare * 100 <= l.size * 20 THEN list_concat(l.head, j.rest) ELSE l.w END AS template,
         coalesce(j.rare > 0 AND j.rare * 100 <= l.size * 20, FALSE) AS opened
  FROM leaves AS l LEFT JOIN judged AS j USING (doc_id, line_no) WHERE l.in_leaf >= l.least),
named AS (
  SELECT doc_id, line_no, least,
         CASE WHEN len(list_filter(template, lambda x: x <> '<*>')) * 100 >= size * 50 THEN concat('t', opened, array_to_string(template, ' '))
              ELSE concat('l', line) END AS name
  FROM shaped),
recurring AS (
  SELECT name, min((doc_id, line_no)) AS first FROM named GROUP BY name HAVING count(DISTINCT doc_id) >= max(least)),
dropped AS (SELECT doc_id, list(line_no) AS gone FROM named JOIN recurring USING (name) WHERE (doc_id, line_no) <> first GROUP BY doc_id)
SELECT doc_id, coalesce(len(string_split(text, chr(10))), 0)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_dropped,
       CASE WHEN gone IS NULL THEN text
            ELSE coalesce(array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: NOT list_contains(gone, i - 1)), chr(10)), '') END AS text
FROM documents LEFT JOIN dropped USING (doc_id)
"""
