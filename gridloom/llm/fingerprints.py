"""Document fingerprints: Merkle trees over runs of words, paragraphs and sections, in DataFrame functions only.

Leaves are SHA-256 digests of runs of words; the runs of a paragraph (line) cover it byte for byte, and a run ends after a
word whose MD5 is below RUN_END, in any language, so that an insertion moves no boundary but those beside it. Words of more than
LONG_WORD code points (scripts without blanks, encoded data) are cut the same way between code points. A paragraph's
digest covers those of its runs. A section ends after a paragraph whose digest starts with a zero digit; its digest
covers those of its paragraphs, and the root covers the sections: equal roots mean equal texts.

Trees are compared from above: sections that both have drop out, then paragraphs that both of the differing sections have; the
runs of the paragraphs that are left are matched by the first 32 bits of their digests. The likeness of two fingerprints
is the share of their distinct runs in branches that both have, or matched below. The differing paragraphs locate an edit:
compare_edits() gives the first one and their number, locate_edits() all of them.

Cases: a null text is empty, one empty paragraph; a paragraph of which no word ends a run (one word repeated) is one run; very
long paragraphs are nodes like others; repeated rows have equal results, and the next document of both is the next different row;
rows of one doc_id with different texts are ordered by digest; a null doc_id comes last; the next document of a
lone document is itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import common

RUN_END = "3"
"""Hexadecimal MD5 digests below it end a run: three words in sixteen."""
LONG_WORD = 32
RANGES = 1000
"""Ranges of ids: so many quantiles reach the driver, whatever the table."""


def nodes(text: Column) -> Column:
    """Per paragraph `digest:run run ...`: its digest, and the first 32 bits of those of its runs."""

    def ended(piece: Column) -> Column:
        # no paragraph holds the mark, so that the runs joined are the paragraph
        return F.when(F.md5(piece) < RUN_END, F.concat(piece, F.lit("\n"))).otherwise(piece)

    def word(w: Column) -> Column:
        return F.when(F.length(w) > LONG_WORD, F.array_join(F.transform(F.split(w, ""), ended), "")).otherwise(ended(w))

    def node(p: Column) -> Column:
        marked = F.array_join(F.transform(F.split(p, " ", -1), word), " ")
        found = F.when(p == "", F.array(p)).otherwise(F.array_remove(F.split(marked, "\n", -1), ""))
        leaves = F.transform(found, lambda r: F.sha2(r, 256))
        joined = F.array_join(leaves, " ")
        return F.concat(F.sha2(joined, 256), F.lit(":"), F.regexp_replace(joined, "([0-9a-f]{8})[0-9a-f]{56}", "$1"))

    return F.transform(F.split(text, "\n", -1), node)


def sections(paragraph_nodes: Column) -> Column:
    """Sections, each the nodes of its paragraphs joined by commas."""
    return F.split(F.regexp_replace(F.array_join(paragraph_nodes, ","), r"\b(0[0-9a-f]{63}:[0-9a-f ]+),", "$1;"), ";")


def root(section_nodes: Column) -> Column:
    """The root from the digests of sections, and those from the digests of paragraphs."""
    digest = lambda s: F.sha2(F.concat(F.lit("section:"), F.regexp_replace(s, ":[0-9a-f ]+", "")), 256)
    return F.sha2(F.concat(F.lit("root:"), F.array_join(F.transform(section_nodes, digest), ",")), 256)


def outline(section_nodes: Column) -> Column:
    """Sections as the runs of their paragraphs: commas part paragraphs, blanks runs."""
    return F.transform(section_nodes, lambda s: F.regexp_replace(s, "[0-9a-f]{64}:", ""))


def tree(df: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """df with the columns fingerprint and sections (its outline)."""
    s = sections(nodes(F.coalesce(F.col(text), F.lit(""))))
    with_nodes = df.withColumn(f"{prefix}sections", s)
    return with_nodes.withColumn(f"{prefix}fingerprint", root(F.col(f"{prefix}sections"))).withColumn(f"{prefix}sections", outline(F.col(f"{prefix}sections")))


def children(parents: Column, mark: str) -> Column:
    """Distinct children of the nodes in an array."""
    return F.array_remove(F.array_distinct(F.split(F.array_join(parents, mark), mark)), "")


def runs(outlines: Column) -> Column:
    return F.array_distinct(F.split(F.translate(F.array_join(outlines, " "), ",", " "), " "))


def differing(a: Column, b: Column) -> Column:
    """Paragraphs of b, in order, that a lacks: first the sections that differ, then the paragraphs within them."""
    here, there = F.array_except(b, a), F.array_except(a, b)
    return F.array_except(children(here, ","), children(there, ","))


def likeness(a: Column, b: Column, n_a: Column, n_b: Column) -> Column:
    """From 0 to 1, of two outlines with n_a and n_b distinct runs."""
    left_a, left_b = children(differing(b, a), " "), children(differing(a, b), " ")
    return (n_a - F.size(left_a) + n_b - F.size(left_b) + 2.0 * F.size(F.array_intersect(left_a, left_b))) / (n_a + n_b)


def locate_edits(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, section, paragraph, runs) for each paragraph of tree `new`, numbered from 0, below a section that tree `old` of the key lacks, and absent from such sections of `old`.

    Descends as joins: sections meet by their content, and only the children of those that differ go on.
    """
    sides = [t.select(F.col(key).alias("key"), F.posexplode("sections").alias("section", "node")) for t in (old, new)]
    one, two = (x.join(y, ["key", "node"], "left_anti") for x, y in (sides, sides[::-1]))
    was, now = (t.select("key", "section", F.posexplode(F.split("node", ",")).alias("paragraph", "runs")) for t in (one, two))
    return now.join(was.select("key", "runs").distinct(), ["key", "runs"], "left_anti").select(F.col("key").alias(key), "section", "paragraph", "runs")


def next_rows(ids: DataFrame) -> DataFrame:
    """(rid, next_rid) for distinct rows (doc_id, rid) in descending order, the first after the last.

    The order is cut into ranges at quantiles of doc_id; lead() runs within ranges, and a table of at most
    RANGES + 1 rows links the ranges.
    """
    cuts = sorted(set(ids.approxQuantile("doc_id", [i / RANGES for i in range(1, RANGES)], 0.25 / RANGES)))
    # null ids are in a range of their own, the last in descending order
    ranged = ids.withColumn("range", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(_rank(F.col("doc_id").cast("double"), cuts)))
    inside = W.partitionBy("range").orderBy(F.col("doc_id").desc_nulls_last(), F.col("rid").desc())
    linked = ranged.withColumn("next_rid", F.lead("rid").over(inside)).withColumn("place", F.row_number().over(inside))
    firsts = linked.filter(F.col("place") == 1).select("range", F.col("rid").alias("first_rid"))
    over = W.orderBy(F.col("range").desc())
    chain = firsts.select("range", F.coalesce(F.lead("first_rid").over(over), F.first("first_rid").over(over)).alias("after"))
    return linked.join(F.broadcast(chain), "range").select("rid", F.coalesce("next_rid", "after").alias("next_rid"))


def _rank(x: Column, cuts: list[float]) -> Column:
    """Number of cuts below x: first among each step-th cut, then within the block between two of those."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    blocks = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    heads, doubles = [b[0] for b in blocks], "array<double>"
    below = lambda array: F.size(F.filter(array, lambda c: c < x))
    block = F.greatest(below(F.lit(heads).cast(doubles)) - 1, F.lit(0))
    return block * step + below(F.get(F.lit(blocks).cast(f"array<{doubles}>"), block))


def compare_edits(docs: DataFrame) -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and how alike they and the next one's are.

    Texts shuffle once, by row key, and the two joins reuse that exchange; of the next text only the part that is
    copied moves a second time.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.sha2(text, 256)), 256)
    base = docs.select("doc_id", text.alias("text")).withColumn("rid", key)
    ids = common.save(base.select("doc_id", "rid", F.length("text").cast("long").alias("n_chars")).distinct(), "fingerprint-ids")
    links = common.save(
        next_rows(ids.select("doc_id", "rid")).join(ids.select("rid", F.floor(F.col("n_chars") / 2).cast("int").alias("half")), "rid"), "fingerprint-links"
    )
    common.drop(ids)
    # Only rid, doc_id and text shuffle; both joins read that exchange, and trees are built behind it.
    shuffled = base.select("rid", "doc_id", "text").repartition(F.col("rid"))
    copy = W.partitionBy("rid").orderBy("rid")
    giver = (
        tree(shuffled.withColumn("copy", F.row_number().over(copy)).filter("copy = 1"))
        .select(F.col("rid").alias("next_rid"), F.col("text").alias("next_text"), F.col("sections").alias("next_sections"), F.col("doc_id").alias("next_doc_id"))
        .join(links, "next_rid")
        .select("rid", "next_doc_id", "next_sections", F.expr("substring(next_text, 1, half)").alias("tail"))
    )
    own = tree(shuffled)
    both = own.join(giver, "rid")
    n = F.length("text")
    edited = both.withColumn("edited", F.concat(F.expr("substring(text, 1, length(text) - CAST(floor(length(text) / 2) AS INT))"), F.col("tail")))
    out = tree(edited.withColumn("n_chars", n.cast("long")), "edited", "edited_")
    counted = out.withColumns({f"{p}n_runs": F.size(runs(F.col(f"{p}sections"))) for p in ("", "edited_", "next_")})
    near = lambda p: likeness(F.col("sections"), F.col(f"{p}sections"), F.col("n_runs"), F.col(f"{p}n_runs"))
    counted = counted.withColumn("changed", differing(F.col("sections"), F.col("edited_sections")))
    first = F.array_position(F.split(F.array_join("edited_sections", ","), ","), F.get("changed", F.lit(0))) - 1
    return counted.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        near("edited_").alias("near_edited"),
        near("next_").alias("near_next"),
        "next_doc_id",
        F.size("changed").cast("long").alias("edited_paragraphs"),
        first.cast("long").alias("first_edited"),
    )


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edits(common.table(spark, sf_dir, "documents"))


def _sql_tree(text: str) -> str:
    ended = lambda x: f"CASE WHEN md5({x}) < '{RUN_END}' THEN concat({x}, chr(10)) ELSE {x} END"
    word = f"CASE WHEN length(w) > {LONG_WORD} THEN array_to_string(list_transform(string_split(w, ''), lambda c: {ended('c')}), '') ELSE {ended('w')} END"
    run = f"list_filter(string_split(array_to_string(list_transform(string_split(p, ' '), lambda w: {word}), ' '), chr(10)), lambda r: r <> '')"
    leaves = f"array_to_string(list_transform(CASE WHEN p = '' THEN [p] ELSE {run} END, lambda r: sha256(r)), ' ')"
    node = f"concat(sha256({leaves}), ':', regexp_replace({leaves}, '([0-9a-f]{{8}})[0-9a-f]{{56}}', '\\1', 'g'))"
    return f"string_split(regexp_replace(array_to_string(list_transform(string_split({text}, chr(10)), lambda p: {node}), ','), '\\b(0[0-9a-f]{{63}}:[0-9a-f ]+),', '\\1;', 'g'), ';')"


def _sql_root(sections: str) -> str:
    return f"sha256(concat('root:', array_to_string(list_transform({sections}, lambda s: sha256(concat('section:', regexp_replace(s, ':[0-9a-f ]+', '', 'g')))), ',')))"


def _sql_except(a: str, b: str) -> str:
    return f"list_filter({a}, lambda x: NOT list_contains({b}, x))"


def _sql_children(parents: str, mark: str) -> str:
    return f"list_filter(string_split(array_to_string({parents}, '{mark}'), '{mark}'), lambda x: x <> '')"


def _sql_changed(a: str, b: str) -> str:
    return _sql_except(_sql_children(_sql_except(b, a), ","), _sql_children(_sql_except(a, b), ","))


OP1_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
k AS (SELECT *, sha256(concat(coalesce(CAST(doc_id AS VARCHAR), 'null'), ':', sha256(text))) AS rid FROM d),
o AS (SELECT *, coalesce(lead(rid) OVER w, first_value(rid) OVER w) AS next_rid FROM (SELECT DISTINCT * FROM k)
      WINDOW w AS (ORDER BY doc_id DESC NULLS LAST, rid DESC)),
e AS (SELECT k.doc_id, k.text, n.doc_id AS next_doc_id, n.text AS next_text,
             concat(substring(k.text, 1, length(k.text) - length(k.text) // 2), substring(n.text, 1, length(k.text) // 2)) AS edited
      FROM k JOIN o ON k.rid = o.rid JOIN (SELECT DISTINCT * FROM k) n ON n.rid = o.next_rid),
t AS (SELECT *, {_sql_tree("text")} AS ta, {_sql_tree("edited")} AS tb, {_sql_tree("next_text")} AS tc FROM e),
s AS (SELECT *, {", ".join(f"list_transform(t{x}, lambda x: regexp_replace(x, '[0-9a-f]{{64}}:', '', 'g')) AS s{x}" for x in "abc")} FROM t),
n AS (SELECT *, {", ".join(f"len(list_distinct(string_split(replace(array_to_string(s{x}, ' '), ',', ' '), ' '))) AS n{x}" for x in "abc")},
      {_sql_changed("sa", "sb")} AS ab, {_sql_changed("sb", "sa")} AS ba, {_sql_changed("sa", "sc")} AS ac, {_sql_changed("sc", "sa")} AS ca FROM s),
l AS (SELECT *, {", ".join(f"list_distinct({_sql_children(x, ' ')}) AS l{x}" for x in ("ab", "ba", "ac", "ca"))} FROM n)
SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256, {_sql_root("ta")} AS fingerprint, {_sql_root("tb")} AS edited_fingerprint,
  (na - len(lba) + nb - len(lab) + 2.0::DOUBLE * len(list_intersect(lba, lab))) / (na + nb) AS near_edited,
  (na - len(lca) + nc - len(lac) + 2.0::DOUBLE * len(list_intersect(lca, lac))) / (na + nc) AS near_next,
  next_doc_id, CAST(len(list_distinct(ab)) AS BIGINT) AS edited_paragraphs,
  CAST(list_position(string_split(array_to_string(sb, ','), ','), ab[1]) - 1 AS BIGINT) AS first_edited
FROM l
"""
