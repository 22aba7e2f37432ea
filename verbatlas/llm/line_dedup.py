"""Line dedup by a deletion-neighbourhood join, in DataFrame operations only.

A line goes if an earlier one, in the order of (doc_id, line number), equals it or is one edit away (a
character put in, taken out or replaced). Lines of fewer than MIN_CHARS characters always stay.

Two lines one edit apart agree outside one of s segments, for any s. Lines are first grouped by what lies
outside a half, then, those that met another, outside an eighth. What still met another emits its deletion
variants inside that eighth as hashed keys:
  replaced  lines of length m at one variant and position differ in that character alone
  put in    a line of length m meets, under its own hash, lines of length m + 1 with that deletion
Lines are distinct there, so a key holds no more of them than the alphabet has letters (times positions),
however often a line occurs. Each line looks at the earliest partner of each key, so no pair of a group but
those is made, and edit distance is then verified on the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from verbatlas.llm import common

MIN_CHARS = 20
LAST = 2**63 - 1  # where a null doc_id stands in the order


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, place (of the id), row_hash (tells rows of one id apart) and text."""
    base = common.id_and_text(docs)
    return base.withColumn("place", F.coalesce("doc_id", F.lit(LAST))).withColumn("row_hash", F.xxhash64("text"))


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    rows = _rows(docs).select("place", "row_hash", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return rows.where(F.length("line") >= min_chars).withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), "line")})


def _outside(line: Column, m: Column, segment: int, of: int) -> Column:
    """Hash of a line without one segment; m: length of the shorter line of a pair."""
    left, right = F.floor(m * segment / of).cast("int"), F.floor(m * (segment + 1) / of).cast("int")
    return F.xxhash64(m, F.lit(segment), F.left(line, left), F.right(line, m - right))


def _met(lines: DataFrame, keys: list[Column], *also: str) -> DataFrame:
    """(h1, h2, m, segment) of the lines that share a key with another; keys: structs of m, segment, key."""
    dealt = lines.select("h1", "h2", *also, F.explode(F.array(*keys)).alias("k")).select("h1", "h2", *also, "k.*")
    shared = dealt.groupBy("m", "segment", "key").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return dealt.join(shared, ["m", "segment", "key"]).drop("key")


def _keys(of: int) -> list[Column]:
    n = F.col("n")
    return [F.struct(m.alias("m"), F.lit(s).alias("segment"), _outside(F.col("line"), m, s, of).alias("key")) for m in (n, n - 1) for s in range(of)]


def distinct_lines(lines: DataFrame) -> DataFrame:
    """(h1, h2, first, times, halves), stored: first occurrence, number of occurrences, and the keys of what lies
    outside each half. lines: place, row_hash, line_no, line, h1, h2 of every occurrence."""
    n = F.length("line")
    halves = [F.struct(m.alias("m"), F.lit(s).alias("segment"), _outside(F.col("line"), m, s, 2).alias("key")) for m in (n, n - 1) for s in range(2)]
    own = lines.groupBy("h1", "h2").agg(F.min(F.struct("place", "line_no", "row_hash")).alias("first"), F.count("*").alias("times"), F.first(F.array(*halves)).alias("halves"))
    return common.stored(own, "lines")


def near_lines(lines: DataFrame, distinct: DataFrame) -> DataFrame:
    """(h1, h2) of the distinct lines that an earlier line is one edit away from; distinct: of distinct_lines()."""
    dealt = distinct.select("h1", "h2", "first", F.explode("halves").alias("k")).select("h1", "h2", "first", "k.*")
    shared = dealt.groupBy("m", "segment", "key").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    half_met = dealt.join(shared, ["m", "segment", "key"]).select("h1", "h2", F.col("first.place").alias("place"), F.col("first.line_no").alias("line_no"), F.col("first.row_hash").alias("row_hash")).distinct()
    where = ["place", "row_hash", "line_no"]
    texts = common.stored(lines.select(*where, "line").join(half_met, where).dropDuplicates(["h1", "h2"]).withColumn("n", F.length("line")), "half-met")

    met = _met(texts, _keys(8), "place", "line_no", "line", "n")
    start, end = F.floor(F.col("m") * F.col("segment") / 8).cast("int"), F.floor(F.col("m") * (F.col("segment") + 1) / 8).cast("int")
    short = F.col("n") == F.col("m")

    def without(i: Column) -> Column:
        return F.concat(F.left(F.col("line"), i - 1), F.substr(F.col("line"), i + 1))

    def key(kind: Column, text: Column) -> Column:
        return F.struct(kind.alias("kind"), F.xxhash64(F.col("m"), kind, text).alias("a"), F.xxhash64(text, F.col("m")).alias("b"))

    span = F.when(short, end - start).otherwise(end - start + 1)
    positions = F.when(span > 0, F.sequence(start + 1, start + F.greatest(span, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    variants = F.transform(positions, lambda i: key(F.when(short, i).otherwise(F.lit(0)), without(i)))
    own = F.when(short, F.array(key(F.lit(0), F.col("line")))).otherwise(F.array().cast(variants_type()))
    emitted = met.select("h1", "h2", "place", "line_no", short.alias("short"), "m", F.explode(F.concat(own, variants)).alias("k")).select("h1", "h2", "place", "line_no", "short", "m", "k.*").distinct()
    at = F.struct("place", "line_no", "h1", "h2")
    group = W.partitionBy("m", "kind", "a", "b")
    partner = F.when(F.col("kind") > 0, F.min(at).over(group)).when(F.col("short"), F.min(F.when(~F.col("short"), at)).over(group)).otherwise(F.min(F.when(F.col("short"), at)).over(group))
    pairs = emitted.withColumn("to", partner).where((F.col("to.place") < F.col("place")) | ((F.col("to.place") == F.col("place")) & (F.col("to.line_no") < F.col("line_no")))).select("h1", "h2", F.col("to.h1").alias("g1"), F.col("to.h2").alias("g2")).distinct()
    a, b = texts.select("h1", "h2", F.col("line").alias("line_a")), texts.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("line").alias("line_b"))
    close = pairs.join(a, ["h1", "h2"]).join(b, ["g1", "g2"]).where(F.levenshtein("line_a", "line_b", 1) >= 0)
    return close.select("h1", "h2").distinct()


def variants_type() -> str:
    return "array<struct<kind:int,a:bigint,b:bigint>>"


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(place, row_hash, drops): the numbers of the lines that go, of every row that loses some."""
    lines = _lines(docs, min_chars)
    distinct = distinct_lines(lines)
    near = near_lines(lines, distinct).withColumn("near", F.lit(True))
    many = distinct.select("h1", "h2", "first", "times")
    gone = many.join(near, ["h1", "h2"], "left").where("near or times > 1").select("h1", "h2", "first", F.coalesce("near", F.lit(False)).alias("near"))
    hits = lines.select("place", "row_hash", "line_no", "h1", "h2").join(gone, ["h1", "h2"])
    drops = hits.where((F.col("first.place") < F.col("place")) | ((F.col("first.place") == F.col("place")) & (F.col("first.line_no") < F.col("line_no"))) | F.col("near")).groupBy("place", "row_hash").agg(F.collect_set("line_no").alias("drops"))
    return common.sent_if_small(common.stored(drops, "drops"), F.size("drops") + 3)  # then no text has to move


def _split(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _without(text: Column, drops: Column) -> Column:
    return F.array_join(F.filter(_split(text), lambda _, i: ~F.array_contains(drops, i)), "\n")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, place, row_hash, text, kept, n_lines, n_dropped) of every row; kept: the text of the lines that stay.

    Null texts are empty; an empty text is one empty line. Null ids stand last in the order. Rows of one
    doc_id share its place, so none of their lines of one number is earlier than another. Other columns are
    ignored; an empty table gives an empty result.
    """
    out = _rows(docs).join(dropped_lines(docs, min_chars), ["place", "row_hash"], "left")
    kept = F.when(F.col("drops").isNull(), F.col("text")).otherwise(_without(F.col("text"), F.col("drops")))
    return out.select("doc_id", "place", "row_hash", "text", kept.alias("kept"), F.size(_split(F.col("text"))).alias("n_lines"), F.coalesce(F.size("drops"), F.lit(0)).alias("n_dropped"))


def query(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(common.read(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.col("kept").alias("text"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with the text (and n_chars, where it has one) that stays; documents that lose all they had go."""
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(F.struct("*").alias("row"), F.coalesce("doc_id", F.lit(LAST)).alias("place"), F.xxhash64(text).alias("row_hash"))
    joined = keyed.join(dropped_lines(docs), ["place", "row_hash"], "left")
    kept = F.when(F.col("drops").isNotNull(), _without(F.col("row.text"), F.col("drops")))
    out = joined.select("row", kept.alias("kept")).where("kept is null or trim(kept) <> ''")
    changed = F.col("row").withField("text", F.col("kept"))
    if "n_chars" in docs.columns:
        changed = changed.withField("n_chars", F.length("kept").cast(docs.schema["n_chars"].dataType))
    return out.select(F.when(F.col("kept").isNull(), F.col("row")).otherwise(changed).alias("row")).select("row.*")


SQL = f"""
WITH l AS (
  SELECT doc_id, unnest(range(len(p))) AS line_no, unnest(p) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents)
), d AS (
  SELECT line, length(line) AS n, min(struct_pack(d := doc_id, i := line_no)) AS pos
  FROM l WHERE length(line) >= {MIN_CHARS} GROUP BY line
), m AS (SELECT *, n AS m FROM d UNION ALL SELECT *, n - 1 FROM d),
k AS (
  SELECT line, n, pos, m, 0 AS side, left(line, (m // 2)::BIGINT) AS key FROM m
  UNION ALL SELECT line, n, pos, m, 1, right(line, (m - m // 2)::BIGINT) FROM m
), near AS (
  SELECT DISTINCT b.line
  FROM k a JOIN k b ON a.m = b.m AND a.side = b.side AND a.key = b.key AND a.pos < b.pos
  WHERE CASE WHEN a.n = b.n
    THEN list_sum(list_transform(range(1, a.n + 1), lambda i: CASE WHEN a.line[i] <> b.line[i] THEN 1 ELSE 0 END)) <= 1
    ELSE len(list_filter(range(1, greatest(a.n, b.n) + 1), lambda i:
      CASE WHEN a.n < b.n THEN left(b.line, i - 1) || substring(b.line, i + 1) = a.line
      ELSE left(a.line, i - 1) || substring(a.line, i + 1) = b.line END)) > 0 END
), o AS (
  SELECT l.doc_id, l.line_no, l.line, d.line IS NOT NULL
    AND (near.line IS NOT NULL OR d.pos < struct_pack(d := l.doc_id, i := l.line_no)) AS gone
  FROM l LEFT JOIN d ON d.line = l.line LEFT JOIN near ON near.line = l.line
)
SELECT doc_id, CAST(count(*) AS INTEGER) AS n_lines, CAST(count(*) FILTER (gone) AS INTEGER) AS n_dropped,
  coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT gone), '') AS text
FROM o GROUP BY doc_id
"""
