"""Removal of passages that repeat across a corpus, by content-defined chunks of lines.

A rolling hash over the hashes of neighbouring lines decides after which lines a chunk ends, so a
passage is cut alike wherever it stands. A line of ``LONG_WORDS`` words or more (a paragraph
written without breaks) is a chunk by itself. Chunks of two or more lines that are not blank, and
long lines, are compared over the whole corpus: first by hash, then byte by byte with the first
occurrence; all but that one are removed. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfglass.llm.registry import query, read
from shelfglass.staging import stage

#: One line in ``MEAN_LINES`` ends a chunk; words that make a line a paragraph.
MEAN_LINES, LONG_WORDS = 3, 50
#: Slots of the filter that keeps texts of unrepeated chunks from being moved.
SLOTS = 1 << 20

# A word, and text with words on two lines (anchored, so that it is tried once).
_WORD = r"[^\x20\x09-\x0D]+"
_TWO_LINES = r"^[\x20\x09-\x0D]*[^\x20\x09-\x0D][^\n]*\n[\x20\x09-\x0D]*[^\x20\x09-\x0D]"
# Marks between chunks. The text's own marks are escaped first, so they cannot be mistaken.
_MARK, _ESCAPE = "\x01", "\x02"


def _long(line: Column) -> Column:
    # A word and the space after it take two characters.
    return (F.length(line) >= 2 * LONG_WORDS - 1) & (
        F.regexp_count(line, F.lit(_WORD)) >= LONG_WORDS)


def _plain(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(_ESCAPE + "a"), F.lit(_MARK)), F.lit(_ESCAPE + "b"),
                     F.lit(_ESCAPE))


def chunks(text: Column) -> Column:
    """Array of a text's chunks, escaped; joined by line feeds they are the text."""
    escaped = F.replace(F.replace(text, F.lit(_ESCAPE), F.lit(_ESCAPE + "b")), F.lit(_MARK),
                        F.lit(_ESCAPE + "a"))
    lines = F.split(escaped, "\n")
    seen = F.transform(lines, lambda l: F.struct(
        l.alias("line"), _long(l).alias("long"),
        F.conv(F.substring(F.md5(_plain(l).cast("binary")), 1, 7), 16, 10).cast("long").alias("hash")))

    def ended(here, following):
        """The line with a mark if the next line begins another chunk."""
        rolled = (here["hash"] * 31 + following["hash"]) % MEAN_LINES
        return F.when(following["long"] | here["long"] | (rolled == 0),
                      F.concat(here["line"], F.lit(_MARK))).otherwise(here["line"])

    return F.transform(F.array(seen), lambda all: F.split(F.array_join(F.zip_with(
        all, F.slice(all, 2, F.greatest(F.size(all), F.lit(1))),
        lambda here, following: F.when(following.isNull(), here["line"]).otherwise(
            ended(here, following))), "\n"), _MARK + "\n"))[0]


def _comparable(chunk: Column) -> Column:
    """Chunks that count: words on two lines, or a long line."""
    return chunk.rlike(_TWO_LINES) | _long(chunk)


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """Places (key, body, pos) of chunks equal to one that comes earlier, by (key, body, pos).

    ``docs`` has key, body (a hash of the text) and text. Chunks meet by hash in a join, whose hot
    keys Spark splits, never in one task. Texts of chunks are moved only where their hash falls
    into a slot that holds a repeated one; the slots are at most ``SLOTS`` rows, whatever the
    corpus, and passing one decides nothing.
    """
    every = docs.filter(F.col("text").contains("\n") | _long(F.col("text"))).select(
        "key", "body", F.posexplode(chunks(F.col("text"))).alias("pos", "chunk")).filter(
        _comparable(F.col("chunk"))).withColumn("hash", F.xxhash64("chunk"))
    place = F.struct("key", "body", "pos")
    slot = F.pmod("hash", F.lit(SLOTS))
    twice = stage(every.groupBy("hash").agg(
        F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        "hash", "first"), "repeats")
    slots = F.broadcast(twice.select(slot.alias("slot")).distinct())
    found = stage(every.withColumn("slot", slot).join(slots, "slot", "left_semi").join(
        twice, "hash").select("hash", "first", "chunk", place.alias("here")), "chunks")
    firsts = found.filter(F.col("here").eqNullSafe(F.col("first"))).select(
        "hash", F.col("chunk").alias("kept")).dropDuplicates(["hash"])
    return found.filter(~F.col("here").eqNullSafe(F.col("first"))).join(firsts, "hash").filter(
        F.col("chunk") == F.col("kept")).select("here.key", "here.body", "here.pos")


def drop_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the cleaned text and ``n_removed``, the number of chunks taken out.

    The first occurrence, by key (nulls first), then by a hash of the text, then by place, stays.
    Null and empty texts stay as they are, and so does every text without a repeated chunk; a
    text whose chunks all go becomes empty. Rows that repeat key and text share their fate. The
    columns of ``docs`` keep their names and order; a column named n_removed is replaced. An empty
    table gives an empty result.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "n_removed"))
    body = F.col(f"`{text}`").cast("string")
    keyed = docs.select(F.col(key).alias("key"), F.xxhash64(body).alias("body"),
                        body.alias("text"), row.alias("row"))
    gone = stage(repeated_chunks(keyed.select("key", "body", "text")).groupBy("key", "body").agg(
        F.collect_set("pos").alias("gone")), "removed").select(
        F.col("key").alias("_key"), F.col("body").alias("_body"), "gone")
    # Only rows whose slot holds a text to clean meet the list; all others pass as they are.
    slot = F.pmod(F.xxhash64("key", "body"), F.lit(SLOTS))
    slots = F.broadcast(gone.select(F.pmod(F.xxhash64("_key", "_body"), F.lit(SLOTS)).alias(
        "slot")).distinct())
    keyed = keyed.drop("text").withColumn("slot", slot)
    touched = keyed.join(slots, "slot", "left_semi").join(
        gone, F.col("key").eqNullSafe(F.col("_key")) & (F.col("body") == F.col("_body")), "left")
    kept = F.filter(chunks(F.col(f"row.`{text}`")),
                    lambda c, i: ~F.array_contains("gone", i))
    clean = F.when(F.col("gone").isNull(), F.col(f"row.`{text}`")).otherwise(
        _plain(F.array_join(kept, "\n")))
    names = [c for c in docs.columns if c != "n_removed"]
    out = touched.select(*(clean.alias(c) if c == text else F.col(f"row.`{c}`").alias(c)
                           for c in names),
                         F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))
    return out.unionByName(keyed.join(slots, "slot", "left_anti").select(
        "row.*", F.lit(0).cast("long").alias("n_removed")))


SQL = rf"""
WITH doc AS (SELECT row_number() OVER () AS row, doc_id, text FROM documents),
line AS (
    SELECT row, unnest(range(1, len(parts) + 1)) AS i, unnest(parts) AS line
    FROM (SELECT row, string_split(text, chr(10)) AS parts FROM doc WHERE text IS NOT NULL)),
seen AS (
    SELECT row, i, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words,
           CAST('0x' || substr(md5(line), 1, 7) AS BIGINT) AS hash
    FROM line),
started AS (
    SELECT row, i, line, words,
           CASE WHEN words >= {LONG_WORDS} OR lag(words) OVER w >= {LONG_WORDS}
                  OR (lag(hash) OVER w * 31 + hash) % {MEAN_LINES} = 0 THEN 1 ELSE 0 END AS begins
    FROM seen WINDOW w AS (PARTITION BY row ORDER BY i)),
numbered AS (
    SELECT row, i, line, words, sum(CASE WHEN i = 1 THEN 0 ELSE begins END) OVER (
        PARTITION BY row ORDER BY i ROWS UNBOUNDED PRECEDING) AS pos
    FROM started),
chunk AS (
    SELECT row, pos, string_agg(line, chr(10) ORDER BY i) AS chunk,
           count(*) FILTER (words > 0) >= 2 OR max(words) >= {LONG_WORDS} AS counts
    FROM numbered GROUP BY row, pos),
ranked AS (
    SELECT row, pos, chunk, counts AND row_number() OVER (
        PARTITION BY chunk, counts ORDER BY doc_id, row, pos) > 1 AS gone
    FROM chunk JOIN doc USING (row)),
clean AS (
    SELECT row, coalesce(string_agg(chunk, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text,
           count(*) FILTER (gone) AS n_removed
    FROM ranked GROUP BY row)
SELECT doc_id, CASE WHEN n_removed > 0 THEN clean.text ELSE doc.text END AS text,
       coalesce(n_removed, 0) AS n_removed
FROM doc LEFT JOIN clean USING (row)"""


@query("op7_line_chunks", SQL)
def op7_line_chunks(spark, sf_dir):
    return drop_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
