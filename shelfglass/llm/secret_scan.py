"""Secrets in texts, found through a trigram inverted index.

Every batch of rows is an index shard: the postings of all trigrams that some rule needs are
built once, each rule's Boolean query intersects and merges them, and only the candidates are
verified by the rule's expression. A rule without a mandatory trigram scans the whole shard.
Nothing is shuffled; a lost executor costs its own shards.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfglass.llm import trigrams
from shelfglass.llm.registry import ORACLES, query, read


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``least`` is the fewest characters of ``group`` in a match kept."""

    kind: str
    pattern: str
    ignore_case: bool = False
    group: int = 0
    least: int = 0


# The three base kinds, in the order their spans are listed. A hex or access match
# is a maximal run, so asking for the length in the pattern gives the same matches.
BASE = (
    Rule("assign", r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
                   r"([A-Za-z0-9+/_.=-]+)", ignore_case=True, group=2, least=12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
# Public formats of credentials.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"[rs]k_(live|test)_[0-9A-Za-z]{16,}"),
    Rule("private_key", r"-----BEGIN ([A-Z]+ )*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("bearer", r"bearer\x20+[A-Za-z0-9._~+/-]{20,}", ignore_case=True),
)
RULES = BASE + MORE

#: Characters of text that one index shard holds (a longer text is a shard by itself).
SHARD_CHARS = 4_000_000


def _shards(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > SHARD_CHARS:
            yield start, i
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield start, len(texts)


def _spans(texts: list[str], rules: tuple[Rule, ...]) -> list[list[dict]]:
    """All spans of one shard, ordered by start, then by the order of the rules."""
    asked = [trigrams.derive(r.pattern) for r in rules]
    needed = sorted(set().union(*(trigrams.trigrams_of(q) for q in asked)))
    index = trigrams.TrigramIndex([t.encode("utf-8", "replace") for t in texts], needed)
    found: list[list] = [[] for _ in texts]
    for k, (rule, ask) in enumerate(zip(rules, asked, strict=True)):
        search = trigrams.compiled(rule.pattern, rule.ignore_case).finditer
        for i in index.candidates(ask).tolist():
            for m in search(texts[i]):
                a, b = m.span(rule.group)
                if b - a >= rule.least:
                    found[i].append((m.start(), k, m.end(), m.group()))
    return [[{"kind": rules[k].kind, "start": a, "end": b, "value": v}
             for a, k, b, v in sorted(spans)] for spans in found]


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, key: str = "doc_id",
         text: str = "text") -> DataFrame:
    """One row per row of ``docs``: its key and ``spans`` array<kind, start, end, value>.

    Positions are code points, ends exclusive; spans go by start, then by the order of the rules.
    Matches of one rule are leftmost and do not overlap; those of different rules may. A null or
    empty text has no spans; repeated rows are scanned each; other columns are not read; an empty
    table gives an empty result; the key may be null. Memory: one batch and one shard's index.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                          ("value", pa.string())])
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in _shards(texts):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a),
                     pa.array(_spans(texts[a:b], rules), pa.list_(item))], ["key", "spans"])

    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, f"key {kind}, spans array<struct<kind:string,start:bigint,end:bigint,value:string>>"
    ).withColumnRenamed("key", key)


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of their spans, and all spans as text."""
    base = F.filter("spans", lambda s: s["kind"].isin(*(r.kind for r in BASE)))

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id", *(count(r.kind).alias(f"n_{r.kind}") for r in BASE),
        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


@query("op2_secret_scan")
def op2_secret_scan(spark, sf_dir):
    return digest(scan(read(spark, sf_dir, "documents")))


def _sql() -> str:
    """DuckDB: mark the matches of each rule, split at the marks, add up the lengths before."""
    def text(s):
        return "'" + s.replace("'", "''") + "'"

    rows = ", ".join(
        f"({k}, {text(r.kind)}, {text(('(?i)' if r.ignore_case else '') + r.pattern)}, {r.group}, "
        f"{r.least}, {str(k < len(BASE)).lower()})" for k, r in enumerate(RULES))
    split = "\n    UNION ALL ".join(
        f"SELECT row, {k} AS k, string_split(regexp_replace(text, "
        f"{text(('(?i)' if r.ignore_case else '') + r.pattern)}, chr(57344) || '\\0' || chr(57345), "
        f"'g'), chr(57344)) AS parts FROM d" for k, r in enumerate(RULES))
    kept = " ".join(
        f"WHEN {k} THEN length(regexp_extract(value, "
        f"{text(('(?i)' if r.ignore_case else '') + r.pattern)}, {r.group})) >= {r.least}"
        for k, r in enumerate(RULES) if r.least)
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
rule(k, kind, pattern, grp, least, base) AS (VALUES {rows}),
split AS ({split}),
part AS (
    SELECT row, k, unnest(range(1, len(parts) + 1)) AS i, unnest(parts) AS part FROM split
    WHERE len(parts) > 1),
placed AS (
    SELECT row, k, i, split_part(part, chr(57345), 1) AS value,
           sum(length(replace(part, chr(57345), ''))) OVER (
               PARTITION BY row, k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
               AS start
    FROM part),
span AS (
    SELECT row, k, kind, base, start,
           kind || ':' || CAST(CAST(start AS BIGINT) AS VARCHAR) || ':'
               || CAST(CAST(start + length(value) AS BIGINT) AS VARCHAR) AS item
    FROM placed JOIN rule USING (k)
    WHERE i > 1 AND CASE k {kept} ELSE true END),
per AS (
    SELECT row, count(*) FILTER (kind = 'assign') AS n_assign,
           count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
           string_agg(item, ',' ORDER BY start, k) FILTER (base) AS base_spans,
           string_agg(item, ',' ORDER BY start, k) AS spans
    FROM span GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
       coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base_spans, '')) AS base_sha256,
       coalesce(spans, '') AS spans
FROM d LEFT JOIN per USING (row)"""


ORACLES["op2_secret_scan"] = _sql().strip()
