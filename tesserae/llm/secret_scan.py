"""Secret scans judged by corpus-wide ownership.

Base kinds (assignments of secrets, access keys, long hex runs) are always
reported. The method adds generic candidates: unbroken strings of mixed
letters and digits with high entropy that no base span touches. The hash of
every candidate, base or generic, is counted over the corpus by distinct owners
and, if a column of them is named, distinct repositories. A string that several
owners hold is a widely copied example; one of few owners looks live. However
often one owner repeats a string, it stays that owner's. Generic candidates are
reported only if they look live.

Spans are code points, end exclusive, sorted by start and then by kind in the
listed order. Counting goes through two shuffles of hashes with partial sums,
never through texts. Only hashes of shared strings go back to the spans; one
that fills a large part of all spans is sent to where they are. Redaction scans
each text again in place, so no text is shuffled, as long as the hashes of
shared generic strings are at most ``SENT_HASHES``; beyond that the spans are
joined to their texts.

Defined cases: null and empty texts have no spans; null owners and repositories
count as one of their own; repeated rows are reported one by one; an empty table
gives an empty table; other columns pass by, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm._common import free_name, join_counted, schema_of, stored

#: Fixed by the contract: patterns and the fewest characters of what they find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
MIN_ASSIGN, MIN_ACCESS = 12, 18
KINDS = ("assign", "access", "hex", "generic")

GENERIC = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{24,}(?![A-Za-z0-9+/_=-])")
#: Bits a character from which a generic string counts as random.
ENTROPY = 3.8
#: From so many distinct owners on a string is widely copied, or from fewer but several ones with so many repositories.
SHARED_OWNERS, SEVERAL_OWNERS, SHARED_REPOS = 3, 2, 10

Span = tuple[int, int, int, str]  # start, kind, end, secret


def base_spans(text: str) -> list[Span]:
    out = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out)


def _random(s: str) -> bool:
    if not (re.search("[0-9]", s) and re.search("[A-Z]", s) and re.search("[a-z]", s)):
        return False
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) >= ENTROPY


def spans(text: str) -> list[Span]:
    """Base spans and generic candidates of a text."""
    base = base_spans(text)
    extra = [(m.start(), 3, m.end(), m[0]) for m in GENERIC.finditer(text) if _random(m[0])]
    if not base or not extra:
        return base + extra
    # Both are sorted by start; ``reach`` is where the base spans that begin before a candidate's end stop.
    free, at, reach = [], 0, 0
    for x in extra:
        while at < len(base) and base[at][0] < x[2]:
            reach = max(reach, base[at][2])
            at += 1
        if reach <= x[0]:
            free.append(x)
    return sorted(base + free)


def digest(secret: str) -> str:
    return hashlib.sha256(secret.encode("utf-8", "surrogatepass")).hexdigest()[:32]


#: Hashes of shared generic strings that are sent to all executors for redaction: 10 MB at most.
SENT_HASHES = 100_000
SCAN = "struct<kind:int,start:bigint,end:bigint,hash:string>"
_ARROW = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("hash", pa.string())]))


def scan(df: DataFrame, id_col: str = "doc_id", text: str = "text", owner: str = "source", repo: str | None = None) -> DataFrame:
    """Rows ``row, id, owner, repo, hash, found`` of ``df``; ``found`` are the spans. Stored, so ``row`` is fixed.

    Without a column of repositories none are told apart: documents are not repositories.
    """
    fields = [("id", "long"), ("owner", "string"), ("repo", "string"), ("text_hash", "long")]
    slim = df.select(F.col(id_col).cast("long").alias("id"), F.col(owner).cast("string").alias("owner"), (F.col(repo) if repo else F.lit(None)).cast("string").alias("repo"), F.xxhash64(text).alias("text_hash"), F.col(text).cast("string").alias("text"))
    schema = schema_of([*fields, ("found", f"array<{SCAN}>")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[{"kind": k, "start": s, "end": e, "hash": digest(x)} for s, k, e, x in spans(t or "")] for t in b.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(found, _ARROW)], names=[*(n for n, _ in fields), "found"])

    return stored(slim.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "secrets")


def ownership(scanned: DataFrame) -> DataFrame:
    """Per candidate hash: ``owners``, ``repos`` (distinct), ``n_rows`` (spans), ``generic`` (some span is), ``shared``."""
    each = scanned.select("owner", "repo", F.explode("found").alias("s")).select("owner", "repo", F.col("s.hash").alias("hash"), (F.col("s.kind") == 3).alias("generic")).fillna("\0", ["owner", "repo"])
    owned = each.groupBy("hash", "owner").agg(F.count("*").alias("n"), F.max("generic").alias("g")).groupBy("hash").agg(F.count("*").alias("owners"), F.sum("n").alias("n_rows"), F.max("g").alias("generic"))
    kept = each.select("hash", "repo").distinct().groupBy("hash").agg(F.count("*").alias("repos"))
    return owned.join(kept, "hash").withColumn("shared", (F.col("owners") >= SHARED_OWNERS) | ((F.col("owners") >= SEVERAL_OWNERS) & (F.col("repos") >= SHARED_REPOS)))


def _joined(found: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(df: DataFrame, id_col: str = "doc_id", **columns: str | None) -> DataFrame:
    """One row per row of ``df``: id, counts by base kind, digests of the spans, ``n_live``, ``n_shared``, ``reported``.

    ``reported`` lists (kind, start, end, hash, shared) of every reported span.
    """
    scanned = scan(df, id_col=id_col, **columns)
    return _reported(scanned, stored(ownership(scanned).where("shared"), "shared-secrets"), id_col)


def _reported(scanned: DataFrame, common: DataFrame, id_col: str) -> DataFrame:
    hits = scanned.where(F.size("found") > 0).select("row", F.explode("found").alias("s"), F.col("s.hash").alias("hash"))
    judged = join_counted(hits, common.select("hash", "n_rows", "shared"), ["hash"], "left").withColumn("shared", F.coalesce("shared", F.lit(False)))
    judged = judged.where((F.col("s.kind") < 3) | ~F.col("shared"))
    item = F.struct(F.col("s.start").alias("start"), F.col("s.kind").alias("kind"), F.col("s.end").alias("end"), "hash", "shared")
    reports = judged.groupBy("row").agg(F.sort_array(F.collect_list(item)).alias("reported"))
    out = scanned.join(reports, "row", "left").withColumn("reported", F.coalesce("reported", F.array().cast("array<struct<start:bigint,kind:int,end:bigint,hash:string,shared:boolean>>")))

    def count(kind: int) -> Column:
        return F.size(F.filter("reported", lambda s: s["kind"] == kind)).cast("long")

    return out.select(
        F.col("id").alias(id_col),
        "text_hash",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_joined(F.filter("reported", lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
        _joined(F.col("reported")).alias("spans"),
        F.size(F.filter("reported", lambda s: ~s["shared"])).cast("long").alias("n_live"),
        F.size(F.filter("reported", lambda s: s["shared"])).cast("long").alias("n_shared"),
        "reported",
    )


def redact(df: DataFrame, id_col: str = "doc_id", text: str = "text", n_chars: str | None = "n_chars", **columns: str | None) -> DataFrame:
    """``df`` with every reported span replaced by ``[kind]``; the same rows and columns.

    Overlapping spans are replaced as one, under the first one's kind. ``n_chars``,
    if there, is counted anew for the rows that change. Null texts stay null.
    """
    scanned = scan(df, id_col=id_col, text=text, **columns)
    common = stored(ownership(scanned).where("shared"), "shared-secrets")
    known = common.where("generic").select("hash").limit(SENT_HASHES + 1).collect()
    count = n_chars if n_chars in df.columns and n_chars != text else None
    if len(known) <= SENT_HASHES:
        return _redacted(df, text, count, None, df.sparkSession.sparkContext.broadcast(frozenset(r.hash for r in known)))
    names = [free_name(df.columns, n) for n in ("hit_id", "hit_hash", "hit_spans")]
    hits = _reported(scanned, common, id_col).where("spans <> ''").select(F.col(id_col).alias(names[0]), F.col("text_hash").alias(names[1]), F.col("spans").alias(names[2])).dropDuplicates(names[:2])
    rows = df.join(hits, df[id_col].cast("long").eqNullSafe(hits[names[0]]) & (F.xxhash64(df[text]) == hits[names[1]]), "left").select(*df.columns, names[2])
    return _redacted(rows, text, count, names[2], None)


def _redacted(rows: DataFrame, text: str, n_chars: str | None, listed: str | None, common) -> DataFrame:  # noqa: ANN001
    """Spans cut out: those in the column ``listed``, or those found in the text whose generic ones are not in ``common``."""
    names = [c for c in rows.columns if c != listed]
    schema = rows.select(*names).schema

    def found(t: str) -> list[tuple[int, int, str]]:
        return [(s, e, KINDS[k]) for s, k, e, x in spans(t) if k < 3 or digest(x) not in common.value]

    def told(marks: str | None) -> list[tuple[int, int, str]]:
        return [(int(s), int(e), k) for k, s, e in (x.split(":") for x in marks.split(","))] if marks else []

    def clean(t: str, cuts: list[tuple[int, int, str]]) -> str:
        out, end = [], 0
        for s, e, kind in cuts:
            if s >= end:
                out += [t[end:s], f"[{kind}]"]
            end = max(end, e)
        return "".join(out) + t[end:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(text).to_pylist()
            cuts = [told(x) for x in b.column(listed).to_pylist()] if listed else [found(t) if t else [] for t in texts]
            new = {text: [clean(t, c) if c else t for t, c in zip(texts, cuts)]}
            if n_chars:
                new[n_chars] = [len(t) if c else n for t, c, n in zip(new[text], cuts, b.column(n_chars).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(new[c], b.schema.field(c).type) if c in new else b.column(c) for c in names], names=names)

    return rows.mapInArrow(run, schema)
