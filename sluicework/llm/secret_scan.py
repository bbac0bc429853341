"""Secret scanning with corpus-wide ownership frequency (DataFrame functions only).

Candidates are found with regular expressions in every whole text. The hash of each candidate value
is then counted over the corpus: in how many distinct repositories it occurs and how many distinct
owners those have. A value of ``example_owners`` or more owners is a copied example, and so is one that
owners share over ``example_repositories`` or more repositories; what one owner alone uses, in however
many repositories, or a few owners in few repositories, looks live. The counts are pre-aggregated by
(value, owner, repository) and (value, owner) before the shuffle by value, so a value that a third of
all rows carry costs one row a task and owner.

Edge cases: a null text is the empty text; a null owner counts as one owner of its own; repeated
rows each get a row of the result; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Staging, numbered, read_table, restored, whole

# The pattern, the group that must be long enough, and its least length, by kind.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"(AKIA[A-Z0-9]{14,})"
HEX = r"([0-9a-f]{16,})"
BASE = (("assign", ASSIGN, 2, 12), ("access", ACCESS, 1, 18), ("hex", HEX, 1, 16))
#: Whole runs of token characters; the look-behind keeps short runs from being tried at each of their
#: characters. Those without a digit are words and drop out afterwards, however long they are.
TOKEN = r"((?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,})"
ADDED = ("token", TOKEN, 1, 20)
DIGIT = "[0-9]"


def spans_of(text: Column, pattern: str, group: int, least: int, kind: str, rank: int) -> Column:
    """array<struct<start, rank, kind, end, value>> of the matches of one kind, by code points.

    The pieces between matches (``split``) and the matches themselves alternate, so running lengths
    give the positions.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = hits if group == 1 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    pieces = F.split(text, pattern, -1)
    rows = F.arrays_zip(F.transform(F.slice(pieces, 1, F.size(hits)), lambda p: F.length(p)).alias("gap"), hits.alias("hit"), values.alias("value"))
    empty = F.expr("cast(array() as array<struct<start:int,rank:int,kind:string,end:int,value:string>>)")

    def step(acc, row):
        start = acc["at"] + row["gap"]
        end = start + F.length(row["hit"])
        one = F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"), row["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["found"], F.array(one)).alias("found"))

    found = F.aggregate(rows, F.struct(F.lit(0).alias("at"), empty.alias("found")), step, lambda acc: acc["found"])
    kept = F.filter(found, lambda s: F.length(s["value"]) >= least)
    return F.when(text.rlike(pattern), kept).otherwise(empty)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def judge_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_col: str | None = None, example_owners: int = 3, example_repositories: int = 10, staging: Staging | None = None) -> tuple[DataFrame, DataFrame]:
    """``scanned``: id, hash of the text, counts and sorted base spans of every input row; ``judged``:
    the spans with their verdicts for each id and text hash that has any."""
    spark = docs.sparkSession
    staging = staging or Staging(spark, "secrets")
    text = whole(text_col)
    src = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"),
        (F.col(repository_col) if repository_col else F.col(id_col)).cast("string").alias("repo"),
        text.alias("body"),
    )
    scanned = src.select("id", "owner", "repo", F.xxhash64("body").alias("body_hash"), *[spans_of(F.col("body"), p, g, n, k, i).alias(f"s_{k}") for i, (k, p, g, n) in enumerate((*BASE, ADDED))])
    base = F.array_sort(F.concat(*[F.col(f"s_{k}") for k, *_ in BASE]))
    clear = F.filter("s_token", lambda t: t["value"].rlike(DIGIT) & ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    hashed = lambda spans, added: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"), F.xxhash64(s["value"]).alias("vh"), F.lit(added).alias("added")))
    scanned = scanned.withColumn("base", base).withColumn("cand", F.concat(hashed(F.col("base"), False), hashed(clear, True)))
    scanned = staging.put(
        scanned.select("id", "owner", "repo", "body_hash", *[F.size(f"s_{k}").cast("long").alias(f"n_{k}") for k, *_ in BASE], F.transform("base", lambda s: F.struct(s["start"], s["rank"], s["kind"], s["end"])).alias("base"), "cand"),
        "scanned",
    )
    usage = (
        scanned.select("owner", "repo", F.explode(F.array_distinct(F.transform("cand", lambda s: s["vh"]))).alias("vh"))
        .groupBy("vh", "owner", "repo").agg(F.lit(1).alias("one"))
        .groupBy("vh", "owner").agg(F.count("*").alias("repos"))
        .groupBy("vh").agg(F.sum("repos").alias("n_repos"), F.count("*").alias("n_owners"))
    )
    judged = (
        scanned.filter(F.size("cand") > 0).select("id", "body_hash", F.explode("cand").alias("c")).select("id", "body_hash", "c.*")
        .join(usage, "vh")
        .withColumn("live", (F.col("n_owners") < example_owners) & ((F.col("n_owners") == 1) | (F.col("n_repos") < example_repositories)))
        .filter("live or not added")
        .groupBy("id", "body_hash")
        .agg(F.array_sort(F.collect_set(F.struct("start", "rank", "kind", "end", "live", "n_repos", "n_owners"))).alias("judged"))
    )
    return scanned.drop("owner", "repo", "cand"), judged


JUDGED = "array<struct<start:int,rank:int,kind:string,end:int,live:boolean,n_repos:bigint,n_owners:bigint>>"


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per input row: ``id_col``, ``n_assign``, ``n_access``, ``n_hex``, ``base`` and
    ``spans`` (sorted arrays of structs with a verdict for ``spans``), ``n_live``, ``n_example``.

    ``repository_col`` defaults to the row's own id: every document is a repository. Base spans always
    stay; a long token with digits that overlaps no base span is added where its value looks live.
    """
    scanned, judged = judge_spans(docs, id_col=id_col, **options)
    left, right = scanned.alias("l"), judged.alias("r")
    out = left.join(right, F.col("l.id").eqNullSafe(F.col("r.id")) & (F.col("l.body_hash") == F.col("r.body_hash")), "left")
    spans = F.coalesce(F.col("r.judged"), F.expr(f"cast(array() as {JUDGED})"))
    return out.select(
        F.col("l.id").alias(id_col), F.col("l.n_assign"), F.col("l.n_access"), F.col("l.n_hex"), F.col("l.base").alias("base"), spans.alias("spans"),
        F.size(F.filter(spans, lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter(spans, lambda s: ~s["live"])).cast("long").alias("n_example"),
    )


def mask(text: Column, spans: Column, kinds: tuple[str, ...] = ("assign", "access", "hex", "token")) -> Column:
    """The text with every span of these kinds replaced by ``[SECRET]``; spans may overlap."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        gap = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        fresh = s["end"] > acc["at"]
        put = F.when(fresh & (s["start"] >= acc["at"]), F.concat(acc["out"], gap, F.lit("[SECRET]"))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), put.alias("out"))

    return F.aggregate(F.filter(spans, lambda s: s["kind"].isin(*kinds)), start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def redact(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The input rows with every span that looks live replaced by ``[SECRET]``."""
    _, judged = judge_spans(docs, id_col=id_col, text_col=text_col, **options)
    found = judged.select(F.col("id").alias("_id"), F.col("body_hash").alias("_hash"), F.filter("judged", lambda s: s["live"]).alias("_live")).filter(F.size("_live") > 0)
    renamed, names = numbered(docs)
    key, body = names[id_col], names[text_col]
    both = renamed.withColumn("_text_hash", F.xxhash64(whole(body))).join(found, F.col(key).eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash")), "left")
    clean = F.when(F.col("_live").isNotNull(), mask(F.col(body), F.col("_live"))).otherwise(F.col(body))
    return restored(both.withColumn(body, clean), names)


# The same in DuckDB. Its expressions know no look-behind; greedy runs need none.
KINDS_SQL = ",\n".join(
    f"""s{i} AS (SELECT doc_id, source, {i} AS rank, '{kind}' AS kind, regexp_extract_all(body, p, 0) AS hits, regexp_extract_all(body, p, {group}) AS vals, string_split_regex(body, p) AS gaps, {least} AS least
FROM docs, (SELECT '{pattern.replace("(?<![A-Za-z0-9+/_-])", "").replace("'", "''")}' AS p))"""
    for i, (kind, pattern, group, least) in enumerate((*BASE, ADDED))
)
OP9_SQL = f"""WITH docs AS (SELECT doc_id, source, coalesce(text, '') AS body FROM documents),
{KINDS_SQL},
u AS (SELECT * FROM s0 UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3),
h AS (SELECT doc_id, source, rank, kind, least, unnest(hits) AS hit, unnest(vals) AS val, unnest(gaps[1:len(hits)]) AS gap, unnest(range(len(hits))) AS i FROM u WHERE len(hits) > 0),
e AS (SELECT *, CAST(sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, rank ORDER BY i) AS BIGINT) AS stop FROM h),
f AS (SELECT *, stop - length(hit) AS start FROM e WHERE length(val) >= least),
b AS (SELECT * FROM f WHERE rank < 3),
t AS (SELECT * FROM f WHERE rank = 3 AND regexp_matches(val, '{DIGIT}') AND NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = f.doc_id AND b.start < f.stop AND f.start < b.stop)),
c AS (SELECT * FROM b UNION ALL SELECT * FROM t),
o AS (SELECT val, count(DISTINCT source) AS n_owners, count(DISTINCT doc_id) AS n_repos FROM c GROUP BY val),
j AS (SELECT c.*, n_owners < 3 AND (n_owners = 1 OR n_repos < 10) AS live FROM c JOIN o USING (val)),
k AS (SELECT * FROM j WHERE live OR rank < 3),
g AS (SELECT doc_id, count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access, count(*) FILTER (WHERE rank = 2) AS n_hex, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (WHERE rank < 3) AS base,
string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans, count(*) FILTER (WHERE live) AS n_live, count(*) FILTER (WHERE NOT live) AS n_example FROM k GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example FROM docs LEFT JOIN g USING (doc_id)"""


def op9(spark, sf_dir):
    out = scan_secrets(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), "n_live", "n_example")


