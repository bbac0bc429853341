"""I-Match document fingerprints (DataFrame functions only).

Terms whose document frequency lies inside a band form the lexicon. Several randomised sub-lexicons
each keep a fixed share of it, by lots drawn from a hash of the term. A fingerprint has one hash for
each: the distinct terms of the text that the sub-lexicon keeps are sorted, joined and hashed. Equal
hashes mean equal term sets, so the share of equal hashes is a likeness.

Document frequencies are exact, by term, over all rows. A lexicon term is in at least ``low`` of all
documents, so the lexicon has at most the mean number of distinct terms of a document divided by
``low``, however large the corpus is: that bounds what goes to the driver and into the plan.

Texts meet the next text in one exchange, by ranges of ids; they and their edited texts are fingerprinted
there, in place. Terms are not shuffled but to be counted.

Edge cases: a null text is the empty text; a text without terms in any sub-lexicon has one hash over all its
terms; an empty text has no hash at all, its likeness is 1 to another such text and 0 to others;
repeated rows each get a row; rows that share an id follow each other in the order of a hash of their
texts, for the edit and for ``near_next`` alike; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import read_table, whole, width

LOW, HIGH = 0.004, 0.25
#: (share of the lexicon kept as a power of 1/2, how many sub-lexicons of that size)
SUBSETS = ((3, 4), (4, 5), (5, 6), (6, 6), (7, 5), (8, 4), (9, 2))
#: Every sub-lexicon: which bits of a term's lots (those from ``at`` on) must have which value.
LOTS = [(sum(p for p, _ in SUBSETS[:g]), (1 << power) - 1, lot) for g, (power, count) in enumerate(SUBSETS) for lot in range(count)]
#: Hexadecimal digits of a term's lots and of a hash.
LOT_DIGITS, DIGITS = 11, 15
SPLIT = r"[^\p{L}\p{N}]+"


def terms(text: Column) -> Column:
    """Distinct lower-case terms."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), SPLIT)), "")


def number(digest: Column, digits: int) -> Column:
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("long")


def lexicon(docs: DataFrame, text_col: str = "text", low: float = LOW, high: float = HIGH) -> list[str]:
    """The terms in the band: two of more documents, at least ``low`` and at most ``high`` of all."""
    n = docs.count()
    counts = docs.select(F.explode(terms(whole(text_col))).alias("t")).groupBy("t").count()
    return sorted(r["t"] for r in counts.filter(F.col("count").between(max(2, low * n), high * n)).select("t").collect())


def prints(df: DataFrame, text: str, out: str, known: list[str]) -> DataFrame:
    """Add the fingerprint of a text column: an array of one hash for each sub-lexicon."""
    # Terms hold letters and digits alone, so that they need no quoting.
    listed = ",".join(f"'{t}'" for t in known) or "''"
    lots = F.transform(F.expr(f"filter(_terms, t -> t IN ({listed}))"), lambda t: F.struct(t.alias("t"), number(F.md5(t), LOT_DIGITS).alias("lots")))
    df = df.withColumn("_terms", terms(F.col(text))).withColumn("_known", F.sort_array(lots))

    # The terms of any sub-lexicon of a size first: each sub-lexicon then looks through these alone.
    of_size = {at: f"_of_{at}" for at, _, _ in LOTS}
    value = lambda k, at, mask: F.shiftright(k["lots"], at).bitwiseAND(mask)

    def any_of(at: int, mask: int, count: int) -> Column:
        return F.filter("_known", lambda k: value(k, at, mask) < count)

    for (at, mask, _), (_, count) in zip([spec for spec in LOTS if spec[2] == 0], SUBSETS, strict=True):
        df = df.withColumn(of_size[at], any_of(at, mask, count))

    def hashed(at: int, mask: int, lot: int) -> Column:
        kept = F.filter(of_size[at], lambda k: value(k, at, mask) == lot)
        joined = F.array_join(F.transform(kept, lambda k: k["t"]), " ")
        return F.when(F.size(kept) > 0, number(F.md5(joined), DIGITS))

    df = df.withColumn(out, F.array(*[hashed(*spec) for spec in LOTS])).drop(*of_size.values())
    of_all = F.when(F.size("_terms") > 0, number(F.md5(F.array_join(F.sort_array("_terms"), " ")), DIGITS))
    fallback = F.concat(F.array(of_all), F.array_repeat(F.lit(None).cast("long"), len(LOTS) - 1))
    return df.withColumn(out, F.when(F.exists(out, lambda h: h.isNotNull()), F.col(out)).otherwise(fallback)).drop("_terms", "_known")


def as_text(prints: Column) -> Column:
    return F.array_join(F.transform(prints, lambda h: F.coalesce(F.lpad(F.lower(F.hex(h)), DIGITS, "0"), F.lit("-"))), ".")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among the sub-lexicons that hold a term of either text (0 to 1)."""
    pairs = F.arrays_zip(a.alias("a"), b.alias("b"))
    either = F.size(F.filter(pairs, lambda p: p["a"].isNotNull() | p["b"].isNotNull()))
    same = F.size(F.filter(pairs, lambda p: p["a"] == p["b"]))
    return F.when(either == 0, F.lit(1.0)).otherwise(same / either)


def cuts_of(docs: DataFrame, id_col: str) -> list[int]:
    """The least id, then ids at quantiles: as many as a fixed multiple of the shuffle partitions."""
    parts = 4 * width(docs.sparkSession)
    found = docs.select(F.percentile_approx(id_col, [i / parts for i in range(1, parts)], 10_000).alias("q"), F.min(id_col).alias("m")).first()
    return [] if found["m"] is None else [found["m"], *sorted({x for x in found["q"] if x > found["m"]})]


def placed(docs: DataFrame, id_col: str, cuts: list[int]) -> DataFrame:
    """Rows in ranges of ids (``_part``), each range in one partition. A row that begins a range also
    stands, as ``_copy``, at the end of the range before, and the first row of all after the last one:
    so no range needs to know another, and no task gets more than its ranges. Null ids come first."""
    key, last = F.col(id_col), max(len(cuts) - 2, 0)
    spot = lambda part, copy: F.struct(F.lit(part).cast("int").alias("part"), F.lit(copy).alias("copy"))
    here = F.lit(0)
    bounds = F.array(*[F.lit(x).cast("long") for x in cuts[1:]]) if len(cuts) > 1 else None
    if bounds is not None:
        here = F.coalesce(F.size(F.filter(bounds, lambda b: b <= key)), F.lit(0))
        last = len(cuts) - 1
    least = key == F.lit(cuts[0]) if cuts else F.lit(False)
    places = F.when(least, F.array(spot(0, False), spot(last, True)))
    if bounds is not None:
        places = places.when(F.array_contains(bounds, key), F.array(F.struct(here.alias("part"), F.lit(False).alias("copy")), F.struct((here - 1).alias("part"), F.lit(True).alias("copy"))))
    places = places.otherwise(F.array(F.struct(here.alias("part"), F.lit(False).alias("copy"))))
    rows = docs.withColumn("_at", F.explode(places)).select(*docs.columns, F.col("_at.part").alias("_part"), F.col("_at.copy").alias("_copy"))
    return rows.repartition(width(docs.sparkSession), "_part")


def with_next(rows: DataFrame, id_col: str, carried: list[str], order: list[str]) -> DataFrame:
    """Add ``next_<column>`` of the following row by id (after the last: the first). Rows that share an
    id stand in the order of a hash of ``order``."""
    w = Window.partitionBy("_part").orderBy("_copy", F.col(id_col).asc_nulls_first(), F.xxhash64(*order))
    return rows.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in carried]).filter("not _copy").drop("_part", "_copy")


def fingerprint_edited(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", low: float = LOW, high: float = HIGH) -> DataFrame:
    """Fingerprints of every text and of its edited text, with both likenesses."""
    known = lexicon(docs, text_col, low, high)
    base = placed(docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("body")), "doc_id", cuts_of(docs, id_col))
    both = with_next(prints(base, "body", "prints", known), "doc_id", ["body", "prints"], ["body"])
    n = F.length("body")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("body"), F.lit(1), n - cut), F.substring(F.coalesce("next_body", F.lit("")), F.lit(1), cut))
    rows = both.select("doc_id", n.cast("long").alias("n_chars"), "prints", "next_prints", edited.alias("edited"))
    rows = prints(rows, "edited", "edited_prints", known)
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("prints")).alias("fingerprint"), as_text(F.col("edited_prints")).alias("edited_fingerprint"),
        likeness(F.col("prints"), F.col("edited_prints")).alias("near_edited"), F.coalesce(likeness(F.col("prints"), F.col("next_prints")), F.lit(0.0)).alias("near_next"),
    )


def likeness_sql(a: str, b: str) -> str:
    either, same = (f"len(list_filter(range(1, {len(LOTS) + 1}), lambda i: {test}))" for test in (f"{a}[i] <> '-' OR {b}[i] <> '-'", f"{a}[i] = {b}[i] AND {a}[i] <> '-'"))
    return f"coalesce({same} / nullif(CAST({either} AS DOUBLE), 0), 1.0)"


#: The same in DuckDB, on exploded terms.
OP2_SQL = f"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
b AS (SELECT doc_id, body, length(body) AS n, coalesce(lead(body) OVER w, first_value(body) OVER w) AS next_body, coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS next_id FROM docs WINDOW w AS (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
e AS (SELECT *, substr(body, 1, n - n // 4) || substr(next_body, 1, n // 4) AS edited FROM b),
v AS (SELECT doc_id, 0 AS is_edited, body FROM b UNION ALL SELECT doc_id, 1, edited FROM e),
t AS (SELECT * FROM (SELECT doc_id, is_edited, unnest(list_distinct(string_split_regex(lower(body), '{SPLIT}'))) AS t FROM v) WHERE t <> ''),
k AS (SELECT t, ('0x' || substr(md5(t), 1, {LOT_DIGITS}))::BIGINT AS lots FROM t WHERE is_edited = 0 GROUP BY t
HAVING count(*) BETWEEN greatest(2, {LOW} * (SELECT count(*) FROM docs)) AND {HIGH} * (SELECT count(*) FROM docs)),
s AS (SELECT unnest(range({len(LOTS)})) AS i, unnest({[x[0] for x in LOTS]}) AS pos, unnest({[x[1] for x in LOTS]}) AS mask, unnest({[x[2] for x in LOTS]}) AS lot),
h AS (SELECT doc_id, is_edited, i, string_agg(t, ' ' ORDER BY t) AS joined FROM t JOIN k USING (t) JOIN s ON ((lots >> pos) & mask) = lot GROUP BY ALL),
f AS (SELECT doc_id, is_edited, 0 AS i, string_agg(t, ' ' ORDER BY t) AS joined FROM t GROUP BY ALL),
a AS (SELECT * FROM h UNION ALL SELECT * FROM f ANTI JOIN h USING (doc_id, is_edited)),
g AS (SELECT doc_id, is_edited, i, substr(md5(joined), 1, {DIGITS}) AS h FROM a),
p AS (SELECT v.doc_id, v.is_edited, string_agg(coalesce(h, '-'), '.' ORDER BY s.i) AS print FROM v CROSS JOIN s LEFT JOIN g ON g.doc_id = v.doc_id AND g.is_edited = v.is_edited AND g.i = s.i GROUP BY ALL),
m AS (SELECT e.doc_id, CAST(e.n AS BIGINT) AS n_chars, sha256(e.edited) AS edited_sha256, x.print AS fingerprint, y.print AS edited_fingerprint, string_split(x.print, '.') AS px, string_split(y.print, '.') AS py, string_split(z.print, '.') AS pz
FROM e JOIN p x ON x.doc_id = e.doc_id AND x.is_edited = 0 JOIN p y ON y.doc_id = e.doc_id AND y.is_edited = 1 JOIN p z ON z.doc_id = e.next_id AND z.is_edited = 0)
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, {likeness_sql("px", "py")} AS near_edited, {likeness_sql("px", "pz")} AS near_next FROM m"""


def op2(spark, sf_dir):
    return fingerprint_edited(read_table(spark, sf_dir, "documents"))
