"""Near-duplicate classes by improved consistent weighted sampling.

Texts become weighted sets of five-word shingles: a shingle weighs its count times the mean inverse
document frequency of its words. Each shingle is dealt by its hash to one of ``BANDS * ROWS`` bins, and
improved consistent weighted sampling (Ioffe 2010) draws one shingle of each bin; for an empty bin the
shingles of another bin, chosen by hash, are drawn from anew with lots of the empty bin. Where few shingles
hold most of the weight, as in looping texts, every bin draws from all shingles with lots of its own: one
bin a shingle would not weigh them. This goes by band: each has its own limit of the effective number of
shingles, so that two like texts on two sides of a limit still meet in other bands. Two texts draw the
same in a bin about as often as their weighted Jaccard similarity. Texts that agree on a whole band are candidates, and every candidate is
verified by its exact weighted Jaccard similarity.

Shape of the work: equal word sequences are one node from the start. In a bucket, all nodes are
compared with the most central one, then links are closed into components, and only where a bucket still
holds several components are nodes outside its largest one compared with the other components. No
link between candidates is lost, and a group of n near copies costs n comparisons. Two exact bounds
spare comparisons of this second kind. One minus the similarity is a metric, so nodes whose distances
from the central node differ by more than a link allows cannot be linked; distances are cut into
ranges, and only neighbouring ranges of a bucket meet. And two texts share at most what neither of them
has alone among the texts that are left, so edited copies that lie too far from their original are
known to have no link at all.

Word frequencies sit in ``BUCKETS`` hash buckets, so what is broadcast has a fixed size. Components are found by joins
over staged tables; nothing about single documents goes to the driver.

Word (rather than shingle) frequencies weigh the shingles, because the frequency of a shingle inside a
large group of copies would push the weight of just the shared part down, and with it the similarity.

Every verified link counts in ``n_links`` of both its texts, and ``similarity`` is the greatest of them:
links of a text to different texts, found with the central node or in a second comparison; texts that
are joined by a chain of links need not have been compared with each other.

Edge cases: a text of fewer than five words is one shingle; a text without words is only like an equal
text; case and signs do not count; null texts are empty texts; rows with a null id stay alone, with a
null class; rows that share an id are one document; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import chunks, code_points, is_word, mixed, prefix_hashes, runs, substring_hashes
from .common import Staging, numbered, read_table, release, restored, whole

BANDS, ROWS, SHINGLE, SIMILARITY = 40, 8, 5, 0.8
BUCKETS = 1 << 16
U64 = np.uint64
#: Effective numbers of shingles up to which each band draws from all of them.
DENSE = 16 * 4 ** ((np.arange(BANDS) + 0.5) / BANDS)


def words_of(texts: list[str]):
    """(hash, text number) of every word in order."""
    cps, bounds = code_points([t.lower() for t in texts])
    start, end = runs(is_word(cps), bounds)
    return mixed(substring_hashes(prefix_hashes(cps), start, end)), np.searchsorted(bounds, start, side="right") - 1


def shingles(texts: list[str], idf: np.ndarray):
    """(text number, shingle hash, weight) sorted by text and hash, and a hash pair of each text."""
    words, doc = words_of(texts)
    n = len(texts)
    count = np.bincount(doc, minlength=n)
    first = np.cumsum(count) - count
    weight = idf[(words & U64(BUCKETS - 1)).astype(np.int64)]
    at = np.arange(len(words)) - first[doc]
    own, sums = np.zeros(len(words), U64), np.zeros(len(words))
    for j in range(SHINGLE):
        shifted, value = np.zeros(len(words), U64), np.zeros(len(words))
        if j < len(words):
            shifted[: len(words) - j], value[: len(words) - j] = words[j:], weight[j:]
        inside = at + j < count[doc]
        own = np.where(inside, own * U64(0x9E3779B97F4A7C15) + shifted, own)
        sums += np.where(inside, value, 0)
    size = np.minimum(count[doc], SHINGLE)
    whole_ones = at + size <= count[doc]
    doc2, h, w = doc[whole_ones], mixed(own[whole_ones]), (sums / np.maximum(size, 1))[whole_ones]
    order = np.lexsort((h, doc2))
    doc2, h, w = doc2[order], h[order], w[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (doc2[1:] != doc2[:-1])
    heads = np.flatnonzero(fresh)
    times = np.diff(np.append(heads, len(h)))
    # Order-dependent hashes of the word sequence; a text without words takes that of its characters.
    pair = []
    for seed in (1, 2):
        value = mixed(words ^ mixed(np.full(1, seed, U64)) + (at.astype(U64) + U64(1)) * U64(0xD1B54A32D192ED03))
        total = np.concatenate([[U64(0)], np.cumsum(value, dtype=U64)])
        pair.append(mixed(total[first + count] - total[first] + U64(seed)))
    for i in np.flatnonzero(count == 0):
        cps = np.frombuffer(texts[i].encode("utf-32-le", "surrogatepass"), np.uint32)
        h0 = prefix_hashes(cps)[-1:] + U64(len(cps))
        pair[0][i], pair[1][i] = mixed(h0 ^ U64(0xABCD))[0], mixed(h0 * U64(7) + U64(5))[0]
    return doc2[heads], h[heads], w[heads] * times, np.stack(pair), count


def uniform(h: np.ndarray, seed: int) -> np.ndarray:
    return (mixed(h + U64(seed * 0x9E3779B97F4A7C15 & (2**64 - 1))) >> U64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54


def draws(h: np.ndarray, log_w: np.ndarray, lot: np.ndarray | None = None):
    """(level, value) of the consistent weighted draw of each shingle; the least level wins.

    ``lot`` numbers independent draws of the same shingle.
    """
    seed = h if lot is None else mixed(h ^ mixed(lot.astype(U64) + U64(0x632BE59BD9B4E019)))
    r = -np.log(uniform(seed, 1) * uniform(seed, 2))
    c = -np.log(uniform(seed, 3) * uniform(seed, 4))
    beta = uniform(seed, 5)
    t = np.floor(log_w / r + beta)
    return np.log(c) - r * (t - beta) - r, mixed(h + t.astype(np.int64).astype(U64) * U64(0x2545F4914F6CDD1D))


def winners(level: np.ndarray, value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The value of the least level of each run; runs begin at ``first`` and are not empty."""
    size = np.diff(np.append(first, len(level)))
    won = np.flatnonzero(level == np.repeat(np.minimum.reduceat(level, first), size))
    out = np.zeros(len(first), U64)
    out[np.searchsorted(first, won, side="right") - 1] = value[won]
    return out


def band_hashes(doc: np.ndarray, h: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    """(texts x BANDS) hashes of the consistent weighted samples of each band."""
    bins = BANDS * ROWS
    out = np.zeros((n, bins), U64)
    log_w = np.log(w)
    total, squares = (np.bincount(doc, weights=x, minlength=n).astype(float) for x in (w, w * w))
    # The first band that draws from all shingles; texts without shingles need none.
    dense = np.where(squares > 0, np.searchsorted(DENSE, total * total / np.maximum(squares, 1e-300)), 0)
    # One draw for each bin that holds shingles.
    some = dense[doc] > 0
    key = doc[some] * bins + (mixed(h[some] ^ U64(0x5851F42D4C957F2D)) % U64(bins)).astype(np.int64)
    order = np.argsort(key, kind="stable")
    key, of = key[order], np.flatnonzero(some)[order]
    if len(key):
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(first, len(key)))
        at = np.full(n * bins, -1)
        at[key[first]] = np.arange(len(first))
        out.ravel()[key[first]] = winners(*draws(h[of], log_w[of]), first)
        full = (at >= 0).reshape(n, bins)
        row, col = np.nonzero(~full & (np.arange(bins)[None, :] < dense[:, None] * ROWS))
        turn = 0
        while len(row):
            turn += 1
            other = (mixed(col.astype(U64) * U64(1000003) + U64(turn)) % U64(bins)).astype(np.int64) if turn < 400 else (col + turn) % bins
            ok = full[row, other]
            if ok.any():
                run = at[row[ok] * bins + other[ok]]
                many = size[run]
                begin = np.cumsum(many) - many
                take = of[np.arange(many.sum()) - np.repeat(begin, many) + np.repeat(first[run], many)]
                out[row[ok], col[ok]] = winners(*draws(h[take], log_w[take], np.repeat(col[ok], many)), begin)
            row, col = row[~ok], col[~ok]
    # A draw from all shingles for every bin of the other bands.
    for band in range(BANDS):
        take = np.flatnonzero(dense[doc] <= band)
        if len(take):
            own = doc[take]
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            for col in range(band * ROWS, band * ROWS + ROWS):
                out[own[first], col] = winners(*draws(h[take], log_w[take], np.array([col])), first)
    bands = np.zeros((n, BANDS), U64)
    grouped = out.reshape(n, BANDS, ROWS)
    for j in range(ROWS):
        bands = mixed(bands * U64(31) + grouped[:, :, j])
    return mixed(bands + np.arange(BANDS, dtype=U64)[None, :] * U64(0x9E3779B97F4A7C15))


def similarities(left: list[str], right: list[str], idf: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of each pair of texts."""
    index: dict[str, int] = {}
    a = np.array([index.setdefault(t, len(index)) for t in left], int)
    b = np.array([index.setdefault(t, len(index)) for t in right], int)
    doc, h, w, _, _ = shingles(list(index), idf)
    n = len(index)
    count = np.bincount(doc, minlength=n)
    first = np.cumsum(count) - count
    total = np.bincount(doc, weights=w, minlength=n).astype(float)
    # One row for every shingle of either text, by pair.
    take = np.concatenate([a, b])
    size = count[take]
    pair = np.repeat(np.concatenate([np.arange(len(a))] * 2), size)
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first[take], size)
    order = np.lexsort((h[at], pair))
    p, x, y = pair[order], h[at][order], w[at][order]
    both = np.flatnonzero((p[1:] == p[:-1]) & (x[1:] == x[:-1])) if len(p) else np.zeros(0, int)
    shared = np.bincount(p[both], weights=np.minimum(y[both], y[both + 1]), minlength=len(a)) if len(p) else np.zeros(len(a))
    union = total[a] + total[b] - shared
    return np.where(union > 0, shared / np.maximum(union, 1e-12), 0.0)


def word_idf(docs: DataFrame, text_col: str) -> np.ndarray:
    """Smoothed inverse document frequencies by word-hash bucket, over all rows; BUCKETS numbers."""

    def count(batches):
        total, rows = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            texts = batch.column(0).to_pylist()
            rows += len(texts)
            for a, b in chunks(texts):
                words, doc = words_of(texts[a:b])
                pairs = np.unique(doc.astype(U64) * U64(BUCKETS) + (words & U64(BUCKETS - 1)))
                total += np.bincount((pairs & U64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(total[used], rows))], ["bucket", "n"])

    counted = docs.select(whole(text_col)).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    df, n = np.zeros(BUCKETS), 0
    for bucket, k in counted:
        if bucket < 0:
            n = k
        else:
            df[bucket] = k
    del counted
    release()
    return np.log((n + 1) / (df + 1)) + 1


def sketches(docs: DataFrame, idf: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """id, h1, h2 (word sequence), weight (total), bands: array of band hashes, empty without words."""

    def run(batches):
        for batch in batches:
            texts, ids = batch.column(1).to_pylist(), batch.column(0)
            for a, b in chunks(texts):
                doc, h, w, pair, count = shingles(texts[a:b], idf)
                bands = band_hashes(doc, h, w, b - a).astype(np.int64)
                rows = np.where(count > 0, BANDS, 0)
                flat = bands[count > 0].ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(rows)]), pa.int32()), pa.array(flat))
                weight = np.bincount(doc, weights=w, minlength=b - a).astype(float)
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(pair[0].astype(np.int64)), pa.array(pair[1].astype(np.int64)), pa.array(weight), lists], ["id", "h1", "h2", "weight", "bands"])

    src = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text"))
    return src.mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, h1 long, h2 long, weight double, bands array<long>")


def measured(pairs: DataFrame, texts: DataFrame, idf: np.ndarray) -> DataFrame:
    """The pairs (a, b) with the similarity of their texts."""

    def run(batches):
        for batch in batches:
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            found = [similarities(a[s:e], b[s:e], idf) for s, e in chunks([x + y for x, y in zip(a, b, strict=True)])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(found) if found else np.zeros(0))], ["a", "b", "similarity"])

    kind = dict(pairs.dtypes)["a"]
    left = pairs.join(texts.withColumnsRenamed({"id": "a", "text": "text_a"}), "a")
    both = left.join(texts.withColumnsRenamed({"id": "b", "text": "text_b"}), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, f"a {kind}, b {kind}, similarity double")


def own_weights(texts: DataFrame, idf: np.ndarray) -> DataFrame:
    """(id, own): the weight of the shingles of a text that no other text of the table has."""

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in chunks(texts):
                doc, h, w, _, _ = shingles(texts[a:b], idf)
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a).take(pa.array(doc)), pa.array(h.astype(np.int64)), pa.array(w.astype(float))], ["id", "h", "w"])

    rows = texts.select("id", "text").mapInArrow(run, f"id {dict(texts.dtypes)['id']}, h long, w double")
    single = rows.groupBy("h").agg(F.count("*").alias("n"), F.first("id").alias("id"), F.first("w").alias("w")).filter("n = 1")
    return single.groupBy("id").agg(F.sum("w").alias("own"))


def components(edges: DataFrame, staging: Staging, name: str) -> DataFrame:
    """(id, label): the least id of each connected component, for every id that has an edge.

    Each round takes the least label among neighbours, then follows labels of labels. Rounds end when
    no label changes; they grow with the logarithm of the longest chain.
    """
    both = staging.put(edges.select("a", "b").union(edges.select("b", "a")).distinct(), f"{name}-edges")
    labels = staging.put(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label")), f"{name}-0")
    turn = 0
    while True:
        turn += 1
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near.withColumnRenamed("a", "id"), "id").select("id", "label", F.least("label", "near").alias("lower"))
        jump = step.join(labels.select(F.col("id").alias("lower"), F.col("label").alias("far")), "lower", "left")
        fresh = staging.put(jump.select("id", F.least("lower", F.coalesce("far", "lower")).alias("label"), (F.least("lower", F.coalesce("far", "lower")) != F.col("label")).alias("moved")), f"{name}-{turn}")
        done = fresh.filter("moved").limit(1).count() == 0
        if turn > 1:
            staging.drop(f"{name}-{turn - 2}")
        labels = fresh.select("id", "label")
        if done:
            return labels


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, staging: Staging | None = None) -> DataFrame:
    """``id_col``, ``class_id`` (least id of the class), ``class_size`` (documents), ``n_links`` and
    ``similarity`` (of the text's verified links) of each row."""
    staging = staging or Staging(docs.sparkSession, "near-dups")
    idf = word_idf(docs, text_col)
    sketch = staging.put(sketches(docs, idf, id_col, text_col), "sketches")
    named = sketch.filter("id is not null")
    # One node for each word sequence.
    nodes = staging.put(named.groupBy("h1", "h2").agg(F.min(F.struct("id", "weight", "bands")).alias("n")).select("h1", "h2", "n.*"), "nodes")
    member = staging.put(nodes.select(F.col("id").alias("node"), "weight", F.explode("bands").alias("bucket")), "members")
    # The leader of a bucket is the node that meets most others over all its buckets: the original of a
    # group of edited copies, say, which is like all of them while they are less like each other.
    sizes = member.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    meeting = staging.put(member.join(sizes, "bucket"), "meeting")
    central = meeting.groupBy("node").agg(F.sum("n").alias("met"))
    leader = meeting.join(central, "node").groupBy("bucket").agg(F.min(F.struct(-F.col("met"), F.col("node").alias("leader"))).getField("leader").alias("leader"))
    shared = staging.put(meeting.drop("n").join(leader, "bucket"), "shared")
    first = staging.put(shared.filter("node != leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct(), "pairs")
    source = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text"))
    # The ids grow with the input: a merge join at every size, rather than a broadcast while they are few.
    texts = staging.put(source.join(shared.select(F.col("node").alias("id")).distinct().hint("merge"), "id", "left_semi").groupBy("id").agg(F.min("text").alias("text")), "texts")
    found = staging.put(measured(first, texts, idf), "similarities")
    edges = found.filter(F.col("similarity") >= similarity)
    labels = components(edges, staging, "labels-1")
    # Nodes of the buckets in which several components are left, with their distance from the leader.
    label = labels.select(F.col("id").alias("node"), "label")
    held = shared.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed_ones = held.groupBy("bucket", "label").count().groupBy("bucket").agg(F.max(F.struct("count", "label")).alias("m"), F.count("*").alias("k")).filter("k > 1").select("bucket", F.col("m.label").alias("main"))
    far = found.select(F.col("a").alias("node"), F.col("b").alias("leader"), (1 - F.col("similarity")).alias("far"))
    apart = staging.put(held.join(mixed_ones, "bucket").join(far, ["node", "leader"], "left").withColumn("far", F.coalesce("far", F.lit(0.0))), "apart")
    # Two texts share at most what neither has alone, which bounds their similarity from above. A text
    # that has too much alone among these can have no link to any of them.
    asked = texts.join(apart.filter("far > 0").select(F.col("node").alias("id")).distinct(), "id", "left_semi")
    own = staging.put(own_weights(asked, idf), "own").withColumnRenamed("id", "node")
    common = F.col("weight") - F.coalesce("own", F.lit(0.0))
    apart = staging.put(apart.filter("far > 0").join(own, "node", "left").withColumn("common", common).filter(F.col("common") >= similarity * F.col("weight") - 1e-9), "open")
    # A pair that shares several buckets is taken in the least of them alone.
    mine = apart.groupBy("node").agg(F.collect_set("bucket").alias("mine"))
    apart = staging.put(apart.join(mine, "node"), "open-buckets")
    slack = 1 - similarity + 1e-9
    cell = F.floor(F.col("far") / F.lit(slack)).cast("int")
    one = apart.select("bucket", "main", "node", "weight", "common", "label", "far", "mine", cell.alias("cell"))
    rest = apart.filter("label != main").select("bucket", F.col("node").alias("b"), F.col("weight").alias("wb"), F.col("common").alias("cb"), F.col("label").alias("lb"), F.col("far").alias("fb"), F.col("mine").alias("mb"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    enough = F.least("common", "cb") * (1 + similarity) >= similarity * (F.col("weight") + F.col("wb")) - 1e-9
    like = (F.abs(F.col("far") - F.col("fb")) <= slack) & enough
    once = (F.col("label") != F.col("lb")) & ((F.col("label") == F.col("main")) | (F.col("node") < F.col("b")))
    # Leaders, at distance 0, have met every node of their buckets.
    o, r = one.alias("o"), rest.alias("r")
    second = o.join(r, (F.col("o.bucket") == F.col("r.bucket")) & (F.col("o.cell") == F.col("r.cell")) & once & like & (F.array_min(F.array_intersect("mine", "mb")) == F.col("o.bucket")))
    second = staging.put(second.select(F.greatest("node", "b").alias("a"), F.least("node", "b").alias("b")).distinct().join(first.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), ["a", "b"], "left_anti"), "pairs-2")
    if second.limit(1).count():
        more = staging.put(measured(second, texts, idf).filter(F.col("similarity") >= similarity), "edges-2")
        if more.limit(1).count():
            edges = edges.unionByName(more)
            labels = components(edges, staging, "labels-2")
    both = edges.select(F.col("a").alias("id"), F.col("b").alias("other"), "similarity").unionByName(edges.select(F.col("b").alias("id"), F.col("a").alias("other"), "similarity"))
    links = both.groupBy("id").agg(F.count("*").alias("n_links"), F.max("similarity").alias("similarity"))
    node_class = nodes.select("h1", "h2", "id").join(labels, "id", "left").join(links, "id", "left")
    node_class = node_class.select("h1", "h2", F.struct(F.coalesce("label", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "similarity").alias("of"))
    # Written, so that the sequence that a third of all rows have, and a class of as many, can be split.
    node_class = staging.put(node_class, "node-classes")
    rows = sketch.select("id", "h1", "h2").filter("id is not null").join(node_class.hint("merge"), ["h1", "h2"])
    # An id that stands on several rows belongs to the least of their classes.
    by_id = staging.put(rows.groupBy("id").agg(F.min("of").alias("of")).select("id", "of.*"), "by-id")
    sizes = staging.put(by_id.groupBy("class_id").agg(F.count("*").alias("class_size")), "sizes")
    known = by_id.join(sizes.hint("merge"), "class_id")
    out = sketch.select("id").join(known, "id", "left")
    out = out.select(F.col("id").alias(id_col), "class_id", F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "similarity")
    out = staging.put(out, "classes")
    staging.clear("classes")
    return out


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of the least id of each class, and rows with a null id; other rows are left out. Of rows
    that share an id and a text one stays."""
    classes = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    kept = classes.filter(F.col(id_col) == F.col("class_id")).select(F.col(id_col).alias("kept")).distinct()
    renamed, names = numbered(docs)
    key = names[id_col]
    rows = renamed.join(kept.hint("merge"), F.col(key) == F.col("kept"), "left_semi")
    rows = rows.withColumn("_text", F.struct(F.xxhash64(whole(names[text_col])), F.xxhash64(whole(names[text_col]), F.lit(1)))).dropDuplicates([key, "_text"]).drop("_text")
    return restored(rows.unionByName(renamed.filter(F.col(key).isNull())), names)


def op3(spark, sf_dir):
    return near_duplicates(read_table(spark, sf_dir, "documents"))


