"""Removal of repeated byte strings by a sparse, hash-compared suffix sort.

Every byte that a ``LENGTH``-byte string covers which also starts earlier in the corpus is removed.

Which windows can repeat is found from anchors: in every window of ``LENGTH`` bytes the ``GRAM``-byte
gram of least hash is an anchor, so equal windows hold equal anchors at equal places, while anchors are
some forty bytes apart. Anchors whose gram hash occurs once drop out. What an anchor's windows can
reach is its block. Equal blocks need no comparison: only the first of them can hold a first window.
They are known by three independent 64-bit hashes (of the gram, and two of the block), as the bytes of
all copies would have to be moved to compare them.

The different blocks of one anchor gram are compared: their suffixes from the anchor on are sorted by
mergesort, where prefix polynomial hashes and binary search give the common extension of two suffixes
in a logarithmic number of steps; ranges of the sorted suffixes that share the needed extension to the
right, split by the hash of the extension to the left, are the sets of equal windows. Claimed
extensions are verified byte by byte.

A group of more than ``MOST_BLOCKS`` blocks, as a line makes that a third of all documents hold, is split
by content until it is small enough: its windows are halved by where they begin, and blocks go on
together only if they have the bytes that all windows of a half share. Blocks that agree on all bytes
of a half are one from then on. Both compare bytes, not hashes. A single window has nothing left to
compare, so splitting ends; blocks that are alone drop out on the way.

Scale: grams are counted with partial sums and joined to a written table of unique keys, so that Spark
can split a hot gram; equal blocks collapse to one row a task before they are shuffled. No task sorts
more than ``MOST_BLOCKS`` blocks of one group, and nothing goes to the driver. Intermediate tables are
staged in the shared folder and dropped when read.

Edge cases: a null text is the empty text; texts shorter than ``LENGTH`` bytes lose nothing; rows
that share an id are one document at the same places, so that they keep equal parts alike, and a null
id comes before all others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import mixed, prefix_hashes, substring_hashes
from .common import Staging, read_table

LENGTH, GRAM = 100, 32
SIDE = LENGTH - GRAM
MOST_BLOCKS = 4_096
CHUNK_BYTES, CHUNK_BLOCKS = 250_000, 4_096
U64 = np.uint64
TOP = U64(0xFFFFFFFFFFFFFFFF)
#: Other values of the bytes, for a second hash.
SECOND = mixed(np.arange(256, dtype=U64) + U64(77))


def sliding(values: np.ndarray, size: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over [i, i + size) for every i with a full range, by doubling."""
    span, out = 1, values
    while span * 2 <= size:
        out = pick(out[:-span], out[span:])
        span *= 2
    rest = size - span
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


def byte_chunks(column: pa.Array):
    """(first row, last row, bytes of all, bounds) for runs of rows of a binary column."""
    texts = column.to_pylist()
    begin, size = 0, 0
    for i in range(len(texts) + 1):
        if i == len(texts) or size and size + len(texts[i]) > CHUNK_BYTES:
            if i > begin:
                part = texts[begin:i]
                bounds = np.zeros(len(part) + 1, np.int64)
                np.cumsum([len(t) for t in part], out=bounds[1:])
                yield begin, i, np.frombuffer(b"".join(part), np.uint8), bounds
            begin, size = i, 0
        if i < len(texts):
            size += len(texts[i])


def find_anchors(data: np.ndarray, bounds: np.ndarray):
    """(row, position in the row, gram hash, two block hashes) of every anchor of the rows."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none, none, none
    prefix = prefix_hashes(data)
    at = np.arange(n - GRAM + 1)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    gram = mixed(substring_hashes(prefix, at, at + GRAM))
    order = gram.copy()
    order[at + GRAM > bounds[row[at] + 1]] = TOP
    least = sliding(order, SIDE + 1, np.minimum)
    window = np.arange(len(least))
    least[window + LENGTH > bounds[row[window] + 1]] = 0
    padded = np.zeros(len(order) + SIDE, U64)
    padded[SIDE : SIDE + len(least)] = least
    reach = sliding(padded, SIDE + 1, np.maximum)
    pos = np.flatnonzero((reach == order) & (order != TOP) & (order != 0))
    owner = row[pos]
    low, high = np.maximum(bounds[owner], pos - SIDE), np.minimum(bounds[owner + 1], pos + LENGTH)
    place = mixed((pos - low).astype(U64) * U64(1000) + (high - pos).astype(U64))
    block = mixed(substring_hashes(prefix, low, high) ^ place)
    check = mixed(substring_hashes(prefix_hashes(SECOND[data]), low, high) + place)
    return owner, pos - bounds[owner], gram[pos].astype(np.int64), block.astype(np.int64), check.astype(np.int64)


def anchors_of(docs: DataFrame) -> DataFrame:
    """gram, block, check, doc, pos of every anchor of the (doc, data) rows."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for first, last, data, bounds in byte_chunks(batch.column(1)):
                owner, pos, gram, block, check = find_anchors(data, bounds)
                if len(owner):
                    yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(block), pa.array(check), ids.slice(first, last - first).take(pa.array(owner)), pa.array(pos.astype(np.int32))], ["gram", "block", "check", "doc", "pos"])

    return docs.mapInArrow(run, f"gram long, block long, check long, doc {dict(docs.dtypes)['doc']}, pos int")


class Blocks:
    """Some blocks: group, bytes, bytes left of the anchor; in the order in which they start."""

    def __init__(self, group: np.ndarray, blocks: list[bytes], left: np.ndarray):
        self.group, self.left = group, left.astype(np.int64)
        self.bounds = np.zeros(len(blocks) + 1, np.int64)
        np.cumsum([len(b) for b in blocks], out=self.bounds[1:])
        self.data = np.frombuffer(b"".join(blocks), np.uint8)
        self.prefix = prefix_hashes(self.data)
        self.anchor = self.bounds[:-1] + self.left
        self.size = self.bounds[1:] - self.anchor  # of the suffix from the anchor on

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Lengths of the common extensions of suffixes i and j: binary search on prefix hashes."""
        a, b = self.anchor[i], self.anchor[j]
        low, high = np.zeros(len(i), np.int64), np.minimum(self.size[i], self.size[j])
        while True:
            open_ = low < high
            if not open_.any():
                return low
            mid = (low + high + 1) // 2
            same = substring_hashes(self.prefix, a, a + mid) == substring_hashes(self.prefix, b, b + mid)
            low, high = np.where(open_ & same, mid, low), np.where(open_ & ~same, mid - 1, high)

    def before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether suffix i sorts before suffix j; equal suffixes do not."""
        shared = self.common(i, j)
        ends = (shared == self.size[i]) | (shared == self.size[j])
        x = self.data[np.minimum(self.anchor[i] + shared, len(self.data) - 1)]
        y = self.data[np.minimum(self.anchor[j] + shared, len(self.data) - 1)]
        return np.where(ends, self.size[i] < self.size[j], x < y)

    def sort(self) -> np.ndarray:
        """Suffixes of each group in order, by merging runs of doubling length in all groups at once."""
        n = len(self.group)
        order = np.argsort(self.group, kind="stable")
        g = self.group[order]
        head = np.searchsorted(g, g, side="left")
        total = np.searchsorted(g, g, side="right") - head
        local = np.arange(n) - head
        run = 1
        while True:
            live = np.flatnonzero(total > run)
            if not len(live):
                return order
            mine = local[live] // run
            other = mine ^ 1
            begin = head[live] + other * run
            end = np.minimum(begin + run, head[live] + total[live])
            begin = np.minimum(begin, end)
            me = order[live]
            # The place in the partner run: before equals for the first run, after them for the second.
            low, high = begin.copy(), end.copy()
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                mid = (low[open_] + high[open_]) // 2
                them, us = order[mid], me[open_]
                first = mine[open_] % 2 == 0
                less = np.zeros(len(open_), bool)
                less[first] = self.before(them[first], us[first])
                less[~first] = ~self.before(us[~first], them[~first])
                low[open_[less]] = mid[less] + 1
                high[open_[~less]] = mid[~less]
            fresh = order.copy()
            fresh[head[live] + (mine // 2) * 2 * run + local[live] % run + (low - begin)] = me
            order = fresh
            run *= 2

    def repeated(self) -> np.ndarray:
        """(blocks x SIDE + 1): whether the window that starts so many bytes before the anchor is
        equal to one of an earlier block of the group."""
        n = len(self.group)
        out = np.zeros((n, SIDE + 1), bool)
        order = self.sort()
        wide = np.minimum(self.size, LENGTH)
        # Verify: exact common extensions of neighbours; a false order falls back on the bytes.
        right = np.full((n, LENGTH), -1, np.int16)
        for c in range(LENGTH):
            inside = np.flatnonzero(wide > c)
            right[inside, c] = self.data[self.anchor[inside] + c]
        for turn in range(2):
            a, b = right[order[:-1]], right[order[1:]]
            differ = a != b
            shared = np.where(differ.any(1), differ.argmax(1), np.minimum(wide[order[:-1]], wide[order[1:]])) if n > 1 else np.zeros(0, np.int64)
            at = np.minimum(shared, LENGTH - 1)
            rows = np.arange(n - 1)
            wrong = (self.group[order[1:]] == self.group[order[:-1]]) & differ.any(1) & (a[rows, at] > b[rows, at]) if n > 1 else np.zeros(0, bool)
            if turn or not wrong.any():
                break
            order = np.lexsort((*right.T[::-1], self.group))
        cut = np.ones(n, np.int64) * -1
        cut[1:] = np.where(self.group[order[1:]] == self.group[order[:-1]], shared, -1)
        left = np.full((n, SIDE), -1, np.int16)
        for c in range(SIDE):
            inside = np.flatnonzero(self.left > c)
            left[inside, c] = self.data[self.anchor[inside] - 1 - c]
        place = np.zeros(n, np.int64)
        for back in range(SIDE + 1):
            need = LENGTH - back
            place[order] = np.cumsum(cut < need)
            ok = np.flatnonzero((self.left >= back) & (wide >= need))
            if len(ok) < 2:
                continue
            key = mixed(substring_hashes(self.prefix, self.anchor[ok] - back, self.anchor[ok]) + place[ok].astype(U64) * U64(0x9E3779B97F4A7C15))
            by = np.argsort(key, kind="stable")  # rows are in starting order, so the first stays first
            key, rows = key[by], ok[by]
            head = np.ones(len(rows), bool)
            head[1:] = key[1:] != key[:-1]
            source = rows[np.maximum.accumulate(np.where(head, np.arange(len(rows)), 0))]
            late = rows[~head]
            same = (left[late, :back] == left[source[~head], :back]).all(1) & (place[late] == place[source[~head]])
            out[late[same], back] = True
        return out


GROUP = ["gram", "low", "high", "core"]


def group_starts(table: pa.Table) -> np.ndarray:
    """Which rows differ from the row before in one of the columns that make a group."""
    out = np.ones(len(table), bool)
    for n, name in enumerate(GROUP):
        col = table.column(name).combine_chunks()
        a, b = col.slice(0, max(len(col) - 1, 0)), col.slice(1)
        differ = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(a.is_null(), b.is_null())).to_numpy(zero_copy_only=False)
        out[1:] = differ if n == 0 else out[1:] | differ
    return out


def compare_blocks(blocks: DataFrame) -> DataFrame:
    """doc, pos, bits (which windows repeat) of the blocks of groups with several."""

    def solve(table: pa.Table) -> pa.RecordBatch:
        group = np.cumsum(group_starts(table)) - 1
        # Blocks of a group in the order in which they start; null ids come first.
        docs = table.column("doc").combine_chunks()
        ranks = pc.rank(docs, sort_keys="ascending", null_placement="at_start", tiebreaker="min").to_numpy()
        order = np.lexsort((table.column("pos").to_numpy(), ranks, group))
        table = table.take(pa.array(order))
        found = Blocks(group[order], table.column("data").to_pylist(), table.column("left").to_numpy()).repeated()
        hit = np.flatnonzero(found.any(1))
        bits = [b.tobytes() for b in np.packbits(found[hit], axis=1)]
        table = table.take(pa.array(hit))
        return pa.RecordBatch.from_arrays([table.column("doc").combine_chunks(), table.column("pos").combine_chunks(), pa.array(bits, pa.binary())], ["doc", "pos", "bits"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= CHUNK_BLOCKS:
                table = pa.Table.from_batches(held)
                whole = int(np.flatnonzero(group_starts(table))[-1])  # the last group may go on
                if whole:
                    yield solve(table.slice(0, whole))
                    pa.default_memory_pool().release_unused()
                held, rows = table.slice(whole).to_batches(), len(table) - whole
        if rows:
            yield solve(pa.Table.from_batches(held))

    kind = dict(blocks.dtypes)["doc"]
    return blocks.repartition(*GROUP).sortWithinPartitions(*GROUP).mapInArrow(run, f"doc {kind}, pos int, bits binary")


def code(first: int):
    """An entry of a document: an anchor, which windows of it are meant, and whether they are the first."""
    return (((F.col("pos").cast("long") * 128 + F.col("low")) * 128 + F.col("high")) * 2 + first).alias("code")


def split_groups(hot: DataFrame, most: int, staging: Staging) -> tuple[list[DataFrame], list[DataFrame]]:
    """Groups of at most ``most`` blocks (as ``compare_blocks`` takes them) out of larger ones, and the
    entries (doc, code) of blocks that agree on whole halves of their windows."""
    ready, entries, turn = [], [], 0
    right = F.length("data") - F.col("left") - GRAM
    shared = F.substring(F.col("data"), F.col("left") - F.col("low") + 1, F.col("low") + GRAM + SIDE - F.col("high"))
    while hot.limit(1).count():
        turn += 1
        middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        halves = F.array(F.struct(F.col("low").alias("low"), middle.alias("high")), F.struct((middle + 1).alias("low"), F.col("high").alias("high")))
        parts = hot.withColumn("_half", F.explode(halves)).withColumn("low", F.col("_half.low")).withColumn("high", F.col("_half.high"))
        # Blocks that have a window of the half, cut down to what its windows reach.
        parts = parts.filter((F.col("low") <= F.col("high")) & (F.col("left") >= F.col("low")) & (right >= SIDE - F.col("high")))
        keep_left, keep_right = F.least("left", "high"), F.least(right, SIDE - F.col("low"))
        reach = F.substring(F.col("data"), F.col("left") - keep_left + 1, keep_left + GRAM + keep_right)
        parts = staging.put(parts.select("gram", "low", "high", "doc", "pos", keep_left.alias("left"), reach.alias("data")), f"parts-{turn}")
        firsts = parts.groupBy("gram", "low", "high", "left", "data").agg(F.min(F.struct("doc", "pos")).alias("f"))
        firsts = staging.put(firsts.select("gram", "low", "high", shared.alias("core"), "f.doc", "f.pos", "left", "data"), f"firsts-{turn}")
        counts = staging.put(firsts.groupBy(*GROUP).agg(F.count("*").alias("n_blocks")).filter("n_blocks > 1"), f"counts-{turn}")
        alive = staging.put(firsts.join(counts.hint("merge"), GROUP), f"alive-{turn}")
        entries += [parts.select("doc", code(0)), firsts.select("doc", code(1))]
        ready.append(alive.filter(F.col("n_blocks") <= most))
        hot = alive.filter(F.col("n_blocks") > most)
    return ready, entries


def windows_to_spans(n: int, codes: np.ndarray, partly: list[dict]) -> list[tuple[int, int]]:
    """Maximal removed runs of a text of n bytes.

    ``codes`` are entries (see ``code``) of anchors with equal windows. Those that are never a first one
    repeat with all these windows; ``partly`` has the windows (``bits``) that repeat of others.
    """
    if n < LENGTH or not len(codes) and not partly:
        return []
    size = n - LENGTH + 1
    later = np.setdiff1d(codes[codes % 2 == 0] // 2, codes[codes % 2 == 1] // 2)
    pos, nearest, farthest = later >> 14, later >> 7 & 127, later & 127
    step = np.zeros(size + 1, np.int64)
    low, high = np.maximum(pos - farthest, 0), np.minimum(pos - nearest + 1, size)
    ok = low < high
    np.add.at(step, low[ok], 1)
    np.add.at(step, high[ok], -1)
    hit = np.cumsum(step[:-1]) > 0
    if partly:
        bits = np.unpackbits(np.frombuffer(b"".join(p["bits"] for p in partly), np.uint8).reshape(len(partly), -1), axis=1, count=SIDE + 1)
        row, back = np.nonzero(bits)
        start = np.array([p["pos"] for p in partly])[row] - back
        hit[start[(start >= 0) & (start < size)]] = True
    starts = np.flatnonzero(hit)
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > LENGTH)
    return list(zip(starts[np.append(0, cut + 1)].tolist(), (starts[np.append(cut, len(starts) - 1)] + LENGTH).tolist(), strict=True))


def locate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", staging: Staging | None = None, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """``doc``, ``data`` (bytes of the text) and what ``windows_to_spans`` takes to find its runs."""
    staging = staging or Staging(docs.sparkSession, "suffix")
    source = docs.select(F.col(id_col).alias("doc"), F.encode(F.coalesce(text_col, F.lit("")), "utf-8").alias("data"))
    anchors = staging.put(anchors_of(source), "anchors")
    # A gram that occurs once anchors no repeat. The written right side is unique by gram, so that a hot
    # gram of the left side can be split.
    often = staging.put(anchors.groupBy("gram").count().filter("count > 1").select("gram"), "often")
    shared = staging.put(anchors.join(often.hint("merge"), "gram"), "shared")
    staging.drop("anchors")
    first = staging.put(shared.groupBy("gram", "block", "check").agg(F.min(F.struct("doc", "pos")).alias("f")).select("gram", "f.doc", "f.pos"), "first")
    several = staging.put(first.groupBy("gram").agg(F.count("*").alias("n_blocks")).filter("n_blocks > 1"), "several")
    wanted = first.join(several.hint("merge"), "gram").groupBy("doc").agg(F.collect_list(F.struct("gram", "pos", "n_blocks")).alias("wanted"))

    def cut(batches):
        for batch in batches:
            cols = ([], [], [], [], [], [])
            for i, (data, wanted) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                for w in wanted:
                    low = max(0, w["pos"] - SIDE)
                    for c, v in zip(cols, (w["gram"], w["n_blocks"], i, w["pos"], w["pos"] - low, data[low : w["pos"] + LENGTH]), strict=True):
                        c.append(v)
            if cols[0]:
                kinds = (pa.int64(), pa.int64(), None, pa.int32(), pa.int32(), pa.binary())
                arrays = [batch.column(0).take(pa.array(c)) if k is None else pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, ["gram", "n_blocks", "doc", "pos", "left", "data"])

    kind = dict(source.dtypes)["doc"]
    s, w = source.alias("s"), wanted.alias("w")
    joined = s.join(w, F.col("s.doc").eqNullSafe(F.col("w.doc"))).select("s.doc", "s.data", "w.wanted")
    blocks = staging.put(joined.mapInArrow(cut, f"gram long, n_blocks long, doc {kind}, pos int, left int, data binary").dropDuplicates(["gram", "doc", "pos"]), "blocks")
    whole = [F.lit(0).alias("low"), F.lit(SIDE).alias("high")]
    blocks = blocks.select("gram", *whole, F.lit(None).cast("binary").alias("core"), "doc", "pos", "left", "data", "n_blocks")
    ready, split = split_groups(blocks.filter(F.col("n_blocks") > most_blocks), most_blocks, staging)
    bits = staging.put(compare_blocks(reduce(DataFrame.unionByName, ready, blocks.filter(F.col("n_blocks") <= most_blocks))), "bits")
    no_bits = F.lit(None).cast("struct<pos:int,bits:binary>").alias("part")
    anchored = [shared.select("doc", "pos", *whole).select("doc", code(0)), first.select("doc", "pos", *whole).select("doc", code(1)), *split]
    entries = reduce(DataFrame.unionByName, [df.select("doc", "code", no_bits) for df in anchored])
    entries = entries.unionByName(bits.select("doc", F.lit(None).cast("long").alias("code"), F.struct("pos", "bits").alias("part")))
    lists = staging.put(entries.groupBy("doc").agg(F.collect_list("code").alias("codes"), F.collect_list("part").alias("partly")), "entries")
    staging.clear("entries")
    s, e = source.alias("s"), lists.alias("e")
    return s.join(e, F.col("s.doc").eqNullSafe(F.col("e.doc")), "left").select("s.doc", "s.data", "e.codes", "e.partly")


def spans_of(batch: pa.RecordBatch):
    """(bytes, removed runs) of every row of a batch of ``locate``."""
    codes = batch.column(2)
    values = codes.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum([k or 0 for k in codes.value_lengths().to_pylist()], dtype=np.int64)
    begin = 0
    for data, end, partly in zip(batch.column(1), ends.tolist(), batch.column(3), strict=True):
        text = data.as_py()
        yield text, windows_to_spans(len(text), values[begin:end], partly.as_py() or [])
        begin = end


def repeated_spans(docs: DataFrame, **options) -> DataFrame:
    """``doc`` and ``spans``: the [start, end) byte runs of each row's text that repeat."""

    def run(batches):
        for batch in batches:
            found = [[{"start": a, "end": b} for a, b in spans] for _, spans in spans_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], ["doc", "spans"])

    found = locate(docs, **options)
    return found.mapInArrow(run, f"doc {dict(found.dtypes)['doc']}, spans array<struct<start:long,end:long>>")


def without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for start, end in spans:
        out.append(data[at:start])
        at = end
    return b"".join([*out, data[at:]])


def digests(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""

    def run(batches):
        for batch in batches:
            cols = ([], [], [], [])
            for data, spans in spans_of(batch):
                row = (len(data), sum(b - a for a, b in spans), len(spans), hashlib.sha256(without(data, spans)).hexdigest())
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    found = locate(docs, **options)
    return found.mapInArrow(run, f"doc_id {dict(found.dtypes)['doc']}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op1(spark, sf_dir):
    return digests(read_table(spark, sf_dir, "documents"))
