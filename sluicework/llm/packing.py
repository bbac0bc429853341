"""Vector best-fit packing of token sequences.

Every document is tokenized once, where it is read; longer ones are cut into full pieces with the
shorter piece first. What is dealt out for packing are rows of a few numbers for each piece. A bin
(a training sequence) has three capacities: tokens, documents and attention cost (the sum of squared
lengths). Pieces are placed largest first into the open bin whose weighted residual norm after
placement is least, among all open bins that can take the piece under every capacity; if there is none,
a bin is opened. Residual tokens weigh so much more than the other two that these decide among bins of
equal residual tokens: so the least norm is found without scoring every bin. Tasks pack ``chunk`` pieces at a time, which bounds memory and costs at most one
ill-filled bin for each chunk.

Edge cases: a null text is the empty text (its piece is the end token alone); null ids are kept;
repeated rows are packed as rows of their own; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read_table, whole

#: The weight of documents and of attention, as a share of one squared token of the residual.
LIGHT = 0.1


def byte_level_encoder(path: str):
    """An encoder of texts to the ids that ``tokenizers`` gives for this byte-level BPE file.

    The ids of such a vocabulary are ordered by merge rank, so a rank-based encoder yields the same
    ids several times faster. Both are compared on a few strings; if they differ, or the file is of
    another kind, ``tokenizers`` itself encodes.
    """
    import json

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    plain = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    try:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in printable]
        of_char = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(hidden)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(of_char[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        # Fixed value: the split pattern of byte-level BPE.
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        fast = tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        encode = lambda text: fast.encode(text, allowed_special="all", disallowed_special=())
        tests = ["", "It's  a\n\n test, 12345 \t x", "éçü ñandú 漢字 🙂", "<|endoftext|>a b", "don't!!  %%% ###\r\n", "aaaaaaaaaaaaaaaaaaaaaaaa  "]
        if all(encode(t) == plain(t) for t in tests):
            return encode
    except (ImportError, KeyError, TypeError, ValueError):
        pass
    return plain


def pieces_of(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: a row for each piece of at most ``capacity`` ids."""

    def cut(batches):
        encode = byte_level_encoder(tokenizer_path)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            cols = ([], [], [], [], [])
            for i, text in enumerate(texts.to_pylist()):
                found = np.array([*encode(text), end_id], dtype="<u4")
                at, piece = 0, 0
                size = len(found) % capacity or capacity
                while at < len(found):
                    for c, v in zip(cols, (i, piece, at, size, zlib.crc32(found[at : at + size].tobytes())), strict=True):
                        c.append(v)
                    at, piece, size = at + size, piece + 1, capacity
            if cols[0]:
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(cols[0])), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text"))
    return src.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, capacity: int, max_docs: int, max_attention: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item; lengths are at most ``capacity``. Among equal norms, fewer documents,
    then less attention left, then the bin opened last."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    # Open bins by residual tokens, then by what else is left: bins alike in all three are as good.
    open_bins: list[dict[tuple[int, int], list[int]]] = [{} for _ in range(capacity + 1)]
    filled = np.zeros(capacity + 1, bool)
    wd, wa = LIGHT / max_docs**2, LIGHT / float(max_attention) ** 2
    used = 0
    for i in np.argsort(-lengths, kind="stable"):
        size = int(lengths[i])
        cost = size * size
        at, left = size, None
        while at <= capacity and left is None:
            r = at + int(filled[at:].argmax())
            if not filled[r]:
                break
            fits = [state for state in open_bins[r] if state[1] >= cost]
            if len(fits) > 1:
                left = min(fits, key=lambda state: (wd * (state[0] - 1) ** 2 + wa * (state[1] - cost) ** 2, state))
            elif fits:
                left = fits[0]
            at = r + 1
        if left is None:
            r, left, b = capacity, (max_docs, max_attention), used
            used += 1
        else:
            alike = open_bins[r][left]
            b = alike.pop()
            if not alike:
                del open_bins[r][left]
                filled[r] = bool(open_bins[r])
        bins[i], offsets[i] = b, capacity - r
        docs, costs = left[0] - 1, left[1] - cost
        # A bin that is full in any dimension is closed: no piece is shorter than one token.
        if r - size > 0 and docs > 0 and costs > 0:
            open_bins[r - size].setdefault((docs, costs), []).append(b)
            filled[r - size] = True
    return bins, offsets


def pack_pieces(pieces: DataFrame, *, capacity: int = 1024, max_docs: int | None = None, max_attention: int | None = None, groups: int = 1, chunk: int = 100_000) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a ``length``. By default the limits on
    documents and attention cost are those that tokens imply, so that they never bind.

    A piece alone in a bin may exceed ``max_attention``, as it cannot be cut further.
    """
    most_docs = max_docs or capacity
    most_cost = max_attention or capacity * capacity
    names = pieces.columns

    def place(batches):
        base = TaskContext.get().partitionId() << 40
        held, rows, used = [], 0, 0

        def flush():
            nonlocal used
            table = pa.Table.from_batches(held).sort_by([("length", "descending"), *[(c, "ascending") for c in names if c != "length"]])
            lengths = table.column("length").to_numpy()
            alone = (lengths >= capacity) | (lengths * lengths >= most_cost) | (most_docs == 1)
            bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            bins[alone] = np.arange(alone.sum())
            if not alone.all():
                b, offsets[~alone] = best_fit(lengths[~alone], capacity, most_docs, most_cost)
                bins[~alone] = b + alone.sum()
            table = table.append_column("sequence_id", pa.array(bins + base + used)).append_column("offset", pa.array(offsets))
            used += int(bins.max()) + 1
            return table.combine_chunks().to_batches()

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= chunk:
                yield from flush()
                held, rows = [], 0
        if rows:
            yield from flush()

    schema = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long"
    return pieces.repartition(max(1, groups), "doc_id", "piece").mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2, docs_per_group: int = 50_000, **limits) -> DataFrame:
    """Tokenize, cut and pack; the number of packing tasks follows the number of rows."""
    groups = -(-docs.count() // docs_per_group)
    return pack_pieces(pieces_of(docs, tokenizer_path, id_col=id_col, text_col=text_col, capacity=capacity, end_id=end_id), capacity=capacity, groups=groups, **limits)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6(spark, sf_dir):
    return pack_documents(read_table(spark, sf_dir, "documents"), default_tokenizer())
