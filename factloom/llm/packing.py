"""Sum-of-squares packing of tokenised documents into sequences of a fixed length.

Tokenising runs inside the tasks that read the texts and leaves one small row per piece.
Pieces as long as a sequence are sequences by themselves. The others are dealt at random
into partitions of about ``per_task`` pieces, and each partition is packed by the
sum-of-squares rule; the sequences that it leaves badly filled are unpacked and go through
further, coarser rounds, so the room lost at the seams between partitions is small.
"""

from __future__ import annotations

import base64
import functools
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_or_empty

#: White space in a row that the faster library, which backtracks over it, isn't given (it fails at some 700,000).
LONG_RUN = 100_000

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
SPECIAL = "<|endoftext|>"


@functools.cache
def _encoder(json_path: str, ranks_path: str | None):
    """A function from text to ids.

    The ranks file holds the same vocabulary for a faster library; a text with the special
    token's own string, or with LONG_RUN white-space characters in a row, takes the
    tokenizer of the JSON file, whose ids are the same.
    """
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(json_path)

    def plain(text: str) -> list[int]:
        return slow.encode(text, add_special_tokens=False).ids

    if ranks_path is None:
        return plain
    import tiktoken
    from public_tokenizers import PATTERN

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        return plain(text) if SPECIAL in text or long_space(text) else fast.encode_ordinary(text)

    return encode


def long_space(text: str) -> bool:
    """Whether LONG_RUN white-space characters stand in a row, in time proportional to the text."""
    return len(text) >= LONG_RUN and any(m.end() - m.start() >= LONG_RUN for m in re.finditer(r"\s+", text))


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all as long as a sequence but the first."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    starts = [*([0] if first else []), *range(first, n, capacity)]
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], n], strict=True)]


def tokenize(docs: DataFrame, json_path: str, ranks_path: str | None, capacity: int, end_id: int, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, ids."""
    names = [f.split()[0] for f in PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(json_path, ranks_path)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array(encode(text.as_py()) + [end_id], dtype="<u4")
                for k, (a, n) in enumerate(cut(len(ids), capacity)):
                    part = ids[a : a + n]
                    rows.append((doc, k, a, n, zlib.crc32(part.tobytes()), *([part.tolist()] if with_ids else ())))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            columns = list(zip(*rows, strict=True)) if rows else [()] * (len(names) + with_ids)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=False)], names=names + ["ids"] * with_ids)

    schema = PIECES + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, schema)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each piece, in the order given.

    ``open_bins[g]`` counts the open bins with room g. A piece of length s that goes from
    room g to g - s changes the sum of squares by 2 * (open_bins[g - s] - open_bins[g] + 1);
    room 0 isn't counted, so filling a bin up changes it by 1 - 2 * open_bins[s]. Ties take
    the tightest room. A new bin is opened only where no open one has room: with pieces in
    descending order that needs far fewer bins than when it competes with the open ones.
    """
    open_bins = np.zeros(capacity, dtype=np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity)]
    bins, made = np.empty(len(lengths), dtype=np.int64), 0
    never = np.iinfo(np.int64).max
    for k, s in enumerate(lengths.tolist()):
        now = open_bins[s:]  # rooms s .. capacity - 1
        change = 2 * (open_bins[: len(now)] - now + 1)
        change[:1] = 1 - 2 * now[:1]
        change[now == 0] = never
        best = int(change.argmin()) if len(change) else -1
        if best >= 0 and now[best]:
            room = s + best
            place = stacks[room].pop()
            open_bins[room] -= 1
        else:
            place, room, made = made, capacity, made + 1
        if room > s:
            stacks[room - s].append(place)
            open_bins[room - s] += 1
        bins[k] = place
    return bins


def _pack_partition(capacity: int, round_number: int, last: bool, keep_from: float):
    """A function for mapInPandas: packs what one partition holds.

    A sequence filled to less than ``keep_from`` of its length gets no number (null) unless
    the round is the last, and its pieces are packed again.
    """

    def run(batches):
        import pandas as pd

        parts = [b for b in batches if len(b)]
        if not parts:
            return
        rows = pd.concat(parts, ignore_index=True)
        rows = rows.sort_values(["length", "ids_crc32", "doc_id", "piece"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        place = sum_of_squares(rows["length"].to_numpy(), capacity)
        filled = np.bincount(place, weights=rows["length"].to_numpy())
        base = ((round_number + 1) << 56) | (TaskContext.get().partitionId() << 32)
        rows["sequence_id"] = pd.array(base + place, dtype="Int64")
        if not last:
            rows.loc[filled[place] < keep_from * capacity, "sequence_id"] = pd.NA
        rows["offset"] = rows.groupby(place)["length"].cumsum() - rows["length"]
        yield rows

    return run


def pack(pieces: DataFrame, capacity: int = 1024, per_task: int = 50_000, keep_from: float = 0.999, max_rounds: int = 4) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32).

    ``pieces`` should be a written table, since it is counted first. Pieces that are as long
    as a sequence get negative numbers; the others get round, partition and place.
    A round's partitions hold about ``per_task`` pieces each; there are as many as
    that takes, and from the second round on only pieces of badly filled sequences are left.
    Equal rows are separate pieces. No pieces give no rows.
    """
    whole = pieces.where(F.col("length") >= capacity).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    out, rest = [whole], pieces.where(F.col("length") < capacity)
    schema = PIECES + ", sequence_id bigint, offset bigint"
    for k in range(max_rounds):
        n = rest.count()
        tasks = max(1, -(-n // per_task))
        last = tasks == 1 or k == max_rounds - 1
        dealt = rest.select(*[f.split()[0] for f in PIECES.split(", ")]).repartition(tasks, F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(k)))
        packed = materialize(dealt.mapInPandas(_pack_partition(capacity, k, last, keep_from), schema), "packed")
        out.append(packed.where("sequence_id is not null"))
        if last:
            break
        rest = packed.where("sequence_id is null")
    return functools.reduce(DataFrame.unionByName, out)


def pack_documents(docs: DataFrame, json_path: str, ranks_path: str | None = None, capacity: int = 1024, end_id: int = 2, **options) -> DataFrame:
    """Tokenise and pack whole documents.

    docs: doc_id (integer, may be null or repeat), text (null counts as empty: just the end
    token); other columns are ignored. Each row of the input is a document of its own.
    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    pieces = materialize(tokenize(docs, json_path, ranks_path, capacity, end_id), "pieces")
    return pack(pieces, capacity, **options)


def sequence_tokens(docs: DataFrame, packed: DataFrame, json_path: str, ranks_path: str | None = None, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (at most ``capacity``), for training.

    An id may repeat, or be null, as after mixing: pieces are matched by id, place, length and crc32, and
    each row of ``packed`` gets its ids once. A sequence's pieces meet in one group of at most
    ``capacity`` tokens.
    """
    keys = ["doc_id", "piece", "start", "length", "ids_crc32"]
    ids = tokenize(docs, json_path, ranks_path, capacity, end_id, with_ids=True).dropDuplicates(keys)
    same = functools.reduce(Column.__and__, [packed[k].eqNullSafe(ids[k]) for k in keys])
    joined = packed.join(ids, same).select("sequence_id", "offset", "ids")
    return joined.groupBy("sequence_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))


def crc32_of(ids: list[int]) -> int:
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
