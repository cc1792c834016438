"""SimHash near-duplicates through tables of distances to reference fingerprints.

Two operators share the search below:

* ``near_duplicates`` links 64-bit fingerprints at up to a few differing bits and misses none. The
  table holds each fingerprint's distances to 49 references: the zero fingerprint, one for each
  of 32 pairs of neighbouring bits with ones there, and 16 pseudo-random ones. A distance to a pair's
  reference less that to zero is a coordinate of 0, 1 or 2 (shifted). Changing a bit changes one of
  these 32 coordinates, so linked fingerprints differ in at most ``max_distance`` of them and agree
  in all coordinates of some a of ``max_distance`` + a groups: those are the keys of
  an equi-join, with a = 3 shared by chance by about 1 in 6 million each, and a grows with the table. Nothing of the fingerprints but these distances is in a key.
* ``similar_documents`` links documents whose five-word shingles are similar to 0.8 or more,
  which differ in far more bits, and holds each link against the shingles themselves. Its keys are least hashes
  of the set of shingles, which a pair shares with the probability of its similarity for any kind of
  edit; there are as many as a pair at that similarity needs to meet with the probability asked for.

In both, a key's members are compared through the pivot table: the distances to the 16
pseudo-random references over all bits. By the triangle inequality, pairs whose distances to any of
these differ by more than the limit can't be linked and are discarded by the largest coordinate
difference; only survivors are compared bit by bit. Large keys are searched
breadth first: each found member drops out of what is left to compare, and only one link per
member is kept, to the least id of its group. So a crowd of near copies gives as many links as
members, never all its pairs. Keys with more than ``chunk`` members are cut in chunks, and
each two chunks are compared in a task.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_counted, materialize, text_or_empty
from .components import connected_components

UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
TO_LOWER = bytes.maketrans(UPPER, LOWER)
SLAB = 200_000


SMALL = 8
#: Nodes whose keys a task takes, where there are more than the session's shuffle partitions hold.
PER_TASK = 200_000

#: Least hashes in a key of ``similar_documents``.
ROWS = 5


def majority(hashes: np.ndarray) -> np.ndarray:
    """The 64 bits that over half of the hashes have set, as one unsigned number in an array."""
    ones = np.zeros(64, dtype=np.int64)
    for a in range(0, len(hashes), SLAB):  # bounded memory for texts of any length
        ones += np.unpackbits(hashes[a : a + SLAB].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(TO_LOWER).split()


def simhash_of(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The fingerprint of one text, unsigned."""
    words = words_of(text)
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))
    digest = functools.partial(xxhash.xxh64_intdigest, seed=seed)
    return int(majority(np.fromiter(map(digest, shingles), dtype="<u8"))[0])


def simhash(text: Column, width: int = 3, seed: int = 42) -> Column:
    """SimHash of ``width``-word shingles as a long (its 64 bits; the sign is one of them)."""

    @F.pandas_udf("bigint")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([simhash_of(t, width, seed) for t in texts], dtype=np.uint64).view(np.int64))

    return run(text)


def _stir(h: np.ndarray) -> np.ndarray:
    """A 64-bit mixer for arrays of hashes."""
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(factor)
    return h ^ (h >> np.uint64(33))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles; a text of fewer words is one shingle."""
    words = words_of(text)
    each = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64)
    if not words:
        return each
    n = max(1, len(each) - width + 1)
    order = [np.uint64((2 * k + 1) * 0x9E3779B97F4A7C15 % 2**64) for k in range(width)]
    with np.errstate(over="ignore"):
        return np.unique(functools.reduce(np.add, [_stir(each[k : k + n]) * order[k] for k in range(min(width, len(each)))]))


def wide_simhash_of(shingles: np.ndarray, parts: int = 4) -> list[int]:
    """64 * ``parts`` bits, as signed numbers, of a set of hashes; an empty set gives zeros."""
    with np.errstate(over="ignore"):
        salt = [np.uint64((k + 1) * 0xD6E8FEB86659FD93 % 2**64) for k in range(parts)]
        return [int(majority(_stir(shingles ^ x)).view("<i8")[0]) for x in salt]


def planned_tables(similarity: float, recall: float, rows: int = ROWS) -> int:
    """Keys of ``rows`` least hashes that a pair at ``similarity`` needs to share one with probability ``recall``.

    A least hash is shared with the probability of the Jaccard similarity, whatever kind of edit
    made the difference, so the number doesn't depend on that or on the number of texts.
    """
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def least_hash_keys(shingles: np.ndarray, tables: int, rows: int = ROWS, seed: int = 7) -> np.ndarray:
    """``tables`` keys, each of the least of ``rows`` hashes of a set; an empty set's are all alike."""
    draws = np.random.default_rng(seed).integers(0, 2**64, size=(2, tables * rows, 1), dtype=np.uint64)
    least = np.full(tables * rows, 2**64 - 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for a in range(0, len(shingles), 2_048):  # bounded memory for texts of any length
            np.minimum(least, ((shingles[a : a + 2_048] ^ draws[0]) * (draws[1] | np.uint64(1))).min(axis=1), out=least)
        least = _stir(least).reshape(tables, rows) * np.arange(1, 2 * rows, 2, dtype=np.uint64)
        return _stir(least.sum(axis=1, dtype=np.uint64) + np.arange(tables, dtype=np.uint64)).view(np.int64)


#: References with ones in one pair of neighbouring bits each, and pseudo-random references.
PAIRS, RANDOM = 32, 16


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def pivot_table(*fp: Column) -> Column:
    """The distances to RANDOM references over all bits, one in each byte of an array of longs (distances
    above 255 count as 255, which keeps the triangle inequality's bound)."""

    def distance(k: int) -> Column:
        reference = [_signed(xxhash.xxh64_intdigest(f"pivot {k} {part}".encode())) for part in range(len(fp))]
        parts = [F.bit_count(x.bitwiseXOR(F.lit(r))) for x, r in zip(fp, reference, strict=True)]
        return F.least(functools.reduce(Column.__add__, parts), F.lit(255)).cast("bigint")

    eight = lambda first: functools.reduce(Column.bitwiseOR, [F.shiftleft(distance(first + k), 8 * k) for k in range(8)])
    return F.array(*[eight(first) for first in range(0, RANDOM, 8)])


def pair_coordinates(fp: Column) -> Column:
    """The distances to the pairs' references less that to zero, each halved and counted from its largest: 2 bits each in a long.

    With d the distance: d(fp, pair) - d(fp, 0) is 2, 0 or -2, as none, one or both of the pair's
    bits are set; kept is (2 - that) / 2. All 32 at once: both bits set, else one of them.
    """
    upper, lower = F.shiftrightunsigned(fp, 1), F.lit(_signed(0x5555555555555555))
    return F.shiftleft(upper.bitwiseAND(fp).bitwiseAND(lower), 1).bitwiseOR(upper.bitwiseXOR(fp).bitwiseAND(lower))


def planned_agreeing(nodes: int, max_distance: int, chance: float = 100.0) -> int:
    """Groups in a key, 3 to 6: the fewest with which a fingerprint meets at most ``chance`` others by chance.

    Two coordinates are equal by chance at 3 in 8. More groups give more keys; any number misses nothing.
    """
    for agreeing in range(3, 7):
        groups = max_distance + agreeing
        if nodes * math.comb(groups, agreeing) * 0.375 ** (PAIRS * agreeing / groups) <= chance:
            break
    return agreeing


def coordinate_keys(coordinates: Column, max_distance: int, agreeing: int = 3) -> Column:
    """An array of a hash for each choice of ``agreeing`` groups of coordinates, and these."""
    groups = max_distance + agreeing
    edges = [2 * (PAIRS * k // groups) for k in range(groups + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in itertools.pairwise(edges)]
    chosen = [sum(c) for c in itertools.combinations(masks, agreeing)]
    return F.array(*[F.xxhash64(F.lit(k), coordinates.bitwiseAND(F.lit(_signed(m)))) for k, m in enumerate(chosen)])


def _near(a: np.ndarray, b: np.ndarray, pivots_a: np.ndarray, pivots_b: np.ndarray, limit: int) -> np.ndarray:
    """Whether fingerprints (rows of words) are within ``limit`` bits: by pivots, then by bits."""
    near = np.abs(pivots_a - pivots_b).max(axis=1, initial=0) <= limit
    if b.ndim == 2 and len(b) == len(a):
        b = b[near]
    near[near] = np.bitwise_count(a[near] ^ b).sum(axis=1, dtype=np.int64) <= limit
    return near


def linked_groups(ids: np.ndarray, fps: np.ndarray, pivots: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(roots, members) of the links among one key's fingerprints; a root is its group's least id."""
    left = np.arange(len(ids))
    while len(left) > 1:
        found, queue, left = [left[0]], [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = _near(fps[left], fps[x], pivots[left], pivots[x], limit)
            hit = left[near]
            if len(hit):
                left = left[~near]
                found.extend(hit)
                queue.extend(hit)
        if len(found) > 1:
            group = np.sort(ids[found])
            yield np.full(len(group) - 1, group[0]), group[1:]


def _search(limit: int, parts: int):
    """For mapInPandas over rows sorted by key: the links within each run of a key."""
    pivot_columns = [f"p{k}" for k in range(RANDOM // 8)]
    names = ["key", "node", *pivot_columns, *[f"f{k}" for k in range(parts)]]
    wide = 2 + len(pivot_columns)

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
        kept: list[np.ndarray] = []  # of the last key, whose run may go on in the next batch
        for b in batches:
            if not len(b):
                continue
            rows = b[names].to_numpy(dtype=np.int64)
            last = rows[-1, 0]
            if kept and kept[0][0, 0] == last:
                kept.append(rows)
                continue
            at = int(np.searchsorted(rows[:, 0], last))
            yield np.concatenate([*kept, rows[:at]])
            kept = [rows[at:]]
        if kept:
            yield np.concatenate(kept)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in runs(batches):
            key, ids = rows[:, 0], rows[:, 1]
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.array([], dtype=int)
            sizes = np.diff(np.append(starts, len(key)))
            fps = np.ascontiguousarray(rows[:, wide:]).view(np.uint64)
            pivots = np.ascontiguousarray(rows[:, 2:wide]).view(np.uint8).reshape(len(rows), -1).astype(np.int16)
            few = np.repeat(sizes <= SMALL, sizes)
            src, dst = [], []
            for step in range(1, min(SMALL, len(key))):  # small keys: all their rows at once
                a = np.flatnonzero(few[:-step] & (key[:-step] == key[step:]))
                a = a[_near(fps[a], fps[a + step], pivots[a], pivots[a + step], limit)]
                src.append(np.minimum(ids[a], ids[a + step]))
                dst.append(np.maximum(ids[a], ids[a + step]))
            for k, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
                for roots, members in linked_groups(ids[k : k + n], fps[k : k + n], pivots[k : k + n], limit):
                    src.append(roots)
                    dst.append(members)
            if src:
                yield pd.DataFrame({"src": np.concatenate(src), "dst": np.concatenate(dst)}).drop_duplicates()

    return run


def fingerprint_links(prints: DataFrame, keys: Column, limit: int, chunk: int = 16_384) -> DataFrame:
    """(src, dst), src < dst: links that join all rows whose fingerprints a chain joins of distances
    of at most ``limit`` between rows that share a key.

    prints: a written table of node (a distinct long) and fingerprint words f0, f1 ...
    """
    words = sorted(c for c in prints.columns if c.startswith("f"))
    table = prints.withColumn("pivots", pivot_table(*map(F.col, words)))
    pivots = [F.col("pivots")[k].alias(f"p{k}") for k in range(RANDOM // 8)]
    columns = ["key", "node", *[f"p{k}" for k in range(RANDOM // 8)], *words]
    keyed = table.select("node", *words, *pivots, F.explode(keys).alias("key")).select(columns)
    crowded = materialize(prints.select(F.explode(keys).alias("key")).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > chunk), "crowded")
    if crowded.limit(1).count():
        chunks = F.ceil(F.col("n") / chunk).cast("int")
        each = keyed.join(crowded, "key", "left")
        many = each.where("n is not null").withColumn("own", F.pmod(F.xxhash64("node"), chunks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
        many = many.withColumn("key", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")))
        keyed = each.where("n is null").select(columns).unionByName(many.select(columns))
    tasks = max(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-prints.count() // PER_TASK))
    return keyed.repartition(tasks, "key").sortWithinPartitions("key").mapInPandas(_search(limit, len(words)), "src bigint, dst bigint").distinct()


def _grouped(prints: DataFrame, limit: int, chunk: int) -> DataFrame:
    """Add component_id to a written table of doc_id and fp.

    Equal fingerprints are one node, the least doc_id that has it.
    """
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies")), "fingerprints")
    search = nodes.where("node is not null").select("node", F.col("fp").alias("f0"))
    keys = coordinate_keys(pair_coordinates(F.col("f0")), limit, planned_agreeing(nodes.count(), limit))
    parts = materialize(connected_components(fingerprint_links(search, keys, limit, chunk)), "parts")
    labelled = materialize(nodes.join(parts, "node", "left").withColumn("component_id", F.coalesce("component", "node")).drop("component", "node"), "labelled")
    total = labelled.agg(F.sum("copies")).first()[0] or 0
    return join_counted(prints, labelled, ["fp"], "copies", total)


def near_duplicates(docs: DataFrame, width: int = 3, max_distance: int = 3, seed: int = 42, chunk: int = 16_384) -> DataFrame:
    """Group documents whose SimHash fingerprints differ in at most ``max_distance`` bits.

    docs: doc_id (integer), text; other columns are ignored. Words are runs of anything but
    ASCII white space after A-Z are lower-cased, shingles are ``width`` words with repeats,
    joined by a space (a text with fewer words is one shingle, a text with none or null has
    fingerprint 0 and links like any other). A bit is set where over half of the shingles'
    XXH64 have it.

    Returns a row for each input row: doc_id, fp (long), fingerprint (16 hex digits),
    component_id (the smallest doc_id that links reach, itself included). A row with a null id
    gets the component of the rows with an id that share its fingerprint, else null.
    """
    prints = materialize(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), simhash(text_or_empty(), width, seed).alias("fp")), "simhash")
    grouped = _grouped(prints, max_distance, chunk)
    return grouped.select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def wide_limit(similarity: float, bits: int) -> int:
    """Differing bits that pairs with this Jaccard similarity stay within but for less than one in a million."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.floor(bits * p + 7 * math.sqrt(bits * p * (1 - p)))


def similar_groups(sets: list[np.ndarray], similarity: float) -> Iterator[np.ndarray]:
    """Places of sets (of distinct numbers) that a chain of pairs with this Jaccard similarity joins."""
    n, sizes = len(sets), np.array([len(x) for x in sets])
    terms, owner = np.unique(np.concatenate(sets), return_inverse=True)[1], np.repeat(np.arange(n), sizes)
    own = np.split(terms, np.cumsum(sizes)[:-1])
    left, count, indexed = np.ones(n, dtype=bool), n, 2 * n + 1
    for first in range(n):
        if not left[first]:
            continue
        left[first], count, found, queue = False, count - 1, [first], [first]
        while queue and count:
            if 2 * count < indexed:  # what holds each term, of the sets that are left
                at = left[owner]
                held = owner[at][np.argsort(terms[at], kind="stable")]
                often = np.bincount(terms[at], minlength=len(terms))
                starts, indexed = np.cumsum(often) - often, count
            x = queue.pop()
            often_x = often[own[x]]
            holders = held[np.arange(often_x.sum()) + np.repeat(starts[own[x]] - np.cumsum(often_x) + often_x, often_x)]
            shared = np.bincount(holders, minlength=n)
            hit = np.flatnonzero(left & (shared > 0) & (shared * (1 + similarity) >= similarity * (sizes[x] + sizes) - 1e-9))
            left[hit], count = False, count - len(hit)
            found.extend(hit)
            queue.extend(hit)
        if len(found) > 1:
            yield np.array(found)


#: A column whose equality is that of doc_id, null included.
def _row_id() -> Column:
    return F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_signed(1 << 63)))


def similar_links(docs: DataFrame, nodes: DataFrame, width: int, similarity: float, chunk: int = 4_096, chars: int = 16_000_000) -> DataFrame:
    """(src, dst), src < dst: links that join all nodes whose texts a chain joins of pairs within a
    part whose sets of shingles have this similarity.

    nodes: node, doc_id, mark (XXH64 of the text, of the rows with this id), chars and part. A part with more
    than ``chunk`` nodes or ``chars`` characters is cut in chunks, and each two are compared in a task.
    """
    sizes = nodes.groupBy("part").agg(F.greatest(F.ceil(F.count("*") / chunk), F.ceil(F.sum("chars") / chars)).cast("int").alias("chunks"))
    many = F.col("chunks") > 1
    each = nodes.join(sizes, "part").withColumn("own", F.pmod(F.xxhash64("node"), "chunks").cast("int"))
    each = each.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    key = F.when(many, F.xxhash64("part", F.least("own", "other"), F.greatest("own", "other"))).otherwise(F.xxhash64("part"))
    texts = docs.select(_row_id().alias("row"), text_or_empty().alias("text")).withColumn("mark", F.xxhash64("text"))
    keyed = texts.join(each.select(_row_id().alias("row"), "mark", "node", key.alias("key")), ["row", "mark"])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("node")
        ids = group["node"].to_numpy(dtype=np.int64)
        links = [(min(ids[g]), ids[g]) for g in similar_groups([shingle_set(t, width) for t in group["text"]], similarity)]
        out = pd.DataFrame({"src": np.repeat([a for a, _ in links], [len(g) for _, g in links]), "dst": np.concatenate([g for _, g in links] or [[]])}, dtype=np.int64)
        return out[out["src"] < out["dst"]]

    return keyed.groupBy("key").applyInPandas(run, "src bigint, dst bigint").distinct()


def similar_documents(docs: DataFrame, width: int = 5, similarity: float = 0.8, recall: float = 0.9999, chunk: int = 16_384) -> DataFrame:
    """Group documents whose ``width``-word shingles are similar to ``similarity`` or more.

    docs: doc_id (integer), text; other columns are ignored, and words are as in
    ``near_duplicates``. Links of 256-bit SimHash fingerprints of the set of shingles, at a distance
    that hardly any pair of this similarity exceeds, join parts; within a part the sets of
    shingles themselves are compared, and only pairs that reach the similarity are linked. Candidates
    share one of several keys of five least hashes of the set of shingles; there are as many
    keys as any pair at that similarity needs to meet with probability ``recall``.

    Returns doc_id, mark (XXH64 of the text), component_id and keep for each input row. component_id is the smallest
    doc_id of the row's group (null where no row of it has one). keep is true for one (doc_id, mark) of each
    group: that with this id and, of several texts with it, the smallest mark. Rows that repeat both are all marked;
    ``one_of_each`` leaves one of them. Texts without words are alike, and ids may be null or repeat.
    """
    parts, tables = 4, planned_tables(similarity, recall)
    names = [f"f{k}" for k in range(parts)]

    @F.pandas_udf(", ".join(f"{n} bigint" for n in names) + ", keys array<bigint>")
    def run(texts: pd.Series) -> pd.DataFrame:
        sets = [shingle_set(t, width) for t in texts]
        prints = pd.DataFrame(np.array([wide_simhash_of(x, parts) for x in sets], dtype=np.int64).reshape(-1, parts), columns=names)
        return prints.assign(keys=[least_hash_keys(x, tables) for x in sets])

    columns = [F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text_or_empty()).alias("mark"), F.length(text_or_empty()).cast("bigint").alias("chars")]
    prints = materialize(docs.select(*columns, run(text_or_empty()).alias("p")).select("doc_id", "mark", "chars", "p.*"), "wide-simhash")
    # a fingerprint is one node; its first row is that with the least id, null last
    least = F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "mark", "chars", "keys")).alias("least")
    nodes = materialize(prints.groupBy(*names).agg(least, F.count("*").alias("copies")).select(F.xxhash64(*names).alias("node"), *names, "least.*", "copies"), "fingerprints")
    loose = materialize(connected_components(fingerprint_links(nodes.select("node", *names, "keys"), F.col("keys"), wide_limit(similarity, 64 * parts), chunk)), "loose")
    members = nodes.select("node", "doc_id", "mark", "chars").join(loose.select("node", F.col("component").alias("part")), "node")
    found = materialize(connected_components(similar_links(docs, members, width, similarity)), "parts")
    grouped = materialize(nodes.select("node", *names, "absent", "doc_id", "mark", "copies").join(found, "node", "left").withColumn("group", F.coalesce("component", "node")), "grouped")
    first = grouped.groupBy("group").agg(F.min(F.struct("absent", "doc_id", "mark")).alias("first"), F.count("*").alias("n"))
    first = materialize(first.select("group", F.col("first.doc_id").alias("component_id"), F.col("first.mark").alias("kept_mark"), "n"), "first-of-group")
    total, nodes_total = grouped.agg(F.sum("copies"), F.count("*")).first()
    labelled = materialize(join_counted(grouped.select(*names, "group", "copies"), first, ["group"], "n", nodes_total).drop("group"), "labelled")
    rows = join_counted(prints.select("doc_id", "mark", *names), labelled, names, "copies", total or 0)
    keep = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("mark") == F.col("kept_mark"))
    return rows.select("doc_id", "mark", "component_id", keep.alias("keep"))


def one_of_each(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """One row of docs of each group that ``similar_documents`` found in it."""
    kept = materialize(groups.where("keep").groupBy(_row_id().alias("_row"), F.col("mark").alias("_mark")).agg((F.count("*") > 1).alias("_again")), "kept")
    keys = ["_row", "_mark"]
    marked = docs.withColumns({"_row": _row_id(), "_mark": F.xxhash64(text_or_empty())})
    once = marked.join(kept.where("not _again").select(keys), keys, "left_semi")
    again = kept.where("_again").select(keys)
    out = once if not again.limit(1).count() else once.unionByName(marked.join(again, keys, "left_semi").dropDuplicates(keys))
    return out.select(*docs.columns)
