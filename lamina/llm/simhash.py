"""SimHash near-deduplication with a Gray-order hierarchical index.

A fingerprint bit is set if it is set in over half of the XXH64 digests of a text's word shingles,
repeats included. To find fingerprints that differ in few bits, each goes under several keys, every
key a mask of its bits. Masks made of all but ``radius`` blocks make the search exact: fingerprints
within the radius agree outside the blocks that their differences touch. With 6 blocks, any two
left out, a key fixes 42 bits or more, so a bucket has 2**22 different fingerprints at most and each
of them 253 others within 2 bits, whatever the input.

Inside a bucket, fingerprints are sorted by Gray rank, so that neighbours share most bits. Groups
of neighbours become nodes that hold the bits all their members share; nodes are grouped again up
to one root. The self-join descends from the root in pairs of nodes: differences in bits that both
sides share add up from level to level, and a pair over the radius is dropped with all below it. A
bucket hands on only its clusters' spanning links, not their pairs.

Null and empty texts have fingerprint zero and link like any other; fewer words than a shingle has
make one shingle. Repeated rows stay, each with its group. A null doc_id counts for no minimum.

similar_groups() links texts by the Jaccard similarity of their shingles instead. There fingerprints
can only propose: the index finds nearly all links and joins what is alike into groups, and what it
may have missed is found by an exact search over few shingles of each text (module ``overlap``).
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from fractions import Fraction
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm import overlap
from lamina.llm.common import components, materialise, small, whole_row

SEED, BITS, FAN = 42, 64, 8


def shingles(text: str | None, words: int) -> list[bytes]:
    """UTF-8 shingles after lower-casing A-Z; bytes.split() splits at 0x20 and 0x09-0x0D, which is the rule for words here."""
    w = (text or "").encode("utf-8", "replace").lower().split()
    if len(w) < words:
        return [b" ".join(w)] if w else []
    return list(map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)))


def digests(text: str | None, words: int) -> np.ndarray:
    s = shingles(text, words)
    return np.fromiter(map(xxhash.xxh64_intdigest, s, itertools.repeat(SEED)), dtype=np.uint64, count=len(s))


def _majority(h: np.ndarray) -> int:
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.int64)[0]) if len(h) else 0


def fingerprint(text: str | None, words: int) -> int:
    return _majority(digests(text, words))


def second_fingerprint(h: np.ndarray) -> int:
    """Another 64 bits from the same digests, mixed."""
    x = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return _majority(x ^ (x >> np.uint64(31)))


def fingerprint_column(text: Column, words: int) -> Column:
    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t, words) for t in texts.to_pylist()], pa.int64())

    return of(text)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The digests of the different shingles in ascending order; a text without words has one digest, 0."""
    h = np.unique(digests(text, words))
    return h if len(h) else np.zeros(1, dtype=np.uint64)


def sketch(text: Column, words: int, similarity: Fraction) -> Column:
    """Both fingerprints, of the different shingles as the similarity that decides on links is theirs, their number, their parity bits, and the first of them."""

    @F.arrow_udf("struct<fp: long, more: long, n: int, parity: array<long>, tokens: array<long>>")
    def of(texts: pa.Array) -> pa.Array:
        h = [shingle_set(t, words) for t in texts.to_pylist()]
        first = [x[: overlap.prefix_length(len(x), similarity)].view(np.int64) for x in h]
        ends = np.cumsum([0, *map(len, first)])
        tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*first, np.empty(0, dtype=np.int64)])))
        return pa.StructArray.from_arrays([pa.array([_majority(x) for x in h], pa.int64()), pa.array([second_fingerprint(x) for x in h], pa.int64()), pa.array([len(x) for x in h], pa.int32()), overlap.parity(h), tokens], names=["fp", "more", "n", "parity", "tokens"])

    return of(text)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def covering_masks(radius: int, blocks: int) -> list[int]:
    """Masks that leave out any ``radius`` of the blocks: one of them fits each pair within the radius."""
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    block = [((1 << (z - a)) - 1) << a for a, z in itertools.pairwise(cuts)]
    return [_signed(sum(block) - sum(out)) for out in itertools.combinations(block, radius)]


def sampled_masks(count: int, bits: int, seed: int = 7) -> list[int]:
    """Masks of ``bits`` positions drawn at random: a pair that differs in h of 64 bits shares one with probability (1 - h/64) ** bits."""
    draw = np.random.default_rng(seed)
    return [_signed(sum(1 << int(b) for b in draw.choice(BITS, bits, replace=False))) for _ in range(count)]


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """The place of each value in the Gray order: neighbours in that order differ in one bit."""
    x = fp.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def _levels(fp: np.ndarray, start: np.ndarray, size: np.ndarray) -> list[tuple]:
    """For each level from the rows up to one root per bucket: bits set in all members, bits set in any, first child, number of children."""
    levels, ones, any_, count = [(fp, fp, None, None)], fp, fp, size
    while True:
        groups = -(-count // FAN)
        first_group = np.cumsum(groups) - groups
        within = np.arange(groups.sum()) - np.repeat(first_group, groups)
        child = np.repeat(start, groups) + within * FAN
        children = np.minimum(FAN, np.repeat(count, groups) - within * FAN)
        ones, any_ = np.bitwise_and.reduceat(ones, child), np.bitwise_or.reduceat(any_, child)
        levels.append((ones, any_, child, children))
        start, count = first_group, groups
        if (groups == 1).all():
            return levels


def near_pairs(fp: np.ndarray, start: np.ndarray, size: np.ndarray, radius: int, number: np.ndarray | None = None, live: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows, i < j, of one bucket whose fingerprints differ in ``radius`` bits at most. Rows of a bucket lie together in Gray order.

    Buckets (``number`` of a row) that ``live``, which the caller may change meanwhile, has not are left.
    """
    levels = _levels(fp, start, size)
    chunk = 1 << 16 if live is None else 1 << 13  # each pair of nodes makes FAN ** 2 at most
    if live is not None:
        own = [number]
        for _, _, child, _ in levels[1:]:
            own.append(own[-1][child])
    roots = np.arange(len(start))
    stack = [(len(levels) - 1, roots, roots)]
    while stack:
        level, a, b = stack.pop()
        if len(a) > chunk:
            half = len(a) // 2
            stack += [(level, a[:half], b[:half]), (level, a[half:], b[half:])]
            continue
        if live is not None:
            on = live[own[level][a]]
            a, b = a[on], b[on]
        if level == 0:
            keep = a < b
            yield a[keep], b[keep]
            continue
        _, _, child, children = levels[level]
        na, nb = children[a], children[b]
        total = na * nb
        pair = np.repeat(np.arange(len(a)), total)
        k = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
        x, y = child[a][pair] + k // nb[pair], child[b][pair] + k % nb[pair]
        ones, any_ = levels[level - 1][:2]
        fixed = ~(ones[x] ^ any_[x]) & ~(ones[y] ^ any_[y])
        keep = (x <= y) & (np.bitwise_count((ones[x] ^ ones[y]) & fixed) <= radius)
        if keep.any():
            stack.append((level - 1, x[keep], y[keep]))


def _clusters(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each row the first row of its cluster."""
    label = np.arange(n)
    for i, j in pairs:
        while len(i):
            a, b = label[i], label[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label[label] != label).any():
                label = label[label]
    return label


def _spans(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    return start, np.diff(np.append(start, len(bucket)))


def _sorted(bucket: np.ndarray, ids: np.ndarray, fp: np.ndarray, *more: np.ndarray) -> list[np.ndarray]:
    """Rows of buckets with more than one row, each bucket in Gray order."""
    number = np.cumsum(np.concatenate(([False], bucket[1:] != bucket[:-1])))
    keep = np.flatnonzero(np.bincount(number)[number] > 1)
    keep = keep[np.lexsort((ids[keep], gray_rank(fp[keep]), number[keep]))]
    return [x[keep] for x in (number, ids, fp, *more)]


def _spanning(bucket: np.ndarray, ids: np.ndarray, fp: np.ndarray, more: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (id, id) that join exactly what lies within the radius, over whole buckets."""
    number, ids, fp = _sorted(bucket, ids, fp)
    if len(fp):
        label = _clusters(len(fp), near_pairs(fp, *_spans(number), radius))
        a = np.flatnonzero(label != np.arange(len(fp)))
        yield ids[a], ids[label[a]]


def _proposals(bucket: np.ndarray, ids: np.ndarray, fp: np.ndarray, more: np.ndarray, radius: int, both: int, allowed: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (id, id) to verify: of each row that to the nearest one of its bucket within both radii, or, in buckets with more than ``allowed`` such pairs a row, to its Gray neighbour."""
    number, ids, fp, more = _sorted(bucket, ids, fp, more)
    if not len(fp):
        return
    number = np.unique(number, return_inverse=True)[1]
    start, size = _spans(number)
    limit, live, count = allowed * size, np.ones(len(start), dtype=bool), np.zeros(len(start), dtype=np.int64)
    apart = lambda i, j: np.bitwise_count(fp[i] ^ fp[j]).astype(np.int64) + np.bitwise_count(more[i] ^ more[j])
    far = np.int64(1) << 62
    nearest = np.full(len(fp), far)  # distance, then the order of ids, so that all tables choose alike
    order = np.empty(len(fp), dtype=np.int64)
    order[np.argsort(ids, kind="stable")] = np.arange(len(fp))
    for i, j in near_pairs(fp, start, size, radius, number, live):
        d = apart(i, j)
        i, j, d = i[d <= both], j[d <= both], d[d <= both]
        count += np.bincount(number[i], minlength=len(start))
        live &= count <= limit  # near_pairs() leaves such a bucket
        np.minimum.at(nearest, i, (d << 40) | order[j])
        np.minimum.at(nearest, j, (d << 40) | order[i])
    at = np.argsort(order, kind="stable")
    i = np.flatnonzero((nearest < far) & live[number])
    yield ids[i], ids[at[nearest[i] & ((1 << 40) - 1)]]
    i = np.flatnonzero((number[1:] == number[:-1]) & ~live[number[1:]])
    i = i[apart(i, i + 1) <= both]
    yield ids[i], ids[i + 1]


def links(nodes: DataFrame, masks: list[int], join: Callable[..., Iterator[tuple[np.ndarray, np.ndarray]]]) -> DataFrame:
    """Links (a, b) between ids of nodes (id long, fp long, more long), found by ``join`` among those that share a mask's bits."""

    def search(batches):
        held: list[tuple] = []

        def flush():
            n, key, ids, fp, more = (np.concatenate(x) for x in zip(*held, strict=True))
            bucket = np.cumsum(np.concatenate(([0], (n[1:] != n[:-1]) | (key[1:] != key[:-1]))))
            for a, b in join(bucket, ids, fp, more):
                for i in range(0, len(a), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(a[i : i + (1 << 16)]), pa.array(b[i : i + (1 << 16)])], names=["a", "b"])

        for batch in batches:
            n, key, ids, fp, more = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            if not len(n):
                continue
            fp, more = fp.view(np.uint64), more.view(np.uint64)
            change = np.flatnonzero((n[1:] != n[:-1]) | (key[1:] != key[:-1]))
            whole = change[-1] + 1 if len(change) else 0  # the last bucket may go on
            if held and not whole and (n[0], key[0]) != (held[-1][0][-1], held[-1][1][-1]):
                yield from flush()
                held = []
            if whole:
                held.append((n[:whole], key[:whole], ids[:whole], fp[:whole], more[:whole]))
                if sum(len(x[0]) for x in held) >= 1 << 15:
                    yield from flush()
                    held = []
            held.append((n[whole:], key[whole:], ids[whole:], fp[whole:], more[whole:]))
        if held:
            yield from flush()

    keyed = nodes.select("id", "fp", "more", F.explode(F.array(*[F.struct(F.lit(i).alias("n"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])).alias("k"))
    sorted_ = keyed.select("k.n", "k.key", "id", "fp", "more").repartition("n", "key").sortWithinPartitions("n", "key")
    return sorted_.mapInArrow(search, "a long, b long").distinct()


def near_duplicates(documents: DataFrame, words: int = 3, radius: int = 2, blocks: int = 6) -> DataFrame:
    """One row per document: doc_id, fingerprint (hex), component_id (smallest doc_id that links reach).

    All texts of one fingerprint are one node, so copies cost one row each and nothing more.
    """
    own = materialise(documents.select("doc_id", fingerprint_column(F.col("text"), words).alias("fp")), "fingerprints")
    nodes = materialise(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    found = links(nodes.select(F.col("fp").alias("id"), "fp", F.lit(0).cast("long").alias("more")), covering_masks(radius, blocks), partial(_spanning, radius=radius))
    member = materialise(components(found, "simhash"), "members").withColumnRenamed("node", "fp")
    linked = materialise(nodes.join(member, "fp"), "linked")
    least = materialise(linked.groupBy("component").agg(F.min("least").alias("component_id")), "least")
    ids = materialise(linked.join(least, "component").select("fp", "component_id"), "ids")
    ids = materialise(nodes.join(ids, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "groups")
    return own.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Tables of the index over similar texts; bits of a table's mask so that a bucket holds about 2 ** SHARING of unrelated texts.
TABLES, SHARING = 48, 3


def similar_groups(documents: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 18, both: int = 34, tables: int = TABLES) -> DataFrame:
    """Groups of texts whose word shingles have a Jaccard similarity of ``similarity`` or more: rows (doc_id, text_hash, component_id) of the linked ones.

    Groups are exactly those of all such links. The index proposes texts that share one of
    ``tables`` sampled masks, lie within ``radius`` bits and, with a second fingerprint, within
    ``both`` bits (a similarity of 0.8 differs in about 10 and 19 bits); every link is verified on
    the two texts' shingle digests, and verified links are contracted. Then overlap.candidates()
    proposes all pairs of different groups that can be as similar. A text is known by doc_id and
    the hash of the text; component_id is the smallest doc_id. Rows without doc_id are in no group.
    """
    share = Fraction(str(similarity))
    key = F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")
    own = documents.where("doc_id IS NOT NULL").select("doc_id", key, sketch(F.col("text"), words, share).alias("f"))
    own = materialise(own.select(F.monotonically_increasing_id().alias("id"), "doc_id", "text_hash", "f.*"), "sketches")

    @F.arrow_udf("array<long>")
    def whole(texts: pa.Array) -> pa.Array:
        return pa.array([shingle_set(t, words).view(np.int64) for t in texts.to_pylist()], pa.list_(pa.int64()))

    def sets(wanted: DataFrame) -> DataFrame:
        """(id, s) of the texts with these ids."""
        named = materialise(own.select("id", "doc_id", "text_hash").join(small(wanted), "id", "left_semi"), "named")
        texts = documents.select("doc_id", key, "text").join(small(named), ["doc_id", "text_hash"], "left_semi").dropDuplicates(["doc_id", "text_hash"])
        return texts.select("doc_id", "text_hash", whole("text").alias("s")).join(named, ["doc_id", "text_hash"]).select("id", "s")

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = materialise(overlap.possible(pairs, own, share), "possible")
        wanted = materialise(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "wanted")
        s = materialise(sets(wanted), "sets")
        two = small(pairs).join(s.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(s.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
        shared = F.size(F.array_intersect("sa", "sb"))
        return two.where(share.denominator * shared >= share.numerator * (F.size("sa") + F.size("sb") - shared)).select("a", "b")

    bits = min(48, max(8, own.count().bit_length() - SHARING))
    proposed = links(own.select("id", "fp", "more"), sampled_masks(tables, bits), partial(_proposals, radius=radius, both=both, allowed=16))
    pairs = materialise(proposed.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "proposed")
    good = materialise(verified(pairs), "verified")
    groups = materialise(components(good, "similar"), "groups")
    rest = materialise(overlap.candidates(own, groups, sets, share), "rest")
    more = materialise(verified(rest), "verified")
    groups = components(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(more), "similar")
    named = materialise(groups.withColumnRenamed("node", "id").join(own.select("id", "doc_id", "text_hash"), "id"), "groups")
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return named.join(least, "component").select("doc_id", "text_hash", "component_id").distinct()


def keep_one(documents: DataFrame) -> DataFrame:
    """The smallest doc_id of each group of similar documents and all documents outside groups, with their columns; of several texts of that doc_id in one group all stay."""
    gone = similar_groups(documents).where("doc_id <> component_id").select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash"))
    gone = small(materialise(gone, "gone"))
    # Each document goes along as one value, so that its columns clash with none of these.
    own = documents.select(whole_row(documents), F.col("doc_id").alias("own_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("own_hash"))
    stay = own.join(gone, (F.col("own_id") == F.col("gone_id")) & (F.col("own_hash") == F.col("gone_hash")), "left_anti")
    return stay.select("row.*")
