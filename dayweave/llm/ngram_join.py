"""Jaccard join on word n-grams by adaptive multi-match prefixes."""

from __future__ import annotations

import hashlib
import math
import sys
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

from dayweave.llm.components import components
from dayweave.llm.hashing import Hashed, Powers, blocks, mixed
from dayweave.llm.text import running_totals
from dayweave.sources import materialize, scratch_space

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORDS, PERCENT = 5, 80
# Shared prefix n-grams that a pair must have: the fewest and the most a document asks for, and
# the expected chance partners per match above which it asks for twice as many.
FEWEST, MOST, COST = 8, 32, 4.0
BUCKETS = 1 << 16
# Prefix n-grams are dealt to buckets: the fewest, and how many n-grams one holds where there are
# more. Of the hash, `SENT` bits are sent; others choose the bucket.
LEAST_BUCKETS, BUCKET_TOKENS, SENT = 256, 1 << 19, 32
# Values of a signature, how many of them gather families, and how many must agree for that.
VALUES, BANDS, AGREE = 16, 6, 6
# Documents gathered, or compared with each other, in one go; larger groups take more goes.
GROUP, TILE = 4096, 512
BLOCK_BYTES = 1 << 20
# Ids, of 8 bytes each, that may be broadcast: to find texts, and where rows would be shuffled
# otherwise. More of the former go as bits of their hashes, `ID_BITS` whatever their number.
IDS, FEW_IDS, ID_BITS = 65_536, 1_000_000, 1 << 25
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LOWER = np.arange(256, dtype=np.uint8) + np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), 32, 0).astype(np.uint8)
_STEP = np.uint64(0xD1B54A32D192ED03)
_SHORT = np.uint64(0x2545F4914F6CDD1D)
_SEEDS = np.random.default_rng(5).integers(1 << 62, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Shingles:
    """Hashes of the distinct n-grams of words of many texts."""

    def __init__(self, n: int, powers: Powers | None = None):
        self.n, self.powers = n, powers or Powers()

    def words(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each word, and which text it is in."""
        if not len(data):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        inside = ~_SPACE[data]
        cut = np.zeros(len(data) + 1, dtype=bool)
        cut[ends] = True
        before = np.concatenate([[False], inside[:-1]]) & ~cut[:-1]
        after = np.concatenate([inside[1:], [False]]) & ~cut[1:]
        start = np.flatnonzero(inside & ~before)
        end = np.flatnonzero(inside & ~after) + 1
        h = mixed(Hashed(_LOWER[data], self.powers).of(start, end))
        return h, np.searchsorted(ends, start, side="right") - 1

    def keys(self, data, ends, level=None) -> list[np.ndarray]:
        """For every text its distinct n-grams, sorted; with the levels of words, rare ones
        first: the sum of the levels leads, then the hash. A text of fewer words than n has one
        n-gram of them all, a text without words has none."""
        h, text = self.words(data, ends)
        n = self.n
        whole = np.searchsorted(text, np.arange(len(ends)))
        m = max(len(h) - n + 1, 0)
        joined, height = np.zeros(m, np.uint64), np.zeros(m, np.int64)
        levels = level[(h >> np.uint64(48)).astype(np.int64)] if level is not None else None
        for i in range(n):
            joined = joined * _STEP + h[i : i + m]
            if levels is not None:
                height += levels[i : i + m]
        joined = self._key(joined, height if levels is not None else None)
        out = []
        for a, b in zip(whole[:-1], whole[1:]):
            if b - a >= n:
                out.append(np.unique(joined[a : b - n + 1]))
            elif b > a:
                short = np.full(1, b - a, np.uint64)
                for i in range(a, b):
                    short = short * _STEP + h[i : i + 1]
                top = levels[a:b].sum(keepdims=True) if levels is not None else None
                out.append(self._key(short * _SHORT, top))
            else:
                out.append(joined[:0])
        return out

    @staticmethod
    def _key(joined: np.ndarray, height: np.ndarray | None) -> np.ndarray:
        joined = mixed(joined)
        if height is None:
            return joined
        return (np.minimum(height, 255).astype(np.uint64) << np.uint64(56)) | (joined >> np.uint64(8))


def _word_counter(batches):
    """How many words fall into each bucket of hashes, summed per task."""
    shingles, counts = Shingles(1), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for _, _, data, ends in blocks(batch.column("text"), BLOCK_BYTES):
            h, _ = shingles.words(data, ends)
            counts += np.bincount((h >> np.uint64(48)).astype(np.int64), minlength=BUCKETS)
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["bucket", "n"])


def word_levels(docs: DataFrame) -> tuple[np.ndarray, float]:
    """The logarithm of the count of each of a fixed number of buckets of words, over all texts,
    and of all words. The table has the same size whatever the input."""
    counted = docs.select("text").mapInArrow(_word_counter, "bucket long, n long")
    rows = counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(BUCKETS)
    for row in rows:
        counts[row["bucket"]] = row["n"]
    return np.round(np.log2(counts + 1)).astype(np.int64), math.log2(counts.sum() + 1)


def _required(n: int, percent: int) -> int:
    """N-grams that a set of n must share with any other to be similar."""
    return -(-n * percent // 100)


def prefix_length(keys: np.ndarray, percent: int, total: float, words: int) -> tuple[int, int]:
    """Length of a document's prefix, and how many matches in it a partner must have.

    Sets that share r of n n-grams share at least m of the first n - r + m in any common order.
    The more chance partners the n-grams of the prefix are expected to have, by the frequency of
    their words, the longer the prefix and the more matches are asked for.
    """
    n = len(keys)
    r = _required(n, percent)
    m = min(FEWEST, r)
    expected = np.cumsum(np.exp2((keys >> np.uint64(56)).astype(np.float64) - (words - 1) * total))
    while m < min(MOST, r) and expected[min(n - r + m, n) - 1] > COST * m:
        m = min(2 * m, r)
    return n - r + m, m


def signatures(keys: list[np.ndarray]) -> np.ndarray:
    """For each set the smallest of its hashes, under several hash functions."""
    out = np.zeros((len(keys), VALUES), dtype=np.int32)
    full = np.flatnonzero([len(k) for k in keys])
    if len(full):
        flat = np.concatenate([keys[i] for i in full])
        begins = np.cumsum([0, *(len(keys[i]) for i in full)])[:-1]
        for v, seed in enumerate(_SEEDS):
            least = np.minimum.reduceat(mixed(flat * seed), begins)
            out[full, v] = (least >> np.uint64(33)).astype(np.int32)
    return out


def _sent(keys: np.ndarray) -> np.ndarray:
    """The bits of n-grams that are sent to the buckets."""
    return (keys & np.uint64((1 << SENT) - 1)).astype(np.uint32)


def _profiler(n: int, percent: int, level: np.ndarray, total: float):
    def profile(batches):
        shingles = Shingles(n)
        for batch in batches:
            sizes, digests, signs, matches, lasts, lengths, prefixes = [], [], [], [], [], [], []
            for _, _, data, ends in blocks(batch.column("text"), BLOCK_BYTES):
                own = shingles.keys(data, ends, level)
                signs.append(signatures(own))
                for keys in own:
                    sizes.append(len(keys))
                    digests.append(hashlib.blake2b(keys.tobytes(), digest_size=16).digest())
                    length, m = prefix_length(keys, percent, total, n) if len(keys) else (0, 0)
                    # So many n-grams may be lost among others that look alike when they are sent.
                    alike = length - len(np.unique(_sent(keys[:length])))
                    matches.append(max(m - alike, min(m, 1)))
                    lengths.append(length - alike)
                    # Order of unsigned values.
                    lasts.append((int(keys[length - 1]) if length else 0) - (1 << 63))
                    prefixes.append(keys[:length].view(np.uint8).reshape(-1, 8)[:, :6].tobytes())
            sign = np.concatenate(signs).ravel() if signs else np.zeros(0, np.int32)
            columns = [
                batch.column("doc_id"),
                pa.array(sizes, pa.int64()),
                pa.array(digests, pa.binary()),
                pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * VALUES, pa.int32()), pa.array(sign)),
                pa.array(matches, pa.int32()),
                pa.array(lasts, pa.int64()),
                pa.array(lengths, pa.int32()),
                pa.array(prefixes, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "digest", "sign", "matches", "last", "length", "prefix"])

    return profile


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    low, high = sorted((len(a), len(b)))
    if 100 * low < percent * high:
        return False
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (low + high - shared)


def _all_keys(column: pa.Array, shingles: Shingles) -> list[np.ndarray]:
    return [k for _, _, data, ends in blocks(column, BLOCK_BYTES) for k in shingles.keys(data, ends)]


def _gather(batches):
    """In runs of rows of one group, join each document to an earlier one with much the same
    signature, if there is one among those that stand for themselves."""
    group, signs, leaders = None, np.zeros((GROUP, VALUES), np.int32), []
    for batch in batches:
        docs, heads = [], []
        own = np.asarray(batch.column("sign").flatten()).reshape(-1, VALUES)
        keys = zip(*(batch.column(c).to_pylist() for c in ("band", "value", "part", "doc")))
        for sign, (*key, doc) in zip(own, keys):
            if key != group:
                group, leaders = key, []
            if len(leaders) == len(signs):
                signs = np.concatenate([signs, np.zeros_like(signs)])
            agree = (signs[: len(leaders)] == sign).sum(axis=1)
            at = int(agree.argmax()) if len(agree) else 0
            if len(agree) and agree[at] >= AGREE:
                docs.append(doc)
                heads.append(leaders[at])
            else:
                signs[len(leaders)] = sign
                leaders.append(doc)
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(heads, pa.int64())], names=["a", "b"])


def linked(keys: list[np.ndarray], side: np.ndarray, both: bool, percent: int) -> list[tuple[int, int]]:
    """Links among sets that connect all that are connected, found by comparing them all: those of
    the two sides with each other, or with `both` false all of them. Pairs that are connected
    already are not compared."""
    size = np.array([len(k) for k in keys])
    owner = np.repeat(np.arange(len(keys)), size)
    _, token, count = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    shared = count > 1
    place = np.cumsum(shared) - 1
    use = shared[token]
    owner, token = owner[use], place[token[use]]
    bits = np.zeros((len(keys), int(shared.sum()) // 64 + 1), dtype=np.uint64)
    order = np.lexsort((token, owner))
    owner, token = owner[order], token[order]
    cell = owner * bits.shape[1] + token // 64
    first = np.flatnonzero(np.diff(cell, prepend=-1))
    if len(first):
        one = np.uint64(1) << (token % 64).astype(np.uint64)
        bits.ravel()[cell[first]] = np.bitwise_or.reduceat(one, first)
    root, out = np.arange(len(keys)), []
    at = np.arange(len(keys))
    for i in range(len(keys)):
        fits = (100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i])) & (root != root[i])
        fits &= (side != side[i]) & (at > i) if both else at > i
        others = np.flatnonzero(fits)
        if not len(others):
            continue
        common = np.bitwise_count(bits[others] & bits[i]).sum(axis=1, dtype=np.int64)
        for j in others[100 * common >= percent * (size[others] + size[i] - common)]:
            if root[j] != root[i]:
                out.append((i, int(j)))
                root[root == root[j]] = root[i]
    return out


def _comparer(n: int, percent: int):
    """Compare the documents of two tiles of a family, or of one with each other."""

    def compare(batches):
        shingles, group, docs, tiles, keys = Shingles(n), None, [], [], []

        def links():
            side = np.array(tiles)
            found = linked(keys, side, bool(group) and group[1] != group[2], percent) if len(keys) > 1 else []
            columns = [pa.array([docs[p[k]] for p in found], pa.int64()) for k in (0, 1)]
            return pa.RecordBatch.from_arrays(columns, names=["a", "b"])

        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("family", "x", "y", "doc", "tile")))
            for (*key, doc, tile), own in zip(rows, _all_keys(batch.column("text"), shingles)):
                if key != group:
                    yield links()
                    group, docs, tiles, keys = key, [], [], []
                docs.append(doc)
                tiles.append(tile)
                keys.append(own)
        yield links()

    return compare


def _dealer(buckets: int):
    """Pack prefix n-grams: a row for each bucket and run of documents has their bits, their
    documents, and for the last of them, those of documents in families, these families."""

    def deal(batches):
        for batch in batches:
            prefix, family = batch.column("prefix"), batch.column("family")
            # Six bytes each: four of them, and two that choose the bucket.
            data = np.zeros((sum(map(len, parts := prefix.to_pylist())) // 6, 8), np.uint8)
            data[:, :6] = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, 6)
            keys = data.view(np.uint64).ravel()
            size = pc.binary_length(prefix).to_numpy() // 6
            doc, home, known = (
                np.repeat(c.to_numpy(zero_copy_only=False), size) for c in (batch.column("doc"), family.fill_null(0), family.is_valid())
            )
            bucket = ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(16)).astype(np.int64)
            order = np.lexsort((known, bucket))
            token, doc, home, known, bucket = _sent(keys)[order], doc[order], home[order], known[order], bucket[order]
            begins = np.flatnonzero(np.diff(bucket, prepend=-1))
            rows = [
                (int(bucket[a]), token[a:b].tobytes(), doc[a:b].tobytes(), home[a:b][known[a:b]].tobytes())
                for a, b in zip(begins, [*begins[1:], len(bucket)])
            ]
            kinds = {"bucket": pa.int64(), "tokens": pa.binary(), "docs": pa.binary(), "families": pa.binary()}
            columns = [pa.array([row[i] for row in rows], kind) for i, kind in enumerate(kinds.values())]
            yield pa.RecordBatch.from_arrays(columns, names=list(kinds))

    return deal


def _shared(bucket: pa.Table) -> pa.Table:
    """The n-grams of a bucket that documents of different families have, with these documents,
    each once."""
    token, doc = (np.frombuffer(b"".join(bucket.column(c).to_pylist()), kind) for c, kind in (("tokens", np.uint32), ("docs", np.int64)))
    family, ends = doc.copy(), np.cumsum([len(d) // 8 for d in bucket.column("docs").to_pylist()])
    for end, packed in zip(ends, bucket.column("families").to_pylist()):
        family[end - len(packed) // 8 : end] = np.frombuffer(packed, np.int64)
    order = np.lexsort((doc, token))
    order = order[(np.diff(token[order].astype(np.int64), prepend=-1) != 0) | (np.diff(doc[order], prepend=0) != 0)]
    token, doc, family = token[order], doc[order], family[order]
    begins = np.flatnonzero(np.diff(token.astype(np.int64), prepend=-1))
    df = np.diff(np.append(begins, len(token)))
    keep = np.repeat(np.minimum.reduceat(family, begins) != np.maximum.reduceat(family, begins), df)
    token = token.astype(np.int64) | bucket.column("bucket")[0].as_py() << 32
    return pa.table({"token": token[keep], "df": np.repeat(df, df)[keep], "doc": doc[keep], "family": family[keep]})


def _verifier(n: int, percent: int):
    def verify(batches):
        shingles = Shingles(n)
        for batch in batches:
            left, right = (_all_keys(batch.column(c), shingles) for c in ("text_a", "text_b"))
            keep = pa.array([similar(x, y, percent) for x, y in zip(left, right)], pa.bool_())
            yield batch.select(["a", "b"]).filter(keep)

    return verify


def _families(reps: DataFrame, folder: str) -> DataFrame:
    """doc, family and its size for documents that are much like some other, by signatures.

    Families only decide how documents are compared: all within one, by prefixes across them.
    """
    bands = F.explode(F.array(*[F.struct(F.lit(i).alias("band"), F.col("sign")[i].alias("value")) for i in range(BANDS)]))
    # One signature of each document, also where rows are repeated.
    signs = materialize(reps.groupBy("doc").agg(F.min("sign").alias("sign")), "signs", folder)
    active = signs.select("doc", bands.alias("b")).select("doc", "b.band", "b.value")
    coarse, key = [], ["band", "value"]
    while True:
        groups = active.groupBy(*key).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 1)
        parts = F.ceil(F.col("size") / GROUP).alias("parts")
        members = active.join(groups.select(*key, parts), key)
        members = materialize(members.withColumn("part", F.pmod(F.xxhash64("doc"), "parts")), "bands", folder)
        # A group is never more than about GROUP documents, however many share a value.
        laid = members.join(signs, "doc").repartition(*key, "part").sortWithinPartitions(*key, "part", "doc")
        found = laid.select("band", "value", "part", "doc", "sign").mapInArrow(_gather, "a long, b long")
        coarse.append(materialize(found.distinct(), "gathered", folder))
        # What is left of a group that took several goes is gathered again, while that helps.
        rest = members.where(F.col("parts") > 1).select("doc", *key)
        if rest.isEmpty() or coarse[-1].isEmpty():
            break
        active = materialize(rest.join(coarse[-1].select(F.col("a").alias("doc")).distinct(), "doc", "left_anti"), "active", folder)
    found = components(reduce(DataFrame.union, coarse), folder).select(F.col("node").alias("doc"), F.col("component").alias("family"))
    sizes = found.groupBy("family").agg(F.count(F.lit(1)).alias("members"))
    return materialize(found.join(sizes, "family"), "families", folder)


def join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every document.

    A document's set holds the distinct runs of `words` words of its whole text, lower-cased in
    A-Z. Two documents are linked when 100 * intersection >= percent * union; component_id is the
    smallest doc_id reachable by links. No link between different texts is lost:

    1. Documents with equal sets are one class with one representative.
    2. Representatives that are much alike by their signatures are a family. The members of a
       family are compared with each other, in tiles, and only links that connect leave a task;
       so a large group of near copies gives no more rows than it has members for each tile.
    3. N-grams are ordered by the frequency of their words over all texts, rare ones first. Each
       representative has a prefix in that order, see `prefix_length`. Pairs from different
       families that share enough prefix n-grams are verified on their texts.

    A missing or empty text, or one without words, has an empty set and links with nothing; a
    text of fewer words has them all as one n-gram. Rows with the same doc_id are one document
    in the graph; a row without doc_id links with nothing and has no component. Ties at the
    threshold are links. An empty table gives no rows. Other columns are not used. The result is
    written, and the tables it was made from go.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with scratch_space(docs.sparkSession, "ngram-join") as folder:
        level, total = word_levels(rows)
        schema = "doc_id long, n long, digest binary, sign array<int>, matches int, last long, length int, prefix binary"
        profile = materialize(rows.mapInArrow(_profiler(words, percent, level, total), schema), "profile", folder)
        usable = profile.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
        classes = materialize(usable.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("rows")), "classes", folder)
        heads = classes.select("digest", F.col("rep").alias("doc"))
        own = usable.withColumnRenamed("doc_id", "doc")
        families = _families(own.select("doc", "digest", "sign").join(heads, ["doc", "digest"]).select("doc", "sign"), folder)
        homes = heads.join(families.select("doc", "family"), "doc", "left")
        reps = own.drop("sign").join(homes, ["doc", "digest"])
        pairs = materialize(_candidates(reps, _buckets(profile), percent, folder), "pairs", folder)
        wanted = families.select("doc").union(pairs.select("a")).union(pairs.select("b")).distinct()
        texts = _texts(rows, materialize(wanted, "wanted", folder))
        texts = materialize(texts, "texts", folder)

        for s in ("a", "b"):
            pairs = pairs.join(texts.select(F.col("doc").alias(s), F.col("text").alias(f"text_{s}")), s)
        across = pairs.select("a", "b", "text_a", "text_b").mapInArrow(_verifier(words, percent), "a long, b long")
        links = [_copies(usable, classes), _compared(families, texts, words, percent), across]
        connected = components(reduce(DataFrame.union, links), folder)
        out = profile.select("doc_id", F.col("n").alias("n_shingles"))
        out = out.join(connected, F.col("doc_id") == F.col("node"), "left").select(
            "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")
        )
        return materialize(out, "ngram-components")


def _copies(usable: DataFrame, classes: DataFrame) -> DataFrame:
    several = classes.where(F.col("rows") > 1)
    return usable.select("doc_id", "digest").join(several, "digest").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))


def _compared(families: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links inside families. Each member goes to the comparisons of its tile with every tile."""
    tiles = F.ceil(F.col("members") / TILE)
    placed = families.withColumns({"tiles": tiles, "tile": F.pmod(F.xxhash64("doc"), tiles)})
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("other")
    placed = placed.select("family", "doc", "tile", other)
    laid = (
        placed.select("family", F.least("tile", "other").alias("x"), F.greatest("tile", "other").alias("y"), "doc", "tile")
        .join(texts, "doc")
        .repartition("family", "x", "y")
        .sortWithinPartitions("family", "x", "y", "doc")
    )
    return laid.mapInArrow(_comparer(words, percent), "a long, b long")


def _buckets(profile: DataFrame) -> int:
    """How many buckets the prefix n-grams need."""
    tokens = profile.agg(F.sum("length")).first()[0] or 0
    return min(max(LEAST_BUCKETS, math.ceil(tokens / BUCKET_TOKENS)), 1 << 16)


def _candidates(reps: DataFrame, buckets: int, percent: int, folder: str) -> DataFrame:
    """Pairs (a, b) of documents from different families with enough prefix n-grams in common.

    With prefixes cut at the earlier of their ends, what one has there and the other has not is
    missing from the whole of the other. A pair can be similar only if the one whose prefix ends
    first misses no more than its size less the n-grams that the pair must share. Different
    n-grams that look alike add pairs, and `_profiler` asks for as many less as they may hide.
    Where several texts have one doc_id, the least that any of them asks for counts.
    """
    dealt = reps.select("doc", "family", "prefix").mapInArrow(_dealer(buckets), "bucket long, tokens binary, docs binary, families binary")
    shared = dealt.groupBy("bucket").applyInArrow(_shared, "token long, df long, doc long, family long")
    across = materialize(shared, "across", folder)
    found = across.groupBy("doc").agg(F.count(F.lit(1)).alias("found"), F.first("family").alias("family"))
    # No partner asks for less than this.
    least = F.least("matches", F.lit(FEWEST))
    asks = reps.groupBy("doc").agg(
        F.min(least).alias("least"),
        F.min("n").alias("low"),
        F.max("n").alias("high"),
        F.min("last").alias("last"),
        F.min(F.col("length") - F.col("n")).alias("spare"),
        (F.min("digest") != F.max("digest")).alias("several"),
    )
    enough = materialize(asks.join(found, "doc").where(F.col("found") >= F.col("least")), "enough", folder)
    # A pair that shares so many n-grams shares the rarest of them also when each document leaves
    # out its most frequent ones, one less than that.
    by_df = Window.partitionBy("doc").orderBy(F.desc("df"), F.desc("token"))
    rare = across.drop("family").join(enough, "doc").withColumn("place", F.row_number().over(by_df)).where(F.col("place") >= F.col("least"))
    names = ("doc", "low", "high", "family", "last", "spare", "several")
    side = lambda s: rare.select("token", *[F.col(c).alias(f"{c}_{s}") for c in names])
    small, large = F.least("high_a", "high_b"), F.greatest("low_a", "low_b")
    must_share = F.ceil(percent * (F.col("low_a") + F.col("low_b")) / (100 + percent))
    asked = F.when(F.col("several_a") | F.col("several_b"), F.least("spare_a", "spare_b"))
    asked = asked.when(F.col("last_a") <= F.col("last_b"), F.col("spare_a")).otherwise(F.col("spare_b"))
    pairs = (
        side("a")
        .join(side("b"), "token")
        .where((F.col("doc_a") < F.col("doc_b")) & (F.col("family_a") != F.col("family_b")) & (100 * small >= percent * large))
        .groupBy(F.col("doc_a").alias("a"), F.col("doc_b").alias("b"))
        .agg(F.first(must_share + asked).alias("asked"))
    )
    tokens = across.join(enough.select("doc"), "doc").groupBy("doc").agg(F.collect_set("token").alias("tokens"))
    for s in ("a", "b"):
        pairs = pairs.join(tokens.select(F.col("doc").alias(s), F.col("tokens").alias(f"tokens_{s}")), s)
    return pairs.where(F.size(F.array_intersect("tokens_a", "tokens_b")) >= F.col("asked")).select("a", "b")


def _texts(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """doc and text of the rows with these ids.

    A broadcast of ids would grow with the input in the driver. Where there are many, their bits are
    sent, and only rows that may have one of them are shuffled.
    """
    if ids.count() <= IDS:
        ids = F.broadcast(ids)
    else:
        at = lambda c: F.pmod(F.xxhash64(c), F.lit(ID_BITS))
        bucket, bit = F.bitmap_bucket_number(at("doc")), F.bitmap_bit_position(at("doc"))
        bits = ids.groupBy(bucket.alias("bucket")).agg(F.bitmap_construct_agg(bit).alias("bits"))
        bit = F.bitmap_bit_position(at("doc_id")).cast("int")
        byte = F.conv(F.hex(F.substring("bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        held = byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), bit % 8)) != 0
        rows = rows.join(F.broadcast(bits), (F.bitmap_bucket_number(at("doc_id")) == F.col("bucket")) & held, "left_semi")
    return rows.join(ids, rows["doc_id"] == ids["doc"]).select("doc", "text")


def _small(ids: DataFrame) -> DataFrame:
    """A table of ids, to be broadcast if there are few enough; otherwise Spark shuffles both sides."""
    return F.broadcast(ids) if ids.count() <= FEW_IDS else ids


def _nodes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`docs` with a node, `__node`, for each doc_id and text, and the nodes that are no doc_id.

    Usually a node is the doc_id. Where rows with one doc_id have different texts, the text with
    the smallest hash has that node, and the others have numbers that no doc_id has.
    """
    named = docs.withColumns(
        {"__id": F.col("doc_id").cast("long"), "__h1": F.xxhash64("text"), "__h2": F.xxhash64(F.lit("text"), "text")}
    )
    some = named.where(F.col("__id").isNotNull()).select("__id", "__h1", "__h2")
    differ = [F.min(c) != F.max(c) for c in ("__h1", "__h2")]
    torn = some.groupBy("__id").agg((differ[0] | differ[1]).alias("differ")).where("differ").select("__id")
    texts = some.join(materialize(torn, "torn"), "__id").distinct()
    by_hash = Window.partitionBy("__id").orderBy("__h1", "__h2")
    others = texts.withColumn("place", F.row_number().over(by_hash)).where(F.col("place") > 1).drop("place")
    ranked = materialize(running_totals(others, [F.col(c) for c in ("__id", "__h1", "__h2")], {"rank": F.lit(1)}, "texts-of-ids"), "ranks")
    count = ranked.count()
    if not count:
        return docs.withColumn("__node", F.col("doc_id").cast("long")), ranked.select(F.col("rank").alias("__other"), "__id")
    low, high = some.agg(F.min("__id"), F.max("__id")).first()
    if high + count < 1 << 63:
        node = F.lit(high) + F.col("rank")
    elif low - count >= -(1 << 63):
        node = F.lit(low) - F.col("rank")
    else:
        raise ValueError("no numbers are left for texts with the same doc_id")
    extra = materialize(ranked.select("__id", "__h1", "__h2", node.cast("long").alias("__other")), "nodes")
    noded = named.join(extra, ["__id", "__h1", "__h2"], "left").withColumn("__node", F.coalesce("__other", "__id"))
    return noded.select(*docs.columns, "__node"), extra.select(F.col("__other"), "__id")


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents, one of each group of linked ones: that with the smallest doc_id.

    Rows without doc_id stay. Rows with the same doc_id are linked by their texts like any
    others: of those with equal texts the one that is smallest in the order of its other columns
    stays, those whose texts are not linked all stay. Whole rows are shuffled once, unless few rows go,
    and once more only those that are repeated.
    """
    noded, others = _nodes(docs)
    found = join(noded.select(F.col("__node").alias("doc_id"), "text"), words, percent)
    found = found.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("__dropped"), F.col("component_id").alias("group"))
    counted = found.groupBy("__dropped").agg(F.min("group").alias("group"), F.count(F.lit(1)).alias("rows"))
    found = materialize(counted.join(others, F.col("__dropped") == F.col("__other"), "left"), "found")
    # The numbers of further texts do not tell which doc_id is smallest.
    own = F.struct(F.coalesce("__id", "__dropped").alias("id"), F.col("__dropped").alias("node"))
    first = found.groupBy("group").agg(F.min(own).alias("first"))
    stays = F.col("__dropped") == F.col("first.node")
    # Rows that go, and rows of nodes that have several, of which one stays.
    marked = found.join(first, "group").where(~stays | (F.col("rows") > 1)).select("__dropped", stays.alias("stays"))
    marked = materialize(marked, "marked")
    single = noded.join(_small(marked.select("__dropped")), F.col("__node") == F.col("__dropped"), "left_anti").select(*docs.columns)
    if not marked.where("stays").head(1):
        return single
    columns = [c for c in docs.columns if c != "text"]
    ordered = [c for c, t in docs.dtypes if c != "text" and "map<" not in t]
    # Maps have no order. Rows of a node have the same text.
    row = F.struct(*docs.columns)
    least = F.min(row) if len(ordered) == len(columns) else F.min_by(row, F.struct(*ordered))
    repeated = noded.join(marked.where("stays"), F.col("__node") == F.col("__dropped")).groupBy("__node").agg(least.alias("__row"))
    return single.unionByName(repeated.select(*[F.col("__row")[c].alias(c) for c in docs.columns]))
