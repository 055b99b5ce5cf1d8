"""Near-duplicate classes by MinHash with tensored banding, candidates verified on whole texts.

*Signatures.* Two small collections of ``M`` half keys each are computed per shingle set; a half key is made of ``K`` minhashes.
A table of the banding is a pair (i, j) and its key is the pair of half keys (left i, right j): ``M * M`` tables from only
``2 * M * K`` minhashes. Two sets of similarity s share a table unless they differ in all left or in all right half keys, which
has probability below ``2 * (1 - s**K)**M``: 1.5e-6 at 0.85 with the defaults, and far less above. Another similarity gets
as many half keys as it needs for a probability below ``MISS``.

*Candidates.* Documents with equal shingle sets form one class, represented once. A half key that only one class has
is dropped before pairs are formed, so documents without relatives give no table keys at all.

*Links without all pairs.* In every bucket one centre, the class with the most shared half keys, is compared with the
other members; all members that meet a centre anywhere are its cluster. A cluster of up to ``CLUSTER`` members and ``LOAD`` shingles is
settled by the task that gets its texts: members outside the centre's component count their overlaps with the others in inverted
lists. A larger cluster is dealt in slices, each with the centre's text.

In larger clusters, two members that aren't both linked with their centre c meet through the prefix filter: in the order "shingles
outside c first, then by hash" two sets of the wanted similarity share one of their first ``n - ceil(s n) + 1`` shingles, and the place
of the first shared one bounds their overlap. Members far from the centre have mostly shingles of their own there, so hardly any of
them meet. One member of a meeting is compared with the others, then 8, 64, ... until all of them are in one component or compared.
Either way a pair is left out only if it can't reach the similarity or is in one component already.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellset.llm.common import ascii_lower, byte_text, in_small_batches, slices, texts_of
from cellset.llm.components import components
from cellset.session import materialize

WIDTH = 5
M, K = 11, 2
#: Largest probability that the tables miss a pair of just the wanted similarity.
MISS = 2e-6
#: Similarity at which documents are linked, in hundredths.
PERCENT = 85
CACHED_WORDS = 200_000
#: Members of a cluster that one task settles; their sets are held in memory.
CLUSTER = 4_000
#: Shingles of all members of such a cluster.
LOAD = 2_000_000
#: Members of a larger cluster that one slice compares with the centre, and their shingles.
SLICE, SLICE_LOAD = 500, 250_000


class WordHashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


@lru_cache(maxsize=1)
def word_hashes() -> WordHashes:
    return WordHashes()


def hashed_words(words: list[bytes]) -> np.ndarray:
    known = word_hashes()
    if len(known) > CACHED_WORDS:
        known.clear()
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def mixed_bits(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit numbers (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct ``width``-word shingles; fewer words: all of them as one; none: empty."""
    words = ascii_lower(text).split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    h = hashed_words(words)
    n = len(h) - width + 1
    value = np.zeros(n, np.uint64)
    for i in range(width):
        value = mixed_bits(value + h[i:i + n])
    return np.unique(value)


def half_keys(percent: int) -> int:
    """Half keys of each collection for a similarity in hundredths: ``M`` at the default."""
    return next(m for m in count(1) if 2 * (1 - (percent / 100) ** K) ** m < MISS)


def multipliers(m: int) -> np.ndarray:
    seeds = np.arange(1, 2 * m * K + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mixed_bits(seeds) | np.uint64(1)


def set_digest(values: np.ndarray) -> tuple[int, int]:
    """128-bit digest of a set as two signed numbers; it doesn't depend on order."""
    return tuple(int(np.add.reduce(mixed_bits(values ^ np.uint64(salt))).view(np.int64)) for salt in (0, 0x5851F42D4C957F2D))


#: Shingles scrambled at once, so that a very long text needs no more memory than a short one.
BLOCK = 16_384


def signature(values: np.ndarray, m: int = M) -> np.ndarray:
    """Half keys of a set as 64-bit numbers; place ``t`` belongs to the left collection for ``t < m``."""
    least = np.full(2 * m * K, np.iinfo(np.uint64).max, np.uint64)
    factors = multipliers(m)[:, None]
    for at in range(0, len(values), BLOCK):
        scrambled = values[at:at + BLOCK] * factors
        scrambled ^= scrambled >> np.uint64(32)
        np.minimum(least, scrambled.min(axis=1), out=least)
    least = least.reshape(2 * m, K)
    key = np.zeros(2 * m, np.uint64)
    for i in range(K):
        key = mixed_bits(key + least[:, i])
    return mixed_bits(key + np.arange(2 * m, dtype=np.uint64))


def text_hashes(text_col: str) -> list[Column]:
    """128 bits that tell texts apart, as two numbers."""
    return [F.xxhash64(byte_text(text_col)).alias("h1"), F.xxhash64(F.lit(1), byte_text(text_col)).alias("h2")]


def signed(df: DataFrame, id_col: str, text_col: str, m: int) -> DataFrame:
    """``id, n_shingles, s1, s2, keys, h1, h2``: set size, a 128-bit digest of the set, its half keys (NULL for an empty set) and
    hashes of the text."""
    def run(iterator):
        for batch in iterator:
            n, s1, s2, keys = [], [], [], []
            for text in texts_of(batch.column(1)):
                values = shingles(text)
                n.append(len(values))
                if not len(values):
                    s1.append(None), s2.append(None), keys.append(None)
                    continue
                one, two = set_digest(values)
                s1.append(one), s2.append(two)
                keys.append(signature(values, m).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()),
                 pa.array(keys, pa.list_(pa.int64())), batch.column(2), batch.column(3)],
                ["id", "n_shingles", "s1", "s2", "keys", "h1", "h2"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), byte_text(text_col).alias("text"), *text_hashes(text_col)).mapInArrow(
        run, f"id {kind}, n_shingles long, s1 long, s2 long, keys array<long>, h1 long, h2 long")


def table_rows(classes: DataFrame, m: int) -> DataFrame:
    """``bucket, cid, n, shared`` for every table key that at least two classes may have."""
    halves = classes.select("cid", "n", F.posexplode("keys").alias("place", "half"))
    common = halves.groupBy("half").agg(F.count("*").alias("c")).where("c > 1")
    alive = halves.join(common, "half").groupBy("cid", "n").agg(
        F.sum("c").alias("shared"), F.collect_list(F.when(F.col("place") < m, F.col("half"))).alias("left"),
        F.collect_list(F.when(F.col("place") >= m, F.col("half"))).alias("right"))  # at most m each
    keys = alive.select("cid", "n", "shared", F.explode("left").alias("l"), "right").select(
        "cid", "n", "shared", "l", F.explode("right").alias("r"))
    return keys.select(F.xxhash64("l", "r").alias("bucket"), "cid", "n", "shared")


def least_prefix(own: np.ndarray, centre: np.ndarray, percent: int) -> np.ndarray:
    """The shingles of ``own`` of which one must be shared, in the order of ``centre``: others first, then by hash."""
    inside = np.isin(own, centre, assume_unique=True)
    first = len(own) + percent * len(own) // -100 + 1
    return np.concatenate([own[~inside], own[inside]])[:first]


def needed(n, m, percent: int):
    """Shared shingles that sets of ``n`` and ``m`` need."""
    return (percent * (n + m) + 99 + percent) // (100 + percent)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    return len(np.intersect1d(a, b, assume_unique=True)) >= needed(len(a), len(b), percent)


class Cluster:
    """Members of one centre that a single task settles."""

    def __init__(self, centre: int, own: np.ndarray, percent: int):
        self.percent, self.ids, self.sets, self.label, self.links = percent, [centre], [own], [0], []

    def root(self, i: int) -> int:
        while self.label[i] != i:
            self.label[i] = i = self.label[self.label[i]]
        return i

    def add(self, cid: int, own: np.ndarray) -> None:
        self.ids.append(cid)
        self.sets.append(own)
        self.label.append(len(self.label))
        if similar(self.sets[0], own, self.percent):
            self.join(0, len(self.ids) - 1)

    def join(self, i: int, j: int) -> None:
        self.links.append((self.ids[i], self.ids[j]))
        self.label[max(self.root(i), self.root(j))] = min(self.root(i), self.root(j))

    def settle(self) -> list[tuple[int, int]]:
        """Links (enough to connect each component) among the members.

        Members outside the centre's component count their overlaps with all others through the shingles' lists of members.
        """
        far = [i for i in range(len(self.ids)) if self.root(i) != 0]
        if len(self.ids) < 3 or not far:
            return self.links
        sizes = np.array([len(x) for x in self.sets])
        begin = np.cumsum(sizes) - sizes
        code = np.unique(np.concatenate(self.sets), return_inverse=True)[1]
        owners = np.repeat(np.arange(len(sizes)), sizes)[np.argsort(code, kind="stable")]
        count = np.bincount(code)
        start = np.cumsum(count) - count
        for i in far:
            own = code[begin[i]:begin[i] + sizes[i]]
            own = own[count[own] > 1]
            lengths = count[own]
            at = np.arange(lengths.sum()) + np.repeat(start[own] - (np.cumsum(lengths) - lengths), lengths)
            shared = np.bincount(owners[at], minlength=len(sizes))
            for j in np.flatnonzero(shared >= needed(sizes, sizes[i], self.percent)).tolist():
                if self.root(i) != self.root(j):
                    self.join(i, j)
        return self.links


def settled_clusters(pairs: DataFrame, texts: DataFrame, percent: int, most: int) -> DataFrame:
    """``a, b, linked, prefix`` of candidate ``pairs`` (``centre, cid``) by their whole shingle sets.

    ``pairs`` has ``n`` too, the shingles of ``cid``. Clusters of up to ``most`` members and ``LOAD`` shingles come as links that connect
    them; of larger ones, which are dealt in slices, each member comes with its comparison with the centre and its prefix.
    """
    def run(iterator):
        out, cluster, large, centre_set = [], None, False, None
        for batch in slices(iterator):
            for centre, cid, is_large, text in zip(*(c.to_pylist() for c in batch.columns[:3]), texts_of(batch.column(3)), strict=True):
                own = shingles(text)
                if centre == cid:
                    if cluster is not None:
                        out += [(a, b, True, None) for a, b in cluster.settle()]
                    large, centre_set = is_large, own
                    cluster = None if large else Cluster(cid, own, percent)
                elif large:
                    out.append((centre, cid, similar(centre_set, own, percent), least_prefix(own, centre_set, percent).view(np.int64)))
                else:
                    cluster.add(cid, own)
            if len(out) > 1000:
                yield links_batch(out)
                out = []
        if cluster is not None:
            out += [(a, b, True, None) for a, b in cluster.settle()]
        if out:
            yield links_batch(out)

    sizes = pairs.groupBy("centre").agg((F.count("*") + 1).alias("m"), F.sum("n").alias("load")).selectExpr(
        "centre", f"m > {most} or load > {LOAD} as large", f"cast(greatest(m div {SLICE}, load div {SLICE_LOAD}) + 1 as int) as parts")
    sizes = sizes.withColumn("parts", F.when(F.col("large"), F.col("parts")).otherwise(1))
    rows = pairs.join(sizes, "centre").select("centre", "cid", "large", F.expr("cast(pmod(xxhash64(cid), parts) as int)").alias("slice"))
    rows = rows.unionByName(sizes.select("centre", F.col("centre").alias("cid"), "large", F.expr("explode(sequence(0, parts - 1))").alias("slice")))
    placed = rows.join(texts, "cid").select("centre", "cid", "large", "text", "slice").repartition(
        "centre", "slice").sortWithinPartitions("centre", "slice", F.col("cid") != F.col("centre")).drop("slice")
    return placed.mapInArrow(run, "a long, b long, linked boolean, prefix array<long>")


def links_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)],
                                      ["a", "b", "linked", "prefix"])


def overlap(n: str, m: str, percent: int) -> str:
    """Shared shingles that sets of ``n`` and ``m`` need."""
    return f"(({percent} * ({n} + {m}) + {99 + percent}) div {100 + percent})"


def with_component(rows: DataFrame, comps: DataFrame) -> DataFrame:
    named = comps.select(F.col("node").alias("cid"), F.col("component").alias("comp"))
    return rows.join(named, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))


def still_open(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of those groups that hold more than one component."""
    mixed = rows.groupBy(*keys).agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select(*keys)
    return rows.join(mixed, keys, "left_semi")


def linked_components(members: DataFrame, texts: DataFrame, percent: int, most: int) -> DataFrame:
    """``node, component`` of the classes with links, from the table rows ``bucket, cid, n, shared`` (see the module's text)."""
    centres = members.groupBy("bucket").agg(F.max(F.struct("shared", "cid")).alias("c")).select("bucket", F.col("c.cid").alias("centre"))
    pairs = materialize(members.join(centres, "bucket").where("cid <> centre").select("centre", "cid", "n", "shared").distinct())
    first = materialize(settled_clusters(pairs.select("centre", "cid", "n"), texts, percent, most))
    links = first.where("linked").select("a", "b")
    comps = components(links)
    large = first.where("prefix is not null").select(F.col("a").alias("centre"), F.col("b").alias("cid"), "linked", "prefix")
    if not large.limit(1).count():
        return comps

    far = large.where("not linked").select("centre").distinct()
    meeting = large.join(far, "centre", "left_semi").join(pairs, ["centre", "cid"]).select(
        "centre", "cid", "n", "shared", F.posexplode("prefix").alias("pos", "shingle"))
    least = meeting.groupBy("centre", "shingle").agg(F.min("n").alias("least_n"), F.count("*").alias("c")).where("c > 1").drop("c")
    able = meeting.join(least, ["centre", "shingle"]).where(
        f"n - pos >= {overlap('n', f'greatest(least_n, ({percent} * n + 99) div 100)', percent)}").drop("least_n")
    rows = materialize(still_open(with_component(able, comps), ["centre", "shingle"]))

    tested, turn = pairs.select("centre", "cid"), 0
    while rows.limit(1).count():
        slot = F.pmod(F.xxhash64("cid", F.lit(turn)), F.lit(8 ** turn))
        chosen = materialize(rows.withColumn("slot", slot).groupBy("centre", "shingle", "slot").agg(
            F.max(F.struct("shared", "cid", "n", "pos", "comp")).alias("c")).select(
            "centre", "shingle", F.col("c.cid").alias("other"), F.col("c.n").alias("m"), F.col("c.pos").alias("at"),
            F.col("c.comp").alias("other_comp")))
        near = rows.join(chosen, ["centre", "shingle"]).where(F.col("comp") != F.col("other_comp")).where(
            f"least(n, m) * 100 >= greatest(n, m) * {percent} and least(n - pos, m - at) >= {overlap('n', 'm', percent)}")
        near = near.select(F.col("other").alias("centre"), "cid", "n").distinct()
        near = materialize(near.join(tested, ["centre", "cid"], "left_anti"))
        # as clusters of any size: only the comparison with the centre is wanted
        found = materialize(settled_clusters(near, texts, percent, 0).where("linked").select("a", "b"))
        tested = tested.unionByName(near.select("centre", "cid"))
        if found.limit(1).count():
            links = links.unionByName(found)
            comps = components(links)
        used = chosen.select("centre", "shingle", F.col("other").alias("cid"))
        left = rows.drop("comp").join(used, ["centre", "shingle", "cid"], "left_anti")
        rows = materialize(still_open(with_component(left, comps), ["centre", "shingle"]))
        turn += 1
    return comps


def marked_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT,
                       most: int = CLUSTER) -> DataFrame:
    """``id, n_shingles, component_id, kept``, one row per row of ``df``, with hashes ``h1, h2`` of its text and the number
    ``component`` of its component (NULL for a text without words).

    Documents are linked when their sets of distinct five-word shingles (A-Z lower-cased) have a similarity of ``percent``
    hundredths or more; ``component_id`` is the smallest id reachable. Texts without words are linked with nothing. Rows that
    repeat an id with equal text share everything; with different texts each is placed by its own text. NULL ids
    are never smallest unless a component has no other. An empty table gives an empty result.
    """
    m = half_keys(percent)
    rows = materialize(signed(in_small_batches(df), id_col, text_col, m))
    classes = rows.where("n_shingles > 0").groupBy("s1", "s2").agg(
        F.min("id").alias("first_id"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()))
    members = materialize(table_rows(classes, m))
    live = classes.join(members.select("cid").distinct(), "cid", "left_semi").select("cid", "s1", "s2", "first_id")
    texts = materialize(class_texts(df, id_col, text_col, live))

    comps = linked_components(members, texts, percent, most)
    grouped = classes.select("cid", "s1", "s2", "first_id").join(comps.withColumnRenamed("node", "cid"), "cid", "left").withColumn(
        "component", F.coalesce("component", "cid"))
    least = grouped.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = grouped.join(least, "component")
    placed = rows.drop("keys").join(named.select("s1", "s2", "component", "component_id"), ["s1", "s2"], "left").withColumn(
        "component_id", F.when(F.col("n_shingles") == 0, F.col("id")).otherwise(F.col("component_id")))
    return placed.select("id", "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"), "h1", "h2", "component")


def class_texts(df: DataFrame, id_col: str, text_col: str, live: DataFrame) -> DataFrame:
    """``cid, text``: one whole text for every class in ``live``, found by id and set digest."""
    def run(iterator):
        for batch in iterator:
            s1, s2 = zip(*(set_digest(shingles(x)) for x in texts_of(batch.column(1))), strict=True) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), batch.column(1)], ["s1", "s2", "text"])

    docs = df.select(F.col(id_col).alias("id"), byte_text(text_col).alias("text"))
    near = docs.join(live, docs["id"].eqNullSafe(live["first_id"]), "left_semi").mapInArrow(run, "s1 long, s2 long, text binary")
    # repeated rows give the same text more than once
    return near.join(live, ["s1", "s2"]).groupBy("cid").agg(F.first("text").alias("text"))


def without_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """``df`` with one document of each component: the one with the smallest id (NULL last, ties by a hash of the text). Columns unchanged.

    Texts without words are all kept. A document is its id and text together: other texts under the same id, or without an
    id, are placed by what they say, and rows equal in both stay or go together. An empty table gives an empty result.
    """
    place = {c: f"c{i}" for i, c in enumerate(df.columns)}
    rows = df.toDF(*place.values())
    marked = materialize(marked_near_copies(rows, place[id_col], place[text_col], percent).where("n_shingles > 0").select(
        "component", "id", "h1", "h2"))
    first = marked.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h1", "h2")).alias("first"))
    gone = marked.distinct().join(first, "component").where(
        ~(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("h1") == F.col("first.h1")) & (F.col("h2") == F.col("first.h2"))))
    gone = materialize(gone.select("id", F.col("h1").alias("gone_1"), F.col("h2").alias("gone_2")))
    h1, h2 = text_hashes(place[text_col])
    kept = rows.join(gone, rows[place[id_col]].eqNullSafe(gone["id"]) & (h1 == gone["gone_1"]) & (h2 == gone["gone_2"]), "left_anti")
    return kept.select(*[F.col(v).alias(k) for k, v in place.items()])
