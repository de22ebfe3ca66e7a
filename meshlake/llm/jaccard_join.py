"""N-gram Jaccard self-join with PartEnum signatures, and the groups that its links make.

A document's set is its distinct three-word shingles. Two sets link when their Jaccard similarity
is at least 0.9, which bounds how many shingles they may differ by (their Hamming distance).

Signatures. Sizes are cut into bands; the larger set of a pair decides the band, and a set gives
signatures for each band where it may be a partner. With at most k differences in a band, the
shingle domain is hashed into ``ceil((k + 1) / 2)`` parts, one of which holds at most one of them,
and each part into three, of which two are then equal. So every part gives three signatures, one
for each two of its three, and linked sets share at least one.

Links. Sets that are equal are one class first, so copies make no pairs. Within each signature's
bucket every class is paired with the bucket's first and with the one before it; these few pairs
are verified and joined into groups. Then only pairs of different groups within a bucket are
left, and all of them are verified, in blocks of bounded size. No link between groups is lost, and
those inside a group need not be found. Pairs are ruled out first by their sizes and by a parity
sketch of 512 bits, whose distance never exceeds the sets'; the rest compare whole sets.

Hot buckets. Signatures that many classes of a small sample share are dealt into salted parts, so
that no task sorts a whole bucket. A bucket of many classes in different groups is refined: its
classes get the signatures of another hash of the domain, and linked ones share one of those too,
so a bucket falls into smaller ones that lose no link; only what stays large is compared in blocks.

Defined cases
-------------
* Words are maximal runs outside white space (tab to carriage return, and blank), A-Z lower-cased.
* One or two words are one shingle; without words or text the set is empty and links with nothing.
* Rows with a null id take part; a group's name is its smallest id, null if it has none.
* Repeated rows are equal sets. ``one_of_each_group`` keeps one row of each group, also of repeated
  rows and of rows without an id, and every row whose set is empty. Further columns are ignored. An empty table gives no rows.

Classes are known by a 64-bit hash of the set and by its size. Texts are never shuffled while the
ids to verify fit the broadcast bound. Nothing of the corpus is collected.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, shared_table
from .hashing import blocks, byte_table, words_of

#: Similarity from which sets link, in hundredths.
LINK = 90
SHINGLE = 3
SKETCH = 8
#: Members of a bucket that are compared in one task.
BLOCK = 1024
#: Times that a bucket with more classes than ``BLOCK`` is refined.
REFINED = 3
#: A class of ``SAMPLE`` is looked at to find hot signatures: those of ``HOT`` such classes, dealt in ``SALTS`` parts.
SAMPLE, HOT, SALTS = 64, 64, 64
_NO_ID = 2**63 - 1

DIGEST = "doc_id long, text_hash long, n long, class long, " + ", ".join(f"s{i} long" for i in range(SKETCH))
SIGNATURES = "sig long, class long"
SETS = "class long, shingles array<long>"

_WHITE = byte_table((9, 13), (32, 32))
_M = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _M[3]
    h = (h ^ (h >> np.uint64(29))) * _M[0]
    return h ^ (h >> np.uint64(32))


def shingles(texts: pa.Array):
    """For each text its distinct shingles as sorted 64-bit hashes."""
    for _, some in blocks(texts):
        w = words_of(pc.ascii_lower(some), _WHITE)
        h, bounds = w.hashes(), w.bounds(len(some)).tolist()
        n = max(0, len(h) - SHINGLE + 1)
        s = h[:n] * _M[0]
        s = (s ^ (s >> np.uint64(32)) ^ h[1 : n + 1]) * _M[1]
        s = _mix((s ^ (s >> np.uint64(32)) ^ h[2 : n + 2]) * _M[2])
        for i, j in zip(bounds, bounds[1:]):
            if j - i >= SHINGLE:
                yield np.unique(s[i : j - SHINGLE + 1])
            elif j - i == 2:
                yield _mix((h[i : i + 1] * _M[1] ^ h[i + 1 : j] * _M[2]) * _M[4] + np.uint64(2))
            else:
                yield _mix(h[i:j] * _M[1] + np.uint64(1))


def class_of(h: np.ndarray) -> int:
    """Name of the class of equal sets; 0 is the empty set's."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(h.tobytes()) or 1))) if len(h) else 0


def sketch_of(h: np.ndarray) -> list[int]:
    """Parity of the number of elements in each of 512 cells."""
    odd = np.bincount((h >> np.uint64(20) & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


@lru_cache(maxsize=100_000)
def bands_for(size: int) -> tuple[tuple[int, int], ...]:
    """(band, largest number of differences) of the bands in which a set of this size may be a partner."""
    out, band, low = [], 0, 10
    while low * LINK <= size * 100:
        high = max(low, low * 100 * 100 // (LINK * LINK))
        if size <= high:
            out.append((band, 2 * high * (100 - LINK) // (100 + LINK)))
        band, low = band + 1, high + 1
    return tuple(out)


def signatures_of(h: np.ndarray, level: int = 0) -> np.ndarray:
    """Every signature of one set; another ``level`` hashes the domain anew."""
    out = []
    spread = _mix(h + _M[4] * np.uint64(2 * level + 1)) >> np.uint64(32)
    low, high = (h & np.uint64(0xFFFFFFFF)).astype(np.float64), (h >> np.uint64(32)).astype(np.float64)
    for band, k in bands_for(len(h)):
        parts = (k + 2) // 2
        cell = (spread * np.uint64(3 * parts) >> np.uint64(32)).astype(np.int64)
        total = np.bincount(cell, low, 3 * parts).astype(np.uint64) + (np.bincount(cell, high, 3 * parts).astype(np.uint64) << np.uint64(32))
        total = total.reshape(parts, 3)
        name = (np.arange(parts, dtype=np.uint64) + np.uint64(band << 32)) * _M[1]
        for which, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))):
            out.append(_mix(_mix(total[:, a] + name + np.uint64(which)) * _M[2] + total[:, b]))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


def _keyed(docs: DataFrame) -> DataFrame:
    """``key, text_hash, text``: a row is known by its id (a large number for null) and a hash of its text."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("key"), F.xxhash64("text").alias("text_hash"), "text")


def digests(docs: DataFrame) -> DataFrame:
    """One row per document: size, class and sketch of its set."""
    schema = _schema(DIGEST)

    def run(batches):
        for batch in batches:
            cols: list[list] = [[] for _ in range(len(schema) - 2)]
            for h in shingles(batch.column("text")):
                for col, x in zip(cols, (len(h), class_of(h), *sketch_of(h)), strict=True):
                    col.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in cols)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, DIGEST)


def signatures(docs: DataFrame, level: int = 0) -> DataFrame:
    """(sig, class) of every set; a task gives those of equal sets once as long as it remembers them."""
    schema = _schema(SIGNATURES)

    def run(batches):
        met: set[int] = set()
        for batch in batches:
            sigs, classes, counts = [], [], []
            for h in shingles(batch.column("text")):
                name = class_of(h)
                if name in met:
                    continue
                if len(met) > 1_000_000:
                    met.clear()
                met.add(name)
                own = signatures_of(h, level)
                if len(own):
                    sigs.append(own)
                    classes.append(name)
                    counts.append(len(own))
            if sigs:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.repeat(np.array(classes, np.int64), counts))], schema=schema
                )

    return docs.select("text").mapInArrow(run, SIGNATURES)


def sets_of(docs: DataFrame) -> DataFrame:
    """(class, shingles) of every document given, in batches of about a million shingles."""
    schema = _schema(SETS)

    def batch_of(sets: list[np.ndarray]) -> pa.RecordBatch:
        ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
        values = pa.array(np.concatenate(sets).view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array([class_of(h) for h in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), values)], schema=schema)

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for h in shingles(batch.column("text")):
                held.append(h)
                n += len(h)
                if n > 1_000_000:
                    yield batch_of(held)
                    held, n = [], 0
        if held:
            yield batch_of(held)

    return docs.select("text").mapInArrow(run, SETS)


def texts_of(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """One text of each class in ``wanted``, or a few where rows are repeated."""
    rows = shared_table(classes.join(wanted, "class", "left_semi").select("key", "text_hash"), "asked-texts")
    return _keyed(docs).join(broadcast_if_small(rows), ["key", "text_hash"], "left_semi")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) with the smallest node reachable as the label; edges (a, b) of longs.

    Each round takes the smallest label of the neighbours and then the label's own label, so the
    distance that labels travel grows with every round; written to the shared folder each time.
    """
    both = shared_table(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = shared_table(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels["node"] == near["a"], "left").select("node", "label", F.least("label", "near").alias("new"))
        up = labels.select(F.col("node").alias("at"), F.col("label").alias("up"))
        jumped = step.join(up, step["new"] == up["at"], "left").select("node", F.least("new", "up").alias("label"), (F.least("new", "up") != F.col("label")).alias("moved"))
        after = shared_table(jumped, "labels")
        if not after.where("moved").limit(1).count():
            return after.select("node", "label")
        labels = after.select("node", "label")


def _may_link(a: str, b: str) -> Column:
    """Sizes and sketches of two rows don't rule a link out."""
    x, y = F.col(f"{a}.n"), F.col(f"{b}.n")
    apart = sum((F.bit_count(F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))) for i in range(1, SKETCH)), F.bit_count(F.col(f"{a}.s0").bitwiseXOR(F.col(f"{b}.s0"))))
    return (F.least(x, y) * 100 >= F.greatest(x, y) * LINK) & (apart * (100 + LINK) <= (x + y) * (100 - LINK))


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets link; the sets are made again from one text of each class."""
    pairs = shared_table(pairs, "pairs")
    wanted = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct()
    sets = shared_table(sets_of(texts_of(docs, classes, wanted)).dropDuplicates(["class"]), "sets")
    left, right = (sets.select(F.col("class").alias(c), F.col("shingles").alias(f"set_{c}")) for c in ("a", "b"))
    met = pairs.join(right, "b").join(left, "a")
    both = F.size(F.array_intersect("set_a", "set_b"))
    return met.where(both * 100 >= (F.size("set_a") + F.size("set_b") - both) * LINK).select("a", "b")


def classes_of(digest: DataFrame) -> DataFrame:
    """One row per distinct non-empty set, with the row of the smallest id that has it as ``key`` and ``text_hash``."""
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(_NO_ID)).alias("key"), "text_hash")).alias("f")
    sketch = [f"s{i}" for i in range(SKETCH)]
    return digest.where("n > 0").groupBy("class", "n").agg(first, *(F.first(c).alias(c) for c in sketch)).select("class", "n", "f.key", "f.text_hash", *sketch)


def bucket_members(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(sig, class, before, leader) of every class that shares a signature, or the salted part of a hot one."""
    few = docs.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0)
    common = shared_table(signatures(few).distinct().groupBy("sig").count().where(F.col("count") >= hot).select("sig", F.lit(SALTS).alias("salts")), "hot-signatures")
    dealt = signatures(docs).join(broadcast_if_small(common), "sig", "left")
    dealt = dealt.withColumn("salt", F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64("class"), F.col("salts"))).otherwise(F.lit(0)))
    dealt = dealt.select("sig", "class", "salt", F.col("salts").isNotNull().alias("hot")).repartition("sig", "salt").dropDuplicates(["sig", "salt", "class"])
    part = Window.partitionBy("sig", "salt").orderBy("class")
    members = dealt.select(
        "sig", "class", "hot", F.lag("class").over(part).alias("before"), F.lead("class").over(part).alias("after"), F.first("class").over(part).alias("leader")
    )
    return shared_table(members.where("before is not null or after is not null or hot").select("sig", "class", "before", "leader", "hot"), "buckets")


def few_pairs(members: DataFrame) -> DataFrame:
    """(a, b): each class with its part's first class and the one before it, and the parts' first classes with the first of all."""
    pair = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    inside = members.where("before is not null").select(F.explode(F.array(pair("leader", "class"), pair("before", "class"))).alias("p"))
    leaders = members.where("hot and before is null")
    first = leaders.groupBy("sig").agg(F.min("class").alias("least"))
    across = leaders.join(first, "sig").where("least != class").select(pair("least", "class").alias("p"))
    return inside.unionByName(across).select("p.a", "p.b").distinct()


def mixed_buckets(rows: DataFrame) -> DataFrame:
    """(sig, m) of the buckets with classes of different groups."""
    sizes = rows.groupBy("sig").agg(F.count("*").alias("m"), F.min("group").alias("lo"), F.max("group").alias("hi"))
    return shared_table(sizes.where("lo != hi").select("sig", "m"), "mixed-buckets")


def refined(rows: DataFrame, docs: DataFrame, classes: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """(sig, class, group) and the mixed buckets, where those of more than ``block`` classes are divided by further signatures."""
    mixed = mixed_buckets(rows)
    for level in range(1, REFINED + 1):
        large = mixed.where(F.col("m") > block)
        if not large.limit(1).count():
            break
        big = shared_table(rows.join(large, "sig").select("sig", "class", "group"), "large-buckets")
        more = signatures(texts_of(docs, classes, big.select("class").distinct()), level).withColumnRenamed("sig", "further").distinct()
        parts = big.join(more, "class").select(F.xxhash64("sig", "further").alias("sig"), "class", "group")
        rows = shared_table(rows.join(mixed.where(F.col("m") <= block), "sig").select("sig", "class", "group").unionByName(parts), "refined-buckets")
        mixed = mixed_buckets(rows)
    return rows, mixed


def class_links(docs: DataFrame, classes: DataFrame, block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """Verified links (a, b) between classes, enough to connect each group."""
    members = bucket_members(docs, hot)
    sketches = classes.select("class", "n", *(f"s{i}" for i in range(SKETCH)))

    # Few pairs of each bucket first.
    few = (
        few_pairs(members)
        .join(sketches.alias("x"), F.col("a") == F.col("x.class"))
        .join(sketches.alias("y"), F.col("b") == F.col("y.class"))
        .where(_may_link("x", "y"))
        .select("a", "b")
    )
    first = shared_table(verified(few, docs, classes), "links-1")
    grouped = components(first)

    # Then whatever is left between groups.
    rows = members.select("sig", "class").join(grouped, members["class"] == grouped["node"], "left").select("sig", "class", F.coalesce("label", "class").alias("group"))
    rows, mixed = refined(shared_table(rows, "grouped-buckets"), docs, classes, block)
    rows = rows.join(mixed.select("sig", F.ceil(F.col("m") / block).cast("int").alias("blocks")), "sig").join(sketches, "class")
    own = F.pmod(F.hash("class"), F.col("blocks"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    a = rows.withColumn("i", own).select("*", every.alias("j"))
    b = rows.withColumn("j", own).select("*", every.alias("i"))
    on = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("sig", "i", "j")]
    rest = a.alias("x").join(b.alias("y"), [*on, F.col("x.group") < F.col("y.group"), _may_link("x", "y")])
    second = verified(rest.select(F.col("x.class").alias("a"), F.col("y.class").alias("b")).distinct(), docs, classes)
    return first.unionByName(shared_table(second, "links-2"))


def labelled_classes(digest: DataFrame, docs: DataFrame, **kw) -> DataFrame:
    """Each class with its own first row and the group's: ``class, n, key, text_hash, first_key, first_hash``."""
    classes = shared_table(classes_of(digest), "set-classes")
    label = components(class_links(docs, classes, **kw))
    named = classes.select("class", "n", "key", "text_hash").join(label, classes["class"] == label["node"], "left").select("class", "n", "key", "text_hash", F.coalesce("label", "class").alias("label"))
    named = shared_table(named, "class-labels")
    smallest = named.groupBy("label").agg(F.min(F.struct("key", "text_hash")).alias("f"))
    return shared_table(named.join(smallest, "label").select("class", "n", "key", "text_hash", F.col("f.key").alias("first_key"), F.col("f.text_hash").alias("first_hash")), "class-names")


def jaccard_groups(docs: DataFrame, **kw) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document."""
    digest = shared_table(digests(docs), "set-digests")
    names = labelled_classes(digest, docs, **kw).select("class", "n", "first_key")
    joined = digest.select("doc_id", "n", "class").join(names, ["class", "n"], "left")
    return joined.select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.nullif("first_key", F.lit(_NO_ID))).alias("component_id")
    )


def one_of_each_group(docs: DataFrame, **kw) -> DataFrame:
    """``docs`` with one row of each group: that of the smallest id, then of the smallest hash of its text."""
    digest = shared_table(digests(docs), "set-digests")
    names = labelled_classes(digest, docs, **kw)
    rows = digest.where("n > 0").select("class", "n", F.coalesce("doc_id", F.lit(_NO_ID)).alias("key"), "text_hash").groupBy("class", "n", "key", "text_hash").agg(F.count("*").alias("copies"))
    fate = rows.join(names.select("class", "n", "first_key", "first_hash"), ["class", "n"])
    stays = (F.col("key") == F.col("first_key")) & (F.col("text_hash") == F.col("first_hash"))
    fate = shared_table(fate.select("key", "text_hash", stays.alias("stays"), "copies").where("not stays or copies > 1"), "near-copies")
    keyed = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("key"), F.xxhash64("text").alias("text_hash"))
    met = keyed.join(broadcast_if_small(fate), ["key", "text_hash"], "left")
    # Repeated rows of one that stays are few and meet by their name; all others never leave their place.
    alone = met.where("stays is null").select("row")
    repeated = met.where("stays").groupBy("key", "text_hash").agg(F.first("row").alias("row")).select("row")
    return alone.unionByName(repeated).select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
