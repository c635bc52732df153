"""SimHash near-duplicate detection by meet-in-the-middle ball hashing.

Two fingerprints at most 2r bits apart both lie within r bits of some value between
them. With r = 1 every distinct fingerprint emits itself and all values one bit away;
a shuffle on these variants brings each pair within two bits together at least twice.
A bucket holds at most bits + 1 distinct fingerprints whatever the data, and any two of
them are within two bits, so a bucket is kept as one bit mask (which bits of the variant
were flipped), never as a list that could grow with a group of copies.

Near duplicates by shingle similarity take their candidates from the balls and, since a ball
of so small a radius misses most pairs near a similarity of 0.8, from bands of minimum hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftspark.llm.common import met, written

#: Hashes whose bits are counted at once, so that a very long text needs no more memory than others.
CHUNK = 1 << 15


def shingles(data: bytes, n: int) -> list[bytes]:
    """The n-word shingles of lower-cased words, repeats included; fewer words: the whole sequence; none: nothing."""
    words = data.lower().split()  # bytes: ASCII letters and white space only
    if len(words) <= n:
        return [b" ".join(words)] if words else []
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return [flat[a:b] for a, b in zip(starts[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist(), strict=True)]


def majority(hashes: np.ndarray) -> int:
    """The number whose bits are 1 where over half of the hashes have them set; no hash: 0."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        counts += np.unpackbits(hashes[at : at + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def fold(features: list[bytes], seed: int) -> int:
    """The 64-bit SimHash of the features' XXH64."""
    return majority(np.fromiter((xxhash.xxh64_intdigest(x, seed) for x in features), np.uint64, len(features)))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _fingerprint(words: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_signed(fold(shingles(x.as_py() or b"", words), seed)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], names=["id", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp) of every row; a null, empty or blank text has fingerprint 0."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(_fingerprint(words, seed), f"id {kind}, fp long")


def variants(distinct: DataFrame, bits: int) -> DataFrame:
    """(variant, flip, own): every fp of distinct itself (flip 0, own 1) and its values with one of the low bits flipped."""
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << b if b < 63 else -(1 << 63)) for b in range(bits)))
    return distinct.select("fp", F.explode(flips).alias("flip")).select(F.col("fp").bitwiseXOR(F.col("flip")).alias("variant"), "flip", (F.col("flip") == 0).cast("byte").alias("own"))


def members(distinct: DataFrame, bits: int) -> DataFrame:
    """(variant, fp) for every variant that two or more fingerprints share, with least, the bucket's smallest."""
    buckets = variants(distinct, bits).groupBy("variant").agg(F.bit_or("flip").alias("mask"), F.max("own").alias("own"))
    full = buckets.where(F.bit_count("mask") + F.col("own") > 1)
    listed = F.concat(F.expr(f"transform(filter(sequence(0, {bits - 1}), i -> getbit(mask, i) = 1), i -> variant ^ shiftleft(1L, i))"), F.when(F.col("own") == 1, F.array("variant")).otherwise(F.array().cast("array<long>")))
    return full.select("variant", listed.alias("fps")).select("variant", F.array_min("fps").alias("least"), F.explode("fps").alias("fp"))


def ball_links(distinct: DataFrame, bits: int = 64) -> DataFrame:
    """Verified links (src, dst) that connect the same fingerprints as all pairs at two or fewer differing bits.

    Each bucket links its members to its smallest; pairs that more than one bucket finds are kept once.
    """
    star = members(distinct.select("fp"), bits).where("fp <> least").select(F.col("fp").alias("src"), F.col("least").alias("dst")).distinct()
    return star.where(F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= 2)


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (src, dst): root is the smallest node that it reaches.

    Labels pass along links and jump to their label's label in each turn, so the turns
    grow with the logarithm of the longest path; each turn is written to the shared folder.
    """
    both = written(links.select("src", "dst").union(links.select("dst", "src")).where("src <> dst").distinct())
    labels = written(both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("root"), F.count(F.lit(1)).alias("n")).withColumnRenamed("src", "node"))
    degrees = labels.select(F.col("node").alias("dst"), "n")
    while True:
        followers = labels.groupBy("root").agg(F.count(F.lit(1)).alias("n"))  # nodes that ask for a label's own label
        passed = met(both, degrees.join(labels.select(F.col("node").alias("dst"), "root"), "dst"), "dst").select(F.col("src").alias("node"), "root")
        up = followers.join(labels.select(F.col("node").alias("root"), F.col("root").alias("r")), "root")
        jumped = met(labels.select("node", "root"), up, "root").select("node", F.col("r").alias("root"))
        own = labels.select("node", "root", F.col("root").alias("was"))
        nothing = F.lit(None).cast("long")
        turned = own.union(passed.withColumn("was", nothing)).union(jumped.withColumn("was", nothing)).groupBy("node").agg(F.min("root").alias("root"), F.max("was").alias("was"))
        turned = written(turned)
        labels = turned.select("node", "root")
        if not turned.where("root <> was").limit(1).count():
            return labels


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp, component) of every row: component is the smallest id whose fingerprint is reached by links of two or fewer bits.

    Equal fingerprints are one node. A null text is empty; all texts without words share
    fingerprint 0. A null id is no candidate for a component's name; repeated rows come
    back as often as they went in; an empty table gives no rows.
    """
    rows = written(fingerprints(docs, id_col, text_col, words, seed))
    least = written(rows.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(ball_links(least))
    named = least.join(roots, least["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = written(named)
    names = named.groupBy("root").agg(F.min("least").alias("component"))
    labelled = named.join(names, "root").select(F.col("fp").alias("_fp"), "component")
    return rows.join(labelled, rows["fp"] == labelled["_fp"]).select("id", "fp", "component")


# ---- near duplicates by shingle similarity

#: Minima whose four bits each are a text's signature, and how many of them two texts of the least similarity agree in: fewer in one of a billion cases.
SIGNED, DOUBT = 256, 1e-9
#: Shingles of a block of texts: pairs of texts are verified by pairs of such blocks.
BLOCK = 1 << 17
#: Turns at most in which texts of the largest component of a bucket are tried before all are; they spare comparisons and lose none.
TURNS = 8
#: Texts of a bucket up to which all its pairs are compared; those of larger ones are joined by their shingles.
FEW = 16
#: Texts of one shingle that are paired in one task with all others of it.
FRAGMENT = 1000
#: Words of a filter of texts at most, four texts a word.
WORDS = 1 << 20


def _agreements(similarity: float) -> int:
    """The least number of agreeing four-bit values that a pair of that similarity has, but in a share DOUBT of all cases."""
    p, below, k = similarity + (1 - similarity) / 16, 0.0, 0
    while below <= DOUBT and k <= SIGNED:
        below += math.exp(math.lgamma(SIGNED + 1) - math.lgamma(k + 1) - math.lgamma(SIGNED - k + 1) + k * math.log(p) + (SIGNED - k) * math.log(max(1 - p, 1e-300)))
        k += 1
    return k - 1


def _features(data: bytes, words: int) -> np.ndarray:
    """The distinct shingles' hashes, sorted."""
    found = {xxhash.xxh64_intdigest(x) for x in shingles(data, words)}
    return np.sort(np.fromiter(found, np.uint64, len(found)))


def _sketch(words: int, bands: int, rows: int):
    """Of a text's distinct words-word shingles: their number, SimHash, a hash of rows minima of hashed shingles for each of bands bands, the signature."""
    rng = np.random.default_rng(42)
    many = max(SIGNED, bands * rows)
    factors, shifts = (rng.integers(0, 1 << 32, (many, 1), np.uint32) for _ in range(2))
    factors |= np.uint32(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, prints, keys, signs = [], [], [], []
            for x in batch.column(2):
                found = _features(x.as_py(), words)
                hashes = found.astype(np.uint32)
                least = np.full(many, (1 << 32) - 1, np.uint32)
                for at in range(0, len(hashes), 512):  # so many that their products stay in the processor's cache
                    np.minimum(least, (hashes[at : at + 512] * factors + shifts).min(axis=1), out=least)
                raw = least.tobytes()
                sizes.append(len(found))
                prints.append(_signed(majority(found)))
                keys.append([_signed(xxhash.xxh64_intdigest(raw[4 * rows * t : 4 * rows * (t + 1)], t)) for t in range(bands)])
                four = ((least[:SIGNED] * np.uint32(0x9E3779B1)) >> np.uint32(28)).astype(np.uint8)
                signs.append((four[0::2] << 4 | four[1::2]).tobytes())
            columns = [pa.array(sizes, pa.int64()), pa.array(prints, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(signs, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["id", "digest", "size", "fp", "keys", "sign"])

    return run


def _agree(least: int):
    """The pairs (src, dst) whose signatures agree in least values or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for k in (2, 3))
            other = a ^ b
            same = ((other & 15) == 0).sum(axis=1) + ((other >> 4) == 0).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["src", "dst"]).filter(pa.array(same >= least))

    return run


def _verify(words: int, least: float):
    """The pairs (src, dst) that are as similar as least; of each cell its texts (node, text) come before its pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, {}
        for batch in batches:
            kept = []
            for own, node, text, src, dst in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != cell:
                    cell, held = own, {}
                if text is not None:
                    held[node] = _features(text, words)
                    continue
                a, b = held[src], held[dst]
                if len(a) > len(b):
                    a, b = b, a
                at = np.searchsorted(b, a)
                both = int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(a) else 0
                if both >= least * (len(a) + len(b) - both):
                    kept.append((src, dst))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in kept], pa.int64()) for k in range(2)], names=["src", "dst"])

    return run


def _linked(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, blocks: int, words: int, similarity: float) -> DataFrame:
    """Those of the distinct pairs (src, dst) whose texts are as similar as that.

    What is sure to be below it goes first: the lesser number of shingles over the greater
    bounds the similarity from above, and signatures that agree too seldom rule it out but in
    a share DOUBT of cases. The rest is verified by cells: nodes are dealt over blocks by
    hash, and a cell, a pair of blocks, has its texts once, however many pairs they are in.
    So a text of very many pairs is spread over cells, and no task grows with it.
    """
    a, b = (nodes.select(F.col("node").alias(end), F.col("size").alias(f"{end}_size"), F.col("sign").alias(f"{end}_sign")) for end in ("src", "dst"))
    alike = F.least("src_size", "dst_size") >= F.lit(similarity) * F.greatest("src_size", "dst_size")
    degree = lambda end: pairs.groupBy(end).agg(F.count(F.lit(1)).alias("n"))
    both = met(met(pairs, degree("src").join(a, "src"), "src"), degree("dst").join(b, "dst"), "dst").where(alike)
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
    near = written(both.select("src", "dst", "src_sign", "dst_sign").mapInArrow(_agree(_agreements(similarity)), "src long, dst long").withColumn("cell", block("src") * blocks + block("dst")))
    needed = near.select("cell", F.col("src").alias("node")).union(near.select("cell", F.col("dst").alias("node"))).distinct()
    none = lambda kind: F.lit(None).cast(kind)
    rows = needed.join(texts, "node").select("cell", "node", "text", none("long").alias("src"), none("long").alias("dst"))
    rows = rows.union(near.select("cell", none("long"), none("binary"), "src", "dst"))
    return written(rows.repartition("cell").sortWithinPartitions("cell", F.col("src").asc_nulls_first()).mapInArrow(_verify(words, similarity), "src long, dst long"))


def _mixed(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, node, root, big, n) of the buckets in which more than one component is: big is the bucket's largest, n its texts."""
    named = written(shared.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")))
    parts = named.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"))
    big = parts.groupBy("key").agg(F.max(F.struct("c", "root")).alias("m"), F.count(F.lit(1)).alias("parts"), F.sum("c").alias("n")).where("parts > 1").select("key", F.col("m.root").alias("big"), "n")
    return written(met(named, big, "key", "n").select("key", "node", "root", "big", "n"))


def _elected(mixed: DataFrame, turn: int) -> DataFrame:
    """Pairs of a text of each bucket's largest component, another in each turn and bucket, with the bucket's texts outside of it."""
    heads = mixed.where("root = big").groupBy("key").agg(F.min(F.struct(F.xxhash64("node", "key", F.lit(turn)).alias("h"), F.col("node").alias("head"))).alias("x"))
    sizes = mixed.where("root <> big").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    asked = met(mixed.where("root <> big").select("key", "node"), heads.select("key", "x.head").join(sizes, "key"), "key")
    return asked.select(F.greatest("node", "head").alias("src"), F.least("node", "head").alias("dst")).distinct()


def _all_pairs(mixed: DataFrame) -> DataFrame:
    """Pairs (src, dst) of different components in buckets of few texts."""
    one = mixed.where(F.col("n") <= FEW).select("key", F.col("node").alias("src"), F.col("root").alias("of"))
    other = mixed.where(F.col("n") <= FEW).select("key", F.col("node").alias("dst"), "root")
    return one.join(other, "key").where("src > dst and root <> of").select("src", "dst").distinct()


def _shingled(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = [_features(x, words).view(np.int64) for x in part.column(1).to_pylist()]
                sizes = np.array([len(x) for x in found], np.int64)
                nodes = np.repeat(part.column(0).to_numpy(), sizes)
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(np.concatenate(found) if found else nodes, pa.int64()), pa.array(np.repeat(sizes, sizes), pa.int64())], names=["node", "shingle", "size"])

    return run


def _across(mixed: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """Pairs (src, dst) of different components among the texts of mixed that hold all pairs as similar as that.

    A text's shingles are put in one order for all, rare ones first. Two texts as similar as
    that have one in common among the first of either, as many as size - ceil(similarity *
    size) + 1, and the first that they have in common stands early enough in both for all that
    they must share to follow; so what many share, being last in order, makes few pairs. Of a
    shingle, the texts outside of its largest component are paired with all that are not in their own.
    """
    nodes = mixed.select("node", "root").distinct()
    found = written(texts.join(nodes.select("node"), "node").select("node", "text").mapInArrow(_shingled(words), "node long, shingle long, size long"))
    ordered = met(found, found.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")), "shingle", "df")
    first = ordered.where("df > 1").withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("df", "shingle")))
    # a shingle of one text alone makes no pair but has its place, before all others: these are counted, not sorted
    alone = ordered.groupBy("node").agg(F.count(F.when(F.col("df") == 1, 1)).alias("alone"))
    length = F.col("size") - F.ceil(F.lit(similarity) * F.col("size") - 1e-9) + 1
    prefix = written(first.join(alone, "node").where(F.col("r") + F.col("alone") <= length).join(nodes, "node").select("node", "shingle", "root", "size", (F.col("r") + F.col("alone")).alias("place")))
    parts = prefix.groupBy("shingle", "root").agg(F.count(F.lit(1)).alias("c"))
    about = parts.groupBy("shingle").agg(F.max(F.struct("c", "root")).alias("m"), F.count(F.lit(1)).alias("parts"), F.sum("c").alias("n")).where("parts > 1").select("shingle", F.col("m.root").alias("big"), F.ceil((F.col("n") - F.col("m.c")) / FRAGMENT).cast("int").alias("fragments"), "n")
    members = written(met(prefix, about, "shingle"))
    minor = members.where("root <> big").select("shingle", F.pmod(F.xxhash64("node"), F.col("fragments")).cast("int").alias("f"), F.col("node").alias("a"), F.col("root").alias("of"), F.col("size").alias("a_size"), F.col("place").alias("a_place"))
    all_ = members.select("shingle", F.explode(F.sequence(F.lit(0), F.col("fragments") - 1)).alias("f"), F.col("node").alias("b"), "root", F.col("size").alias("b_size"), F.col("place").alias("b_place"))
    alike = F.least("a_size", "b_size") >= F.lit(similarity) * F.greatest("a_size", "b_size") - 1e-9
    # of a pair's first shingle in common all others come after it in both orders
    enough = 1 + F.least(F.col("a_size") - F.col("a_place"), F.col("b_size") - F.col("b_place")) >= F.lit(similarity / (1 + similarity)) * (F.col("a_size") + F.col("b_size")) - 1e-9
    return minor.join(all_, ["shingle", "f"]).where((F.col("root") != F.col("of")) & alike & enough).select(F.greatest("a", "b").alias("src"), F.least("a", "b").alias("dst")).distinct()


def _sifted(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """rows with a column hit, false only where their node is none of listed's: for exact joins that need not shuffle all rows.

    A blocked Bloom filter: a node chooses a 64-bit word and sets four of its bits. The words
    are sent to all executors, WORDS at most (16 bytes each); beyond what these can tell
    apart more rows are a hit, and are shuffled.
    """
    words = min(max(listed.count() // 4, 1 << 10), WORDS)
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright("node", 6 * k).bitwiseAND(63).cast("int"))
    mask = bit(0).bitwiseOR(bit(1)).bitwiseOR(bit(2)).bitwiseOR(bit(3))
    place = F.pmod(F.shiftright("node", 24), F.lit(words)).alias("_place")
    table = written(listed.select(place, mask.alias("_mask")).groupBy("_place").agg(F.bit_or("_mask").alias("_word")))
    found = rows.select("*", place, mask.alias("_mask")).join(F.broadcast(table), "_place", "left")
    return found.withColumn("hit", F.coalesce(F.col("_word").bitwiseAND(F.col("_mask")) == F.col("_mask"), F.lit(False))).drop("_place", "_mask", "_word")


def _key(digest: Column, id_: Column) -> Column:
    """One key of a text's digest and its row's id, null or not."""
    return F.concat(digest, F.coalesce(F.concat(F.lit("="), id_.cast("string")), F.lit("")))


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, bands: int = 50, rows: int = 8) -> DataFrame:
    """(id, digest, component, component_digest, alone) of the distinct texts: texts of one component are linked by similarity.

    Similarity is the Jaccard index of the sets of words-word shingles of lower-cased
    words, checked on whole texts. Candidates share a ball of SimHashes of these sets, or a
    bucket: in one of bands bands, the same rows minima of hashed shingles. A minimum agrees
    as often as the similarity says, whatever the kind of edit, so a pair of 0.8 shares none
    of 50 bands of 8 in 1 of 10,000 cases, one of 0.85 in 1 of 8 million; pairs of 0.5 share
    one in 18 %, of 0.2 in 0.01 %. Each text is compared with its bucket's smallest; then, as
    long as that links many, those outside of a bucket's largest component with other texts
    of it; then, of buckets in which more than one component is left, all pairs are compared
    if they are few, and else the texts are joined by their rarest shingles, which misses no
    pair. So every two texts of a bucket are in one
    component or less similar than that.

    Null texts are empty; equal texts are one node, texts without words are alike. id is a
    distinct text's smallest id (null if all are null), of any type that can be ordered;
    component is the smallest id of its component, null only if it has no other;
    component_digest is the md5 of that one's text; alone says that one row has the text and
    none is linked to it. An empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    texts = docs.select(F.col(id_col).alias("id"), F.md5(text).alias("digest"), text.alias("text"))
    sketched = texts.mapInArrow(_sketch(words, bands, rows), f"id {kind}, digest string, size long, fp long, keys array<long>, sign binary")
    nodes = written(sketched.groupBy("digest").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), *(F.first(c).alias(c) for c in ("size", "fp", "keys", "sign"))).withColumn("node", F.xxhash64("digest")))
    prints = written(nodes.groupBy("fp").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n")))
    balls = ball_links(prints.select("fp")).join(prints.select(F.col("fp").alias("src"), F.col("head").alias("a")), "src").join(prints.select(F.col("fp").alias("dst"), F.col("head").alias("b")), "dst")
    equal = met(nodes.select("node", "fp"), prints.where("n > 1"), "fp")
    buckets = nodes.select("node", F.explode("keys").alias("key"))
    several = written(buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))  # of most keys there is one text
    shared = written(met(buckets, several, "key", "n").select("key", "node", "n"))
    heads = shared.groupBy("key").agg(F.min("node").alias("head"), F.first("n").alias("n"))
    pair = lambda a, b: (F.greatest(a, b).alias("src"), F.least(a, b).alias("dst"))
    pairs = written(met(shared.select("key", "node"), heads, "key").select(*pair("node", "head")).union(equal.select(*pair("node", "head"))).union(balls.select(*pair("a", "b"))).where("src <> dst").distinct())
    wanted = pairs.select(F.col("src").alias("node")).union(pairs.select(F.col("dst").alias("node"))).distinct()
    asked = written(nodes.join(wanted, "node").select("node", "size", "sign", "digest", "id"))
    named = written(asked.select(_key(F.col("digest"), F.col("id")).alias("key"), "node"))  # a narrow table, sent to all executors while it is small
    # one row of each text that has a candidate; equal texts of one id are equal rows, found where the join has dealt them
    may = _sifted(texts.withColumn("node", F.xxhash64("digest")), named).where("hit")
    stored = written(may.select(_key(F.col("digest"), F.col("id")).alias("key"), "text").join(named, "key").groupBy("key").agg(F.first("node").alias("node"), F.first("text").alias("text")).select("node", "text"))
    blocks = max(1, -(-(asked.agg(F.sum("size").alias("s")).first()["s"] or 0) // BLOCK))
    verified = lambda candidates: _linked(candidates, asked, stored, blocks, words, similarity)
    links, tried = verified(pairs), pairs
    roots = components(links)
    for turn in range(TURNS):
        pairs = written(_elected(_mixed(shared.select("key", "node"), roots), turn).join(tried, ["src", "dst"], "left_anti"))
        more = verified(pairs)
        links, tried = links.union(more), tried.union(pairs)
        roots = components(links)
        if 20 * more.count() <= pairs.count():  # what is left is unlike for the most part
            break
    mixed = _mixed(shared.select("key", "node"), roots)
    pairs = _all_pairs(mixed).union(_across(mixed.where(F.col("n") > FEW), stored, words, similarity)).distinct()
    pairs = written(pairs.join(tried, ["src", "dst"], "left_anti"))
    more = verified(pairs)
    if more.limit(1).count():
        roots = components(links.union(more))
    found = written(nodes.select("digest", "id", "copies", "node").join(roots, "node", "left").select("digest", "id", "copies", F.coalesce("root", "node").alias("root")))
    first = F.struct(F.col("id").isNull().alias("none"), "id", "digest")
    best = found.groupBy("root").agg(F.min(first).alias("best"), F.count(F.lit(1)).alias("n")).select("root", F.col("best.id").alias("component"), F.col("best.digest").alias("component_digest"), "n")
    return met(found, best, "root", "texts").select("digest", "id", "component", "component_digest", ((F.col("copies") == 1) & (F.col("texts") == 1)).alias("alone"))


def near_deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, with their columns, that stay: one of each group of near_duplicate_groups, that of the smallest id."""
    groups = written(near_duplicate_groups(docs, id_col, text_col, **options))
    kept = groups.where("digest = component_digest").select(_key(F.col("digest"), F.col("id")).alias("_key"))
    text = F.md5(F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), _key(text, F.col(id_col)).alias("_key"), F.xxhash64(text).alias("node"))
    # only rows whose text may have copies or a link are dealt by key; a text that is alone stays where it is read
    tested = _sifted(rows, groups.where("not alone").select(F.xxhash64("digest").alias("node")))
    # dealt once: the join's key is the group's, so whole rows are not shuffled again to find repeated ones
    dealt = tested.where("hit").join(kept, "_key").groupBy("_key").agg(F.first("_row").alias("_row"))
    return tested.where("not hit").select("_row").union(dealt.select("_row")).select("_row.*")
