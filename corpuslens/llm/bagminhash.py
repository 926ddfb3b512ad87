"""Near duplicates by BagMinHash signatures of word-shingle multisets (Ertl, 2018)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.components import components
from corpuslens.llm.exact_dedup import LOCATOR, addressable, located, normalised, sha256_hex, whole_rows
from corpuslens.llm.staging import bounded_batches, stage
from corpuslens.llm.words import draws, hashed_words, mix, parts, shingles, slices

#: Words handled at once by a task.
GROUP_WORDS = 200_000
_STRIP = draws(101, 64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def weighted_elements(keys: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, shingle) with how often it occurs there."""
    if not len(keys):
        return keys, doc, np.empty(0, np.int64)
    own = mix(keys + (doc.astype(np.uint64) + np.uint64(1)) * _STEP)
    order = np.argsort(own)
    own = own[order]
    first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    weight = np.diff(np.append(first, len(own)))
    return keys[order[first]], doc[order[first]], weight


def signatures(keys: np.ndarray, doc: np.ndarray, weight: np.ndarray, docs: int, m: int) -> np.ndarray:
    """(docs, m) arrival times; two texts agree in a slot with their weighted Jaccard similarity.

    Weights are discretised at 1, 2, 3, ... Each element has a Poisson process over
    (time, weight), cut into strips (0, 1], (1, 2], (2, 4], (4, 8], ... of rate equal to
    their width. The points of a strip come in order of time; each falls in one slot and,
    by the halvings that its random bits choose, on one unit of weight; it counts if the
    element weighs that much. A slot keeps its earliest point. A process stops once its
    time passes the latest slot of its text, so nearly all stop after a few points.
    Texts without elements keep infinite times.
    """
    times = np.full(docs * m, np.inf)
    if not len(keys):
        return times.reshape(docs, m)
    strips = np.where(weight > 1, np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64), 0) + 1
    at = np.repeat(np.arange(len(keys)), strips)
    strip = np.arange(len(at)) - np.repeat(np.cumsum(strips) - strips, strips)
    below = np.where(strip == 0, 0, np.left_shift(1, np.maximum(strip - 1, 0)))  # weight under the strip
    width = np.maximum(below, 1)
    seed = mix(keys[at] ^ _STRIP[strip])
    d, heavy, time = doc[at].astype(np.int64), weight[at] - below, np.zeros(len(at))
    rate, width = 1.0 / (m * width), width.astype(np.uint64)
    while len(seed):
        seed = seed + _STEP
        one = mix(seed)
        time = time - np.log(((one >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) * rate
        two = mix(one ^ _STEP)
        slot = ((two >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        unit = ((two & np.uint64(0xFFFFFFFF)) * width) >> np.uint64(32)
        counts = unit.astype(np.int64) < heavy
        np.minimum.at(times, d[counts] * m + slot[counts].astype(np.int64), time[counts])
        active = np.flatnonzero(np.bincount(d, minlength=docs))
        latest = np.zeros(docs)
        latest[active] = times.reshape(docs, m)[active].max(axis=1)
        on = time < latest[d]
        seed, d, heavy, time, rate, width = (x[on] for x in (seed, d, heavy, time, rate, width))
    return times.reshape(docs, m)


def band_keys(times: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(docs, bands) 64-bit keys of the signature's bands."""
    values = np.ascontiguousarray(times[:, : bands * rows]).view(np.uint64).reshape(len(times), bands, rows)
    factors = draws(211, rows) | np.uint64(1)
    return mix((values * factors).sum(axis=2, dtype=np.uint64) + draws(307, bands)).view(np.int64)


def similarity(a: pa.Array, b: pa.Array, n: int) -> np.ndarray:
    """Weighted Jaccard similarity of the shingle multisets of paired texts."""
    (wa, pa_), (wb, pb) = hashed_words(a), hashed_words(b)
    both, sizes = np.zeros(len(a), np.int64), np.zeros((2, len(a)), np.int64)
    for lo, hi in slices(pa_ + pb, GROUP_WORDS):
        sides = []
        for k, (words, places) in enumerate(((wa, pa_), (wb, pb))):
            part = places[lo : hi + 1]
            keys, pair = shingles(words[part[0] : part[-1]], part - part[0], n)
            sizes[k, lo:hi] = np.bincount(pair, minlength=hi - lo)
            sides.append(weighted_elements(keys, pair))
        (x, px, nx), (y, py, ny) = sides
        own = [mix(keys + (pair.astype(np.uint64) + np.uint64(1)) * _STEP) for keys, pair in ((x, px), (y, py))]
        _, ix, iy = np.intersect1d(*own, assume_unique=True, return_indices=True)
        both[lo:hi] = np.bincount(px[ix], np.minimum(nx[ix], ny[iy]), hi - lo)
    bare = (sizes == 0).any(axis=0)
    return np.where(bare, sizes[0] == sizes[1], both / np.where(bare, 1, sizes.sum(axis=0) - both))


def _signed(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, locator, digest, number of shingles and band keys of every document, in one scan."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, _file string, _row long, digest string, size int, bands array<long>"

    def run(batches):
        for batch in parts(batches, 4):
            words, places = hashed_words(batch.column(4))
            counts = np.diff(places)
            sizes = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
            keys = []
            for lo, hi in slices(places, GROUP_WORDS):
                part = places[lo : hi + 1]
                k, d = shingles(words[part[0] : part[-1]], part - part[0], n)
                times = signatures(*weighted_elements(k, d), hi - lo, bands * rows)
                found = band_keys(times, bands, rows)
                found[np.diff(part) == 0] = 0
                keys.append(found)
            flat = np.concatenate(keys).ravel() if keys else np.empty(0, np.int64)
            offsets = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * bands)
            lists = pa.ListArray.from_arrays(offsets, pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(4)), pa.array(sizes.astype(np.int32)), lists],
                names=["doc_id", "_file", "_row", "digest", "size", "bands"],
            )

    source = located(docs, "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows_ = source.select("doc_id", *LOCATOR, sha256_hex(F.trim(normalised(F.col("text")))).alias("digest"), "text")
    return rows_.mapInArrow(run, schema)


def _verified(pairs: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """(a, b, sim) of candidate pairs, by their whole texts."""

    def run(batches):
        for batch in parts(batches, 2, 3):
            sims = similarity(batch.column(2), batch.column(3), n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sims)], names=["a", "b", "sim"])

    one = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(run, "a long, b long, sim double")


def _own_shingles(texts: DataFrame, n: int) -> DataFrame:
    """(node, alone): how many shingles of a text, with repeats, no other of the texts has.

    Counted by shingle; those that many texts share meet in the partial sums of each task.
    """

    def run(batches):
        for batch in parts(batches, 1):
            words, places = hashed_words(batch.column(1))
            nodes = batch.column(0).to_numpy()
            for lo, hi in slices(places, GROUP_WORDS):
                part = places[lo : hi + 1]
                keys, doc, weight = weighted_elements(*shingles(words[part[0] : part[-1]], part - part[0], n))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)), pa.array(nodes[lo:hi][doc]), pa.array(weight)], names=["shingle", "node", "times"]
                )

    rows = texts.select("node", "text").mapInArrow(run, "shingle long, node long, times long")
    held = rows.groupBy("shingle").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("texts"), F.sum("times").alias("times"))
    return held.where("texts = 1").groupBy("node").agg(F.sum("times").alias("alone"))


def _joined(linked: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Components of the links and of those that ``roots`` knows, whose links it stands for."""
    links = linked.select("a", "b")
    return components(links if roots is None else links.union(roots.select("node", "root")))


#: Sizes are binned by this ratio when pairs are formed.
_BIN = 1.06


def _bin(size: Column) -> Column:
    return F.floor(F.log(size) / float(np.log(_BIN))).cast("int")


def _pairs_left(left: DataFrame, threshold: float, rounds: int) -> DataFrame:
    """(a, b) of one bucket in different components that nothing rules out.

    The larger text names the sizes of smaller ones that it can be linked with, so only
    pairs of such sizes meet. Of those, a star rules out pairs whose distances to its centre
    differ too much (the distance is a metric), and pairs whose overlap is too small: two
    texts share at most the smaller of their overlaps with the centre, and of what they have
    beyond it the smaller part that is not theirs alone.
    """
    stars = [f"{c}{k}" for k in range(rounds) for c in ("sim", "with", "beyond")]
    carried = F.struct("node", "root", "size", "most", *stars)
    reach = F.sequence(_bin(F.col("size") * (threshold * (1 - 1e-9))), _bin(F.col("size")))
    small = left.select("bucket", _bin(F.col("size")).alias("bin"), carried.alias("a"))
    large = left.select("bucket", F.explode(reach).alias("bin"), carried.alias("b"))
    possible = (F.col("a.size") < F.col("b.size")) | ((F.col("a.size") == F.col("b.size")) & (F.col("a.node") < F.col("b.node")))
    possible &= F.col("a.root") != F.col("b.root")
    possible &= (F.col("a.most") >= F.col("b.size")) & (F.col("b.most") >= F.col("a.size"))
    least = (F.col("a.size") + F.col("b.size")) * threshold / (1 + threshold) - 1e-6
    for k in range(rounds):
        far = F.abs(F.col(f"a.sim{k}") - F.col(f"b.sim{k}")) > 1 - threshold + 1e-9
        most = F.least(f"a.with{k}", f"b.with{k}") + F.least(f"a.beyond{k}", f"b.beyond{k}")
        both = F.col(f"a.sim{k}").isNotNull() & F.col(f"b.sim{k}").isNotNull()
        possible &= ~(both & (far | (most < least)))
    on = possible & (F.col("l.bucket") == F.col("r.bucket")) & (F.col("l.bin") == F.col("r.bin"))
    met = small.alias("l").join(large.alias("r"), on)
    return met.select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame, n: int = 5, threshold: float = 0.8, bands: int = 32, rows: int = 6, star_rounds: int = 1,
) -> DataFrame:
    """One row per document with its class of near duplicates.

    Columns: doc_id, class_id (smallest doc_id of the class), class_size, kept (one row a
    class) and the row's locator. Two texts are linked when the multisets of their
    ``n``-word shingles overlap by ``threshold`` or more (weighted Jaccard); classes are
    the components of the links. Texts of fewer than ``n`` words have one shingle of all
    words. Null texts count as empty; texts without words are equal to each other and to
    nothing else. Null doc_ids come last in the order; repeated ids are rows of their own
    and the first locator stays. Empty tables give no rows; other columns are not read.

    Copies are folded into one node each before anything else. Nodes that share a band
    are candidates. In each bucket the node with the largest buckets is compared with
    all others (a star); after ``star_rounds`` of these the pairs that are still in
    different components are compared one by one. Nothing is capped, but pairs that
    provably have no link are left out: shingles that no other candidate has bound a
    node's overlap with any other, which rules out nodes and pairs of sizes; and as the
    distance is a metric, so do distances to the same centre. A large group thus costs
    its stars and not all its pairs.
    """
    bounded_batches(docs.sparkSession)
    docs = addressable(docs)
    signed = stage(_signed(docs, n, bands, rows), "signed")
    first = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", *LOCATOR)).alias("first")
    nodes = stage(
        signed.groupBy("digest").agg(first, F.first("size").alias("size"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("copies"))
        .withColumn("node", F.monotonically_increasing_id()), "nodes",
    )
    spots = nodes.where("size > 0").select("node", "size", F.posexplode("bands").alias("band", "value")).select(
        F.xxhash64("band", "value").alias("bucket"), "node", "size"
    )
    shared = spots.groupBy("bucket").agg(F.count(F.lit(1)).alias("pull")).where("pull > 1")
    buckets = stage(spots.join(shared, "bucket"), "buckets")
    wanted = buckets.select("node").distinct().join(nodes.select("node", "first._file", "first._row"), "node")
    texts = stage(
        located(docs, F.coalesce("text", F.lit("")).alias("text")).join(wanted, list(LOCATOR)).select("node", "text"), "texts"
    )
    alone = _own_shingles(texts, n)
    overlap = F.col("size") - F.coalesce("alone", F.lit(0))
    pull = buckets.groupBy("node", "size").agg(F.sum("pull").alias("pull")).join(alone, "node", "left")
    # A link with a text of m shingles needs an overlap of threshold / (1 + threshold) * (size + m).
    able = pull.where(overlap >= threshold * F.col("size")).select(
        "node", "pull", overlap.alias("shared"), (overlap * (1 + threshold) / threshold - F.col("size") + 1e-6).alias("most")
    )
    left = stage(buckets.drop("pull").join(able, "node").withColumn("root", F.col("node")), "groups")
    roots = None
    for turn in range(star_rounds):
        centre = left.groupBy("bucket").agg(
            F.count(F.lit(1)).alias("members"),
            F.max(F.struct("pull", F.xxhash64("node", F.lit(turn)).alias("h"), "node", "root", "size", "most")).alias("c"),
        ).where("members > 1")
        rays = left.join(centre, "bucket").where("node <> c.node").withColumns(
            {"a": F.least("node", "c.node"), "b": F.greatest("node", "c.node")}
        )
        pairs = rays.where("root <> c.root and most >= c.size and c.most >= size").select("a", "b").distinct()
        found = stage(_verified(pairs, texts, n), "found")
        roots = _joined(found.where(F.col("sim") >= threshold), roots)
        sim = F.col(f"sim{turn}")
        overlap_c = F.round(sim / (1 + sim) * (F.col("size") + F.col("c.size")))
        placed = rays.join(found.withColumnRenamed("sim", f"sim{turn}"), ["a", "b"], "left").withColumns(
            {f"with{turn}": overlap_c, f"beyond{turn}": F.greatest(F.col("shared") - overlap_c, F.lit(0))}
        )
        # A linked text with nothing to share beyond the centre, and no smaller than it,
        # overlaps with a text that is not linked to the centre even less than the centre does.
        settled = (sim >= threshold) & (F.col(f"beyond{turn}") == 0) & (F.col("size") >= F.col("c.size"))
        again = placed.where(~F.coalesce(settled, F.lit(False))).drop("a", "b", "c", "members").join(
            roots.withColumnRenamed("root", "new_root"), "node", "left"
        ).withColumn("root", F.coalesce("new_root", "root")).drop("new_root")
        open_ = again.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("bucket")
        left = stage(again.join(open_, "bucket"), "groups")
        if left.isEmpty():
            break
    else:
        found = stage(_verified(_pairs_left(left, threshold, star_rounds), texts, n), "found")
        linked = found.where(F.col("sim") >= threshold)
        if roots is None or not linked.isEmpty():
            roots = _joined(linked, roots)
    classed = nodes.select("digest", "node", "first", "copies").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    heads = classed.groupBy("root").agg(F.min("first").alias("head"), F.sum("copies").alias("class_size"))
    labelled = classed.select("digest", "root").join(heads, "root")
    return signed.select("doc_id", *LOCATOR, "digest").join(labelled, "digest").select(
        "doc_id", F.col("head.doc_id").alias("class_id"), "class_size",
        ((F.col("_file") == F.col("head._file")) & (F.col("_row") == F.col("head._row"))).alias("kept"), *LOCATOR,
    )


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One document of each class, all columns as they were."""
    docs = addressable(docs)
    kept = near_duplicates(docs, **options).where("kept").select(*LOCATOR)
    return whole_rows(docs).join(kept, list(LOCATOR), "left_semi").select("_document.*")
