"""Near-duplicate classes by DartMinHash signatures, banded joining and exact verification.

1. Equal texts are collapsed by fingerprint; only one of them goes on.
2. Each text becomes the weighted set of its runs of five words (weight 1, or the number of times with
   ``weighted``); its signature of ``K`` coordinates is cut into bands of ``ROWS``. Texts that agree in a band meet
   in a bucket: at similarity 0.8 all but about 5 in a million pairs do.
3. Each member is first compared with one leader, the text among its buckets' members that shares the most
   places with others. Links that hold make components.
4. Only buckets that still hold several components are looked at again. Their members get a longer
   signature of ``LONG`` coordinates and are compared in blocks; pairs of different components that agree in
   ``LIKELY`` of the coordinates are verified too (about 5 in 100,000 pairs at 0.8 fall below). Pairs inside
   a component are never made, since they cannot change it; there is no limit on partners.
5. A verified pair has an exact (weighted) Jaccard similarity of ``SIMILARITY`` or more over whole texts. Classes
   are the connected components of all verified links.

Verification deals the pairs over a grid of blocks of texts, so that a text that is in many pairs is sent
once per block and not once per pair.

Defined cases: NULL texts and texts without a word are alone in their class; texts of fewer than five words
are one run, so only texts with the same words match; repeated rows are copies; texts of any length are compared whole; ``class_id`` is the smallest
doc_id of the class (NULL if it has none); an empty table gives no rows; an input column named like an
output column is replaced. The input must be repeatable, such as a table scan.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import batches, sieve, sifted, tidy
from gridloom.llm.darts import WordHashes, bands, mix, shingles, signatures
from gridloom.operators.graph import components
from gridloom.session import cut_lineage, per_key

SHINGLE = 5
SIMILARITY = 0.8
K, ROWS = 240, 6
LONG, LIKELY = 960, 0.75
BLOCK = 512
BATCH = 512

_words = WordHashes()


def _texts_to_shingles(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    # bytes.split() splits at the ASCII white space that separates words here.
    split = [t.encode("utf-8", "surrogatepass").split() if t else [] for t in texts]
    lengths = np.array([len(w) for w in split], dtype=np.int64)
    hashes = np.fromiter((_words[w] for ws in split for w in ws), dtype=np.uint64, count=int(lengths.sum()))
    return shingles(hashes, lengths, n)


def _counted(elements: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct elements of each set with their number of times."""
    order = np.lexsort((elements, owner))
    e, o = elements[order], owner[order]
    first = np.ones(len(e), dtype=bool)
    first[1:] = (e[1:] != e[:-1]) | (o[1:] != o[:-1])
    at = np.flatnonzero(first)
    return e[at], o[at], np.diff(np.append(at, len(e))).astype(np.float64)


def _members(elements: np.ndarray, owner: np.ndarray, weights: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None]:
    """Owner and weight of every distinct element: what the similarity of two sets is reckoned from."""
    return (_counted(elements, owner)[1], None) if weights is None else (owner, weights)


def _sign(n: int, k: int, rows: int, weighted: bool):
    def run(arrow_batches):
        for batch in arrow_batches:
            texts = batch.column("text").to_pylist()
            elements, owner = _texts_to_shingles(texts, n)
            weights = None
            if weighted:
                elements, owner, weights = _counted(elements, owner)
            mass = np.bincount(*_members(elements, owner, weights), minlength=len(texts)).astype(np.int64)
            keys = bands(signatures(elements, weights, owner, len(texts), k), rows).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("pos"), batch.column("doc_id"), batch.column("fp"),
                    pa.array(np.bincount(owner, minlength=len(texts)).astype(np.int64)), pa.array(mass),
                    pa.ListArray.from_arrays(
                        pa.array(np.arange(len(texts) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.ravel())
                    ),
                ],
                ["pos", "doc_id", "fp", "size", "mass", "bands"],
            )

    return run


def _sign_long(n: int, k: int, weighted: bool):
    """Long signatures, 16 bits a coordinate."""

    def run(arrow_batches):
        for batch in arrow_batches:
            texts = batch.column("text").to_pylist()
            elements, owner = _texts_to_shingles(texts, n)
            weights = None
            if weighted:
                elements, owner, weights = _counted(elements, owner)
            short = (mix(signatures(elements, weights, owner, len(texts), k)) & np.uint64(0xFFFF)).astype(np.uint16)
            yield pa.RecordBatch.from_arrays(
                [batch.column("fp"), pa.array([r.tobytes() for r in short], type=pa.binary())], ["fp", "signature"]
            )

    return run


def _runs(arrow_batches, keys: list[str]):
    """Tables of equal keys from sorted batches; a run may span batches."""
    held = None
    for batch in arrow_batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        cols = [held.column(c).to_numpy() for c in keys]
        change = np.zeros(max(len(held) - 1, 0), dtype=bool)
        for c in cols:
            change |= c[1:] != c[:-1]
        cuts = np.concatenate([[0], np.flatnonzero(change) + 1])
        held = held.combine_chunks()
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield held.slice(a, b - a)
        held = held.slice(cuts[-1])
    if held is not None and len(held):
        yield held


def _block_pairs(k: int, similarity: float, likely: float):
    """Pairs of a bucket's block pair that differ in component and look alike by signature."""

    def run(arrow_batches):
        for group in _runs(arrow_batches, ["key", "one", "two"]):
            if len(group) < 2:
                continue
            band = group.column("band")[0].as_py()
            pos, comp, block = (group.column(c).to_numpy() for c in ("pos", "comp", "block"))
            if (comp == comp[0]).all():
                continue
            mass = group.column("mass").to_numpy()
            sig = np.frombuffer(b"".join(group.column("signature").to_pylist()), dtype=np.uint16).reshape(len(group), k)
            keys = group.column("bands").combine_chunks().flatten().to_numpy().reshape(len(group), -1)[:, :band]
            one, two = group.column("one")[0].as_py(), group.column("two")[0].as_py()
            left, right = np.flatnonzero(block == one), np.flatnonzero(block == two)
            found_a, found_b = [], []
            for i in left:
                js = right[right > i] if one == two else right
                js = js[(comp[js] != comp[i])
                        & (np.minimum(mass[js], mass[i]) >= similarity * np.maximum(mass[js], mass[i]))]
                if not len(js):
                    continue
                # A pair that meets in several bands is taken in the first.
                js = js[~(keys[js] == keys[i]).any(axis=1)]
                js = js[(sig[js] == sig[i]).mean(axis=1) >= likely]
                found_a.append(np.full(len(js), pos[i]))
                found_b.append(pos[js])
            if found_a:
                a, b = np.concatenate(found_a), np.concatenate(found_b)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["source", "target"]
                )

    return run


def _verify_group(n: int, similarity: float, weighted: bool):
    def run(pairs: pa.Table, texts: pa.Table) -> pa.Table:
        elements, owner = _texts_to_shingles(texts.column("text").to_pylist(), n)
        elements, owner, counts = _counted(elements, owner)
        if not weighted:
            counts = np.ones(len(counts))
        cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
        at = {p: i for i, p in enumerate(texts.column("pos").to_pylist())}
        keep = np.zeros(len(pairs), dtype=bool)
        for r, (s, t) in enumerate(zip(pairs.column("source").to_pylist(), pairs.column("target").to_pylist())):
            i, j = at[s], at[t]
            a, b = slice(cuts[i], cuts[i + 1]), slice(cuts[j], cuts[j + 1])
            _, x, y = np.intersect1d(elements[a], elements[b], assume_unique=True, return_indices=True)
            common = np.minimum(counts[a][x], counts[b][y]).sum()
            keep[r] = common >= similarity * (counts[a].sum() + counts[b].sum() - common)
        return pairs.select(["source", "target"]).filter(pa.array(keep))

    return run


def texts_of(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """``fp, text``, one row for each ``fp`` of ``wanted``; a sieve keeps all other texts out of the shuffle."""
    fps = per_key(wanted.select("fp").distinct())
    known = sifted(docs.select(F.md5("text").alias("fp"), "text"), sieve(fps, "fp"), "fp")
    # Copies of a text shrink to one per task before they meet.
    return cut_lineage(known.dropDuplicates(["fp"]).join(fps, "fp"), "near-texts")


def verified_links(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, n: int, similarity: float, weighted: bool) -> DataFrame:
    """The pairs ``source, target`` whose whole texts are similar enough."""
    pairs = cut_lineage(pairs, "near-pairs")
    ends = pairs.select(F.col("source").alias("pos")).union(pairs.select("target")).distinct()
    grid = max(1, -(-ends.count() // BLOCK))

    def block(c: str):
        return F.pmod(F.xxhash64(F.col(c), F.lit(17)), F.lit(grid))

    dealt = pairs.withColumn("gx", block("source")).withColumn("gy", block("target"))
    needed = dealt.select(F.col("source").alias("pos"), "gx", "gy").union(dealt.select("target", "gx", "gy")).distinct()
    needed = cut_lineage(needed.join(nodes.select(F.col("node").alias("pos"), "fp"), "pos"), "near-needed")
    texts = needed.join(texts_of(needed, docs), "fp").select("pos", "gx", "gy", "text")
    checked = dealt.groupBy("gx", "gy").cogroup(texts.groupBy("gx", "gy")).applyInArrow(
        lambda p, t: _verify_group(n, similarity, weighted)(p, t), "source long, target long"
    )
    return cut_lineage(checked, "near-links")


def near_duplicates(
    docs: DataFrame, n: int = SHINGLE, similarity: float = SIMILARITY, weighted: bool = False
) -> DataFrame:
    """``doc_id, fp, size, class_id, class_size, representative`` of every input row.

    ``fp`` is the MD5 of the text and ``size`` its number of runs of words; one row per class represents it.
    """
    spark = docs.sparkSession
    texts = tidy(docs).select("doc_id", "text")
    marked = texts.select(F.monotonically_increasing_id().alias("pos"), "doc_id", F.md5("text").alias("fp"), "text")
    with batches(spark, BATCH):
        signed = cut_lineage(
            marked.mapInArrow(
                _sign(n, K, ROWS, weighted),
                f"pos long, doc_id {dict(docs.dtypes)['doc_id']}, fp string, size long, mass long, bands array<bigint>",
            ),
            "near-signed",
        )
    usable = signed.filter("size > 0")
    counted = usable.groupBy("fp").agg(F.min("pos").alias("node"), F.count("*").alias("copies"))
    nodes = per_key(counted)
    # Texts that occur once need no join to find the row that stands for them.
    copied = sieve(nodes.filter("copies > 1"), "fp")
    first_of = sifted(usable, copied, "fp").join(nodes.select(F.col("node").alias("pos")), "pos", "left_semi")
    single = sifted(usable, copied, "fp", passing=False).unionByName(first_of)
    placed = single.select("pos", F.posexplode("bands").alias("band", "key"))
    sizes = per_key(placed.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1"))
    shared = cut_lineage(sifted(placed, sieve(sizes, "key"), "key").join(sizes, "key"), "near-buckets")

    links = verified_links(_leader_pairs(shared), nodes, texts, n, similarity, weighted)
    members = cut_lineage(shared.select(F.col("pos").alias("address")).distinct(), "near-members")
    first = cut_lineage(components(members, links), "near-components")
    likely = _open_pairs(shared, first, single, nodes, texts, n, similarity, weighted)
    more = verified_links(likely, nodes, texts, n, similarity, weighted)
    final = per_key(components(members, links.unionByName(more)))

    node_of = nodes.join(final.select(F.col("address").alias("node"), "cluster"), "node", "left").select(
        "fp", F.coalesce("cluster", "node").alias("class")
    )
    known = signed.select("pos", "doc_id", "fp", "size").join(per_key(node_of), "fp", "left")
    known = cut_lineage(
        known.select(
            "pos", "doc_id", "fp", "size", F.when(F.col("size") > 0, F.col("class")).otherwise(F.col("pos")).alias("class")
        ), "near-classes",
    )
    per_class = per_key(known.groupBy("class").agg(
        F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"),
        F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("pos"))).alias("_first"),
    ))
    return known.join(per_class, "class").select(
        "doc_id", "fp", "size", "class_id", "class_size", (F.col("pos") == F.col("_first.pos")).alias("representative")
    )


def _leader_pairs(shared: DataFrame) -> DataFrame:
    """Each member with the leader of highest score among its buckets; the score is the members met."""
    score = per_key(shared.groupBy("pos").agg(F.sum("members").alias("score")))
    scored = cut_lineage(shared.join(score, "pos"), "near-scored")
    rank = F.struct("score", (-F.col("pos")).alias("p"))
    leaders = per_key(scored.groupBy("key").agg(F.max(rank).alias("leader")))
    met = scored.join(leaders, "key").filter(F.col("pos") != -F.col("leader.p"))
    best = met.groupBy("pos").agg(F.max("leader").alias("leader"))
    other = -F.col("leader.p")
    return best.select(F.least("pos", other).alias("source"), F.greatest("pos", other).alias("target")).distinct()


def _open_pairs(
    shared: DataFrame, found: DataFrame, single: DataFrame, nodes: DataFrame, texts: DataFrame, n: int, similarity: float, weighted: bool
) -> DataFrame:
    """Likely pairs of different components that share a bucket, made block by block."""
    spark = shared.sparkSession
    placed = cut_lineage(shared.join(found.select(F.col("address").alias("pos"), F.col("cluster").alias("comp")), "pos"), "near-open")
    mixed = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high")
    open_rows = cut_lineage(placed.join(per_key(mixed.select("key")), "key"), "near-open-rows")
    members = per_key(open_rows.select("pos").distinct())
    known = sifted(single, sieve(members, "pos"), "pos").select("pos", "fp", "mass", "bands").join(members, "pos", "left_semi")
    known = cut_lineage(known, "near-open-members")
    with batches(spark, BATCH):
        signed = cut_lineage(
            texts_of(known, texts).mapInArrow(_sign_long(n, LONG, weighted), "fp string, signature binary"), "near-long"
        )
    known = known.join(signed, "fp").drop("fp")
    blocks = F.ceil(F.col("members") / BLOCK)
    mine = F.pmod(F.xxhash64("pos", F.lit(23)), blocks)
    paired = open_rows.withColumn("block", mine).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    paired = paired.select(
        "pos", "band", "key", "comp", "block", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two")
    ).join(known, "pos")
    keys = ["key", "one", "two"]
    # A fixed number of partitions, so that a run of equal keys is never cut.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = paired.repartition(parts, *keys).sortWithinPartitions(*keys, "pos")
    with batches(spark, 1024):
        return cut_lineage(dealt.mapInArrow(_block_pairs(LONG, similarity, LIKELY), "source long, target long"), "near-likely")


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One row of each class, with the input's columns: the one of the smallest doc_id.

    The decision is taken by doc_id and text, which most rows share with no other; a sieve lets these pass
    without a join. Rows without words are all kept.
    """
    rows = tidy(docs, taken=("_fp", "_id", "_keep"))
    names = rows.columns
    found = near_duplicates(rows.select("doc_id", "text"), **options).filter("size > 0")
    pairs = found.groupBy(F.col("doc_id").alias("_id"), F.col("fp").alias("_fp")).agg(
        F.max("representative").alias("_keep"), F.count("*").alias("n")
    )
    # Rows to drop, and rows of which several are the same.
    special = per_key(pairs.filter(~F.col("_keep") | (F.col("n") > 1)).drop("n"))
    marked = rows.withColumn("_fp", F.md5("text"))
    key = ["_id", "_fp"]
    bits = sieve(special, *key)
    keyed = marked.withColumn("_id", F.col("doc_id"))
    plain = sifted(keyed, bits, *key, passing=False).select(*names)
    asked = sifted(keyed, bits, *key)
    same = special.select(F.col("_id").alias("_id2"), F.col("_fp").alias("_fp2"), "_keep")
    joined = asked.join(same, (F.col("_fp") == F.col("_fp2")) & F.col("_id").eqNullSafe(F.col("_id2")), "left")
    other = joined.filter("_keep IS NULL").select(*names)
    single = joined.filter("_keep").dropDuplicates(["_id", "_fp"]).select(*names)
    return plain.unionByName(other).unionByName(single)
