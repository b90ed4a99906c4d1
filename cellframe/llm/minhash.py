"""MinHash near-duplicate groups.

Each text becomes the set of its runs of ``shingle`` words; ``bands * rows`` minima of universal
hashes ``(a * x + b) mod 2**64 >> 32`` make its signature. Texts of equal signature are one node
from the start. Nodes that share a band are candidates; candidates whose signatures agree in at
least ``threshold`` (corrected for chance agreement of the stored bytes) are joined; the groups are
the connected components, found by alternating large-star and small-star steps.

Every member of a bucket is compared, none is capped. Buckets are counted before they are gathered: one of more
than ``block`` members is never in one place. Its members are first compared with its least one, each by itself; those
alike are joined by that. The others, and they alone, are then compared with all members, block by block, each pair of blocks
in a task of its own. So nothing is left out, and a bucket of copies costs one comparison for each.

Defined results: null or blank texts are in no group. A text of fewer than ``shingle`` words is one
shingle; one without any word is one shingle of its bytes. Rows with a null id are left out of the groups; rows
sharing an id are one document. The group's id is its smallest document id. Very long texts are hashed whole, alone in their slice. Equal
likeness needs no order: whatever reaches the threshold is joined. An empty table gives no rows. Extra columns, whatever their names
(``group_id``, ``__gone``), are left out of the groups and kept as they are by ``drop_near_duplicates``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellframe.llm._text import Words, checkpointed, map_slices, mix, ngrams, picked, unused

SHINGLE, BANDS, ROWS, THRESHOLD, BLOCK, SEED = 3, 64, 4, 0.55, 4096, 7


def _coefficients(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def shingles(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts and how many each has."""
    words = Words(column)
    h = words.hashes()
    docs = len(words.first) - 1
    per = np.diff(words.first)
    grams, at = ngrams(h, words.first, n)
    of = np.searchsorted(words.first, at, side="right") - 1 if len(at) else at
    short = np.flatnonzero((per > 0) & (per < n))
    odd = np.flatnonzero(per == 0)
    extra, extra_of = [], []
    for i in short:
        v = h[words.first[i] : words.first[i] + 1] ^ np.uint64(per[i])
        for k in range(words.first[i] + 1, words.first[i + 1]):
            v = mix(v * np.uint64(0x9FB21C651E98DF25) + h[k])
        extra.append(v[0])
        extra_of.append(i)
    for i in odd:
        raw = bytes(words.data[words.offsets[i] : words.offsets[i + 1]]).strip()
        if raw:
            extra.append(np.frombuffer(hashlib.blake2b(raw, digest_size=8).digest(), np.uint64)[0])
            extra_of.append(i)
    if extra:
        of = np.concatenate([of, np.array(extra_of)])
        grams = np.concatenate([grams, np.array(extra, np.uint64)])
        order = np.argsort(of, kind="stable")
        of, grams = of[order], grams[order]
    return grams, np.bincount(of, minlength=docs) if len(of) else np.zeros(docs, np.int64)


def minima(grams: np.ndarray, counts: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Signatures (texts with shingles only) of 32-bit minima."""
    has = counts[counts > 0]
    at = np.concatenate([[0], np.cumsum(has)[:-1]]) if len(has) else np.zeros(0, np.int64)
    out = np.empty((len(has), len(a)), np.uint32)
    if len(has):
        h = np.empty_like(grams)
        for k in range(len(a)):
            np.multiply(grams, a[k], out=h)
            h += b[k]
            out[:, k] = np.minimum.reduceat(h, at) >> np.uint64(32)
    return out


def signatures(docs: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, seed: int = SEED) -> DataFrame:
    """``doc_id, key`` (128-bit digest of the signature), ``bands`` (band hashes), ``sig`` (a byte of each minimum)."""

    def make():
        a, b = _coefficients(bands * rows, seed)
        ba, bb = _coefficients(rows, seed + 1)
        salt = mix(np.arange(1, bands + 1, dtype=np.uint64))

        def one(part: pa.RecordBatch) -> pa.RecordBatch:
            grams, counts = shingles(part.column("text"), shingle)
            sig = minima(grams, counts, a, b)
            ids = part.column("doc_id").filter(pa.array(counts > 0))
            v = (sig.reshape(-1, bands, rows).astype(np.uint64) * ba).sum(axis=2, dtype=np.uint64)
            hashes = mix(v + salt).view(np.int64)
            keys = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sig]
            low = np.ascontiguousarray((sig & np.uint32(255)).astype(np.uint8))
            return pa.RecordBatch.from_arrays(
                [ids, pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(0, hashes.size + 1, bands, dtype=np.int32)), pa.array(hashes.ravel())), pa.array([x.tobytes() for x in low], pa.binary())],
                ["doc_id", "key", "bands", "sig"],
            )

        return one

    return map_slices(docs, make, "text", "doc_id long, key binary, bands array<long>, sig binary")


def bucket_edges(ids: np.ndarray, sigs: np.ndarray, need: int) -> list[tuple[int, int]]:
    """Edges from each member of a bucket to the least member of its component, comparing as few pairs as that takes."""
    left = np.arange(len(ids))
    edges = []
    while len(left) > 1:
        part, front, left = [left[0]], [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            hit = (sigs[left] == sigs[x]).sum(axis=1) >= need
            found = left[hit]
            left = left[~hit]
            part += found.tolist()
            front += found.tolist()
        if len(part) > 1:
            low = min(ids[i] for i in part)
            edges += [(int(ids[i]), int(low)) for i in part if ids[i] != low]
    return edges


def _verify(need: int):
    def run(batches):
        kept: list[pa.Table] = []

        def solve(t: pa.Table) -> pa.RecordBatch:
            key = t.column("bucket").to_numpy()
            ids = t.column("member").to_numpy()
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(len(ids), -1)
            cut = np.flatnonzero(np.diff(key)) + 1
            a, b = np.r_[0, cut], np.r_[cut, len(key)]
            two = a[b - a == 2]
            same = (sig[two] == sig[two + 1]).sum(axis=1) >= need
            x, y = ids[two[same]], ids[two[same] + 1]
            u, v = [np.maximum(x, y)], [np.minimum(x, y)]
            more = [e for i, j in zip(a[b - a > 2], b[b - a > 2], strict=True) for e in bucket_edges(ids[i:j], sig[i:j], need)]
            if more:
                m = np.array(more, np.int64)
                u.append(m[:, 0])
                v.append(m[:, 1])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("bucket").to_numpy()
            last = int(np.searchsorted(key != key[-1], False)) if key[0] == key[-1] else int(np.flatnonzero(key != key[-1])[-1]) + 1
            if last:
                kept.append(pa.Table.from_batches([batch.slice(0, last)]))
                yield solve(pa.concat_tables(kept).combine_chunks())
                kept = []
            elif kept and kept[-1].column("bucket")[0].as_py() != key[0]:
                yield solve(pa.concat_tables(kept).combine_chunks())
                kept = []
            kept.append(pa.Table.from_batches([batch.slice(last)]))
        if kept:
            yield solve(pa.concat_tables(kept).combine_chunks())

    return run


def alike(members: DataFrame, need: int) -> DataFrame:
    """``band, member, joined`` of ``band, member, sig, other``: whether the two signatures agree in ``need`` bytes at least."""

    def run(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sig", "other"))
            yield pa.RecordBatch.from_arrays([batch.column("band"), batch.column("member"), pa.array((a == b).sum(axis=1) >= need)], ["band", "member", "joined"])

    return members.select("band", "member", "sig", "other").mapInArrow(run, "band long, member long, joined boolean")


def large_buckets(banded: DataFrame, hot: DataFrame, nodes: DataFrame, need: int, block: int) -> tuple[DataFrame, DataFrame]:
    """Edges ``u, v`` within buckets of more than ``block`` members (``hot``: band and its least member), and ``bucket, member`` of what has to be compared yet."""
    sig = nodes.select(F.col("doc_id").alias("member"), "sig")
    least = hot.join(nodes.select(F.col("doc_id").alias("least"), F.col("sig").alias("other")), "least")
    # written once: read for the edges, for the counts and for the blocks
    seen = checkpointed(alike(banded.join(least, "band").join(sig, "member"), need))
    edges = seen.where("joined").join(hot, "band").where("member <> least").select(F.col("member").alias("u"), F.col("least").alias("v"))
    apart = F.sum(F.when(F.col("joined"), 0).otherwise(1))
    # blocks 0 to p - 1 hold those apart, p to p + q - 1 those joined to the least one, itself at least; every pair with one of the first kind meets
    n = seen.groupBy("band").agg(F.ceil(apart / F.lit(block)).cast("int").alias("p"), F.ceil((F.count("*") - apart) / F.lit(block)).cast("int").alias("q")).where("p > 0")
    h = F.xxhash64("member", "band")
    placed = seen.join(n, "band").withColumn("own", F.when(F.col("joined"), F.col("p") + F.pmod(h, F.col("q"))).otherwise(F.pmod(h, F.col("p"))).cast("int"))
    met = F.sequence(F.lit(0), F.col("p") + F.when(F.col("joined"), 0).otherwise(F.col("q")) - 1)
    pairs = placed.select("band", "member", "own", F.explode(met).alias("other")).where("own <> other")
    return edges, pairs.select(F.xxhash64("band", F.least("own", "other"), F.greatest("own", "other")).alias("bucket"), "member")


def small_buckets(banded: DataFrame) -> DataFrame:
    """``bucket, member`` of buckets of two or more, one for each distinct set of members: near copies share many bands."""
    buckets = banded.groupBy("band").agg(F.array_sort(F.collect_set("member")).alias("members")).where(F.size("members") > 1)
    distinct = buckets.groupBy(F.xxhash64("members").alias("bucket"), "members").agg(F.lit(1).alias("one"))
    return distinct.select("bucket", F.explode("members").alias("member"))


def edges_of(nodes: DataFrame, bands: int = BANDS, rows: int = ROWS, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    # stored bytes agree by chance in 1 of 256, so that much of the disagreement is hidden
    need = int(np.ceil(bands * rows * (threshold + (1 - threshold) / 256) - 1e-9))
    banded = nodes.select(F.explode("bands").alias("band"), F.col("doc_id").alias("member"))
    sized = banded.groupBy("band").agg(F.count("*").alias("n"), F.min("member").alias("least"))
    hot = checkpointed(sized.where(F.col("n") > block).select("band", "least"))
    edges = None
    if hot.isEmpty():
        members = small_buckets(banded)
    else:
        edges, members = large_buckets(banded, hot, nodes, need, block)
        members = members.unionByName(small_buckets(banded.join(hot, "band", "left_anti")))
    by_bucket = members.join(nodes.select(F.col("doc_id").alias("member"), "sig"), "member").repartition("bucket").sortWithinPartitions("bucket", "member")
    found = by_bucket.select("bucket", "member", "sig").mapInArrow(_verify(need), "u long, v long")
    return (found if edges is None else found.unionByName(edges)).distinct()


def connected_components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """``node, comp`` of an undirected graph ``u, v``: alternating large-star and small-star until nothing changes.

    Each round is written to the checkpoint folder. ``comp`` is the least node of the component;
    nodes without an edge to another node aren't in the result.
    """
    e = checkpointed(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large-star: each greater neighbour is linked to the least of the neighbours and the node
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small-star: each lesser neighbour, and the node, is linked to the least
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        e = checkpointed(
            large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        now = e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components didn't settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """``doc_id, group_id, n_group``: members of groups of two or more documents."""
    base = picked(docs, id_col, text_col).where("doc_id is not null")
    signed = checkpointed(signatures(base, shingle, bands, rows))
    nodes = checkpointed(signed.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"), F.first("sig").alias("sig")))
    # copies of equal signature follow the node that stands for them
    own = signed.select("doc_id", "key").join(nodes.select("key", F.col("doc_id").alias("node")), "key")
    # an id with rows of several texts ties these texts' nodes together
    several = signed.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    ties = own.join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("u"), F.col("node").alias("v"))
    comps = connected_components(edges_of(nodes, bands, rows, threshold, block).unionByName(ties))
    member = own.join(comps, "node", "left").select("doc_id", F.coalesce("comp", "node").alias("group_id")).groupBy("doc_id").agg(F.min("group_id").alias("group_id"))
    sizes = member.groupBy("group_id").agg(F.count("*").alias("n_group")).where("n_group > 1")
    return member.join(sizes, "group_id").select("doc_id", "group_id", "n_group")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` less all but the first document of each group; documents in no group stay as they are.

    Of rows that share an id one stays, that of the least text; of rows with a null id one of each text. Rows without an id and a text, which can't be
    likened to anything, all stay. Only rows whose id (or, without one, text) occurs again are brought together; the others stay where they are.
    """
    id_, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")
    # a text stands for an id that is null, by its digest
    own, name = F.when(id_.isNotNull(), id_.cast("string")).otherwise(F.sha2(text, 256)), unused(docs, "own")
    again = checkpointed(docs.select(own.alias(name)).dropna().groupBy(name).agg(F.count("*").alias("n")).where("n > 1").select(name))
    gone = near_duplicates(docs, id_col, text_col, **how).where("doc_id <> group_id").select(F.col("doc_id").alias(unused(docs, "gone")))
    left = docs.join(gone, id_ == F.col(gone.columns[0]), "left_anti")
    if again.isEmpty():
        return left
    columns = [F.col(f"`{c}`") for c in docs.columns]
    marked = left.withColumn(name, own)
    order = F.struct(text, F.xxhash64(*[F.to_json(F.struct(c)) for c in columns]))
    several = marked.join(again, name, "left_semi").groupBy(name).agg(F.min_by(F.struct(*columns), order).alias("row")).select("row.*")
    return marked.join(again, name, "left_anti").select(*columns).unionByName(several)
