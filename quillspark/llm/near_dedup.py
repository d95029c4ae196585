"""Near-duplicate documents: BagMinHash signatures over shingle multisets, banding, exact overlap, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import _text as T
from quillspark.llm._common import cut, lean, load, remove
from quillspark.llm._components import components

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 40
ROWS = 7
#: Elements and documents that one verification task holds of each of its two chunks.
CHUNK_ELEMENTS = 1_000_000
CHUNK_DOCS = 1_500

_U = np.uint64


def shingles(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of each run of k words; a document of 1 to k - 1 words has one shingle, all its words."""
    w = T.words(data, offsets)
    h = T.window_hash(w.hash, k)
    ok = T.windows_inside(w.first, len(h), k)
    n_words = np.diff(w.first)
    short = np.flatnonzero((n_words > 0) & (n_words < k))
    own = np.array([np.bitwise_xor.reduce(T.mix(w.hash[w.first[i] : w.first[i + 1]] + np.arange(n_words[i], dtype=_U))) for i in short], dtype=_U)
    h = np.concatenate([h[ok], T.mix(own + n_words[short].astype(_U))])
    d = np.concatenate([w.doc[: len(ok)][ok], short])
    order = np.lexsort((h, d))
    return h[order], d[order]


def counted(h: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (hash, document, count) of rows sorted by document and hash."""
    if not len(h):
        return h, d, np.zeros(0, dtype=np.int64)
    at = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])]))
    return h[at], d[at], np.diff(np.append(at, len(h)))


def bag_min_hash(h: np.ndarray, d: np.ndarray, c: np.ndarray, n: int, m: int) -> np.ndarray:
    """n x m signatures of weighted sets: two agree in a component with the probability of their weighted Jaccard.

    The weight axis is cut into the dyadic blocks [0,1), [1,2), [2,4), [4,8)...; each element has a Poisson process
    over (time, weight, component) in every block, the same whatever the element's weight, and owns those points
    that lie below its weight. A component's value is the earliest point that any element of the set owns. Points
    are drawn in order of time, and an element stops as soon as no component of its set could be improved. A set's
    signature is the same to the last bit whatever other sets are signed with it.
    """
    sig = np.full((n, m), np.inf)
    blocks = [(0, np.ones(len(h), dtype=bool))]
    top = int(c.max()).bit_length() if len(c) else 0
    blocks += [(j, c > (1 << (j - 1))) for j in range(1, top + 1) if (c > (1 << (j - 1))).any()]
    seed = np.concatenate([T.mix(h[on] + _U(j * 0xA24BAED4963EE407 & 0xFFFFFFFFFFFFFFFF)) for j, on in blocks])
    low = np.concatenate([np.full(on.sum(), 0 if j == 0 else 1 << (j - 1), dtype=float) for j, on in blocks])
    width = np.maximum(low, 1.0)
    doc = np.concatenate([d[on] for _, on in blocks])
    part = (np.concatenate([c[on] for _, on in blocks]) - low) / width  # the share of the block below the weight
    time = np.zeros(len(doc))
    flat, drawn = sig.reshape(-1), 0
    while len(doc):
        steps = int(np.clip(1 + 200_000 // (8 * len(doc)), 1, 512))
        key = T.mix(seed[:, None] + (np.arange(drawn + 1, drawn + steps + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))[None, :])
        at = -np.log(((key >> _U(11)).astype(float) + 0.5) * 2.0**-53) / (width[:, None] * m)
        at[:, 0] += time
        np.cumsum(at, axis=1, out=at)  # one by one in order of drawing: the sums don't depend on ``steps``
        other = T.mix(key ^ _U(0x5851F42D4C957F2D))
        where = doc[:, None] * m + (((other >> _U(32)) * _U(m)) >> _U(32)).astype(np.int64)
        owned = (other & _U(0xFFFFFFFF)).astype(float) * 2.0**-32 < part[:, None]
        owned &= at < flat[where]
        np.minimum.at(flat, where[owned], at[owned])
        time, drawn = at[:, -1], drawn + steps
        on = time < sig.max(axis=1)[doc]
        seed, width, doc, part, time = seed[on], width[on], doc[on], part[on], time[on]
    return sig


def band_keys(texts: pa.Array, bands: int, rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, offsets): ``bands`` keys for each text with a word, none for others."""
    keys, sizes = [], []
    for a, z, data, offsets in T.spans(texts):
        h, d, c = counted(*shingles(data, offsets, k))
        sig = bag_min_hash(h, d, c, z - a, bands * rows)
        filled = np.isfinite(sig[:, 0])
        bits = T.mix(sig.view(_U)).reshape(z - a, bands, rows)
        weights = T.powers(_U(0xD6E8FEB86659FD93), rows)
        band = T.mix((bits * weights).sum(axis=2, dtype=_U) + (np.arange(bands, dtype=_U) * _U(0x2545F4914F6CDD1D))[None, :])
        keys.append(band[filled].ravel())
        sizes.append(np.where(filled, bands, 0))
    keys = np.concatenate(keys) if keys else np.zeros(0, dtype=_U)
    return keys, np.concatenate([[0], np.cumsum(np.concatenate(sizes) if sizes else [])]).astype(np.int32)


def elements(texts: pa.Array, k: int) -> list[bytes]:
    """Each text's multiset as sorted 64-bit integers: the j-th copy of a shingle is an element of its own, so that
    multiset overlap is plain set overlap."""
    out: list[bytes] = []
    for a, z, data, offsets in T.spans(texts):
        h, d = shingles(data, offsets, k)
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])]) if len(h) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        nth = np.arange(len(h)) - np.repeat(at, np.diff(np.append(at, len(h))))
        e = T.mix(h + nth.astype(_U) * _U(0xA0761D6478BD642F))
        order = np.lexsort((e, d))
        e, first = e[order], np.searchsorted(d, np.arange(z - a + 1))
        out += [e[first[i] : first[i + 1]].tobytes() for i in range(z - a)]
    return out


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    both = np.concatenate([x, y])
    both.sort()
    return int((both[1:] == both[:-1]).sum())


def _signature_rows(bands: int, rows: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, offsets = band_keys(b.column(3), bands, rows, k)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.view(np.int64)))], ["id", "t1", "t2", "keys"])
        lean(end=True)

    return run


def _element_rows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e = elements(b.column(1), k)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) // 8 for x in e], pa.int64()), pa.array(e, pa.binary())], ["id", "size", "e"])
        lean(end=True)

    return run


def _verified(similarity: float):
    """(a, b, ea, eb) -> (a, b) of pairs that are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.zeros(b.num_rows, dtype=bool)
            for i, (x, y) in enumerate(zip(b.column(2), b.column(3), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), dtype=_U), np.frombuffer(y.as_buffer(), dtype=_U)
                o = overlap(x, y)
                keep[i] = o >= similarity * (len(x) + len(y) - o) - 1e-9
            yield b.select([0, 1]).filter(pa.array(keep))
        lean(end=True)

    return run


def links_in_block(ids: np.ndarray, comps: np.ndarray, e: list[np.ndarray], side: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links between different components of one block, as few as connect what is linked.

    ``side`` has bit 1 and/or 2: pairs are compared across the sides (of one chunk with itself, all). Every overlap is counted
    exactly, from the elements that at least two documents share; elements of few documents pair by pair, those of
    many in slices of a 0/1 matrix product.
    """
    n = len(ids)
    sizes = np.array([len(x) for x in e])
    doc = np.repeat(np.arange(n), sizes)
    flat = np.concatenate(e) if n else np.zeros(0, dtype=_U)
    order = np.argsort(flat, kind="stable")
    flat, doc = flat[order], doc[order]
    at = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.zeros(0, int)
    df = np.diff(np.append(at, len(flat)))
    shared = np.zeros((n, n), dtype=np.float32)
    rare = np.repeat(df <= 8, df)
    rf, rd = flat[rare], doc[rare]
    for step in range(1, 8):
        same = rf[step:] == rf[:-step]
        np.add.at(shared, (rd[:-step][same], rd[step:][same]), 1)
    shared += shared.T
    often = np.repeat(df > 8, df)
    of, od = flat[often], doc[often]
    if len(of):
        _, col = np.unique(of, return_inverse=True)
        for lo in range(0, int(col.max()) + 1, 4096):
            on = (col >= lo) & (col < lo + 4096)
            x = np.zeros((n, 4096), dtype=np.float32)
            x[od[on], col[on] - lo] = 1
            shared += x @ x.T
    close = shared >= similarity * (sizes[:, None] + sizes[None, :] - shared) - 1e-6
    close &= comps[:, None] != comps[None, :]
    i, j = np.nonzero(np.triu(close, 1))
    apart = ((side[i] & 1) & (side[j] >> 1)) | ((side[j] & 1) & (side[i] >> 1))
    i, j = i[apart > 0], j[apart > 0]
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            root[x] = root.get(root[x], root[x])
            x = root[x]
        return x

    out = []
    for p, q in zip(i.tolist(), j.tolist(), strict=True):
        a, b = find(int(comps[p])), find(int(comps[q]))
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((int(ids[p]), int(ids[q])))
    return out


def _block_links(similarity: float):
    """Rows (key, i, j, id, comp, side, e) sorted by (key, i, j) -> (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def done() -> pa.RecordBatch:
            ids, comps, side, e = zip(*held, strict=True)
            got = links_in_block(np.array(ids), np.array(comps), [np.frombuffer(x, dtype=_U) for x in e], np.array(side), similarity) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.int64())], ["a", "b"])

        for b in batches:
            for k, i, j, own, comp, side, e in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key != (k, i, j) and held:
                    yield done()
                    held = []
                key = (k, i, j)
                held.append((own, comp, side, e))
        if held:
            yield done()
        held = []
        lean(end=True)

    return run


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, copy_of, class_id), a row for each row of ``docs``.

    Two documents are linked if the multisets of their ``k``-word shingles overlap by ``similarity`` or more
    (sum of minima over sum of maxima); class_id is the least id of a document's connected component, and copy_of
    the least id with the very same text. Words are as written; a text of fewer than ``k`` words is one shingle.

    Null text counts as empty; texts without a word are alike only if they are equal. Rows that repeat an id are
    one document. A row with a null id gets nulls and links nothing. Empty tables give no rows. Very long texts are
    taken whole.

    Exact copies collapse to one first. Each bucket's members are compared with its least id, which settles most
    groups; buckets in which different components still meet are then compared pair by pair within the bucket, in
    blocks of bounded size, so no link that shares a bucket is lost however large the bucket. A pair at 0.8 misses
    all 40 bands of 7 with probability 8e-5, at 0.85 with 1e-7.
    """
    body = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    body = body.select("id", F.xxhash64(F.lit(1), "body").alias("t1"), F.xxhash64(F.lit(2), "body").alias("t2"), "body")
    signed = cut(body.mapInArrow(_signature_rows(bands, rows, k), "id long, t1 long, t2 long, keys array<long>"))
    texts = cut(signed.where("id is not null").groupBy("t1", "t2").agg(F.min("id").alias("id")))
    firsts = signed.where("id is not null").join(texts, ["t1", "t2", "id"], "left_semi")
    keyed, keyed_path = cut(firsts.select("id", F.explode("keys").alias("key")), keep_path=True)
    buckets = keyed.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n")).where("lo < hi").drop("hi")
    members = cut(keyed.join(buckets, "key"))
    remove(docs.sparkSession, keyed_path)
    pairs = cut(members.where("id <> lo").select(F.col("lo").alias("a"), F.col("id").alias("b")).distinct())
    wanted = members.select("id").distinct()
    sets = cut(body.where("id is not null").select("id", "body").join(wanted, "id", "left_semi").dropDuplicates(["id"]).mapInArrow(_element_rows(k), "id long, size long, e binary"))
    sized = sets.select("id", "size")
    near = (
        pairs.join(sized.toDF("b", "nb"), "b").join(sized.toDF("a", "na"), "a")
        .where(F.least("na", "nb") >= similarity * F.greatest("na", "nb") - 1e-9)
        .select("a", "b")
        .join(sets.select(F.col("id").alias("b"), F.col("e").alias("eb")), "b")
        .join(sets.select(F.col("id").alias("a"), F.col("e").alias("ea")), "a")
        .select("a", "b", "ea", "eb")
    )
    links = cut(near.mapInArrow(_verified(similarity), "a long, b long"))
    comp = components(links)

    # Buckets of three or more in which components still meet.
    placed = members.where("n > 2").join(comp, "id", "left").select("key", "id", F.coalesce("comp", "id").alias("comp")).join(sized, "id")
    one = F.xxhash64("id")
    meet = (
        placed.groupBy("key")
        .agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("n"), F.sum(one.cast("decimal(38,0)")).alias("s"), F.bit_xor(one).alias("x"), F.sum("size").alias("total"))
        .where("c0 < c1")
        .groupBy("n", "s", "x").agg(F.min(F.struct("key", "total")).alias("b"))  # buckets of the same members count once
        .select("b.key", F.ceil(F.greatest(F.col("b.total") / CHUNK_ELEMENTS, F.col("n") / CHUNK_DOCS)).cast("int").alias("chunks"))
    )
    mine = F.pmod(F.xxhash64(F.lit(3), "id"), F.col("chunks")).cast("int")
    blocks = (
        placed.join(meet, "key")
        .select("key", "id", "comp", mine.alias("c"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("o"))
        .select("key", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "id", "comp", (F.when(F.col("c") <= F.col("o"), 1).otherwise(0) + F.when(F.col("c") >= F.col("o"), 2).otherwise(0)).alias("side"))
        .join(sets.select("id", "e"), "id")
        .select("key", "i", "j", "id", "comp", "side", "e")
        .repartition("key", "i", "j")
        .sortWithinPartitions("key", "i", "j")
    )
    more = cut(blocks.mapInArrow(_block_links(similarity), "a long, b long"))
    if not more.isEmpty():
        comp = components(links.union(more))
    classes = texts.join(comp, "id", "left").select(F.col("t1").alias("u1"), F.col("t2").alias("u2"), F.col("id").alias("copy_of"), F.coalesce("comp", "id").alias("class_id"))
    rows_ = signed.select("id", "t1", "t2")
    return rows_.join(classes, (rows_["t1"] == classes["u1"]) & (rows_["t2"] == classes["u2"]) & rows_["id"].isNotNull(), "left").select(F.col("id").alias("doc_id"), "copy_of", "class_id")


def op9_query(spark, sf_dir):
    return near_duplicates(load(spark, sf_dir, "documents").select("doc_id", "text"))
