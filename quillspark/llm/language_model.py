"""A hierarchical Pitman-Yor language model over words, with seating sampled by Gibbs and predictions averaged.

Every word that follows a context (the word before it, or a document's begin) is a customer of that context's
restaurant; each table sends one customer to the restaurant that all contexts share, whose own tables draw from the
uniform distribution over the training vocabulary and one unknown word.

The sampler is a blocked Gibbs sampler over the numbers of tables. Given the shared restaurant's distribution over words, context
restaurants are independent of each other. Given a Gamma variable for a restaurant, which replaces its rising factorial, its dishes are
independent too, and a dish's tables have the weights S(c, t) * y**t, S a generalised Stirling number. So a sweep draws, for all at
once and each from its exact conditional: the Gamma variables, the tables of all dishes, the shared restaurant's tables, and its
distribution given those (the mass of words never seen there is spread evenly, which is its mean).

Documents are dealt in chunks. A chunk sends its distinct words and distinct pairs, with training counts, to buckets
by hash; buckets of pairs and of words exchange tables and probabilities in every sweep, and in the end answer each
chunk in the order in which it asked. Random numbers are hashes of what they are drawn for, and sums are of integers, so a score
depends on the training rows alone, not on chunks, buckets or partitions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import _text as T
from quillspark.llm._common import crc_mod, cut, lean, load, remove
from quillspark.llm._exchange import PIECE, bucket_of, distinct, grouped, merged, pack_counts, pack_keys, piece, unpack_counts, unpack_keys, unsqueezed, squeezed

#: Bytes of text of a chunk, and of the text whose pairs one bucket holds.
CHUNK_BYTES, BUCKET_BYTES = 5 << 20, 12 << 20
#: Sweeps of the sampler before the samples that are averaged, and those samples.
BURN, SAMPLES = 2, 2
#: Customers of a dish up to which its tables are drawn with tabulated Stirling numbers.
TABLED = 1_024

_U = np.uint64
BEGIN, END = _U(0x1B873593CC9E2D51), _U(0x52DCE729DA3ED7A5)
#: A pair's key: the first 32 bits of the context's hash above the first 32 of the word's.
_HALF = _U(32)
_LOW = _U(0xFFFFFFFF)
#: Masses are drawn as integers of this share of one, so that their sums are exact.
_GRAIN = float(1 << 20)


@dataclass(frozen=True)
class Restaurant:
    discount: float
    strength: float


CONTEXT, SHARED = Restaurant(0.8, 0.5), Restaurant(0.65, 1.0)


def log_stirling(n: int, d: float) -> np.ndarray:
    """Logarithms of generalised Stirling numbers: [c, t] for c customers at t tables, discount d."""
    s = np.full((n + 1, n + 2), -np.inf)
    s[0, 0] = 0.0
    for c in range(1, n + 1):
        t = np.arange(1, c + 1)
        with np.errstate(divide="ignore"):
            s[c, 1 : c + 1] = np.logaddexp(s[c - 1, 0:c], np.log(np.maximum(c - 1 - d * t, 0)) + s[c - 1, 1 : c + 1])
    return s


def uniforms(key: np.ndarray, tag: int) -> np.ndarray:
    """Numbers in (0, 1), a hash of key and tag each."""
    h = T.mix(T.mix(key + _U(0x9E3779B97F4A7C15)) + _U(tag * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF))
    return ((h >> _U(11)).astype(float) + 0.5) * 2.0**-53


def normals(key: np.ndarray, tag: int) -> np.ndarray:
    return np.sqrt(-2 * np.log(uniforms(key, 2 * tag))) * np.cos(2 * np.pi * uniforms(key, 2 * tag + 1))


def gammas(shape: np.ndarray, key: np.ndarray, tag: int) -> np.ndarray:
    """Gamma variables of these shapes and scale one, by rejection from a cubed normal."""
    a = np.where(shape < 1, shape + 1, shape) - 1 / 3
    out, todo, j = np.zeros(len(a)), np.arange(len(a)), 1
    while len(todo):
        x = normals(key[todo], tag + (j << 20))
        v = (1 + x / np.sqrt(9 * a[todo])) ** 3
        fine = v > 0
        with np.errstate(invalid="ignore", divide="ignore"):
            fine &= np.log(uniforms(key[todo], 2 * tag + 1 + (j << 40))) < x * x / 2 + a[todo] * (1 - v + np.log(np.where(fine, v, 1)))
        out[todo[fine]] = (a[todo] * v)[fine]
        todo, j = todo[~fine], j + 1
    return out * np.where(shape < 1, uniforms(key, tag + (1 << 60)) ** (1 / np.maximum(shape, 1e-9)), 1.0)


def draw_tables(count: np.ndarray, y: np.ndarray, key: np.ndarray, tag: int, discount: float, stirling: np.ndarray) -> np.ndarray:
    """Tables t of dishes with ``count`` customers, each with the weights S(count, t) * y**t.

    Up to the table's size in customers, from these weights. Beyond, from their limit: the dish is a sum of as many tables as a
    Poisson variable says, conditioned on its customers. With few tables one of them has nearly all customers and the others
    are Poisson; with many their number is normal. The error is of the order of a customer in TABLED.
    """
    out = (count > 0).astype(np.int64)
    u, top = uniforms(key, tag), stirling.shape[0] - 1
    order = np.argsort(count, kind="stable")
    edge = np.flatnonzero(np.concatenate([[True], count[order][1:] != count[order][:-1]])) if len(order) else []
    for a, z in zip(edge, [*edge[1:], len(order)], strict=True) if len(order) else ():
        c = int(count[order[a]])
        if c < 2 or c > top:
            continue
        for lo in range(a, z, max(1, 2_000_000 // c)):
            at = order[lo : min(z, lo + max(1, 2_000_000 // c))]
            mean = float(y[at].max()) / discount
            t = np.arange(1, min(c, math.ceil(25 + mean + 12 * math.sqrt(mean))) + 1)
            w = stirling[c, t][None, :] + t[None, :] * np.log(y[at])[:, None]
            w = np.cumsum(np.exp(w - w.max(axis=1, keepdims=True)), axis=1)
            out[at] = 1 + (u[at][:, None] * w[:, -1:] > w).sum(axis=1)
    many = np.flatnonzero(count > top)
    if len(many):
        c, ym = count[many].astype(float), y[many]
        low, high = np.full(len(many), -1500.0), np.zeros(len(many))  # log of 1 - z, where y z (1 - z)**(d - 1) = c
        for _ in range(60):
            mid = (low + high) / 2
            above = np.log(ym) + np.log1p(-np.exp(np.minimum(mid, -1e-300))) + (discount - 1) * mid > np.log(c)
            low, high = np.where(above, mid, low), np.where(above, high, mid)
        q = (low + high) / 2
        mean = ym / discount * -np.expm1(discount * q)
        spread = np.log(ym) + np.log1p(-np.exp(np.minimum(q, -1e-300))) + (discount - 2) * q + np.log1p(-discount * (1 - np.exp(q)))
        sd = np.sqrt(np.maximum(mean - np.exp(2 * np.log(c) - spread), 0.25))
        few = mean < 64
        t = np.rint(mean + sd * normals(key[many], tag + 1))
        if few.any():
            k = np.arange(200)
            logs = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 200)))])
            p = np.cumsum(np.exp(k[None, :] * np.log(mean[few])[:, None] - mean[few][:, None] - logs[None, :]), axis=1)
            t[few] = 1 + (u[many][few][:, None] > p).sum(axis=1)
        out[many] = np.clip(t, 1, count[many]).astype(np.int64)
    return out


def sweep_contexts(keys: np.ndarray, count: np.ndarray, start: np.ndarray, tables: np.ndarray, p: np.ndarray, tag: int, stirling: np.ndarray) -> np.ndarray:
    """New tables of the pairs with more than one customer (of sorted ``keys`` with training counts), given ``tables`` of
    each context, whose pairs begin at ``start``, and those pairs' words' probabilities ``p`` in the shared restaurant."""
    more = np.flatnonzero(count > 1)
    of = np.searchsorted(start, more, side="right") - 1
    own, of = np.unique(of, return_inverse=True)
    x = gammas(CONTEXT.strength / CONTEXT.discount + tables[own], T.mix((keys[start[own]] >> _HALF) + _U(77)), tag)
    return draw_tables(count[more], CONTEXT.discount * x[of] * p, keys[more], tag + 2, CONTEXT.discount, stirling)


def sweep_shared(words: np.ndarray, customers: np.ndarray, y: float, tag: int, stirling: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tables, mass as an integer) of each word in the shared restaurant, given its customers; ``y`` is the discount times the
    restaurant's Gamma variable times the uniform probability of a word."""
    key = T.mix(words + _U(99))
    tables = draw_tables(customers, np.full(len(words), y), key, tag, SHARED.discount, stirling)
    mass = np.zeros(len(words), dtype=np.int64)
    on = customers > 0
    mass[on] = np.rint(gammas(customers[on] - SHARED.discount * tables[on], key[on], tag + 4) * _GRAIN).astype(np.int64)
    return tables, mass


@dataclass
class Tokens:
    """A chunk's tokens: word hash, hash of the word before, and document."""

    word: np.ndarray
    context: np.ndarray
    doc: np.ndarray


def tokens(texts: pa.Array) -> Tokens:
    hashes, docs = [], []
    for a, z, data, offsets in T.spans(texts):
        w = T.words(data, offsets, lower=True)
        end = np.arange(a, z)
        hashes.append(np.insert(w.hash, w.first[1:], END))
        docs.append(np.insert(w.doc + a, w.first[1:], end))
    h = np.concatenate(hashes) if hashes else np.zeros(0, dtype=_U)
    d = np.concatenate(docs) if docs else np.zeros(0, dtype=np.int64)
    before = np.concatenate([[BEGIN], h[:-1]]) if len(h) else h
    before[np.concatenate([[True], d[1:] != d[:-1]])[: len(d)]] = BEGIN
    return Tokens(h, before, d)


def pair_keys(t: Tokens) -> np.ndarray:
    return ((t.context >> _HALF) << _HALF) | (t.word >> _HALF)


def _bounds(keys: np.ndarray) -> np.ndarray:
    """Where each context begins in sorted pair keys."""
    context = keys >> _HALF
    return np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)


def _asked(n: int):
    """Chunks (chunk, id, train, body) -> PIECE; kind 0 words, 1 pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (chunk,), table in grouped(batches, 1):
            t = tokens(table.column("body"))
            train = table.column("train").to_numpy().astype(bool)[t.doc]
            for kind, key in enumerate((t.word, pair_keys(t))):
                keys, place = distinct(key, n)
                counts = np.split(np.bincount(place[train], minlength=sum(map(len, keys))), np.cumsum([len(k) for k in keys])[:-1])
                yield piece(kind, chunk, keys, counts)

    return run


#: What buckets and chunks send each other.
MESSAGE = "bucket int, kind int, src int, a binary, b binary, c binary, vocabulary long, train long, customers long, seats long, mass long"
STATIC, STATE, SENT, ANSWERED, ASKED = range(5)
_SUMS = ("vocabulary", "train", "customers", "seats", "mass")


def _message(bucket: int, kind: int, src: int, a: bytes, b: bytes = b"", c: bytes = b"", sums: tuple[int, ...] = (None,) * 5) -> pa.RecordBatch:
    ints, blobs = [pa.array([x], pa.int32()) for x in (bucket, kind, src)], [pa.array([x], pa.binary()) for x in (a, b, c)]
    return pa.RecordBatch.from_arrays([*ints, *blobs, *(pa.array([x], pa.int64()) for x in sums)], ["bucket", "kind", "src", "a", "b", "c", *_SUMS])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of one kind -> a bucket's keys with training counts; those without any aren't kept."""
    for (_, bucket), table in grouped(batches, 2):
        keys, count, _ = merged(table)
        keys, count = keys[count > 0], count[count > 0]
        words, word = np.unique(keys & _LOW, return_inverse=True)  # of pairs: their words, and how many have one customer
        yield _message(bucket, STATIC, -1, pack_keys(keys), pack_counts(count), pack_counts(np.concatenate([words.astype(np.int64), np.bincount(word[count == 1], minlength=len(words))])))


def _of(table: pa.Table, kind: int) -> list[dict]:
    return table.filter(pa.compute.equal(table.column("kind"), kind)).select(["src", "a", "b", "c"]).to_pylist()


def _contexts(n: int, sweep: int, unseen: float, norm: float, tag: int):
    """A bucket's pairs, their state and the words' masses -> new state, and tables for the buckets of words.

    State: tables of each context; in sampled sweeps also each pair's tables added up and each context's by sample. Sweep 0 seats
    every pair at one table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stirling = log_stirling(TABLED, CONTEXT.discount) if sweep else None
        for (bucket,), table in grouped(batches, 1):
            for r in _of(table, STATIC):
                keys, count = unpack_keys(r["a"]), unpack_counts(r["b"])
                start = _bounds(keys)
                summed, kept = np.zeros(len(keys), dtype=np.int64), np.zeros(0, dtype=np.int64)
                words, by = unpack_counts(r["c"]).reshape(2, -1)
                more = np.flatnonzero(count > 1)
                word = np.searchsorted(words, (keys[more] & _LOW).astype(np.int64))
                tables = np.ones(len(keys), dtype=np.int64)
                if sweep and len(keys):
                    (state,) = _of(table, STATE)
                    told = sorted(_of(table, ANSWERED), key=lambda r: r["src"])
                    mass = np.concatenate([np.frombuffer(unsqueezed(x["b"]), dtype="<i8") for x in told])  # in the order of words
                    tables[more] = sweep_contexts(keys, count, start, unpack_counts(state["a"]), (mass[word] + unseen) / norm, tag, stirling)
                    if sweep > BURN:
                        summed, kept = unpack_counts(state["b"]) if state["b"] else summed, unpack_counts(state["c"]) if state["c"] else kept
                        summed, kept = summed + tables, np.concatenate([kept, np.add.reduceat(tables, start)])
                own = pack_counts(np.add.reduceat(tables, start))
                yield _message(bucket, STATE, -1, own, pack_counts(summed) if sweep > BURN else b"", pack_counts(kept) if sweep > BURN else b"")
                by = by + np.bincount(word, weights=tables[more], minlength=len(words)).astype(np.int64)
                edge = np.searchsorted(bucket_of(words.astype(_U) << _HALF, n), np.arange(n + 1))
                for b in range(n):
                    if edge[b + 1] > edge[b]:
                        on = slice(edge[b], edge[b + 1])
                        yield _message(b, SENT, bucket, pack_keys(words[on].astype(_U)), pack_counts(by[on]))

    return run


def _words(sweep: int, y: float, tag: int):
    """A bucket's words and the tables that pairs' buckets told -> new state with sums, and masses for those buckets.

    State: customers and tables of each word, by sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stirling = log_stirling(TABLED, SHARED.discount)
        for (bucket,), table in grouped(batches, 1):
            for r in _of(table, STATIC):
                keys, count = unpack_keys(r["a"]), unpack_counts(r["b"])
                words = keys[_bounds(keys)] >> _HALF
                told = [(x["src"], unpack_keys(x["a"]), unpack_counts(x["b"])) for x in _of(table, SENT)]
                customers = np.zeros(len(words), dtype=np.int64)
                for _, w, t in told:
                    customers[np.searchsorted(words, w)] += t
                tables, mass = sweep_shared(words, customers, y, tag, stirling) if sweep else ((customers > 0).astype(np.int64), customers * int(_GRAIN))
                kept = b""
                if sweep > BURN:
                    old = [unpack_counts(x["a"]) for x in _of(table, STATE) if x["a"]]
                    kept = pack_counts(np.concatenate([*old, customers, tables]))
                yield _message(bucket, STATE, -1, kept, sums=(len(keys), int(count.sum()), int(customers.sum()), int(tables.sum()), int(mass.sum())))
                for src, w, _ in told:
                    yield _message(src, ANSWERED, bucket, b"", squeezed(mass[np.searchsorted(words, w)].astype("<i8").tobytes()))

    return run


ANSWER = "chunk int, kind int, bucket int, a binary, b binary, c binary"


def _answer(chunk: int, kind: int, bucket: int, a: bytes, b: bytes, c: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([kind], pa.int32()), pa.array([bucket], pa.int32()), pa.array([a], pa.binary()), pa.array([b], pa.binary()), pa.array([c], pa.binary())], ["chunk", "kind", "bucket", "a", "b", "c"])


def _found(keys: np.ndarray, asked: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Values (keys along the last axis) of the asked keys; nought for those that aren't there."""
    if not len(keys):
        return [np.zeros((*v.shape[:-1], len(asked)), dtype=np.int64) for v in values]
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return [np.where(keys[at] == asked, v[..., at], 0) for v in values]


def _told(kind: int):
    """A bucket's keys, final state and what chunks asked -> ANSWER rows in the order of asking."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket,), table in grouped(batches, 1):
            static, state = _of(table, STATIC), _of(table, STATE)
            keys, count = (unpack_keys(static[0]["a"]), unpack_counts(static[0]["b"])) if static else (np.zeros(0, dtype=_U), np.zeros(0, dtype=np.int64))
            if kind == 0:
                words = keys[_bounds(keys)] >> _HALF
                kept = (unpack_counts(state[0]["a"]) if len(keys) else np.zeros(0, dtype=np.int64)).reshape(SAMPLES, 2, len(words))
                for r in _of(table, ASKED):
                    asked = unpack_keys(r["a"])
                    (c,) = _found(keys, asked, count)
                    customers, tables = _found(words, asked >> _HALF, kept[:, 0], kept[:, 1])
                    yield _answer(r["src"], 0, bucket, pack_counts(c), pack_counts(customers.ravel()), pack_counts(tables.ravel()))
            else:
                start = _bounds(keys)
                contexts = keys[start] >> _HALF
                summed = unpack_counts(state[0]["b"]) if len(keys) else count
                own = np.concatenate([np.add.reduceat(count, start)[None, :], unpack_counts(state[0]["c"]).reshape(SAMPLES, -1)]) if len(keys) else np.zeros((SAMPLES + 1, 0), dtype=np.int64)
                for r in _of(table, ASKED):
                    asked = unpack_keys(r["a"])
                    c, t = _found(keys, asked, count, summed)
                    (of,) = _found(contexts, np.unique(asked >> _HALF), own)
                    yield _answer(r["src"], 1, bucket, pack_counts(c), pack_counts(t), pack_counts(of.ravel()))

    return run


def _scores(n: int, n_train: int, vocabulary: int, customers: np.ndarray, tables: np.ndarray):
    """(chunk's documents, chunk's answers) -> a row for each document."""

    def run(key, docs: pa.Table, answers: pa.Table) -> pa.Table:
        lean()
        t = tokens(docs.column("body"))
        by = {(r["kind"], r["bucket"]): r for r in answers.to_pylist()}
        keys, place = distinct(t.word, n)
        rows = [by[0, i] for i in range(n) if len(keys[i])]
        samples = lambda r, x, m: unpack_counts(r[x]).reshape(m, -1)
        c = np.concatenate([unpack_counts(r["a"]) for r in rows])
        own = np.concatenate([samples(r, "b", SAMPLES) for r in rows], axis=1)
        seats = np.concatenate([samples(r, "c", SAMPLES) for r in rows], axis=1)
        uniform = 1.0 / (vocabulary + 1)
        shared = (own - SHARED.discount * seats + (SHARED.strength + SHARED.discount * tables)[:, None] * uniform) / (SHARED.strength + customers)[:, None]
        base = np.log10((c + 0.5) / (n_train + 0.5 * (vocabulary + 1)))[place]
        known = (c > 0)[place]

        pairs, at = distinct(pair_keys(t), n)
        doc, t = t.doc, None
        count, summed, context, of, shift = [], [], [], [], 0
        for i in range(n):
            if len(pairs[i]):
                r = by[1, i]
                count.append(unpack_counts(r["a"]))
                summed.append(unpack_counts(r["b"]))
                _, inner = np.unique(pairs[i] >> _HALF, return_inverse=True)
                of.append(inner + shift)
                context.append(samples(r, "c", SAMPLES + 1))
                shift += int(inner.max()) + 1
        count, summed, of, context = np.concatenate(count), np.concatenate(summed), np.concatenate(of), np.concatenate(context, axis=1)
        below = CONTEXT.strength + context[0]
        seen = (count - CONTEXT.discount * summed / SAMPLES) / below[of]
        back = (CONTEXT.strength + CONTEXT.discount * context[1:]) / below
        p = seen[at] + (back[:, of[at]] * shared[:, place]).mean(axis=0)
        m = len(docs)
        add = lambda w: np.bincount(doc, weights=w, minlength=m)
        by = keys = pairs = None
        return pa.table(
            {
                "doc_id": docs.column("id"), "held_out": docs.column("held_out"), "n_tokens": pa.array(np.bincount(doc, minlength=m).astype(np.int64)), "n_known": pa.array(add(known).astype(np.int64)),
                "train_tokens": pa.array(np.full(m, n_train, dtype=np.int64)), "base_score": pa.array(add(base)), "score": pa.array(add(np.log10(p))),
            }
        )

    return run


def score_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_out: int = 1, seed: int = 41) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each row of ``docs``.

    Trained on the rows whose crc32(doc_id) modulo ``folds`` isn't ``held_out``. A-Z is lower-cased; a text is its
    words and one end. Null and empty texts are the end alone. Rows that repeat count and are scored each time. A null
    id is in no fold, so it is trained on. Empty tables give no rows; without training rows every word is unknown. Texts are taken whole,
    however long; columns beside the two named aren't read, whatever their names.
    Pairs are told apart by 64 bits of hash, half for each of their words; single words by 64.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("body") + 64), F.lit(0)).alias("n")).first().n
    chunks, n = max(1, math.ceil(size / CHUNK_BYTES)), max(12, math.ceil(size / BUCKET_BYTES))
    chunk = F.pmod(F.xxhash64(F.lit(seed), "id", F.xxhash64("body")), F.lit(chunks)).cast("int")
    dealt = rows.select(chunk.alias("chunk"), "id", (crc_mod(F.col("id"), folds) == held_out).alias("held_out"), "body")
    pieces, pieces_path = cut(dealt.select("chunk", "id", (~F.col("held_out")).alias("train"), "body").repartition(chunks, "chunk").sortWithinPartitions("chunk").mapInArrow(_asked(n), PIECE), keep_path=True)
    by_bucket = lambda df: df.repartition(n, "bucket").sortWithinPartitions("bucket", "kind", "src")
    static, static_paths = zip(*[cut(pieces.where(F.col("kind") == kind).repartition(n, "bucket").sortWithinPartitions("kind", "bucket").mapInArrow(_added, MESSAGE), keep_path=True) for kind in (0, 1)], strict=True)

    pairs, words, paths, samples = None, None, [], []
    sums = dict.fromkeys(_SUMS, 0)
    uniform = lambda: 1.0 / (sums["vocabulary"] + 1)
    driver = np.array([seed], dtype=np.uint64)
    for sweep in range(BURN + SAMPLES + 1):
        tag = seed + 64 * sweep
        rest = float(gammas(np.array([SHARED.strength + SHARED.discount * sums["seats"]]), driver, tag + 8)[0]) * _GRAIN  # of words that the shared restaurant hasn't seen
        given = static[1] if sweep == 0 else static[1].unionByName(pairs.where(F.col("kind") == STATE)).unionByName(words.where(F.col("kind") == ANSWERED))
        pairs, path = cut(by_bucket(given).mapInArrow(_contexts(n, sweep, rest * uniform(), sums["mass"] + rest, tag), MESSAGE), keep_path=True)
        paths.append(path)
        y = SHARED.discount * float(gammas(np.array([SHARED.strength / SHARED.discount + sums["seats"]]), driver, tag + 12)[0]) * uniform()
        given = static[0].unionByName(pairs.where(F.col("kind") == SENT))
        given = given if words is None else given.unionByName(words.where(F.col("kind") == STATE))
        words, path = cut(by_bucket(given).mapInArrow(_words(sweep, y, tag + 16), MESSAGE), keep_path=True)
        paths.append(path)
        got = words.where(F.col("kind") == STATE).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _SUMS]).first()
        sums = {c: int(got[c]) for c in _SUMS}
        if sweep > BURN:
            samples.append((sums["customers"], sums["seats"]))
        while len(paths) > 2:
            remove(spark, paths.pop(0))

    asked = pieces.select("bucket", F.lit(ASKED).alias("kind"), F.col("chunk").alias("src"), F.col("keys").alias("a"), F.col("kind").alias("of"))
    tell = lambda kind, state, part: by_bucket(asked.where(F.col("of") == kind).drop("of").unionByName(static[kind].select("bucket", "kind", "src", "a", "b"), allowMissingColumns=True).unionByName(state.where(F.col("kind") == STATE).select("bucket", "kind", "src", "a", "b", "c"), allowMissingColumns=True).where(part)).mapInArrow(_told(kind), ANSWER)
    back = cut(tell(0, words, "true")).union(cut(tell(1, pairs, "bucket % 2 = 0"))).union(cut(tell(1, pairs, "bucket % 2 = 1")))  # by halves, for less to shuffle at once
    for path in (pieces_path, *static_paths, *paths):
        remove(spark, path)
    customers, seats = (np.array(x) for x in zip(*samples, strict=True))
    score = _scores(n, sums["train"], sums["vocabulary"], customers, seats)
    return dealt.repartition(chunks, "chunk").groupBy("chunk").cogroup(back.repartition(chunks, "chunk").groupBy("chunk")).applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op6_query(spark, sf_dir):
    return score_documents(load(spark, sf_dir, "documents"))
