"""Passages that repeat across documents, by sparse suffix arrays with minimiser sampling.

Of all suffixes (starting at words) only those at minimiser positions are retained: in every stretch of ``length`` words
the leftmost run of ``k`` words with the least hash. Which positions these are depends on the words alone, so two copies of
a stretch retain the same one. Retained suffixes whose run of ``k`` words other documents have too are sorted by the
words from there to the right, and each is compared with its neighbours of other documents and extended with them to
the left and to the right. They are then sorted by the words to the left, with their neighbours compared likewise.

Neighbours alone don't settle everything: a suffix may share more on the left with one that isn't next to it on the right.
But a neighbour on the right shares the most on the right, and one on the left the most on the left, which bounds what
any other suffix could still add. Stretches within these bounds that no neighbour has shown to repeat are looked up among each other
and among one of each run of neighbours that share theirs.

Words are compared by 48 bits of hash each, one by one, never windows of words by a single hash (but for the last look-up, by 128 bits).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm import _text as T
from quillspark.llm._common import WORD, cut, hot_keys, load, meet, remove, setting

LENGTH, K = 50, 10
#: Bytes of a word in a suffix.
BYTES = 6
_U = np.uint64
DOC = ["id", "t1", "t2"]
SUFFIX = [*DOC, "cls", "pos", "low", "high", "key"]
_SUFFIX = "id long, t1 long, t2 long, cls long, pos array<int>, low int, high int, key long"
#: Suffixes that a task hands over, and compares, at a time.
BATCH = 4_096
#: Suffixes that a range partition's borders are drawn from, for each partition.
SAMPLE = "20"


def sliding_least(x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(least of x[i:i+width], its leftmost place) for each i, in time linear in x.

    Running minima from both ends of blocks of ``width``; a window is the end of one block and the begin of the next.
    """
    n = len(x) - width + 1
    if n <= 0:
        return x[:0], np.zeros(0, dtype=np.int64)
    top = np.iinfo(x.dtype).max
    padded = np.full(-(-len(x) // width) * width, top, dtype=x.dtype)
    padded[: len(x)] = x
    rows, place = padded.reshape(-1, width), np.arange(len(padded)).reshape(-1, width)
    step = np.arange(width)

    forth = np.minimum.accumulate(rows, axis=1)
    new = np.ones(rows.shape, dtype=bool)
    new[:, 1:] = rows[:, 1:] < forth[:, :-1]  # only a lower one moves the place to the right
    forth_at = place[:, :1] + np.maximum.accumulate(np.where(new, step, 0), axis=1)

    turned = rows[:, ::-1]
    back = np.minimum.accumulate(turned, axis=1)
    new[:, 1:] = turned[:, 1:] <= back[:, :-1]  # an equal one moves it to the left
    back_at = place[:, -1:] - np.maximum.accumulate(np.where(new, step, 0), axis=1)

    a, b = back[:, ::-1].ravel()[:n], forth.ravel()[width - 1 : width - 1 + n]
    return np.minimum(a, b), np.where(a <= b, back_at[:, ::-1].ravel()[:n], forth_at.ravel()[width - 1 : width - 1 + n])


def minimisers(w: T.Words, length: int, k: int) -> tuple[np.ndarray, ...]:
    """(place among all words, document, low, high, key) of each retained suffix: it is the minimiser of the stretches
    that begin ``low`` to ``high`` words before it."""
    n = max(0, len(w.hash) - length + 1)
    on = np.flatnonzero(T.windows_inside(w.first, n, length)) if n else np.zeros(0, dtype=np.int64)
    h = T.window_hash(w.hash, k)
    at = sliding_least(h, length - k + 1)[1][on]
    doc = w.doc[on]
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])])) if len(on) else on
    last = np.append(new[1:], len(on)) - 1 if len(on) else on
    return at[new], doc[new], at[new] - on[last], at[new] - on[new], T.mix(h[at[new]])


def _keys(length: int, k: int):
    """(id, t1, t2, body) -> each document's distinct keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, _, data, offsets in T.spans(b.column(3)):
                w = T.words(data, offsets)
                _, doc, _, _, key = minimisers(w, length, k)
                order = np.lexsort((key, doc))
                new = np.concatenate([[True], (key[order][1:] != key[order][:-1]) | (doc[order][1:] != doc[order][:-1])])[: len(doc)]
                own = pa.array(doc[order][new] + a)
                yield pa.RecordBatch.from_arrays([*(b.column(i).take(own) for i in range(3)), pa.array(key[order][new].view(np.int64))], [*DOC, "key"])

    return run


def _ranges(start: np.ndarray, n: np.ndarray, step: int) -> np.ndarray:
    """start, start + step, ... (n of them) for each pair, end to end."""
    return np.repeat(start, n) + step * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))


def _suffixes(length: int, k: int):
    """(id, t1, t2, body, keys) -> the words from each retained suffix with such a key to the right, and from it to the left.

    Suffixes of a document with the same words on both sides are one row (``cls``, a hash of them) with all their places.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            per, flat = b.column(4).value_lengths().to_numpy(), b.column(4).flatten().to_numpy().view(_U)
            first = np.concatenate([[0], np.cumsum(per)])
            for a, z, data, offsets in T.spans(b.column(3)):
                w = T.words(data, offsets)
                at, doc, low, high, key = minimisers(w, length, k)
                in_doc = lambda d, x: T.mix(x + (d.astype(_U) << _U(40)))
                on = np.isin(in_doc(doc, key), in_doc(np.repeat(np.arange(z - a), per[a:z]), flat[first[a] : first[z]]))
                at, doc, low, high, key = (x[on] for x in (at, doc, low, high, key))
                cls = T.mix(T.span_hash(w.hash, at - high, at + length - low) + (low * 64 + high).astype(_U))
                order = np.lexsort((at, cls, doc))
                at, doc, low, high, key, cls = (x[order] for x in (at, doc, low, high, key, cls))
                new = np.flatnonzero(np.concatenate([[True], (cls[1:] != cls[:-1]) | (doc[1:] != doc[:-1])])[: len(doc)])
                places = pa.ListArray.from_arrays(pa.array(np.append(new, len(at)).astype(np.int32)), pa.array((at - w.first[doc]).astype(np.int32)))
                at, doc, low, high, key, cls = (x[new] for x in (at, doc, low, high, key, cls))
                raw = w.hash.view(np.uint8).reshape(-1, 8)[:, :BYTES]
                sides = []
                for start, n, step in ((at, length - low, 1), (at - 1, high, -1)):
                    ends = np.concatenate([[0], np.cumsum(n * BYTES)]).astype(np.int64)
                    sides.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(raw[_ranges(start, n, step)]).tobytes())]).cast(pa.binary()))
                own = pa.array(doc + a)
                yield from pa.Table.from_arrays(
                    [*(b.column(i).take(own) for i in range(3)), pa.array(cls.view(np.int64)), places, pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32)), pa.array(key.view(np.int64)), *sides], [*SUFFIX, "right", "left"]
                ).to_batches(max_chunksize=BATCH)

    return run


def _matrix(side: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows x width words, 0 where there is none; words of each row)."""
    side = side.cast(pa.large_binary())
    offsets = np.frombuffer(side.buffers()[1], dtype=np.int64)[side.offset : side.offset + len(side) + 1]
    n = np.diff(offsets) // BYTES
    flat = np.zeros((int(n.sum()), 8), dtype=np.uint8)
    if len(flat):
        flat[:, :BYTES] = np.frombuffer(side.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]].reshape(-1, BYTES)
    out = np.zeros((len(side), width), dtype=_U)
    out[np.repeat(np.arange(len(side)), n), _ranges(np.zeros(len(n), dtype=np.int64), n, 1)] = flat.view(_U).ravel()
    return out, n


def _common_words(m: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Words that rows i and j have in common from their begin, at most those of row i."""
    differ = np.concatenate([m[i] != m[j], np.ones((len(i), 1), dtype=bool)], axis=1)
    return np.minimum(differ.argmax(axis=1), n[i])


SHARED = ["lo1", "hi1", "lo2", "hi2", "on_right", "on_left"]
_RESULT = f"{_SUFFIX}, {', '.join(f'{c} int' for c in SHARED)}, lead boolean"
_EDGE = "part int, seq long, right binary, left binary"


def _neighbours(length: int, longest: int, edges: bool):
    """Sorted suffixes -> what each shares with its nearest neighbours of other documents before and after it.

    Rows: (lo, hi), the distances to the left at which stretches begin that both have, for either neighbour (lo > hi: none), and the words in
    common; ``lead``: it comes first among its document's adjacent rows, so that the row before has it as neighbour too. With ``edges`` the first
    and last documents of a partition come along as they are, since some of their neighbours are in other partitions.
    """

    def compared(t: pa.Table, begin: np.ndarray, end: np.ndarray, first: int, last: int) -> dict:
        """Of rows first..last-1, whose documents' rows are begin..end-1."""
        rows = np.arange(first, last)
        right, nr = _matrix(t.column("right").combine_chunks(), length)
        left, nl = _matrix(t.column("left").combine_chunks(), longest)
        low, high = (t.column(c).to_numpy() for c in ("low", "high"))
        out = {"on_right": np.zeros(len(rows), dtype=np.int64), "on_left": np.zeros(len(rows), dtype=np.int64)}
        for name, other in (("1", begin[first:last] - 1), ("2", end[first:last])):
            there = (other >= 0) & (other < t.num_rows)
            i, j = rows[there], other[there]
            r, e = _common_words(right, nr, i, j), _common_words(left, nl, i, j)
            lo, hi = np.ones(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
            lo[there], hi[there] = np.maximum(low[i], length - r), np.minimum(high[i], e)
            out["lo" + name], out["hi" + name] = lo, hi
            np.maximum.at(out["on_right"], np.flatnonzero(there), r)
            np.maximum.at(out["on_left"], np.flatnonzero(there), e)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part = context.partitionId() if context is not None else 0
        held: pa.Table | None = None  # the last row of the document before the last one, then the last one's rows
        settled, seq = 0, 0  # rows of held that are settled already

        def shown(t: pa.Table, first: int, last: int, begin: np.ndarray, end: np.ndarray, edge: np.ndarray) -> pa.RecordBatch:
            nonlocal seq
            got = compared(t, begin, end, first, last)
            own = t.slice(first, last - first)
            only = pa.array(np.arange(last - first), mask=~edge[first:last])  # of rows that aren't at an edge nothing is shown
            seq += last - first
            columns = {c: own.column(c) for c in SUFFIX} | {c: pa.array(got[c].astype(np.int32)) for c in SHARED}
            columns["lead"] = pa.array(begin[first:last] == np.arange(first, last))
            if edges:
                columns |= {"part": pa.array(np.full(last - first, part, dtype=np.int32), mask=~edge[first:last]), "seq": pa.array(np.arange(seq - (last - first), seq))}
                columns |= {c: own.column(c).combine_chunks().take(only) for c in ("right", "left")}
            return pa.table(columns).combine_chunks().to_batches()

        def runs(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
            ids, alone = t.column("id").is_null().to_numpy(), t.column("t1").to_numpy()
            key = np.where(ids, alone, t.column("id").fill_null(0).to_numpy())
            new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])]))
            n = np.diff(np.append(new, t.num_rows))
            return np.repeat(new, n), np.repeat(new + n, n)

        first_run = True
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            begin, end = runs(t)
            last = int(begin[-1])  # rows of the last document wait for what follows
            if last > settled:
                edge = (begin == 0) & first_run & (settled == 0)
                yield from shown(t, settled, last, begin, end, edge)
                first_run = False
            keep = max(0, last - 1)
            settled = last - keep if last > 0 else 0
            held = t.slice(keep)
        if held is not None:
            begin, end = runs(held)
            yield from shown(held, settled, held.num_rows, begin, end, np.ones(held.num_rows, dtype=bool))

    return run


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    return rows.select("id", F.xxhash64(F.lit(1), "body").alias("t1"), F.xxhash64(F.lit(2), "body").alias("t2"), "body")


def _in_two_documents():
    """Whether rows are of two documents at least: ids, or texts without one."""
    alone = F.when(F.col("id").isNull(), F.col("t1"))
    return (F.min("id") < F.max("id")) | (F.min(alone) < F.max(alone)) | ((F.count("id") > 0) & (F.count(alone) > 0))


def repeated_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, k: int = K) -> DataFrame:
    """(doc_id, start_word, end_word, n_words, t1, t2): each document's maximal passages all of whose stretches of
    ``length`` words are in other documents too; ends are exclusive, t1 and t2 are hashes of the text.

    Words are as written, blanks between them don't matter. A document is an id: its rows don't repeat each other's
    passages, and rows that repeat both id and text count once. A text with a null id is a document of its own, and two rows of it
    are two. Null, empty and short texts (fewer than ``length`` words) have no passages, nor has a passage that repeats in one document
    only. Texts are compared whole, however long. Empty tables give no rows; columns beside the two named aren't read, whatever their names.

    Suffixes meet by their first ``k`` words. Those of the few runs of ``k`` words that many documents share are dealt to range partitions
    by all their words, so a passage that a third of all documents hold is spread over partitions; neighbours across borders
    are compared from the first and last documents of each. No task holds a group: sorted suffixes stream by, and only
    one document's wait for their next neighbour.
    """
    body = _documents(docs, id_col, text_col)
    keys, keys_path = cut(body.mapInArrow(_keys(length, k), "id long, t1 long, t2 long, key long"), keep_path=True)
    shared = cut(keys.groupBy("key").agg(_in_two_documents().alias("two"), F.count("*").alias("held")).where("two").drop("two"))
    of_doc = meet(keys, shared, ["key"]).groupBy(*DOC).agg(F.collect_set("key").alias("keys"))
    texts = body.dropDuplicates(DOC)
    same = (texts["id"].eqNullSafe(of_doc["id"])) & (texts["t1"] == of_doc["t1"]) & (texts["t2"] == of_doc["t2"])
    suffixes = cut(texts.join(of_doc, same).select(texts["id"], texts["t1"], texts["t2"], "body", "keys").mapInArrow(_suffixes(length, k), f"{_SUFFIX}, right binary, left binary"))
    remove(docs.sparkSession, keys_path)

    longest = length - k
    found = []
    hot = F.broadcast(hot_keys(shared).select("key"))
    for side, order in (("right", ["key", "right", "left"]), ("left", ["key", "left", "right"])):
        whole = suffixes.join(hot, "key", "left_anti").repartition("key").sortWithinPartitions(*order, *DOC, "cls")
        split = suffixes.join(hot, "key", "left_semi").repartitionByRange(*order, *DOC).sortWithinPartitions(*order, *DOC, "cls")
        with setting(docs.sparkSession, "spark.sql.execution.rangeExchange.sampleSizePerPartition", SAMPLE):  # of rows of some 500 bytes
            got = cut(split.select(*SUFFIX, "right", "left").mapInArrow(_neighbours(length, longest, True), f"{_RESULT}, {_EDGE}"))
        borders = got.where("part is not null").select(*SUFFIX, "right", "left", "part", "seq")
        across = borders.repartition(1).sortWithinPartitions("part", "seq").mapInArrow(_neighbours(length, longest, False), _RESULT)
        inner = whole.select(*SUFFIX, "right", "left").mapInArrow(_neighbours(length, longest, False), _RESULT)
        found += [f.withColumn("side", F.lit(side)) for f in (inner, got.drop("part", "seq", "right", "left"), across)]
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    span = lambda i: F.struct(F.col(f"lo{i}").alias("lo"), F.col(f"hi{i}").alias("hi"))
    spans = lambda found: F.array_distinct(F.flatten(F.collect_list(F.filter(found, lambda s: s["lo"] <= s["hi"]))))
    before = lambda side: spans(F.when(F.col("lead") & (F.col("side") == side), F.array(span(1)))).alias(f"before_{side}")
    settled = cut(
        every.groupBy(*DOC, "cls", "low", "high", "key")
        .agg(F.first("pos").alias("pos"), spans(F.array(span(1), span(2))).alias("spans"), before("right"), before("left"), F.max("on_right").alias("on_right"), F.max("on_left").alias("on_left"))
    )
    inside = lambda l, found: F.exists(found, lambda s: (s["lo"] <= l) & (l <= s["hi"]))
    least, most = F.greatest("low", F.lit(length) - F.col("on_right")), F.least("high", "on_left")
    unsure = F.filter(F.when(least <= most, F.sequence(least, most)).otherwise(F.array().cast("array<int>")), lambda l: ~inside(l, "spans"))
    begins = settled.select(*DOC, F.explode("spans").alias("s"), "pos").select(*DOC, "s", F.explode("pos").alias("p")).select(*DOC, (F.col("p") - F.col("s.hi")).alias("a"), (F.col("p") - F.col("s.lo")).alias("b"))

    wanted = cut(settled.select("key", F.explode(unsure).alias("l")).distinct())
    if not wanted.isEmpty():
        held = cut(wanted.groupBy("key").agg(F.array_sort(F.collect_set("l")).alias("ls")).join(shared, "key"))
        # Of stretches that are alike, those with a neighbour before, in the order by the side on which they have more words, needn't be looked up:
        # the first of those that neighbours have settled has none, and it stands for all of them.
        linked = lambda l: F.when(2 * l < length, inside(l, "before_right")).otherwise(inside(l, "before_left"))
        first = F.filter("ls", lambda l: inside(l, "spans") & ~linked(l))
        looked = meet(settled, held, ["key"]).select(*DOC, "cls", "pos", unsure.alias("unsure"), first.alias("first")).where((F.size("unsure") > 0) | (F.size("first") > 0)).alias("x")
        sides = meet(suffixes, held, ["key"]).select(*DOC, "cls", "key", "right", "left").alias("y")
        same = F.col("x.id").eqNullSafe(F.col("y.id")) & (F.col("x.t1") == F.col("y.t1")) & (F.col("x.t2") == F.col("y.t2")) & (F.col("x.cls") == F.col("y.cls"))
        asked = lambda c, ask: F.transform(c, lambda l: F.struct(l.alias("l"), F.lit(ask).alias("ask")))
        around = looked.join(sides, same).select(*(f"x.{c}" for c in DOC), "pos", "key", "right", "left", F.inline(F.concat(asked("unsure", True), asked("first", False))))
        words = F.substring(F.col("left"), F.lit(1), F.col("l") * BYTES), F.substring(F.col("right"), F.lit(1), (F.lit(length) - F.col("l")) * BYTES)
        prints = cut(around.select(*DOC, F.when(F.col("ask"), F.col("pos")).alias("pos"), "l", "ask", "key", F.xxhash64(F.lit(1), *words).alias("f1"), F.xxhash64(F.lit(2), *words).alias("f2")))
        twins = cut(prints.groupBy("key", "l", "f1", "f2").agg((_in_two_documents() | F.bool_or(~F.col("ask"))).alias("two"), F.count_if("ask").alias("held")).where("two and held > 0").drop("two"))
        more = meet(prints.where("ask"), twins, ["key", "l", "f1", "f2"])
        begins = begins.union(more.select(*DOC, "l", F.explode("pos").alias("p")).select(*DOC, (F.col("p") - F.col("l")).alias("a"), (F.col("p") - F.col("l")).alias("b")))
    alone = body.where("id is null").groupBy("t1", "t2").agg(F.count("*").alias("n"), F.first(F.regexp_count("body", F.lit(WORD))).alias("words")).where((F.col("n") > 1) & (F.col("words") >= length))
    begins = begins.union(alone.select(F.lit(None).cast("long"), "t1", "t2", F.lit(0), F.col("words") - length))

    by = Window.partitionBy(*DOC).orderBy("a", "b")
    reach = F.max("b").over(by.rowsBetween(Window.unboundedPreceding, -1))
    runs = begins.withColumn("new", F.when(reach.isNull() | (F.col("a") > reach + length), 1).otherwise(0)).withColumn("nth", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    passages = runs.groupBy(*DOC, "nth").agg(F.min("a").cast("long").alias("start_word"), (F.max("b") + length).cast("long").alias("end_word"))
    return passages.select(F.col("id").alias("doc_id"), "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "t1", "t2")


def with_characters(docs: DataFrame, passages: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``passages`` of ``docs`` with start_char and end_char, in code points of the text, and the passage's text."""
    own = passages.groupBy(F.col("doc_id").alias("pid"), F.col("t1").alias("p1"), F.col("t2").alias("p2")).agg(F.collect_list(F.struct("start_word", "end_word")).alias("spans"))
    texts = _documents(docs, id_col, text_col).dropDuplicates(DOC)
    both = texts.join(own, texts["id"].eqNullSafe(F.col("pid")) & (F.col("t1") == F.col("p1")) & (F.col("t2") == F.col("p2"))).select(*DOC, "body", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            per = b.column(4).value_lengths().to_numpy()
            flat, first = b.column(4).flatten(), np.concatenate([[0], np.cumsum(per)])
            begin, end = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            for a, z, data, offsets in T.spans(b.column(3)):
                w = T.words(data, offsets, hashed=False)
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                doc, on = np.repeat(np.arange(z - a), per[a:z]), slice(first[a], first[z])
                x, y = w.start[w.first[doc] + begin[on]], w.end[w.first[doc] + end[on] - 1]
                base, own = chars[offsets[doc]], pa.array(doc + a)
                yield pa.RecordBatch.from_arrays([*(b.column(i).take(own) for i in range(3)), pa.array(begin[on]), pa.array(end[on]), pa.array(chars[x] - base), pa.array(chars[y] - base), pa.array([bytes(data[i:j]).decode() for i, j in zip(x, y, strict=True)], pa.string())], [*DOC, "start_word", "end_word", "start_char", "end_char", "passage"])

    return both.mapInArrow(run, "id long, t1 long, t2 long, start_word long, end_word long, start_char long, end_char long, passage string").withColumnRenamed("id", "doc_id")


def op4_query(spark, sf_dir):
    return repeated_passages(load(spark, sf_dir, "documents")).select("doc_id", "start_word", "end_word", "n_words")


OP4_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), p AS (
  SELECT doc_id, ws, unnest(range(greatest(0, len(ws) - 49))) AS i FROM w
), h AS (
  SELECT doc_id, i, md5(array_to_string(ws[i + 1 : i + 50], ' ')) AS f FROM p
), r AS (
  SELECT f FROM h GROUP BY f HAVING count(DISTINCT doc_id) > 1
), m AS (
  SELECT doc_id, i, CASE WHEN i > lag(i) OVER o + 50 OR lag(i) OVER o IS NULL THEN 1 ELSE 0 END AS fresh
  FROM h SEMI JOIN r USING (f) WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), g AS (
  SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM m
)
SELECT doc_id, min(i) AS start_word, max(i) + 50 AS end_word, max(i) + 50 - min(i) AS n_words FROM g GROUP BY doc_id, n
"""
