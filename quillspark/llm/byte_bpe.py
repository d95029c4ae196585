"""Byte-level BPE by recursive SQL: DuckDB contracts token pairs in each partition and decodes by ordered aggregation."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm._common import lean, load

#: Distinct words that a Python worker keeps encoded; beyond, it starts anew.
CACHE_WORDS = 1_000_000
#: Characters of text that a task splits at a time; a longer document goes alone.
SLICE_CHARS = 8_000_000
#: Rows that it encodes at a time.
SLICE_ROWS = 1_800
#: Words that one run of the recursive query encodes.
QUERY_WORDS = 100_000

# Rows: token t at position p of word w. Each round pairs every token with the next, looks the pairs up in the merge table
# and contracts pairs that have the word's least rank. A word without pairs is done; its tokens are decoded in order.

#: Only the leftmost pair of the least rank. Words are short here: word and position are one number, word * 64 + p.
ENCODE = """
WITH RECURSIVE s(wp, t, live) AS (
  SELECT w::BIGINT * 64 + p, t, true FROM words
  UNION ALL
  SELECT wp, t, live FROM (
    WITH pairs AS MATERIALIZED (
      SELECT n.wp, n.t, n.np, m.k
      FROM (SELECT wp, t, lead(t) OVER o AS nt, lead(wp) OVER o AS np FROM s WHERE live WINDOW o AS (ORDER BY wp)) n
      LEFT JOIN merges m ON m.lr = CASE WHEN n.np >> 6 = n.wp >> 6 THEN n.t::BIGINT * 16777216 + n.nt END
    ), least AS (
      SELECT wp >> 6 AS w, min(k::BIGINT * 4096 + (wp & 63) * 64 + (np & 63)) AS b FROM pairs WHERE k IS NOT NULL GROUP BY wp >> 6
    )
    SELECT x.wp, CASE WHEN x.wp & 63 = (l.b >> 6) & 63 THEN x.k ELSE x.t END AS t, l.b IS NOT NULL AS live, coalesce(x.wp & 63 = l.b & 63, false) AS gone
    FROM pairs x LEFT JOIN least l ON l.w = x.wp >> 6
  ) WHERE NOT gone
)
SELECT (s.wp >> 6)::INTEGER AS w, list(s.t ORDER BY s.wp) AS ids, string_agg(v.hex, '' ORDER BY s.wp) AS hex
FROM s JOIN vocabulary v ON v.t = s.t WHERE NOT live GROUP BY s.wp >> 6
"""
#: The leftmost, and every further one that doesn't overlap one taken: of a run of touching pairs every second. This
#: is the same as taking them one by one, since what a contraction makes ranks above it; long words need fewer rounds.
ENCODE_LONG = """
WITH RECURSIVE s(w, p, t, live) AS (
  SELECT w, p, t, true FROM words
  UNION ALL
  SELECT w, p, t, live FROM (
    WITH pairs AS MATERIALIZED (
      SELECT n.w, n.p, n.t, n.np, n.i, m.k
      FROM (SELECT w, p, t, lead(t) OVER o AS nt, lead(p) OVER o AS np, row_number() OVER o AS i
            FROM s WHERE live WINDOW o AS (PARTITION BY w ORDER BY p)) n
      LEFT JOIN merges m ON m.lr = n.t::BIGINT * 16777216 + n.nt
    ), least AS (
      SELECT w, min(k) AS k FROM pairs WHERE k IS NOT NULL GROUP BY w
    ), hits AS (
      SELECT w, p, np, k, i, i - row_number() OVER (PARTITION BY w ORDER BY i) AS run FROM pairs SEMI JOIN least USING (w, k)
    ), taken AS (
      SELECT w, p, np, k FROM (SELECT *, min(i) OVER (PARTITION BY w, run) AS i0 FROM hits) WHERE (i - i0) % 2 = 0
    )
    SELECT x.w, x.p, coalesce(h.k, x.t) AS t, l.w IS NOT NULL AS live, g.w IS NOT NULL AS gone
    FROM pairs x LEFT JOIN least l ON l.w = x.w
    LEFT JOIN taken h ON h.w = x.w AND h.p = x.p LEFT JOIN taken g ON g.w = x.w AND g.np = x.p
  ) WHERE NOT gone
)
SELECT s.w, list(s.t ORDER BY s.p) AS ids, string_agg(v.hex, '' ORDER BY s.p) AS hex
FROM s JOIN vocabulary v ON v.t = s.t WHERE NOT live GROUP BY s.w
"""
#: Bytes beyond which a word counts as long.
LONG = 48


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a line for each token, its bytes in base 64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def merge_table(ranks: dict[bytes, int]) -> pa.Table:
    """Every pair of tokens whose bytes together are a token, as left * 2**24 + right, with that token's rank."""
    rows = [(ranks[t[:i]] << 24 | ranks[t[i:]], k) for t, k in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    return pa.table({"lr": pa.array([r[0] for r in rows], pa.int64()), "k": pa.array([r[1] for r in rows], pa.int32())})


class Coder:
    """Encodes the distinct words of one task at a time."""

    def __init__(self, ranks: dict[bytes, int], merges: pa.Table, pattern: str, cache_words: int = CACHE_WORDS):
        import duckdb
        import regex

        self.ranks, self.limit = ranks, cache_words
        self.split = regex.compile(pattern).findall
        self.byte = np.array([ranks.get(bytes([i]), -1) for i in range(256)], dtype=np.int32)
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        vocabulary = pa.table({"t": pa.array(list(ranks.values()), pa.int32()), "hex": pa.array([t.hex() for t in ranks])})
        for name, table in (("merges", merges), ("vocabulary", vocabulary)):
            self.con.register("_given", table)
            self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM _given")
            self.con.unregister("_given")
        self.ids: dict[str, bytes] = {}
        by_id = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            by_id[rank] = token
        self.tokens = pa.array(by_id, pa.large_binary())

    def learn(self, words: set[str]) -> None:
        """Encode, by the recursive query, those of the words that aren't kept from before.

        The query also decodes what it encoded; a word that doesn't come back is an error of the vocabulary and raises.
        """
        missing = words - self.ids.keys()
        if len(self.ids) + len(missing) > self.limit:
            self.ids, missing = {}, words
        short, long = [x for x in missing if len(x) <= LONG // 4], [x for x in missing if len(x) > LONG // 4]
        raw = [x.encode() for x in long]
        short += [x for x, r in zip(long, raw, strict=True) if len(r) <= LONG]
        long = [x for x, r in zip(long, raw, strict=True) if len(r) > LONG]
        for query, own in ((ENCODE, short), (ENCODE_LONG, long)):
            for at in range(0, len(own), QUERY_WORDS):
                part = own[at : at + QUERY_WORDS]
                raw = [x.encode() for x in part]
                for x, given, (ids, decoded) in zip(part, raw, self._encode(raw, query), strict=True):
                    if decoded != given:
                        raise ValueError(f"{x!r} decodes to {decoded!r}; the vocabulary isn't whole")
                    self.ids[x] = ids

    def _encode(self, words: list[bytes], query: str) -> list[tuple[bytes, bytes]]:
        n = np.array([1 if x in self.ranks else len(x) for x in words])
        tokens = [np.array([self.ranks[x]], dtype=np.int32) if x in self.ranks else self.byte[np.frombuffer(x, dtype=np.uint8)] for x in words]
        p = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        t = np.concatenate(tokens)
        if (t < 0).any():
            raise ValueError(f"no token for byte {next(x[i] for x, i in zip(np.repeat(np.array(words, dtype=object), n)[t < 0], p[t < 0], strict=True))}")
        rows = pa.table({"w": pa.array(np.repeat(np.arange(len(words)), n), pa.int32()), "p": pa.array(p, pa.int32()), "t": pa.array(t)})
        self.con.register("words", rows)
        got = self.con.sql(query).to_arrow_table()
        self.con.unregister("words")
        out: list[tuple[bytes, bytes]] = [(b"", b"")] * len(words)
        ids = got.column("ids").combine_chunks()
        flat, first = ids.flatten().to_numpy().astype("<u4").tobytes(), np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy())]) * 4
        for i, (w, h) in enumerate(zip(got.column("w").to_pylist(), got.column("hex").to_pylist(), strict=True)):
            out[w] = flat[first[i] : first[i + 1]], bytes.fromhex(h)
        return out

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The bytes that each document's ids stand for, in the order of the ids."""
        flat = np.frombuffer(b"".join(ids), dtype="<i4")
        got = self.tokens.take(pa.array(flat, pa.int32()))
        raw = got.buffers()[2].to_pybytes() if len(flat) else b""
        ends = np.frombuffer(got.buffers()[1], dtype=np.int64)[np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids], dtype=np.int64)])] if len(flat) else np.zeros(len(ids) + 1, dtype=np.int64)
        return [raw[a:z] for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def run(self, texts: list[str]) -> tuple[list[bytes], list[bytes]]:
        ids, decoded, at = [], [], 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (end == at or chars + len(texts[end]) <= SLICE_CHARS):
                chars += len(texts[end])
                end += 1
            pieces = [self.split(x) for x in texts[at:end]]
            self.learn(set().union(*pieces))
            own = [b"".join(map(self.ids.__getitem__, x)) for x in pieces]
            ids += own
            decoded += self.decode(own)
            at = end
        return ids, decoded


#: The coder of this Python worker, kept from task to task.
_kept: dict[int, Coder] = {}


def encode(docs: DataFrame, rank_file: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, n_tokens, ids, decoded), a row for each row of ``docs``.

    ids: token ids as little-endian unsigned 32-bit integers. decoded: the bytes that those ids stand for. Each match
    of ``pattern`` is encoded by itself; a match that is a token keeps it whole. Null and empty texts have no tokens.
    Ids may be null or repeat, and empty tables give no rows; columns beside those named aren't read, whatever their names.
    Texts are taken whole, however long; a word costs its length times its distinct ranks. ``decoded`` is read from the
    document's ids; a vocabulary without a token for a byte that occurs, or that doesn't give a word back, raises.
    The driver reads the rank file and ships its tokens and pairs (under 10 MB for a vocabulary of 50,000).
    """
    ranks = read_ranks(rank_file)
    if len(ranks) > 1_000_000:
        raise ValueError(f"{rank_file} has {len(ranks)} tokens; tables of over 1,000,000 aren't shipped to tasks")
    merges = merge_table(ranks)
    given = docs.select(F.col(id_col).alias("id"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text_col).cast("string").alias("body"))
    kept = [f.dataType.simpleString() for f in given.schema.fields[:-1]]
    names = ["id", *[f"k{i}" for i in range(len(keep))]]
    shipped_id = hash((tuple(sorted(ranks.items())), pattern))
    shipped = docs.sparkSession.sparkContext.broadcast((ranks, merges, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _kept.get(shipped_id)
        for b in batches:
            if coder is None:
                _kept.clear()
                coder = _kept[shipped_id] = Coder(*shipped.value)
            for at in range(0, b.num_rows, SLICE_ROWS):
                part = b.slice(at, SLICE_ROWS)
                ids, decoded = coder.run([x or "" for x in part.column(part.num_columns - 1).to_pylist()])
                lean(end=True)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())], [*names, "n_tokens", "ids", "decoded"])

    schema = ", ".join(f"{n} {t}" for n, t in zip(names, kept, strict=True))
    out = given.mapInArrow(run, f"{schema}, n_tokens long, ids binary, decoded binary")
    return out.select(F.col("id").alias(id_col), *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "n_tokens", "ids", "decoded")


def op10_query(spark, sf_dir):
    import public_tokenizers

    out = encode(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
