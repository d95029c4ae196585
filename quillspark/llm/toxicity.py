"""Toxicity by a lexicon trie met by Levenshtein automata, with scores from the window around each hit."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm._common import crc_mod, cut, load
from quillspark.llm.near_dedup import near_duplicates

#: Labelled training rows that terms and their weights are learnt from, at most, of each label: those of least hash.
SAMPLE_ROWS = 8_000
#: Bytes of lexicon and harmless words that are shipped to tasks; more is an error.
MAX_SHIPPED = 256 << 20
#: Words that a task remembers as harmless before it starts anew.
SEEN_WORDS = 400_000
WINDOW = 6

# Fixed word lists: common insults that the lexicon starts from; words and marks around a term that report or quote it; words that
# address someone.
SEEDS = "idiot moron stupid loser pathetic worthless trash scum clown disgusting imbecile dumbass bastard bitch asshole retard cretin".split()
REPORTING = frozenset("said says wrote writes quote quoted quoting called word term slur insult dit disait mot cité sagte schrieb wort zitat dijo escribió palabra".split())
ADDRESS = frozenset("you your you're youre u ur du dich dein tu te toi vous votre eres usted tú".split())
QUOTES = "\"“”„«»‘’'`"
EDGE = ".,;:!?()[]{}<>…-–—*_~#|" + QUOTES

EXACT, STEM, NEAR = 0, 1, 2


def edits_allowed(length: int) -> int:
    return 0 if length < 5 else 1 if length < 9 else 2


class Lexicon:
    """A trie of words and stems, intersected with the Levenshtein automaton of any input word.

    A state is the set of (trie node, edits so far); states and their moves are found when first needed and kept, so
    that together they are a deterministic automaton. A word of the lexicon is met within ``edits_allowed`` edits, a
    stem as the exact beginning of an input word.
    """

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.weight = {EXACT: words, STEM: stems}
        self.next: list[dict[str, int]] = [{}]
        self.word: list[str | None] = [None]
        self.stem: list[str | None] = [None]
        self.reach = [0]
        for term in words:
            node, reach = 0, edits_allowed(len(term))
            self.reach[0] = max(self.reach[0], reach)
            for ch in term:
                node = self._child(node, ch)
                self.reach[node] = max(self.reach[node], reach)
            self.word[node] = term
        for term in stems:
            node = 0
            for ch in term:
                node = self._child(node, ch)
            self.stem[node] = term
        self.states: list[dict[int, int]] = []
        self.moves: list[dict[str, int]] = []
        self.found: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self._state({})
        self.start = self._state(self._close({0: 0}))

    def _child(self, node: int, ch: str) -> int:
        if ch not in self.next[node]:
            self.next[node][ch] = len(self.next)
            self.next.append({})
            self.word.append(None)
            self.stem.append(None)
            self.reach.append(0)
        return self.next[node][ch]

    def _close(self, state: dict[int, int]) -> dict[int, int]:
        """With letters of the lexicon left out by the input."""
        todo = list(state.items())
        while todo:
            node, e = todo.pop()
            for child in self.next[node].values():
                if e + 1 <= self.reach[child] and state.get(child, 99) > e + 1:
                    state[child] = e + 1
                    todo.append((child, e + 1))
        return state

    def _state(self, state: dict[int, int]) -> int:
        key = tuple(sorted(state.items()))
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(state)
            self.moves.append({})
            ends = sorted((e, self.word[n]) for n, e in state.items() if self.word[n] and e <= edits_allowed(len(self.word[n])))
            stems = sorted(self.stem[n] for n, e in state.items() if e == 0 and self.stem[n])
            self.found.append((ends[0] if ends else None, stems[0] if stems else None))
        return self.number[key]

    def _move(self, at: int, ch: str) -> int:
        new: dict[int, int] = {}
        for node, e in self.states[at].items():
            for c, child in self.next[node].items():
                cost = e + (c != ch)
                if (cost == 0 or cost <= self.reach[child]) and new.get(child, 99) > cost:
                    new[child] = cost
            if e + 1 <= self.reach[node] and new.get(node, 99) > e + 1:
                new[node] = e + 1
        return self._state(self._close(new))

    def match(self, word: str) -> tuple[str, int] | None:
        """(term, kind) for the best term met, if any."""
        at, stem = self.start, None
        for ch in word:
            to = self.moves[at].get(ch)
            if to is None:
                if len(self.states) > 200_000:
                    self._restart()
                    return self.match(word)
                to = self.moves[at][ch] = self._move(at, ch)
            at = to
            stem = stem or self.found[at][1]
            if at == 0:
                break
        end = self.found[at][0]
        if end and end[0] == 0:
            return end[1], EXACT
        if stem:
            return stem, STEM
        return (end[1], NEAR) if end else None

    def _restart(self) -> None:
        self.states, self.moves, self.found, self.number = [], [], [], {}
        self._state({})
        self.start = self._state(self._close({0: 0}))


@dataclass
class Scorer:
    """Documents to scores. near: share of a near hit's weight; quoted: share of a quoted one's; rest: score without hits."""

    words: dict[str, float]
    stems: dict[str, float]
    near: float = 0.5
    quoted: float = 0.35
    addressed: float = 1.15
    rest: float = 0.02
    harmless: frozenset = frozenset()  # words near a term that harmless texts use
    lexicon: Lexicon | None = field(default=None, repr=False)
    seen: set = field(default_factory=set, repr=False)
    hits: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("lexicon", "seen", "hits")} | {"lexicon": None, "seen": set(), "hits": {}}

    def terms(self, tokens: set[str]) -> set[str]:
        """Those of the tokens that meet a term."""
        if self.lexicon is None:
            self.lexicon = Lexicon(self.words, self.stems)
        for raw in tokens - self.seen - self.hits.keys():
            word = raw.strip(EDGE)
            got = None if word in self.harmless else self.lexicon.match(word)
            if got is None:
                self.seen.add(raw)
            else:
                self.hits[raw] = got
        out = tokens & self.hits.keys()
        if len(self.seen) > SEEN_WORDS:
            self.seen = set()
        if len(self.hits) > SEEN_WORDS:
            self.hits = {}
            return self.terms(tokens)
        return out

    def evidence(self, text: str) -> list[tuple[str, int, bool, bool]]:
        """(term, kind, quoted, addressed) for each hit in the text, which is lower case here."""
        tokens = text.split()
        hit = self.terms(set(tokens))
        if not hit:
            return []
        out, open_ = [], False
        for i, raw in enumerate(tokens):
            begins, ends = raw[0] in QUOTES, raw.rstrip(".,;:!?")[-1:] in QUOTES
            open_ = open_ or begins
            if raw in hit:
                near = {x.strip(EDGE) for x in tokens[max(0, i - WINDOW) : i + WINDOW + 1]}
                closes = any(x.rstrip(".,;:!?")[-1:] in QUOTES for x in tokens[i : i + WINDOW + 1])
                out.append((*self.hits[raw], (open_ and closes) or not near.isdisjoint(REPORTING), not near.isdisjoint(ADDRESS)))
            if ends:
                open_ = False
        return out

    def score(self, text: str) -> float:
        """One minus the chance that every hit is harmless; a term counts once for each kind of context."""
        left = 1 - self.rest
        for term, kind, quoted, addressed in set(self.evidence(text.lower())):
            p = self.stems[term] if kind == STEM else self.words[term]
            p *= (self.near if kind == NEAR else 1) * (self.quoted if quoted else 1) * (self.addressed if addressed and not quoted else 1)
            left *= 1 - min(p, 0.98)
        return 1 - left


def _features(text: str) -> set[str]:
    """Words of two letters or more (those under five are only met as they are), and with a * the beginnings of 4 to 7
    letters of longer words."""
    out = set()
    for raw in set(text.lower().split()):
        w = raw.strip(EDGE)
        if len(w) >= 2:
            out.add(w)
            out.update(w[:n] + "*" for n in range(4, min(8, len(w))))
    return out


def _gain(k: Column, other: Column, n_tox: int, n_non: int) -> Column:
    """Log likelihood ratio of a term's two rates against one common rate."""
    def part(hits: Column, n: int, rate: Column) -> Column:
        log = lambda x: F.log(F.greatest(x, F.lit(1e-300)))
        return hits * log(rate) + (F.lit(n) - hits) * log(1 - rate)

    both = (k + other) / (n_tox + n_non)
    return part(k, n_tox, k / n_tox) + part(other, n_non, other / n_non) - part(k, n_tox, both) - part(other, n_non, both)


def learn(sample: DataFrame, *, min_precision: float = 0.75, min_gain: float = 3.0, min_docs: int = 3) -> Scorer:
    """A scorer from (label, body), the bounded training sample."""
    n = {r.label: r.n for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n_tox, n_non = n.get(1, 0), n.get(0, 0)
    base = Scorer(dict.fromkeys(SEEDS, 0.8), {}, rest=min(0.25, (n_tox + 0.5) / (n_tox + n_non + 1) / 4))
    if not n_tox or not n_non:
        return base

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for label, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = list(_features(x or ""))
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array([label] * len(own), pa.int32())], ["term", "label"])

    one = lambda y: F.sum(F.when(F.col("label") == y, 1).otherwise(0))
    terms = cut(sample.select("label", "body").mapInArrow(features, "term string, label int").groupBy("term").agg(one(1).alias("k"), one(0).alias("other")).where(F.col("k") >= min_docs))
    needed = min_gain + math.log(1 + terms.count())  # the more terms are tried, the more a term has to show
    precision = (F.col("k") + 0.3) / (F.col("k") + 0.6 + F.col("other"))
    passed = terms.select("term", "k", precision.alias("precision"), _gain(F.col("k"), F.col("other"), n_tox, n_non).alias("gain")).where((F.col("precision") >= min_precision) & (F.col("gain") >= needed))
    gained = {r.term: (r.gain, r.precision, r.k) for r in passed.collect()}
    whole = {t: v for t, v in gained.items() if not t.endswith("*")}
    stems: dict[str, float] = {}
    for t in sorted((t for t in gained if t.endswith("*")), key=lambda t: (len(t), t)):
        s, k = t[:-1], gained[t][2]
        if any(s[:n] in stems for n in range(4, len(s))) or any(w.startswith(s) and v[2] >= 0.7 * k for w, v in whole.items()):
            continue
        stems[s] = gained[t][1]
    words = {w: v[1] for w, v in sorted(whole.items()) if not any(w[:n] in stems for n in range(4, len(w) + 1))}
    harmless = {r.term for r in sample.where("label = 0").select("label", "body").mapInArrow(features, "term string, label int").where(F.col("term").isin(SEEDS)).groupBy("term").count().where("count >= 2").collect()}
    scorer = Scorer({x: 0.8 for x in SEEDS if x not in harmless} | words, stems)
    return _weigh(sample, scorer)


def _counted(sample: DataFrame, of) -> Counter:
    """(key, label) to documents: ``of(text)`` gives each document's keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[tuple] = Counter()
        for b in batches:
            for label, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total.update((k, label) for k in of((x or "").lower()))
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in total], pa.string()), pa.array([y for _, y in total], pa.int32()), pa.array(list(total.values()), pa.int64())], ["key", "label", "n"])

    per = sample.select("label", "body").mapInArrow(run, "key string, label int, n long").groupBy("key", "label").agg(F.sum("n").alias("n"))
    return Counter({(r.key, r.label): r.n for r in per.collect()})


def _weigh(sample: DataFrame, scorer: Scorer) -> Scorer:
    """Words near a term that the sample's harmless texts use no longer meet it; other near hits, and documents without any
    hit, get the weight that the sample gives them."""
    near_words = lambda x: {w.strip(EDGE) for w in scorer.terms(set(x.split())) if scorer.hits[w][1] == NEAR}
    seen = _counted(sample, near_words)
    scorer.harmless = frozenset(w for w, y in seen if y == 0 and seen[w, 0] >= 2 and seen[w, 0] > seen[w, 1])
    scorer.seen, scorer.hits = set(), {}

    def kind(x: str) -> set[str]:
        found = {k for _, k, _, _ in scorer.evidence(x)}
        return {"none" if not found else "near" if found == {NEAR} else "sure"}

    got = _counted(sample, kind)
    share = lambda k, prior: (got[k, 1] + 4 * prior) / (got[k, 1] + got[k, 0] + 4)
    scorer.near = min(0.9, share("near", 0.6))
    scorer.rest = min(0.25, share("none", 0.02))
    return scorer


def score_documents(docs: DataFrame, labels: DataFrame, *, folds: int = 4, held_out: int = 2, threshold: float = 0.3, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row for each row of ``docs``.

    Terms and weights come from at most ``sample_rows`` rows of each label among those whose crc32(doc_id) modulo
    ``folds`` isn't ``held_out``: the rows with the least hash of doc_id. Of a class of near copies (as
    ``near_duplicates`` finds them in the sample) each label counts once: copies say no more than one of them. A score
    sees the text alone. Null text scores as the empty text, as a document without hits. Labels that are null or not
    0 or 1 are passed over. A null id is in no fold, so never held out. Without labels of both kinds a fixed list of
    insults is the lexicon; its words stay in the learnt one unless two harmless texts of the sample hold them. Empty
    tables give no rows; columns beside those named aren't read, whatever their names. Texts are read whole. What is
    learnt is selected by Spark and bounded by the sample; the lexicon that tasks get may have MAX_SHIPPED bytes, more raises.
    """
    given = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("body"))
    y = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("label")).where(F.col("label").isin(0, 1) & (crc_mod(F.col("id"), folds) != held_out))
    picked = [y.where(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(sample_rows) for k in (0, 1)]
    sample = cut(given.join(picked[0].union(picked[1]), "id").select(F.xxhash64("id", "body", "label").alias("row"), "label", "body"))
    classes = near_duplicates(sample, id_col="row", text_col="body").select(F.col("doc_id").alias("row"), "class_id").distinct()
    sample = cut(sample.join(classes, "row").groupBy("class_id", "label").agg(F.min(F.struct("row", "body")).alias("first")).select("label", F.col("first.body").alias("body")))
    scorer = learn(sample)
    if sum(100 + len(x) for kind in (scorer.words, scorer.stems, scorer.harmless) for x in kind) > MAX_SHIPPED:
        raise ValueError(f"the lexicon is over {MAX_SHIPPED} bytes; give a smaller sample_rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [scorer.score(x or "") for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return given.select("id", (crc_mod(F.col("id"), folds) == held_out).alias("out"), "body").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op5_query(spark, sf_dir):
    return score_documents(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
