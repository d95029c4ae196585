"""Choosing one path through a document's spans: arcs with audio guards, a beam, and what the choice is worth."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.grouped import map_groups


@dataclass(frozen=True)
class Policy:
    beam: int = 64
    context_weight: float = 1.0
    retention_bonus: float = 0.02
    span_regression: float = 0.20
    mean_regression: float = 0.10
    minimum_margin: float = 0.02
    independent_audio: bool = True
    provisional_on_generated: bool = True


def arcs_from_candidates(spans: DataFrame, posterior: DataFrame) -> DataFrame:
    """(doc, span, text, mass, candidates) of (doc, span, candidate_id, text): what the candidates say in each span, and the
    posterior (doc, candidate_id, p) of those that say it; ``value`` is 2 mass - 1 within its span."""
    rows = spans.join(posterior, ["doc", "candidate_id"]).groupBy("doc", "span", "text").agg(F.sum("p").alias("mass"), F.array_sort(F.collect_set("candidate_id")).alias("candidates"))
    return rows.withColumn("value", F.least(F.lit(1.0), F.greatest(F.lit(-1.0), 2 * F.col("mass") - 1)))


def decode(arcs: DataFrame, policy: Policy | None = None, *, context: DataFrame | None = None) -> DataFrame:
    """One row for each document: selected arcs, score, margin, status, reasons.

    ``arcs``: (doc, span, arc, retained, generated, independent, eligible, score, factor, audio). Retained arcs always stay;
    others must be eligible, generated ones independently heard, and none may lose more than ``span_regression`` of audio
    support against the retained one. Of the beam's paths those whose mean audio support is near the retained path's are
    kept, with the retained path itself. ``context`` (doc, path, value) adds a value to paths, named by their arcs joined by ``>``.
    """
    p = policy or Policy()
    rows = arcs.withColumn("_context", F.lit(None).cast("map<string,double>"))
    if context is not None:
        values = context.groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("path", "value"))).alias("_context"))
        rows = arcs.join(values, "doc", "left")

    def run(doc, own: list[dict]):
        spans: dict[int, list[dict]] = {}
        for a in sorted(own, key=lambda a: (a["span"], a["arc"])):
            spans.setdefault(a["span"], []).append(a)
        kept = {s: next(a for a in xs if a["retained"]) for s, xs in spans.items()}
        values = dict(own[0]["_context"] or ())
        worth = lambda a: a["score"] + (p.retention_bonus * a["factor"] if a["retained"] else 0.0)

        def admitted(a: dict, r: dict) -> bool:
            if a is r:
                return True
            if not a["eligible"] or (p.independent_audio and a["generated"] and not a["independent"]):
                return False
            return r["audio"] is None or (a["audio"] is not None and r["audio"] - a["audio"] <= p.span_regression)

        def heard(path: tuple) -> float:
            xs = [(a["factor"], a["audio"]) for a in path if a["audio"] is not None and a["factor"] > 0]
            return sum(f * v for f, v in xs) / sum(f for f, _ in xs) if xs else -1.0

        beam: list[tuple[float, tuple]] = [(0.0, ())]
        for s, xs in spans.items():
            grown = [(v + worth(a), (*path, a)) for v, path in beam for a in xs if admitted(a, kept[s])]
            beam = sorted(grown, key=lambda x: (-x[0], [a["arc"] for a in x[1]]))[: p.beam]
        first = tuple(kept.values())
        names = lambda path: tuple(a["arc"] for a in path)
        limit = heard(first) - p.mean_regression
        paths = {names(path): (v, path) for v, path in beam if heard(path) >= limit}
        paths.setdefault(names(first), (sum(worth(a) for a in first), first))
        ranked = sorted(((v + p.context_weight * values.get(">".join(n), 0.0), v, n, path) for n, (v, path) in paths.items()), key=lambda x: (-x[0], -x[1], x[2]))
        score, _, chosen, path = ranked[0]
        margin = score - ranked[1][0] if len(ranked) > 1 else 0.0
        generated = any(a["generated"] for a in path)
        reasons = [f"changed-span:{a['span']}" for a in path if not a["retained"]]
        low = len(ranked) > 1 and margin < p.minimum_margin
        reasons += ["low-global-margin"] * low + ["single-surviving-path"] * (len(ranked) == 1) + ["selected-generated-proposal"] * (generated and p.provisional_on_generated)
        yield doc, list(chosen), score, margin, "provisional" if low or (generated and p.provisional_on_generated) else "accepted", reasons

    columns = ["span", "arc", "retained", "generated", "independent", "eligible", "score", "factor", "audio", "_context"]
    return map_groups(rows, "doc", columns, run, "doc long, path array<string>, score double, margin double, status string, reasons array<string>")


def residual_mix(branches: DataFrame, *, most: int = 4, minimum: float = 0.05) -> DataFrame:
    """(group_id, candidate_id, score) of (group_id, branch, reliability, cost, candidate_id, score): the ``most`` reliable
    branches (ties: cheaper, then name), gated by reliability / (1 + cost)."""
    from pyspark.sql import Window

    heads = branches.where(F.col("reliability") >= minimum).select("group_id", "branch", "reliability", "cost").distinct()
    w = Window.partitionBy("group_id").orderBy(F.desc("reliability"), "cost", "branch")
    active = heads.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).withColumn("_g", F.col("reliability") / (1.0 + F.col("cost")))
    gates = active.select("group_id", "branch", (F.col("_g") / F.sum("_g").over(Window.partitionBy("group_id"))).alias("gate"))
    return branches.join(gates, ["group_id", "branch"]).groupBy("group_id", "candidate_id").agg(F.sum(F.col("gate") * F.col("score")).alias("score"))


@dataclass(frozen=True)
class DocumentPolicy:
    beam: int = 96
    consistency_weight: float = 0.65
    similarity_regression: float = 0.35
    minimum_overlap: int = 2
    change_penalty: float = 0.02
    generated_penalty: float = 0.08
    audio_regression: float = 0.10
    most_changed: int | None = None
    most_generated: int = 2
    minimum_margin: float = 0.02


def overlap_similarity(left: list[dict], right: list[dict], start: int, end: int, minimum: int) -> float | None:
    """Ratio of matching characters of what two windows say in [start, end), on lenient keys; nothing if either says too little.

    ``left`` and ``right`` are timed units (start, end, text).
    """
    import difflib

    from quillspark.functions.kernels import lenient_key

    said = [lenient_key("".join(u["text"] for u in units if u["start"] < end and u["end"] > start)) for units in (left, right)]
    return difflib.SequenceMatcher(None, *said, autojunk=False).ratio() if min(map(len, said)) >= minimum else None


def decode_document(options: DataFrame, policy: DocumentPolicy | None = None) -> DataFrame:
    """One row for each document: an option for each window, by a beam over windows in order.

    ``options``: (doc, window, option, retained, changed, generated, start, end, delta, audio, units). An option adds its
    share of the covered time times ``delta``, and for every earlier window that it overlaps how much more alike the two
    are there than the retained ones were, by share of all overlap. A path with an overlap that is much less alike, or with too many
    changed or generated windows, is dropped. At the end the retained path competes too, and paths that lose audio
    support against it don't.
    """
    p = policy or DocumentPolicy()

    def run(doc, rows: list[dict]):
        windows: dict[int, list[dict]] = {}
        for r in sorted(rows, key=lambda r: (r["window"], r["option"])):
            windows.setdefault(r["window"], []).append(r)
        sets = list(windows.values())
        kept = [next(r for r in w if r["retained"]) for w in sets]
        covered = sum(k["end"] - k["start"] for k in kept) or 1
        shared = lambda a, b: (max(a["start"], b["start"]), min(a["end"], b["end"]))
        length = lambda x: max(0, x[1] - x[0])
        overlap = sum(length(shared(a, b)) for i, a in enumerate(kept) for b in kept[:i]) or 1
        alike = lambda a, b: overlap_similarity(a["units"], b["units"], *shared(a, b), p.minimum_overlap)
        before = {(i, j): alike(kept[j], kept[i]) for i in range(len(kept)) for j in range(i) if length(shared(kept[j], kept[i]))}

        def grown(score: float, path: tuple, i: int, o: dict) -> tuple | None:
            for j, q in enumerate(path):
                if (i, j) in before:
                    now, was = alike(q, o), before[i, j]
                    if now is not None and was is not None:
                        if was - now > p.similarity_regression:
                            return None
                        score += p.consistency_weight * length(shared(q, o)) / overlap * (now - was)
            path = (*path, o)
            changed, made = sum(x["changed"] for x in path), sum(x["generated"] for x in path)
            if made > p.most_generated or (p.most_changed is not None and changed > p.most_changed):
                return None
            score += (o["end"] - o["start"]) / covered * o["delta"] - p.change_penalty * o["changed"] - p.generated_penalty * o["generated"]
            return score, changed, made, path

        beam: list[tuple] = [(0.0, 0, 0, ())]
        for i, w in enumerate(sets):
            found = [g for s, _, _, path in beam for o in w if (g := grown(s, path, i, o))]
            beam = sorted(found, key=lambda g: (-g[0], g[1], g[2], [x["option"] for x in g[3]]))[: p.beam]
        first = (0.0, 0, 0, ())
        for i, k in enumerate(kept):
            first = grown(first[0], first[3], i, k) or (first[0], first[1], first[2], (*first[3], k))
        heard = lambda path: sum(x["audio"] * (x["end"] - x["start"]) for x in path) / (sum(x["end"] - x["start"] for x in path) or 1)
        paths = {tuple(x["option"] for x in g[3]): g for g in beam if heard(first[3]) - heard(g[3]) <= p.audio_regression}
        paths.setdefault(tuple(k["option"] for k in kept), first)
        ranked = sorted(paths.items(), key=lambda x: (-x[1][0], x[1][1], x[0]))
        names, (score, changed, made, _) = ranked[0]
        margin = score - ranked[1][1][0] if len(ranked) > 1 else 0.0
        low = len(ranked) > 1 and margin < p.minimum_margin
        yield doc, list(names), score, margin, changed, "provisional" if low or made else "accepted"

    columns = ["window", "option", "retained", "changed", "generated", "start", "end", "delta", "audio", "units"]
    return map_groups(options, "doc", columns, run, "doc long, path array<string>, score double, margin double, changed int, status string")
