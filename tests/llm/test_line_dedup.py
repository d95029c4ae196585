import hashlib
from collections import defaultdict

from quillspark.llm import _common
from quillspark.llm.line_dedup import drop_common_lines, op7_query

LONG = "This line has at least forty code points, it does."


def expected(rows):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({i: i + 32 for i in range(65, 91)})
    held = defaultdict(set)
    for i, t, _ in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40 and i is not None:
                held[key(line)].add(i)
    out = []
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(held.get(key(x), ())) >= 5 and i != max(held[key(x)]))]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_against_plain_python(spark, documents, write):
    from conftest import EDGES  # noqa: F401  (the folder's own)

    rows = EDGES[:6] + [(10 + i, f"own {i}\n  {LONG.upper() if i % 2 else LONG}\t\nend\n" + LONG * (i == 3), "a") for i in range(7)] + [(30, None, "a"), (None, LONG, "b")]
    got = op7_query(spark, write(documents=documents(rows))).collect()
    assert sorted(map(tuple, got), key=str) == expected(rows)


def test_repeated_ids_and_empty_table(spark, documents):
    rows = [(1, LONG, "a")] * 6
    assert all(r.n_dropped == 0 for r in drop_common_lines(documents(rows)).collect())
    assert drop_common_lines(documents([]).where("false")).count() == 0


def test_threshold_counts_documents(spark, documents):
    rows = [(i, LONG, "a") for i in range(4)]
    assert all(r.n_dropped == 0 for r in drop_common_lines(documents(rows)).collect())
    rows.append((9, LONG, "a"))
    got = {r.id: r.kept_text for r in drop_common_lines(documents(rows)).collect()}
    assert got == {0: "", 1: "", 2: "", 3: "", 9: LONG}


def test_lines_of_hot_keys_and_of_others(spark, documents, write, monkeypatch):
    monkeypatch.setattr(_common, "HOT_ROWS", 20)
    rows = [(i, f"{LONG} hot\n{LONG} {i % 9}\nown {i}\n{LONG} hot", "a") for i in range(60)] + [(None, f"{LONG} hot\n{LONG} 3", "b")] * 2
    got = op7_query(spark, write(documents=documents(rows))).collect()
    assert sorted(map(tuple, got), key=str) == expected(rows)
