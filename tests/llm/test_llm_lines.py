"""Line deduplication against plain Python."""

import hashlib
import random
from collections import defaultdict

import pytest

from geoloom.llm import line_dedup
from geoloom.llm.line_dedup import deduplicated

LONG = "A line of boilerplate that very many pages show."
SCHEMA = "doc_id long, text string, drop string, keeper long, lines string, digest string"


def plain(rows, min_chars=40, min_docs=5):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    texts = [(i, (t or "").split("\n")) for i, t in rows]
    holders = defaultdict(list)
    for i, lines in texts:
        for k in {key(x) for x in lines}:
            holders[k].append(i)
    keeper = {k: max((i for i in ids if i is not None), default=None) for k, ids in holders.items() if len(k) >= min_chars and len(ids) >= min_docs}
    out = []
    for i, lines in texts:
        kept = [x for x in lines if key(x) not in keeper or keeper[key(x)] == i]
        out.append((str(i), len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def some_rows():
    draw = random.Random(9)
    pool = [LONG, LONG.upper(), f" \t{LONG}\r", "short line", "", "x" * 39, "y" * 40, "é" * 40, "É" * 40, "　" + "z" * 40, "z" * 40, " ", "İ" * 45]
    rows = [(i, "\n".join(draw.choices(pool + [f"a line of its own, number {i}, nothing else is like it"], k=draw.randrange(1, 9)))) for i in range(60)]
    return rows + [(100, None), (101, ""), (102, "\n"), (None, LONG), (None, LONG), (None, "\n".join([LONG] * 3)), (7, LONG + "\nagain"), (7, LONG + "\nagain"),
                   (90, "\n".join([LONG, "own"] * 3000)), (91, "\n".join(["y" * 40] * 2000 + ["x"])), (200, f"{LONG}\n{LONG}\nlast"), (200, LONG)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "d", 1, "l", None) for i, t in some_rows()], SCHEMA).repartition(5)


def found(df):
    return sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.text) for r in df.collect())


@pytest.mark.parametrize("bound", [500_000, 0])
def test_lines_equal_plain(docs, monkeypatch, bound):
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", bound)
    assert found(deduplicated(docs)) == plain(some_rows())
    assert found(deduplicated(docs, 1, 2)) == plain(some_rows(), 1, 2)


def test_null_ids_alone(spark):
    rows = [(None, LONG), (None, f"{LONG}\nb"), (None, LONG)]
    df = spark.createDataFrame([(i, t, "d", 1, "l", None) for i, t in rows], SCHEMA)
    assert found(deduplicated(df, 40, 2)) == plain(rows, 40, 2)


def test_no_rows(spark):
    assert deduplicated(spark.createDataFrame([], SCHEMA)).count() == 0


def test_text_without_drops_is_untouched(docs):
    texts = {hashlib.sha256(r.text.encode()).hexdigest() for r in deduplicated(docs).filter("n_dropped = 0").collect()}
    assert texts <= {hashlib.sha256((t or "").encode()).hexdigest() for _, t in some_rows()}


def test_no_python_in_the_plan(docs):
    plan = deduplicated(docs)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))
