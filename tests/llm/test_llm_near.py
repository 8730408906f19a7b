"""Large groups of near copies."""

import random

from geoloom.llm.jaccard import jaccard_groups


def test_near_copies_with_poor_first_rows_cost_few_pairs(spark, tmp_path):
    """Rows with most edits come first, so no first row joins the group and several large components are left; their rows may not all meet."""
    words = random.Random(5)
    base = [f"w{k}" for k in range(150)]
    texts = []
    for k in range(600):
        own = list(base)
        for at in words.sample(range(150), 3 - k // 200):
            own[at] = f"x{words.randrange(10 ** 9)}"
        texts.append(" ".join(own))
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_groups(docs, folder=str(tmp_path / "jaccard")).collect()}
    sets = [{tuple(t.split()[i:i + 4]) for i in range(147)} for t in texts]
    least = list(range(len(sets)))

    def root(k):
        while least[k] != k:
            k = least[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                least[max(x, y)] = min(x, y)
    assert got == {k: root(k) for k in range(len(sets))}
    assert spark.read.parquet(str(tmp_path / "jaccard" / "pairs")).count() <= 15 * len(texts)
