"""A group of near copies of a text that is not there itself, most pairs of which fall short of the threshold."""

import numpy as np
import pytest
from test_ops import docs, prose

from matchstats.llm import near_dedup


def group(n, words, edits, seed):
    rng, base, out = np.random.default_rng(seed), prose(seed, words).split(), []
    for _ in range(n):
        w = list(base)
        for i in rng.choice(words, edits, replace=False):
            w[i] = f"edit{rng.integers(0, 400)}"
        out.append(" ".join(w))
    return out


def components_of(texts, size):
    """Smallest reachable index of each text, by the overlaps of all pairs."""
    sets = [{" ".join(w[i : i + size]) for i in range(len(w) - size + 1)} for w in (t.split() for t in texts)]
    names = {x: k for k, x in enumerate(set().union(*sets))}
    m = np.zeros((len(texts), len(names)), dtype=np.float32)
    for k, s in enumerate(sets):
        m[k, [names[x] for x in s]] = 1
    n, both = m.sum(1), m @ m.T
    linked = 100 * both >= 80 * (n[:, None] + n[None, :] - both)
    low = np.arange(len(texts))
    while True:
        new = np.array([low[row].min() for row in linked])
        if (new == low).all():
            return low.tolist(), int(np.triu(linked, 1).sum())
        low = new


def written_pairs(monkeypatch):
    """Rows of each table of candidate pairs that is written from now on."""
    found, write = [], near_dedup.materialise

    def counting(df, name):
        out = write(df, name)
        if name in ("pairs", "place-pairs"):
            found.append(out.count())
        return out

    monkeypatch.setattr(near_dedup, "materialise", counting)
    return found


@pytest.mark.parametrize("size,words,sizes", [(2, 118, (300, 1200)), (5, 300, (600,))])
def test_candidates_grow_with_the_group(spark, monkeypatch, size, words, sizes):
    pairs, each = written_pairs(monkeypatch), []
    for n in sizes:
        texts = group(n, words, 5, 11)
        low, links = components_of(texts, size)
        assert 0 < links < n  # dense, yet hardly any link
        got = near_dedup.near_duplicates(docs(spark, texts), size=size).collect()
        assert [c for _, c in sorted((r.doc_id, r.component_id) for r in got)] == low
        each.append(sum(pairs) / n)
        pairs.clear()
    assert max(each) <= 40


def test_group_of_links_and_strays(spark, monkeypatch):
    """Copies with few edits are one group by the majority set alone; those with many are tested one by one."""
    pairs = written_pairs(monkeypatch)
    texts = group(300, 118, 2, 12) + group(100, 118, 6, 12) + [prose(k, 118) for k in range(30)]
    low, _ = components_of(texts, 2)
    got = near_dedup.near_duplicates(docs(spark, texts), size=2).collect()
    assert [c for _, c in sorted((r.doc_id, r.component_id) for r in got)] == low
    assert sum(pairs) <= 40 * len(texts)


def test_differences_are_counted_without_exploding_them(spark, monkeypatch):
    """How often an element is in a difference follows from the counts of the sets; the order of elements stays the one by these counts."""
    plans, often, write = [], [], near_dedup.materialise

    def looking(df, name):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        out = write(df, name)
        if name in ("able-members", "often-shingles"):
            often.append(out)
        return out

    monkeypatch.setattr(near_dedup, "materialise", looking)
    texts = group(300, 118, 5, 13)
    low, _ = components_of(texts, 2)
    got = near_dedup.near_duplicates(docs(spark, texts), size=2).collect()
    assert [c for _, c in sorted((r.doc_id, r.component_id) for r in got)] == low
    assert not [p for p in plans if "Generate explode(delta" in p]
    _, able, found = often
    able, found = able.collect(), {r.place: r.often for r in found.collect()}
    for place in {r.place for r in able}:
        own = [r.delta for r in able if r.place == place]
        df = {u: sum(u in d for d in map(set, own)) for u in set().union(*own)}
        every = {u for u, n in df.items() if n > 1 and near_dedup.OFTEN * n > len(own)}
        assert every <= set(found[place]) and len(found[place]) <= near_dedup.OFTEN * sum(map(len, own))
