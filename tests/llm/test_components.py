"""The distributed components, which small inputs don't reach by themselves."""

import random

import pytest

from palimpsest.llm import common, nearjaccard, simhash
from palimpsest.llm.common import Scratch, connected_components


def smallest_reachable(links):
    top = {n: n for link in links for n in link}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        low, high = sorted((root(a), root(b)))
        top[high] = low
    return {n: root(n) for n in top}


@pytest.mark.parametrize("few", [-1, 500_000])
def test_components_of_a_random_graph(spark, monkeypatch, few):
    monkeypatch.setattr(common, "FEW_LINKS", few)
    rng = random.Random(8)
    links = [(rng.randrange(120), rng.randrange(120)) for _ in range(60)] + [(k, k + 1) for k in range(200, 260)] + [(300, k) for k in range(301, 340)] + [(5, 5)]
    frame = spark.createDataFrame(links, "u long, v long")
    got = {r["node"]: r["component"] for r in connected_components(frame, Scratch(spark, "components")).collect()}
    assert got == smallest_reachable(links)


def test_near_duplicates_by_distributed_components(spark, monkeypatch):
    rng = random.Random(5)
    texts = []
    for _ in range(15):
        words = [f"w{rng.randrange(300)}" for _ in range(80)]
        for _ in range(rng.randrange(1, 6)):
            texts.append((len(texts), " ".join(words)))
            words = list(words)
            words[rng.randrange(80)] = "edited"
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    rows = lambda: sorted(tuple(r) for r in simhash.near_duplicates(docs).collect())
    kept = lambda: sorted(r["doc_id"] for r in nearjaccard.deduplicate_similar(docs).collect())
    together = rows(), kept()
    monkeypatch.setattr(common, "FEW_LINKS", -1)
    assert (rows(), kept()) == together
