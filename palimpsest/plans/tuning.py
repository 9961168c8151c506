"""Queries that search for fusion weights."""

from __future__ import annotations

from ..operators import channels
from ..operators.links import stored
from ..retrieval.weights import AIM, WeightSearch
from . import base
from .base import query, values
from .retrieval import GOLD_SQL, WHOLE

GRID = [(i, i / 10, (10 - i) / 10) for i in range(11)]


def search(spark, sf_dir) -> WeightSearch:
    """Over the whole rankings of the lexical and the dense channel."""
    whole = base.items(spark, sf_dir).count()
    gold = stored(base.gold(spark, sf_dir), "gold")  # its texts are read once
    lists = {"s": channels.ranked(base.sparse(spark, sf_dir)), "d": base.nearest(spark, sf_dir, whole)}
    return WeightSearch(lists, gold, whole)


@query(
    f"""
WITH {WHOLE}, {GOLD_SQL}, c AS (SELECT config, ws::DOUBLE AS ws, wd::DOUBLE AS wd FROM {values(GRID, 'config, ws, wd')}),
w AS (SELECT coalesce(s.q, d.q) AS q, coalesce(s.item_id, d.item_id) AS item_id, s.rank AS sr, d.rank AS dr FROM s FULL JOIN d ON s.q = d.q AND s.item_id = d.item_id),
f AS (SELECT config, q, item_id, round(ws / (60 + coalesce(sr, n + 1)) + wd / (60 + coalesce(dr, n + 1)), 8) AS score FROM w SEMI JOIN gold USING (q), c, nn),
r AS (SELECT *, row_number() OVER (PARTITION BY config, q ORDER BY score DESC, item_id) AS rank FROM f),
g AS (SELECT q, count(*) AS n_gold FROM gold GROUP BY q),
h AS (SELECT c.config, g.q, n_gold, r.rank FROM g CROSS JOIN c JOIN gold ON gold.q = g.q LEFT JOIN r ON r.config = c.config AND r.q = g.q AND r.item_id = gold.item_id),
per AS (SELECT config, q, {', '.join(f'count(*) FILTER (WHERE rank <= {k}) / n_gold::DOUBLE AS r{k}' for k in AIM)} FROM h GROUP BY config, q, n_gold)
SELECT config::INT AS config, count(*) AS n, {', '.join(f'round(avg(r{k}), 6) AS recall_{k}' for k in AIM)} FROM per GROUP BY config"""
)
def weight_grid(spark, sf_dir):
    """Recalls of every setting of a grid, in one pass over kept rank vectors."""
    return search(spark, sf_dir).table([g[1:] for g in GRID])


@query()
def weight_evolution(spark, sf_dir):
    """The setting that differential evolution finds from a grid."""
    found = search(spark, sf_dir)
    best = found.evolve(population=16, generations=3, start=found.grid(5))
    rows = [(*best.weights.values(), best.value, *best.recalls.values())]
    return spark.createDataFrame(rows, ", ".join(f"{n} double" for n in ["w_s", "w_d", "value", *[f"recall_{k}" for k in AIM]]))
