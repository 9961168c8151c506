import json
import random
import zlib

import pytest
from pyspark.sql import functions as F

from palimpsest.operators.evolution import REPLY, answered, evolve_notes

NOTE, NEAR = "ord long, content string, context string, tags array<string>", "ord long, pos int, neighbour long"


def reply_to(prompt):
    """A made-up model: any reply that depends on the whole prompt."""
    h = zlib.crc32(prompt.encode())
    if h % 4 == 0:
        return None
    return [h % 9 - 1, h % 5], [f"own{h % 7}"] if h % 3 else [], [f"c{h % 11}", None, f"d{h % 13}"][: h % 4], [[f"t{h % 3}"], []][: h % 3]


def one_after_the_other(notes, near):
    state, prompts = {}, {}
    around = {}
    for o, pos, n in sorted(near):
        around.setdefault(o, []).append((pos, n))
    for o, content, context, tags in sorted(notes, key=lambda r: r[0]):
        mine = {k: v for k, v in (("content", content), ("context", context), ("tags", tags)) if v is not None}
        seen = [(p, n) for p, n in around.get(o, []) if n < o and n in state]
        mine["near"] = [{k: v for k, v in (("context", state[n][0]), ("tags", state[n][1])) if v is not None} for _, n in seen]
        prompt = json.dumps(mine, separators=(",", ":"), ensure_ascii=False)
        got = prompts[prompt] = reply_to(prompt)
        state[o] = [context, tags, []]
        if got:
            links, own, contexts, new = got
            state[o][2] = [x for x in links if 0 <= x < o]
            if own:
                state[o][1] = own
            for p, n in seen:
                if p < len(contexts) and contexts[p] is not None:
                    state[n][0] = contexts[p]
                if p < len(new):
                    state[n][1] = new[p]
    return {o: tuple(s) for o, s in state.items()}, prompts


def check(spark, notes, near, table):
    want, prompts = one_after_the_other(notes, near)
    if table:
        answer = answered(spark.createDataFrame([(p, *r) for p, r in prompts.items() if r], "prompt string, " + REPLY))
    else:
        udf = F.udf(reply_to, "struct<" + REPLY.replace(" ", ":").replace(",:", ",") + ">")
        answer = lambda ps: ps.select("ord", udf("prompt").alias("r")).where("r is not null").select("ord", "r.*")
    found, generations = evolve_notes(spark.createDataFrame(notes, NOTE), spark.createDataFrame(near, NEAR), answer)
    assert {r.ord: (r.context, r.tags, r.links) for r in found.collect()} == want
    return generations


@pytest.mark.parametrize("table", [True, False])
def test_generations_equal_one_note_after_the_other(spark, table):
    rng = random.Random(11)
    notes = [(o, f"note {o % 9}", f"ctx{o}", ["x"]) for o in range(30)]
    near = [(o, p, n) for o in range(1, 30) for p, n in enumerate(rng.sample(range(max(0, o - 12), o), min(o, 12, rng.randint(0, 3))))]
    near += [(o, 3, 0) for o in range(5, 30)]
    assert check(spark, notes, near, table) > 1


def test_odd_notes(spark):
    notes = [(0, None, None, None), (1, "", "", []), (2, "long " * 5000, "c", ["é"]), (5, "far", None, ["t"])]
    near = [(1, 0, 0), (2, 0, 1), (2, 1, 1), (2, 2, 7), (5, 0, 2), (0, 0, 5), (5, 1, 4)]
    check(spark, notes, near, False)
    empty, generations = evolve_notes(spark.createDataFrame([], NOTE), spark.createDataFrame([], NEAR), answered(spark.createDataFrame([], "prompt string, " + REPLY)))
    assert empty.collect() == [] and generations == 1
