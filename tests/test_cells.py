"""Cell calling against a serial version."""

import random

import numpy as np

from helixframe.operators.cells import good_turing
from helixframe.plans import queries


def serial_empty_drops(pairs, lower, simulations, fdr, expected):
    table = {}
    for cb, gene in pairs:
        table.setdefault(cb, {}).setdefault(gene, 0)
        table[cb][gene] += 1
    total = {cb: sum(x.values()) for cb, x in table.items()}
    robust = sorted(total.values(), reverse=True)[int(expected * 0.01 + 0.5)]
    knee = {cb for cb, n in total.items() if n >= -(-robust // 10)}
    genes = sorted({g for _, g in pairs})
    ambient = {g: 0 for g in genes}
    for cb, x in table.items():
        for g, n in x.items():
            ambient[g] += n if total[cb] <= lower else 0
    p = good_turing(np.array([ambient[g] for g in genes]))
    logs = dict(zip(genes, np.log(p)))
    factorial = np.cumsum(np.log(np.maximum(np.arange(200), 1)))
    rest = {cb: sum(n * logs[g] - factorial[n] for g, n in table[cb].items()) for cb in table if cb not in knee and total[cb] > lower}
    top = max(total[cb] for cb in rest)
    below = dict.fromkeys(rest, 0)
    for i in range(simulations):
        draw = np.random.Generator(np.random.MT19937(19760110 * (i + 1))).choice(len(genes), top, p=p / p.sum())
        seen, value, walk = {}, 0.0, [0.0]
        for g in draw.tolist():
            seen[g] = seen.get(g, 0) + 1
            value += logs[genes[g]] - np.log(seen[g])
            walk.append(value)
        for cb, x in rest.items():
            below[cb] += walk[total[cb]] <= x
    chance = sorted(((n + 1) / (simulations + 1), cb) for cb, n in below.items())
    rescued, least = set(), 1.0
    for rank in range(len(chance), 0, -1):
        value, cb = chance[rank - 1]
        least = min(least, value * len(chance) / rank)
        if least <= fdr:
            rescued.add(cb)
    return knee, rescued


def test_empty_drops_rescues_a_minority_of_candidates(spark, tmp_path):
    rng = random.Random(4)
    weights = [1 / (g + 1) for g in range(40)]
    ambient = lambda n: rng.choices(range(40), weights, k=n)
    pairs = [(cb, g) for cb in range(4) for g in ambient(400)]
    pairs += [(cb, g) for cb in range(10, 110) for g in ambient(rng.randint(19, 30))]
    pairs += [(cb, rng.randint(30, 39)) for cb in range(200, 205) for _ in range(25)]
    pairs += [(cb, g) for cb in range(300, 600) for g in ambient(rng.randint(5, 18))]
    spark.createDataFrame(pairs, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    out = queries.QUERIES["empty_drops"](spark, str(tmp_path)).collect()
    knee, rescued = serial_empty_drops(pairs, 18, 10_000, 0.01, 300)
    assert {r.cb for r in out if r.kind == "knee"} == knee == set(range(4))
    assert {r.cb for r in out if r.kind == "rescued"} == rescued
    assert rescued >= set(range(200, 205))
