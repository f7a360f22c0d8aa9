"""Near-duplicate vectors against all pairs."""

import numpy as np

from framescore.llm import embeddings


def brute(rows):
    ok = [i is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for i, v in rows]
    n = len(rows)
    links, part = [0] * n, list(range(n))
    scaled = [np.array(v, float) / max(map(abs, v)) if g else None for (_, v), g in zip(rows, ok)]
    unit = [v / np.linalg.norm(v) if g else None for v, g in zip(scaled, ok)]
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= 0.95:
                links[i] += 1
                links[j] += 1
                if part[i] != part[j]:
                    a, b = part[i], part[j]
                    part = [a if p == b else p for p in part]
    out = []
    for k, (i, _) in enumerate(rows):
        c = min((rows[m][0] for m in range(n) if part[m] == part[k] and rows[m][0] is not None), default=None) if ok[k] else i
        out.append((i is None, i or 0, links[k], c, i is not None and i == c))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.vec_id is None, r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in df.collect()), key=str)


def test_whole_table(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    want = brute(rows)
    assert got(embeddings.op5_pca_tiles(spark, sf_dir)) == want


def test_groups_small_tiles_and_odd_rows(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(6, 12))
    rows = [(int(i * 3), [float(x) for x in base[i % 6] + rng.normal(size=12) * rng.choice([0.0, 0.1, 0.25])]) for i in range(90)]
    rows += [(500, rows[0][1]), (500, rows[0][1]), (500, rows[1][1]), (-1, [2 * x for x in rows[0][1]]), (600, None), (601, []), (602, [0.0] * 12), (603, [float("nan")] + [1.0] * 11), (604, [float("inf")] + [1.0] * 11), (605, [None] + [1.0] * 11), (None, rows[0][1]), (606, rows[0][1][:5]), (607, rows[0][1][:5]), (608, [1e200, 1e-200]), (609, [1e-200, 1e-210]), (610, [0.95, (1 - 0.95**2) ** 0.5]), (611, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as h1", "'x' as uid")
    want = brute(rows)
    assert got(embeddings.near_duplicates(df)) == want
    assert got(embeddings.near_duplicates(df, tile=5)) == want
    assert embeddings.near_duplicates(df.limit(0)).count() == 0
