"""Fits the Gaussian mixture of `quality` and writes `quality_model.json`.

    python -m glossmill.llm.quality_fit FOLDER

Expectation-maximization runs on the standardized statistics of at most ROWS rows (those with the smallest hashed ids) of
parquet_keeper in FOLDER and of INVENTED texts that come from no corpus (`quality_examples`), and knows nothing of kinds.
Only then are the components mapped: each speaks for a kind as far as the examples in it are of that kind. Examples are the
invented texts and at most PER_COMPONENT rows of each component, drawn by chance, as `kind_of_example` words what
inspection found them to be. The shipped model comes from /root/testdata/sf0.1; `main` prints its agreement with the
remaining rows, which are no examples.
"""

from __future__ import annotations

import json
import random
import sys

import numpy as np
import pandas as pd

from .quality import FEATURES, KINDS, MODEL, counted, features, kinds, model, shares
from .quality_examples import invented

#: Rows and invented texts the mixture is fitted on, components, passes, least variance of a standardized statistic, and
#: examples of a component.
ROWS, INVENTED, COMPONENTS, PASSES, FLOOR, PER_COMPONENT = 50_000, 6_000, 320, 30, 0.01, 40


def kind_of_example(r: pd.Series) -> str | None:
    """What an inspected row of the corpus is; None for rows that were not sure enough to be examples."""
    n, latin = r.word_count, r.latin_share > 0.5
    if r.cell_share >= 0.9 and r.line_count > 2 and r.symbol_share < 0.6 and r.common_share < 0.03 and r.ending_share < 0.3 and r.field_share < 0.5:
        return "table"
    if (n >= 10 and r.distinct_words <= 5) or r.broken_share > 0.04 or r.long_share > 0.5:
        return "junk"
    if (r.letter_share < 0.45 and r.cell_share < 0.5) or (r.code_share > 0.12 and r.cell_share < 0.9 and r.field_share < 0.8 and r.mean_word_length > 7):
        return "junk"
    if latin and r.cluster_share > 0.2 and r.common_share == 0 and r.ending_share == 0 and r.line_count == 1:
        return "junk"
    if r.symbol_share > 0.8:
        return "junk"
    if r.field_share >= 0.7 and r.short_share > 0.5 and r.common_share < 0.1 and r.part_count > 1:
        return "list"
    if r.cell_share > 0.6 and r.line_count > 1 and r.ending_share < 0.3 and r.common_share < 0.03:
        return "table"
    if latin and r.common_share < 0.03 and (r.short_share >= 0.6 and r.part_count > 2 or r.comma_words <= 3.2 and n / max(r.comma_words, 0.1) > 3.5):
        return "list"
    if latin and r.common_share < 0.03 and r.short_share >= 0.4 and r.bullet_share >= 0.8 and r.line_count > 2:
        return "list"
    if latin and r.part_words > 4.5 and r.comma_words > 3.2 and r.ending_share > 0.2:
        return "prose"
    if r.common_share >= 0.05 or (r.ending_share >= 0.9 and r.short_share < 0.3) or not latin or (r.part_count == 1 and r.comma_words > 3.5):
        return "prose"
    return None


def fit(x: np.ndarray, components: int = COMPONENTS, passes: int = PASSES, seed: int = 0) -> dict:
    """A mixture with full covariances, by expectation-maximization from centres drawn far apart."""
    rng = np.random.default_rng(seed)
    center, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    z = (x - center) / scale
    n, d = z.shape
    mean = z[rng.integers(n)][None]
    near = ((z - mean[0]) ** 2).sum(1)
    while len(mean) < components:
        pick = z[rng.choice(n, p=near / near.sum())]
        mean = np.concatenate([mean, pick[None]])
        near = np.minimum(near, ((z - pick) ** 2).sum(1))
    whiten, weight = np.stack([np.eye(d)] * components), np.full(components, 1 / components)
    for _ in range(passes):
        base = np.log(weight + 1e-12) + np.log(np.abs(np.diagonal(whiten, axis1=1, axis2=2))).sum(1)
        log = np.stack([b - 0.5 * (((z - m) @ w.T) ** 2).sum(1) for b, m, w in zip(base, mean, whiten)], 1)
        share = np.exp(log - log.max(1, keepdims=True))
        share /= share.sum(1, keepdims=True)
        total = share.sum(0) + 1e-9
        weight = total / total.sum()
        mean = (share.T @ z) / total[:, None]
        for k in range(components):
            v = (z - mean[k]) * np.sqrt(share[:, k : k + 1])
            whiten[k] = np.linalg.inv(np.linalg.cholesky((v.T @ v) / max(total[k], 1.0) + FLOOR * np.eye(d)))
    r = lambda a: np.round(a, 4).tolist()
    return {"features": list(FEATURES), "center": r(center), "scale": r(scale), "weight": np.round(weight, 7).tolist(), "mean": r(mean), "whiten": [[r(row[: i + 1]) for i, row in enumerate(w)] for w in whiten]}


def mapped(share: np.ndarray, known: list[str | None]) -> list[list[float]]:
    """For each component the part of its examples that is of each kind; without any, all kinds are as likely."""
    is_kind = np.array([[k == o for o in KINDS] for k in known], float)
    votes = share.T @ is_kind + 1e-3
    return np.round(votes / votes.sum(1, keepdims=True), 4).tolist()


def main(folder: str, seed: int = 0) -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    spark = SparkSession.builder.getOrCreate()
    docs = spark.read.parquet(f"{folder}/parquet_keeper.parquet").where("text is not null").orderBy(F.xxhash64("row_id")).limit(ROWS)
    texts = [r["text"] for r in docs.select("text").collect()]
    spark.stop()
    rng = random.Random(seed)
    made = [invented(rng) for _ in range(INVENTED)]
    stats = counted(pd.Series([*texts, *(t for t, _ in made)]))
    stats = stats.assign(kind=[kind_of_example(r) for _, r in stats.iloc[: len(texts)].iterrows()] + [k for _, k in made], made=[False] * len(texts) + [True] * len(made))
    stats = stats[stats["word_count"] > 0].reset_index(drop=True)
    m = fit(features(stats), seed=seed) | {"kinds": [[0.25] * len(KINDS)] * COMPONENTS}
    MODEL.write_text(json.dumps(m, separators=(",", ":")) + "\n")
    model.cache_clear()
    share = shares(stats)
    top = share.argmax(1)
    drawn = np.random.default_rng(seed).random(len(stats))
    order = pd.Series(np.where(stats["made"], 2.0, drawn)).groupby(top).rank()
    example = (order <= PER_COMPONENT).to_numpy() | stats["made"].to_numpy()
    m["kinds"] = mapped(share[example], list(stats["kind"].where(example, None)[example]))
    MODEL.write_text(json.dumps(m, separators=(",", ":")) + "\n")
    model.cache_clear()
    got = kinds(stats)
    for what, rows in (("examples", example), ("other rows", ~example & stats["kind"].notna().to_numpy())):
        print(f"{what}: {rows.sum()}, of which {(got[rows] == stats['kind'].to_numpy()[rows]).mean():.5f} agree")
    other = random.Random(seed + 1)
    held = [invented(other) for _ in range(2000)]
    right = kinds(counted(pd.Series([t for t, _ in held]))) == np.array([k for _, k in held])
    print(f"new invented texts: {right.mean():.4f} right")


if __name__ == "__main__":
    main(sys.argv[1])
