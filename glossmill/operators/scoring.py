"""Scoring feature rows with a model, and rendering its labels as text."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: From (token_ids, valid_ids) of n rows and their label lengths to case and punctuation scores (n, positions, labels), and
#: maybe a mask (n, positions) of the positions that count.
Scorer = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, ...]]


@lru_cache(maxsize=2)
def _session(path: str):
    import onnxruntime

    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = options.inter_op_num_threads = 1
    return onnxruntime.InferenceSession(path, options, providers=["CPUExecutionProvider"])


class OnnxScorer:
    """A model file, loaded once in each Python worker with one thread."""

    def __init__(self, path: str) -> None:
        self.path = path

    def __call__(self, ids: np.ndarray, valid: np.ndarray, lengths: np.ndarray):
        s = _session(self.path)
        names = [i.name for i in s.get_inputs()]
        return tuple(s.run(None, dict(zip(names, (ids, valid, lengths)))))


class HashScorer:
    """Stands in for a model: labels follow from the token ids, so results can be checked."""

    def __call__(self, ids: np.ndarray, valid: np.ndarray, lengths: np.ndarray):
        first = np.zeros_like(ids)
        for r in range(len(ids)):
            at = np.flatnonzero(valid[r])
            first[r, : len(at)] = ids[r, at]
        return tuple(-np.abs(np.arange(k)[None, None] - (first % k)[:, :, None]).astype(np.float32) for k in (3, 6))


def scored(features: DataFrame, keys: list[str], scorer: Scorer, batch: int = 512) -> DataFrame:
    """(keys, label_pos, case_id, punct_id): the best label of each word position; bos and eos are left out.

    Positions that the model's own mask leaves out have no label. Rows keep their keys, so results are joined, never matched by position. Ties go to the first label.
    """
    types = ", ".join(f"{k} {features.schema[k].dataType.simpleString()}" for k in keys)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for a in range(0, len(part), batch):
                rows = part.iloc[a : a + batch]
                ids, valid = (np.array(rows[c].tolist(), np.int32) for c in ("token_ids", "valid_ids"))
                n = rows["label_len"].to_numpy(np.int64)
                case, punct, *mask = scorer(ids, valid, n)
                case, punct = case.argmax(-1), punct.argmax(-1)
                at = [(r, p) for r in range(len(rows)) for p in range(1, n[r] - 1) if not mask or mask[0][r, p]]
                r, p = (np.array([x[i] for x in at], np.int64) for i in (0, 1))
                out = rows[keys].iloc[r].reset_index(drop=True)
                yield out.assign(label_pos=p - 1, case_id=case[r, p] if len(r) else [], punct_id=punct[r, p] if len(r) else [])

    return features.select(*keys, "token_ids", "valid_ids", "label_len").mapInPandas(run, f"{types}, label_pos int, case_id int, punct_id int")


def rendered_sentences(words: DataFrame, keys: list[str], legacy: bool = False) -> DataFrame:
    """(keys, text) of predicted words (keys, pos, word, case_id, punct_id)."""
    from ..functions.words import rendered

    w = words.select(*keys, F.struct("pos", rendered(F.col("word"), F.col("case_id"), F.col("punct_id"), legacy).alias("t")).alias("w"))
    return w.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list("w")), lambda x: x["t"]), " ").alias("text"))
