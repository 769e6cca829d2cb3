"""Greedy nearest-age, same-sex matching without replacement.

Each cohort is a bounded list of subjects, matched in one task; cohorts run side by side.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def matched(subjects: DataFrame, cohort: str, ratio: int = 1, seed: int = 1, smaller_anchors: bool = False) -> DataFrame:
    """subjects (cohort, id, group 1/0, sex, age) that are in a match, with pair, the anchor's id.

    Anchors (group 1, or the smaller group) come in a seeded order; each takes the `ratio` nearest
    ages of its sex, ties to the smaller id, of any sex once its sex has run out; matching stops when
    the pool is empty. Rows with a null id or age take no part.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=["id", "age"]).sort_values("id")
        anchor = 1
        take = ratio
        if smaller_anchors and (pdf["group"] == 0).sum() < (pdf["group"] == 1).sum():
            anchor, take = 0, 1
        anchors, pool = pdf[pdf["group"] == anchor], pdf[pdf["group"] != anchor]
        order = sorted(anchors.index, key=lambda i: hashlib.md5(f"{seed}:{pdf.at[i, 'id']}".encode()).hexdigest())
        free = np.ones(len(pool), bool)
        ages, sexes = pool["age"].to_numpy(float), pool["sex"].to_numpy()
        found = []
        for i in order:
            if not free.any():
                break
            found.append((i, pdf.at[i, "id"]))
            for _ in range(take):
                if not free.any():
                    break
                same = free & (sexes == pdf.at[i, "sex"])
                left = same if same.any() else free
                best = int(np.where(left, np.abs(ages - pdf.at[i, "age"]), np.inf).argmin())
                free[best] = False
                found.append((pool.index[best], pdf.at[i, "id"]))
        out = pdf.loc[[i for i, _ in found]].copy()
        out["pair"] = [p for _, p in found]
        return out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in subjects.schema.fields) + f", pair {subjects.schema['id'].dataType.simpleString()}"
    return subjects.groupBy(cohort).applyInPandas(lambda pdf: run(pdf), schema)
