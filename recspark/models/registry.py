"""Rankers by name."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .implicit_als import ImplicitALS
from .item_cf import ItemCF
from .mf import MatrixFactorization
from .pairwise import fit_bpr, fit_implicit_bpr, fit_warp
from .popularity import Popularity

RANKERS = {
    "popularity": Popularity.fit,
    "item_cf": ItemCF.fit,
    "matrix_factorization": MatrixFactorization.fit,
    "bpr": fit_bpr,
    "implicit_bpr": fit_implicit_bpr,
    "implicit_als": ImplicitALS.fit,
    "warp": fit_warp,
}


def fit_ranker(name: str, train: DataFrame, **params):
    if name not in RANKERS:
        raise KeyError(f"unknown ranker {name!r}; known: {', '.join(sorted(RANKERS))}")
    return RANKERS[name](train, **params)
