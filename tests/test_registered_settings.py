"""Learned models are registered at the library's own settings."""

import pytest

import __spark_entry__ as entry


class _Model:
    user_factors = item_factors = None

    def rank(self, *args):
        return None


@pytest.mark.parametrize("name, owner, fit", [
    ("mf_top_n", entry.MatrixFactorization, "fit"),
    ("implicit_als_top_n", entry.ImplicitALS, "fit"),
    ("bpr_top_n", entry.pairwise, "fit_bpr"),
    ("implicit_bpr_top_n", entry.pairwise, "fit_implicit_bpr"),
    ("warp_top_n", entry.pairwise, "fit_warp"),
    ("implicit_bpr_check", entry.pairwise, "fit_implicit_bpr"),
    ("warp_check", entry.pairwise, "fit_warp"),
])
def test_models_are_fitted_at_default_settings(monkeypatch, name, owner, fit):
    calls = []
    monkeypatch.setattr(owner, fit, lambda *a, **k: calls.append((a, k)) or _Model())
    monkeypatch.setattr(entry, "_train", lambda spark, d: "train")
    monkeypatch.setattr(entry, "_users", lambda spark, d: "users")
    monkeypatch.setattr(entry, "_audit", lambda *a: None)
    monkeypatch.setattr(entry, "_once", lambda spark, d, key, build: build())
    getattr(entry, f"q_{name}")(None, "none")
    assert calls == [(("train",), {})]
