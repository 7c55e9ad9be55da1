"""Refusals: why an input or a fit was turned down, as an exception or as rows."""

from __future__ import annotations

#: Fixed reason codes.
INPUT_REASONS = ("invalid_option", "invalid_table", "missing_value", "not_finite", "unreadable_label", "invalid_age", "grain_mismatch", "duplicate", "negative_cumulative", "origin_gap", "not_run_off", "not_in_triangle", "origin_not_covered", "off_grain", "keys_collapse", "missing_line", "missing_draws", "misaligned")
MODEL_REASONS = ("no_link_ratio", "exclusions_exhausted", "variance_not_estimable", "negative_increment", "zero_increment", "negative_fitted_mean", "not_identified", "degenerate_fit", "did_not_converge", "tail_not_decaying", "empty_residual_pool", "result_not_finite", "not_supported", "negative_projection", "premium_missing")


class Refusal(ValueError):
    """One exception type with a closed list of reasons; ``cells`` names what offends (100 at most)."""

    def __init__(self, reason: str, detail: str = "", option: str | None = None, cells: tuple = ()):
        if reason not in INPUT_REASONS + MODEL_REASONS:
            raise KeyError(reason)
        super().__init__(f"{reason}: {detail}")
        self.reason, self.detail, self.option, self.cells = reason, detail, option, tuple(cells)[:100]

    @property
    def kind(self) -> str:
        return "input" if self.reason in INPUT_REASONS else "model"

    def to_dict(self) -> dict:
        return {"reason": self.reason, "kind": self.kind, "option": self.option, "detail": self.detail, "cells": list(self.cells)}


def require_none(refusals) -> None:
    """Raise the first row of a refusals frame, if there is one."""
    row = refusals.limit(1).collect()
    if row:
        r = row[0].asDict()
        raise Refusal(r["reason"], str({k: v for k, v in r.items() if k != "reason"}))
