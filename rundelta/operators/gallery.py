"""Models by name: one way to fit any of them, and a place to add one's own."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rundelta.errors import Refusal
from rundelta.operators import fits, mack, methods, posterior, simulate

FAMILIES = ("deterministic", "statistical", "bayesian", "simulation")


@dataclass(frozen=True)
class Entry:
    """``fit(cells, premium, keys, step, **options)`` gives a frame with the keys; ``kind`` is points or draws."""

    name: str
    family: str
    kind: str
    fit: Callable[..., DataFrame]

    @property
    def card(self) -> str:
        """What the model is, from its function."""
        return (self.fit.__doc__ or "").strip()


_ENTRIES: dict[str, Entry] = {}


def register(name: str, family: str, kind: str = "points"):
    """A decorator that adds a model; a name is taken once, and a model says what it is in its docstring."""

    def add(fit):
        if family not in FAMILIES or kind not in ("points", "draws") or not fit.__doc__:
            raise Refusal("invalid_option", f"{name}: family {family!r}, kind {kind!r}, or no docstring")
        if name in _ENTRIES and _ENTRIES[name].fit is not fit:
            raise Refusal("duplicate", name)
        _ENTRIES[name] = Entry(name, family, kind, fit)
        return fit

    return add


def entries(family: str | None = None) -> dict[str, Entry]:
    return {k: e for k, e in sorted(_ENTRIES.items()) if family in (None, e.family)}


def get(name: str) -> Entry:
    if name not in _ENTRIES:
        raise Refusal("invalid_option", f"no model {name!r}; there are {sorted(_ENTRIES)}")
    return _ENTRIES[name]


def fit(name: str, cells: DataFrame, premium: DataFrame, keys: list[str], step: int, **options) -> DataFrame:
    """The named model's result for every cohort."""
    return get(name).fit(cells, premium, keys, step, **options)


@register("chain_ladder", "deterministic")
def _chain_ladder(cells, premium, keys, step, **options):
    """Latest amounts times volume factors to the last age."""
    return methods.chain_ladder(cells, keys, step, **options)


@register("bornhuetter_ferguson", "deterministic")
def _bornhuetter_ferguson(cells, premium, keys, step, **options):
    """Latest amounts plus the undeveloped share of expected losses (``expected_loss_ratio``)."""
    return methods.bornhuetter_ferguson(cells, premium, keys, step, **options)


@register("cape_cod", "deterministic")
def _cape_cod(cells, premium, keys, step, **options):
    """Bornhuetter-Ferguson with loss ratios from the cohort's own data."""
    return methods.cape_cod(cells, premium, keys, step, **options)


@register("mack", "deterministic")
def _mack(cells, premium, keys, step, **options):
    """Chain ladder with process and parameter errors by origin."""
    return mack.mack(cells, keys, step, **options)


@register("clark", "statistical")
def _clark(cells, premium, keys, step, **options):
    """A growth curve by Poisson likelihood."""
    return fits.clark(cells, premium, keys, **options)


@register("tweedie_glm", "statistical")
def _tweedie(cells, premium, keys, step, power: float = 1.0, **options):
    """A Tweedie model of increments."""
    return fits.tweedie_glm(cells, keys, power, **options)


def _company(line: str, cells, keys):
    if line not in keys:
        raise Refusal("invalid_option", f"{line!r} is no key")
    return [k for k in keys if k != line]


@register("sur", "statistical")
def _sur(cells, premium, keys, step, line: str = "lob"):
    """Lines of a company with own slopes and correlated errors."""
    rest = _company(line, cells, keys)
    held = cells if rest else cells.withColumn("company", F.lit("all"))
    return fits.multivariate_chain_ladder(held, rest or ["company"], line, full=False)


@register("mcl", "statistical")
def _mcl(cells, premium, keys, step, line: str = "lob"):
    """Lines of a company, each developed from all of them."""
    rest = _company(line, cells, keys)
    held = cells if rest else cells.withColumn("company", F.lit("all"))
    return fits.multivariate_chain_ladder(held, rest or ["company"], line, full=True)


@register("odp_bootstrap", "simulation", "draws")
def _bootstrap(cells, premium, keys, step, **options):
    """Reserves by resampled residuals of the over-dispersed Poisson model."""
    return simulate.odp_bootstrap(cells, keys, premium=premium, **options)


@register("mack_simulation", "simulation", "draws")
def _simulation(cells, premium, keys, step, **options):
    """Ultimates with drawn factors and process noise."""
    return simulate.mack_simulate(cells, keys, step, **options)


def _bayesian(model: str, text: str):
    def run(cells, premium, keys, step, **options):
        return posterior.posterior(cells, premium, keys, model, **options)

    run.__doc__ = text
    return run


for _name, _text in (("ccl", "Correlated chain ladder."), ("csr", "Changing settlement rate."), ("odp", "Over-dispersed Poisson with origin and age effects."), ("growth", "Hierarchical growth curve of loss ratios.")):
    register(_name, "bayesian", "draws")(_bayesian(_name, _text))
