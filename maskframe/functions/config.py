"""Small nested settings: the driver-side part of sweeps and run identities."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from fractions import Fraction
from itertools import product
from math import gcd, lcm

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskframe.functions import yamltext
from maskframe.functions.arrays import ColumnLike, col


def get(data: dict, key: str):
    """The value at a dotted key; a KeyError names the part of the key that was found."""
    at = data
    for k, part in enumerate(key.split(".")):
        if not isinstance(at, dict) or part not in at:
            raise KeyError(".".join(key.split(".")[: k + 1]))
        at = at[part]
    return at


def flatten(data: dict, prefix: str = "") -> dict:
    """Dotted keys to leaves."""
    out = {}
    for k, v in data.items():
        out |= flatten(v, f"{prefix}{k}.") if isinstance(v, dict) and v else {f"{prefix}{k}": v}
    return out


def merge(base: dict, over: dict) -> dict:
    """Mappings merge, everything else is replaced."""
    return base | {k: merge(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


def override(base: dict, dotted: dict) -> dict:
    """``merge`` with dotted keys; an empty part of a key is an error."""
    out = base
    for key, value in dotted.items():
        if not all(key.split(".")):
            raise ValueError(f"empty part in {key!r}")
        for part in reversed(key.split(".")):
            value = {part: value}
        out = merge(out, value)
    return out


def load_unique(text: str) -> dict:
    """Settings in YAML (or JSON, which is YAML too) in which a key that stands twice in a mapping is an error."""
    return yamltext.load(text, unique=True)


def parse_overrides(texts: list[str]) -> dict:
    """Dotted keys and values of KEY=VALUE texts, values in YAML (so ``lr=1e-3`` is text); the last of a key counts."""
    out = {}
    for text in texts:
        key, sign, value = text.partition("=")
        if not sign or not key.strip():
            raise ValueError(f"{text!r} is not KEY=VALUE")
        out[key.strip()] = yamltext.load(value)
    return out


def inherit(name: str, load: Callable[[str], dict], seen: tuple[str, ...] = ()) -> dict:
    """The settings that ``load`` gives for a name, merged over those of their ``_base_`` (one name or several, later ones win)."""
    if name in seen:
        raise ValueError("settings inherit from themselves: " + " -> ".join([*seen, name]))
    own = dict(load(name))
    bases = own.pop("_base_", None) or []
    out: dict = {}
    for base in [bases] if isinstance(bases, str) else bases:
        out = merge(out, inherit(base, load, (*seen, name)))
    return merge(out, own)


def threshold(value: float) -> float:
    """A finite number from 0 to 1."""
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not 0 <= value <= 1:
        raise ValueError(f"threshold {value!r} is not within 0 to 1")
    return float(value)


def missing(data: dict) -> list[str]:
    """Dotted keys whose value is still the placeholder "?"."""
    return sorted(k for k, v in flatten(data).items() if v == "?")


def digest(data: dict) -> str:
    return hashlib.md5(json.dumps(data, sort_keys=True).encode()).hexdigest()


def integer_weights(names: list[str], proportions: dict[str, str | int | float], default: int = 1) -> dict[str, int]:
    """Exact decimal proportions as the smallest whole weights; names without one have the default."""
    exact = {n: Fraction(str(proportions.get(n, default))) for n in names}
    if any(v < 0 for v in exact.values()):
        raise ValueError("negative proportion")
    scale = lcm(*(v.denominator for v in exact.values()))
    whole = {n: int(v * scale) for n, v in exact.items()}
    shared = gcd(*whole.values()) or 1
    return {n: w // shared for n, w in whole.items()}


def valid_run_id(run_id: ColumnLike) -> Column:
    """Three parts joined by "-", none empty or with separators of paths or control characters."""
    return col(run_id).rlike(r"^[^-/\\\x00-\x1f]+-[^-/\\\x00-\x1f]+-[^-/\\\x00-\x1f]+$")


def run_id(prefix: ColumnLike, nonce: ColumnLike, at: ColumnLike) -> Column:
    return F.concat_ws("-", F.date_format(col(at), "yyyyMMdd_HHmmss"), col(nonce), col(prefix))


def is_plain_name(name: ColumnLike) -> Column:
    """A name that is no path: no separators, not a dot name."""
    return ~col(name).rlike(r"[/\\]") & ~col(name).isin("", ".", "..")


# -- datasets and submissions -------------------------------------------------------------------------

def dataset_modalities(data: dict | None) -> dict[str, str]:
    """Dataset name to modality of {modality: {dataset: options}}; a name under two modalities is an error."""
    found: dict[str, str] = {}
    for modality, datasets in (data or {}).items():
        if datasets is not None and not isinstance(datasets, dict):
            raise TypeError(f"data.{modality} must be a mapping")
        for name in map(str, datasets or {}):
            if name in found:
                raise ValueError(f"dataset {name!r} stands under {found[name]!r} and {modality!r}: names must differ over modalities")
            found[name] = modality
    return found


def camera_profiles(names: set[str], settings: dict | None) -> dict[str, dict] | None:
    """The camera profile of each CT dataset: its own options over the default ones.

    The datasets listed must be just the configured ones, and all profiles must share the size of
    their images and their number of views.  None without settings.
    """
    if settings is None:
        return None
    default, own = settings.get("default"), settings.get("datasets")
    if not isinstance(default, dict) or not isinstance(own, dict):
        raise ValueError("camera settings need the mappings default and datasets")
    if set(own) != set(names):
        raise ValueError(f"camera settings miss {sorted(set(names) - set(own))} and list {sorted(set(own) - set(names))} that are not configured")
    profiles = {n: merge(default, own[n] or {}) for n in sorted(names)}
    sizes = {}
    for n, profile in profiles.items():
        camera = profile.get("intrinsics_cfg") or {}
        if "height" not in camera:
            raise ValueError(f"the profile of {n} has no intrinsics_cfg.height")
        sizes[n] = (int(camera["height"]), int(camera.get("width", camera["height"])))
    views = {n: profile.get("num_views") for n, profile in profiles.items()}
    for what, values in (("height and width", sizes), ("num_views", views)):
        if len(set(values.values())) > 1:
            raise ValueError(f"all profiles must share {what}: {values}")
    return profiles


def expand(base: dict, axes: dict | None) -> list[dict]:
    """Every combination of dotted axes (lists; a scalar is one value) over a base, in product order.

    ``experiment.seed_range`` n stands for the seeds from ``experiment.seed`` (of the axes, the base,
    or 40) on.
    """
    axes = dict(axes or {})
    if (count := axes.pop("experiment.seed_range", None)) is not None:
        seed = axes.pop("experiment.seed", flatten(base).get("experiment.seed", 40))
        if isinstance(seed, list) or int(count) <= 0:
            raise ValueError("experiment.seed_range is a positive number beside one seed")
        axes["experiment.seed"] = [int(seed) + k for k in range(int(count))]
    values = [v if isinstance(v, list) else [v] for v in axes.values()]
    return [override(base, dict(zip(axes, chosen))) for chosen in product(*values)]


def without_inactive(config: dict) -> dict:
    """Datasets whose sampling proportion is 0, taken out of data, camera profiles and loss routes."""
    shares = (config.get("dataloader") or {}).get("proportions") or {}
    inactive = {n for n, p in shares.items() if Fraction(str(p)) == 0}
    if not inactive:
        return config
    active = lambda d: {k: v for k, v in d.items() if k not in inactive} if isinstance(d, dict) else d
    out = dict(config)
    if isinstance(out.get("data"), dict):
        out["data"] = {m: active(d) for m, d in out["data"].items()}
    for block, entry in (("drr_model", "datasets"), ("loss_func", "dataset_profiles")):
        if isinstance(out.get(block), dict):
            out[block] = {k: active(v) if k == entry else v for k, v in out[block].items()}
    return out


def submissions(bases: list[dict], experiment: dict, cluster: dict, log_root: str, explicit: dict | None = None, sweep: dict | None = None, validate: bool = True) -> list[dict]:
    """The settings of every run of a submission, base by base and combination by combination.

    Later ones win: a base, the experiment's literal values, its ``sweep`` and the given sweep axes,
    the cluster's values, explicit dotted values.  An explicit value also takes the axes away that it
    covers.  log.root is the group's folder unless the experiment or an explicit value sets it.  With
    ``validate`` a placeholder "?" that is left is an error.
    """
    explicit = dict(explicit or {})
    own = {k: v for k, v in experiment.items() if k not in ("group", "sweep")}
    axes = experiment.get("sweep") or {}
    if not isinstance(axes, dict):
        raise ValueError("sweep must be a mapping of axes")
    literal, axes = flatten(own), flatten(axes)
    if (count := literal.pop("experiment.seed_range", None)) is not None:
        axes.setdefault("experiment.seed_range", count)
    axes |= sweep or {}
    covered = lambda k: any(k == e or k.startswith(f"{e}.") for e in explicit)
    literal, axes = ({k: v for k, v in d.items() if not covered(k)} for d in (literal, axes))
    if "experiment.seed" in explicit:
        axes.pop("experiment.seed_range", None)
    rooted = any("log.root" in d for d in (literal, axes, flatten(override({}, explicit))))
    out = []
    for base in bases:
        for config in expand(override(base, literal), axes):
            config = override(merge(config, cluster), explicit)
            if not rooted:
                config = merge(config, {"log": {"root": log_root}})
            config = without_inactive(config)
            if validate and (left := missing(config)):
                raise ValueError(f"values are missing: {left}")
            out.append(config)
    return out
