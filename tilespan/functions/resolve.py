"""Resolution specs: a precedence of featuresets and ordered rules, compiled to one CASE expression."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


class SpecError(ValueError):
    pass


@dataclass(frozen=True)
class Rule:
    """when: labels by featureset (empty: always); emit: ("featureset", name), ("literal", text) or ("composite", names, sep)."""

    when: dict
    emit: tuple


@dataclass(frozen=True)
class Spec:
    precedence: tuple[str, ...]
    rules: tuple[Rule, ...]

    def column(self) -> Column:
        """The resolved label of a row that has one column for each featureset."""
        out = F.col(self.precedence[0])
        for rule in reversed(self.rules):
            holds = reduce(lambda a, b: a & b, [F.col(fs).isin(sorted(labels)) for fs, labels in rule.when.items()], F.lit(True))
            out = F.when(holds, emitted(rule.emit)).otherwise(out)
        return out


def emitted(emit: tuple) -> Column:
    if emit[0] == "featureset":
        return F.col(emit[1])
    return F.lit(emit[1]) if emit[0] == "literal" else F.concat_ws(emit[2], *emit[1])


def composite(precedence, sep: str = ":") -> Spec:
    """The default: all labels joined in precedence order."""
    return Spec(tuple(precedence), (Rule({}, ("composite", tuple(precedence), sep)),))


def load(data: Mapping, classes: Mapping[tuple[str, str], set[str]] | None = None) -> Spec:
    """A spec from its plain form. classes gives the labels under (featureset, node), for @node and to know the trees' labels; a rule's featuresets must stand in precedence order."""
    if not isinstance(data, Mapping) or set(data) - {"name", "precedence", "rules"}:
        raise SpecError("a spec has name, precedence and rules only")
    if not isinstance(data.get("precedence"), list) or not data["precedence"] or len(set(data["precedence"])) != len(data["precedence"]):
        raise SpecError("precedence must be a list of different featuresets")
    precedence, rules = tuple(data["precedence"]), []
    if classes is not None and (unknown := set(precedence) - {fs for fs, _ in classes}):
        raise SpecError(f"no tree for {', '.join(sorted(unknown))}")
    for k, raw in enumerate(data.get("rules", [])):
        if set(raw) - {"when", "emit"} or "emit" not in raw:
            raise SpecError(f"rule {k} has when and emit only")
        keys = list(raw.get("when", {}))
        if any(x not in precedence for x in keys) or keys != sorted(keys, key=precedence.index):
            raise SpecError(f"rule {k}: featuresets of when must follow the precedence")
        when = {fs: expand(labels, fs, classes) for fs, labels in raw.get("when", {}).items()}
        rules.append(Rule(when, parse_emit(raw["emit"], precedence, tuple(keys), k)))
    return Spec(precedence, tuple(rules))


def expand(labels, feature_set: str, classes) -> frozenset[str]:
    """Labels of a name, a list or an @class."""
    out: set[str] = set()
    for label in [labels] if isinstance(labels, str) else labels:
        if label.startswith("@"):
            found = (classes or {}).get((feature_set, label[1:]))
            if not found:
                raise SpecError(f"no class {label} in {feature_set}")
            out |= found
        elif classes is not None and (feature_set, label) not in classes:
            raise SpecError(f"{feature_set} has no {label}")
        else:
            out.add(label)
    return frozenset(out)


#: What joins the labels of a composite that names no separator.
SEPARATORS = {"when": "_", "all": ":", "listed": ":"}


def parse_emit(raw, precedence, when_keys, k: int) -> tuple:
    if raw == "composite":
        raw = {"composite": "when"}
    if isinstance(raw, str):
        if raw not in precedence:
            raise SpecError(f"rule {k} emits {raw}, which is no featureset")
        return "featureset", raw
    if not isinstance(raw, Mapping) or set(raw) not in ({"literal"}, {"composite"}, {"composite", "sep"}):
        raise SpecError(f"rule {k} emits a featureset, a literal or a composite")
    if "literal" in raw:
        return "literal", str(raw["literal"])
    kind = raw["composite"] if isinstance(raw["composite"], str) else "listed"
    names = {"all": precedence, "when": when_keys, "listed": tuple(raw["composite"])}.get(kind)
    if not names or any(n not in precedence for n in names):
        raise SpecError(f"rule {k} emits a composite of unknown featuresets")
    return "composite", tuple(names), raw.get("sep", SEPARATORS[kind])


#: The named presets.
PRESETS = {
    "priority": {
        "precedence": ["region", "repeat", "subtelomeric"],
        "rules": [
            {"when": {"subtelomeric": ["canonical_telomere", "noncanonical_telomere", "telomere_like", "ITS", "TAR1"]}, "emit": "subtelomeric"},
            {"when": {"region": "@arm"}, "emit": "repeat"},
            {"when": {"region": ["ct"], "repeat": ["nonrepeat"]}, "emit": {"literal": "ct"}},
            {"when": {"region": ["ct"]}, "emit": "repeat"},
            {"when": {"region": ["rDNA"], "repeat": ["rRNA"]}, "emit": "repeat"},
        ],
    },
    "telomere-satellite": {
        "precedence": ["region", "subtelomeric"],
        "rules": [{"when": {"subtelomeric": ["canonical_telomere", "noncanonical_telomere", "telomere_like", "ITS", "TAR1"]}, "emit": "subtelomeric"}],
    },
    "chromosome-acrocentric": {
        "precedence": ["chromosome", "acrocentric"],
        "rules": [{"when": {"acrocentric": ["DJ", "PHR", "rDNA", "SST1", "PJ", "array", "acrocentric"]}, "emit": "acrocentric"}],
    },
    "telomere-acrocentric": {
        "precedence": ["acrocentric", "subtelomeric"],
        "rules": [
            {"when": {"subtelomeric": ["canonical_telomere", "noncanonical_telomere"]}, "emit": "subtelomeric"},
            {"when": {"acrocentric": ["DJ", "PHR", "rDNA"], "subtelomeric": ["ITS", "TAR1"]}, "emit": "composite"},
            {"when": {"subtelomeric": ["ITS", "TAR1"]}, "emit": "subtelomeric"},
        ],
    },
    "chromosome-telomere-satellite": {
        "precedence": ["chromosome", "region", "subtelomeric"],
        "rules": [
            {"when": {"subtelomeric": ["canonical_telomere", "noncanonical_telomere", "telomere_like", "ITS", "TAR1"]}, "emit": {"composite": ["chromosome", "subtelomeric"], "sep": ":"}},
            {"emit": {"composite": ["chromosome", "region"], "sep": ":"}},
        ],
    },
}


def preset_names() -> list[str]:
    return sorted(PRESETS)


def preset(name: str, classes=None) -> Spec:
    return load(PRESETS[name], classes)


def load_yaml(path: str, classes=None) -> Spec:
    import yaml

    with open(path) as f:
        data = yaml.safe_load(f)
    if not isinstance(data, Mapping) or not isinstance(data.get("name"), str):
        raise SpecError(f"{path} needs a name")
    return load(data, classes)
