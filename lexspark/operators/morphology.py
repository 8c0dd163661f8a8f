"""Features, categories, feature vectors and paradigms."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fst import Fst, as_fst, closure, concat, cross, difference, invert, union
from .rules import BYTE


@dataclass(frozen=True)
class Feature:
    name: str
    values: tuple[str, ...]

    @property
    def acceptor(self) -> Fst:
        return union(*(f"[{self.name}={v}]" for v in self.values))


@dataclass(frozen=True)
class Category:
    """Features in the order of their names."""

    features: tuple[Feature, ...]

    @staticmethod
    def of(*features: Feature) -> Category:
        return Category(tuple(sorted(features, key=lambda f: f.name)))


@dataclass(frozen=True)
class FeatureVector:
    """Values for some features of a category; those not given stand for any."""

    category: Category
    given: tuple[tuple[str, str], ...] = ()

    @staticmethod
    def of(category: Category, *settings: str) -> FeatureVector:
        given = dict(s.split("=", 1) for s in settings)
        known = {f.name: f.values for f in category.features}
        for k, v in given.items():
            if k not in known or v not in known[k]:
                raise ValueError(f"no such feature value: {k}={v}")
        return FeatureVector(category, tuple(sorted(given.items())))

    def unify(self, other: FeatureVector) -> FeatureVector | None:
        """Both together; None if they differ in a value or in the category."""
        if self.category != other.category:
            return None
        a, b = dict(self.given), dict(other.given)
        if any(a[k] != b[k] for k in a.keys() & b.keys()):
            return None
        return FeatureVector(self.category, tuple(sorted((a | b).items())))

    def values(self) -> list[dict[str, str]]:
        """All complete settings that it stands for."""
        given = dict(self.given)
        ways = [[given[f.name]] if f.name in given else list(f.values) for f in self.category.features]
        return [dict(zip((f.name for f in self.category.features), w, strict=True)) for w in product(*ways)]

    @property
    def acceptor(self) -> Fst:
        return union(*(concat("", *(f"[{k}={v}]" for k, v in row.items())) for row in self.values()))


def unified(a: str = "a", b: str = "b"):
    """Two map columns together; null if they differ in a value."""
    both = F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, y))
    clash = F.exists(F.map_keys(a), lambda k: F.try_element_at(F.col(b), k).isNotNull() & (F.try_element_at(F.col(b), k) != F.try_element_at(F.col(a), k)))
    return F.when(~clash, both)


def stem_plus(suffix: str) -> tuple[str, str]:
    """A slot's rule that adds a suffix."""
    return ("suffix", suffix)


def prefix_plus(prefix: str) -> tuple[str, str]:
    return ("prefix", prefix)


@dataclass
class Paradigm:
    """Slots are (rule, feature vector); a child's slots stand before its parent's of the same features."""

    name: str
    category: Category
    slots: list[tuple[tuple[str, str], FeatureVector]]
    stems: list[str] = field(default_factory=list)
    parent: Paradigm | None = None
    boundary: str = "+"

    def all_slots(self) -> list[tuple[tuple[str, str], FeatureVector]]:
        own = {v for _, v in self.slots}
        return self.slots + [(r, v) for r, v in (self.parent.all_slots() if self.parent else []) if v not in own]

    def rows(self) -> list[tuple[str, str, str, str]]:
        """(stem, features, form, segmented form) for each stem and slot."""
        out = []
        for stem in self.stems:
            for (kind, piece), v in self.all_slots():
                form, cut = (stem + piece, stem + self.boundary + piece) if kind == "suffix" else (piece + stem, piece + self.boundary + stem)
                out.append((stem, "".join(f"[{k}={x}]" for k, x in v.given), form, cut))
        return out

    def forms(self, spark: SparkSession) -> DataFrame:
        """The lookup table of the paradigm; a few rows for each stem."""
        return spark.createDataFrame(self.rows(), "stem string, features string, form string, segmented string")

    # As rules: the transducers from forms and back.
    @property
    def inflector(self) -> Fst:
        """Lemma and features to the form."""
        lemma = self.lemma_form()
        return union(*(cross(concat(lemma[stem], features), form) for stem, features, form, _ in self.rows()))

    @property
    def analyzer(self) -> Fst:
        """Form to segmented form and features."""
        return union(*(cross(form, concat(cut, features)) for _, features, form, cut in self.rows()))

    @property
    def tagger(self) -> Fst:
        return union(*(cross(form, concat(form, features)) for _, features, form, _ in self.rows()))

    @property
    def lemmatizer(self) -> Fst:
        """Form to lemma and features."""
        return invert(self.inflector)

    def lemma_form(self) -> dict[str, str]:
        """The form of the first slot of each stem."""
        (kind, piece), _ = self.all_slots()[0]
        return {s: s + piece if kind == "suffix" else piece + s for s in self.stems}


def inflect(words: DataFrame, paradigm: Paradigm, column: str = "stem") -> DataFrame:
    """A row for each slot of each stem of a column: slots are few and fixed, so they are sent to all; no stem list is needed."""
    slots = [(kind, piece, "".join(f"[{k}={x}]" for k, x in v.given)) for (kind, piece), v in paradigm.all_slots()]
    table = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(p).alias("piece"), F.lit(f).alias("features")) for k, p, f in slots))
    rows = words.select("*", F.explode(table).alias("_s"))
    form = F.when(F.col("_s.kind") == "suffix", F.concat(column, F.col("_s.piece"))).otherwise(F.concat(F.col("_s.piece"), F.col(column)))
    return rows.select(*words.columns, F.col("_s.features").alias("features"), form.alias("form"))


def analyze(words: DataFrame, forms: DataFrame, column: str = "form") -> DataFrame:
    """Each word with its stems and features, by a join on the form."""
    return words.join(forms.withColumnRenamed("form", "_form"), F.col(column) == F.col("_form"), "left").drop("_form")


def bytes_but(boundary: str = "+") -> Fst:
    """Any string without the boundary."""
    return closure(difference(BYTE, as_fst(boundary)))


def _vector(category: Category, *settings: str) -> FeatureVector:
    return FeatureVector.of(category, *settings)


def _unsupported(name: str):
    def fail(*_):
        raise NotImplementedError(f"{name} of the rule language isn't supported: Paradigm inflects, analyses and lemmatises columns")

    return fail


#: What the rule language calls.
GRAMMAR = {
    "Feature": lambda name, *values: Feature(name if isinstance(name, str) else name.string(), tuple(v if isinstance(v, str) else v.string() for v in values)),
    "Category": lambda *features: Category.of(*features),
    "FeatureVector": lambda category, *settings: _vector(category, *(s if isinstance(s, str) else s.string() for s in settings)),
    "Analyzer": _unsupported("Analyzer"),
    "Tagger": _unsupported("Tagger"),
    "ParadigmReplace": _unsupported("ParadigmReplace"),
}
