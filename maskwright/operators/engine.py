"""An engine: recognizers by language, defaults for analysis, and a model to share."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame

from maskwright.operators.analyze import Context, Options, analyze, findings
from maskwright.operators.artifacts import ArtifactRecognizer, Settings
from maskwright.operators.catalog import RECOGNIZERS, Recognizer


class Registry:
    """Recognizers by language, in the order in which they were added: of equal spans of a type the first recognizer's stays."""

    def __init__(self):
        self._by_language: dict[str, list] = {}

    def add(self, recognizer: Recognizer | ArtifactRecognizer, *languages: str) -> None:
        """Adds under the given languages, or the recognizer's own."""
        for language in languages or (recognizer.language,):
            self._by_language.setdefault(language, []).append(recognizer)

    def recognizers(self, language: str, entities: list[str] | None = None) -> list:
        """Those of a language that can give one of the types (None: any). An unknown language has none."""
        return [r for r in self._by_language.get(language, []) if r.supports(entities)]

    def supported_entities(self, language: str) -> list[str]:
        """The types of a language, sorted, each once."""
        return sorted({e for r in self.recognizers(language) for e in ((r.entity,) if isinstance(r, Recognizer) else r.entities or ())})

    def languages(self) -> list[str]:
        return sorted(self._by_language)


class Engine:
    """Analyzes tables of texts with the recognizers of a language; every language has all built-in ones."""

    def __init__(self, *languages: str):
        self.registry = Registry()
        for language in languages or ("en",):
            for r in RECOGNIZERS:
                self.registry.add(r, language)
        self.threshold = 0.0
        self.context: Context | None = Context()
        self._model: tuple[Callable, Settings | None] | None = None

    def set_threshold(self, threshold: float) -> None:
        """Holds for calls that name none."""
        self.threshold = threshold

    def set_context(self, context: Context | None) -> None:
        """None: scores by patterns alone."""
        self.context = context

    def set_model(self, backend: Callable, settings: Settings | None = None) -> None:
        """A model (see artifacts) whose findings artifact recognizers read: it runs once for a text, and only where one of them is wanted."""
        self._model = (backend, settings)

    def languages(self) -> list[str]:
        return self.registry.languages()

    def supported_entities(self, language: str = "en") -> list[str]:
        return self.registry.supported_entities(language)

    def _call(self, language: str, options: Options | None) -> dict:
        o = options or Options()
        context = False if self.context is None or not o.context else self.context if o.context is True else o.context
        chosen = replace(o, recognizers=self.registry.recognizers(language, o.entities), threshold=self.threshold if o.threshold is None else o.threshold, context=context)
        return {"options": chosen} | ({"backend": self._model[0], "settings": self._model[1]} if self._model else {})

    def analyze(self, df: DataFrame, text_column: str = "text", language: str = "en", options: Options | None = None, out: str = "spans") -> DataFrame:
        """Adds the array of spans of each text. A language without recognizers gives none."""
        return analyze(df, text_column, out=out, **self._call(language, options))

    def findings(self, df: DataFrame, id_column: str, text_column: str = "text", language: str = "en", options: Options | None = None, allowed: DataFrame | None = None) -> DataFrame:
        """A row for each span."""
        return findings(df, id_column, text_column, allowed=allowed, **self._call(language, options))


def length(span: Column) -> Column:
    """Bytes of a span."""
    return span["end"] - span["start"]


def intersects(a: Column, b: Column) -> Column:
    """Bytes that two spans share, 0 if none."""
    from pyspark.sql import functions as F

    return F.greatest(F.lit(0), F.least(a["end"], b["end"]) - F.greatest(a["start"], b["start"]))


def contained_in(a: Column, b: Column) -> Column:
    return (a["start"] >= b["start"]) & (a["end"] <= b["end"])


def contains(a: Column, b: Column) -> Column:
    return contained_in(b, a)


def equal_indices(a: Column, b: Column) -> Column:
    return (a["start"] == b["start"]) & (a["end"] == b["end"])
