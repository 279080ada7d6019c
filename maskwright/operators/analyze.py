"""Analysis: a text column in, an array of typed spans out, in narrow native projections."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions.arrays import let, running
from maskwright.functions.checksums import VALIDATORS
from maskwright.functions.patterns import native
from maskwright.functions.regex import WORDS, cleared, cuts, gate, gate_condition, spans_of, to_java, word_pattern
from maskwright.operators.artifacts import ArtifactRecognizer, artifact_spans, with_artifacts
from maskwright.operators.catalog import RECOGNIZERS, Recognizer
from maskwright.operators.custom import lookaround_matches

SPAN = "array<struct<entity_type:string,start:int,end:int,score:double,text:string,recognizer:string>>"
_RAW = "array<struct<entity_type:string,start:int,end:int,score:double,text:string,recognizer:string,ordinal:int>>"
_FIELDS = ("entity_type", "start", "end", "score", "text", "recognizer")
_WORD = r"[\p{L}\p{Nd}\p{M}]"
#: Columns that the operators add and drop.
_OWN = re.compile(r"_(?:text|spans|hits|two|artifacts|found|masked|gate\d+|own\d+)")
#: Literal allowed values that the plan may hold; a longer list is a table (see findings).
MOST_ALLOWED = 10_000


@dataclass(frozen=True)
class Context:
    """Words near a span that name its type raise its score by `boost`, to `floor` at least and 1 at most. before, after: how many words count on either side (negative: none)."""

    boost: float = 0.35
    floor: float = 0.4
    before: int = 5
    after: int = 0


@dataclass(frozen=True)
class Options:
    """entities: None for all, an empty list for none. threshold: spans below it go (0: none; None: what the engine names, or none). allow: texts that are never findings; allow_regex: patterns of them, searched anywhere in the span (where they don't compile, they count as texts). context: False to score by patterns alone."""

    entities: list[str] | None = None
    threshold: float | None = None
    allow: list[str] = field(default_factory=list)
    allow_regex: list[str] = field(default_factory=list)
    context: bool | Context = True
    recognizers: list[Recognizer | ArtifactRecognizer] = field(default_factory=lambda: list(RECOGNIZERS))

    def __post_init__(self):
        if len(self.allow) > MOST_ALLOWED:
            raise ValueError(f"more than {MOST_ALLOWED} allowed texts; pass them to findings as a table")


def split_words(phrase: str) -> list[str]:
    """The lower-case words of a context phrase."""
    return re.findall(r"[^\W_]+", phrase.lower())


#: What is known of a hit before recognizers look at it. near: the words around it, in lower case between spaces; label: the same of the 24 bytes before it, where a word cut by their left edge counts as it is.
HIT = "struct<start:int,end:int,text:string,near:string,label:string,before:string>"


def _known(context: Context | None, labels: bool, before: bool, raw: Column | None):
    """A function that makes a HIT of a span and what precedes it; parts that nothing reads are null."""
    none = F.lit(None).cast("string")
    words = lambda text: F.regexp_extract_all(F.lower(text), F.lit(_WORD + "+"), F.lit(0))

    def made(start: Column, end: Column, hit: Column, preceding: Column) -> Column:
        def known(prior: Column) -> Column:
            near, label = none, none
            if context:
                around = F.array().cast("array<string>")
                if context.before > 0:
                    # a word that runs into the span is cut off and doesn't count
                    left = F.when(hit.rlike("^" + _WORD), F.regexp_replace(prior, _WORD + "++$", "")).otherwise(prior)
                    around = let(words(left), lambda w: F.slice(w, F.greatest(F.size(w) - (context.before - 1), F.lit(1)), F.lit(context.before)))
                if context.after > 0:
                    # as many bytes as hold the words wanted unless these are very long
                    after = F.substring(raw, end + 1, F.lit(120 * (context.after + 1))).cast("string")
                    after = F.when(hit.rlike(_WORD + "$"), F.regexp_replace(after, "^" + _WORD + "++", "")).otherwise(after)
                    around = F.concat(around, F.slice(words(after), 1, context.after))
                near = F.concat(F.lit(" "), F.array_join(around, " "), F.lit(" "))
            if labels:
                label = F.lower(F.substring(prior.cast("binary"), F.greatest(F.octet_length(prior) - 23, F.lit(1)), F.lit(24)).cast("string"))
                label = F.concat(F.lit(" "), F.regexp_replace(label, r"[^\p{L}\p{Nd}]+", " "), F.lit(" "))
            return F.struct(start.alias("start"), end.alias("end"), hit.alias("text"), near.alias("near"), label.alias("label"), (prior if before else none).alias("before"))

        return let(preceding, known) if context or labels or before else known(none)

    return made


def has_context(near: Column, phrases: list[str]) -> Column:
    """Whether one of the phrases, its words in the singular or plural, is among the words."""
    ways = "|".join(" ".join(re.escape(w) + "(?:s|es)?" for w in split_words(p)) for p in phrases)
    return near.rlike(f" (?:{ways}) ")


def _scored(r: Recognizer, ordinal: int, score: float, context: Context | None):
    """A function from a HIT to a span."""

    def made(x: Column) -> Column:
        worth = F.lit(score)
        if context and r.context and not r.validator:
            raised = min(1.0, max(score + context.boost, min(max(context.floor, 0.0), 1.0)))
            worth = F.when(has_context(x["near"], r.context), F.lit(raised)).otherwise(worth)
        return F.struct(F.lit(r.entity).alias("entity_type"), x["start"].alias("start"), x["end"].alias("end"), worth.alias("score"), x["text"].alias("text"), F.lit(r.name).alias("recognizer"), F.lit(ordinal).alias("ordinal"))

    return made


def _recognized(r: Recognizer, ordinal: int, hits: list[Column], context: Context | None) -> list[Column]:
    """The spans of each pattern: checked, by label, scored. Those of score 0 go before context words could raise them."""
    spans = []
    for p, ((score, _, _), found) in enumerate(zip(r.patterns, hits, strict=True)):
        if r.validator:
            check = VALIDATORS[r.validator] if isinstance(r.validator, str) else r.validator
            found, score = F.filter(found, lambda x: F.coalesce(check(x["text"]), F.lit(False))), 1.0
        if score <= 0:
            continue
        if r.labels:
            found = F.filter(found, lambda x: x["label"].rlike("(?: " + " | ".join(map(re.escape, r.labels)) + " )"))
        if r.accepts:
            found = F.filter(found, lambda x: F.coalesce(r.accepts(x), F.lit(False)))
        made = F.transform(found, _scored(r, ordinal * 10 + p, score, context))
        # a context may lower scores, and a span of score 0 must not hide another
        lowered = context and r.context and not r.validator and score + context.boost <= 0 and context.floor <= 0
        spans.append(F.filter(made, lambda x: x["score"] > 0) if lowered else made)
    return spans


def dedup(spans: Column) -> Column:
    """Of spans of one type, those that no other contains; of equal ones the first. They are sorted by start, the longest first, so a span is contained if one before it ends as late."""
    keyed = F.array_sort(F.transform(spans, lambda x: F.struct(x["entity_type"].alias("t"), x["start"].alias("a"), (-x["end"]).alias("b"), x["ordinal"].alias("o"), x.alias("x"))))

    def far(acc: Column, k: Column) -> Column:
        same = acc["t"] == k["t"]
        return F.struct(k["t"].alias("t"), F.when(same, F.greatest(acc["far"], -k["b"])).otherwise(-k["b"]).alias("far"))

    def kept(ks: Column) -> Column:
        reach = running(ks, F.struct(F.lit("").alias("t"), F.lit(-1).alias("far")), "struct<t:string,far:int>", far)
        beaten = lambda k, seen: (seen["t"] == k["t"]) & (seen["far"] >= -k["b"])
        return let(reach, lambda rs: F.transform(F.filter(ks, lambda k, i: (i == 0) | ~F.coalesce(beaten(k, F.get(rs, i - 1)), F.lit(False))), lambda k: k["x"]))

    return let(keyed, kept)


def ordered(spans: Column) -> Column:
    """By falling score, then start, then falling length, then registration."""
    keyed = F.transform(spans, lambda x: F.struct((-x["score"]).alias("a"), x["start"].alias("b"), (-x["end"]).alias("c"), x["ordinal"].alias("d"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda k: F.struct(*(k["x"][c].alias(c) for c in _FIELDS)))


_expressions: dict = {}


def _built(key: tuple, make) -> Column:
    """make(), once for each running Spark context: the expressions name columns and so serve any table."""
    key = (id(SparkContext._active_spark_context), *key)
    if key not in _expressions:
        _expressions[key] = make()
    return _expressions[key]


def compiles(pattern: str) -> bool:
    """Whether the JVM takes the pattern."""
    try:
        SparkContext._active_spark_context._jvm.java.util.regex.Pattern.compile(pattern)
    except (IllegalArgumentException, Py4JJavaError):
        return False
    return True


def _allowed(o: Options):
    """A condition on spans that allowed texts don't meet, or None."""
    allow, pattern = list(o.allow), None
    if o.allow_regex:
        pattern = to_java("|".join(o.allow_regex))
        if not compiles(pattern):
            allow, pattern = allow + list(o.allow_regex), None
    if not allow and pattern is None:
        return None

    def stays(x: Column) -> Column:
        out = ~x["text"].isin(*allow) if allow else F.lit(True)
        return out & ~x["text"].rlike(pattern) if pattern is not None else out

    return stays


def set_aside(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with columns that are called as the operators' own renamed, and the names to give back."""
    given, k = {}, 0
    for name in df.columns:
        if _OWN.fullmatch(name.lower()):
            while f"_kept{k}" in map(str.lower, df.columns):
                k += 1
            given[f"_kept{k}"] = name
            k += 1
    return df.withColumnsRenamed({name: held for held, name in given.items()}), given


def analyze(df: DataFrame, text_column: str = "text", options: Options | None = None, out: str = "spans", backend=None, settings=None) -> DataFrame:
    """Adds the array of spans (byte offsets, half open) of the text column. A null text has no spans; nothing is shuffled.

    Each distinct pattern is scanned once, behind a cheap condition that texts with a match meet. Time follows the text's size, whatever it holds. backend (see artifacts): a model, run once for each text, and only if a chosen recognizer reads what it finds; where it fails, patterns still apply.
    """
    o = options or Options()
    df, given = set_aside(df)
    text_column = {name.lower(): held for held, name in given.items()}.get(text_column.lower(), text_column)
    context = (Context() if o.context is True else o.context) or None
    chosen = [(i, r) for i, r in enumerate(o.recognizers) if r.supports(o.entities)]
    patterned = [(i, r) for i, r in chosen if isinstance(r, Recognizer)]
    modelled = [(i, r) for i, r in chosen if isinstance(r, ArtifactRecognizer)] if backend is not None else []
    if not patterned and not modelled:
        return df.withColumn(out, F.array().cast(SPAN)).withColumnsRenamed(given)
    if modelled:
        df = with_artifacts(df, backend, text_column, settings, "_artifacts")
    text = F.col("_text")
    df = df.withColumn("_text", cleared(F.col(text_column)))
    scans = list(dict.fromkeys(s if _word(s) is None else WORDS for _, r in patterned for s in scans_of(r)))
    native, own = [s for s in scans if not s[2]], {s: f"_own{i}" for i, s in enumerate(s for s in scans if s[2])}
    gates = {g: f"_gate{i}" for i, g in enumerate(dict.fromkeys(gate(rx) for rx, _, _ in native))}
    if any(g[0] == "digits" and int(g[1]) > 1 for g in gates):
        df = df.withColumn("_two", text.rlike("[0-9]{2}"))
    df = df.withColumns({name: gate_condition(g, text, F.col("_two")) for g, name in gates.items()} | {name: lookaround_matches(rx, g, text) for (rx, g, _), name in own.items()})
    labels, before = any(r.labels for _, r in patterned), any(r.accepts for _, r in patterned)
    boosted = context if any(r.context and not r.validator for _, r in patterned) else None

    def all_hits(raw: Column | None) -> Column:
        known = _known(boosted, labels, before, raw)
        cut = F.array(*(cuts(rx, g, text, F.col(gates[gate(rx)])) for rx, g, _ in native))
        out = [F.transform(cut, lambda parts: spans_of(parts, known))] if native else []
        return F.concat(*out, *(F.array(F.transform(name, lambda x: known(x["start"], x["end"], x["text"], x["before"]))) for name in own.values()))

    after = boosted is not None and boosted.after > 0
    hits = _built(("hits", tuple(scans), boosted, labels, before), lambda: let(text.cast("binary"), all_hits) if after else all_hits(None))
    df = df.withColumn("_hits", hits.cast(f"array<array<{HIT}>>")) if patterned else df
    place = {s: k for k, s in enumerate([*native, *own])}

    def hits_of(scan: tuple, none: Column) -> Column:
        word = _word(scan)
        found = F.coalesce(F.get("_hits", F.lit(place[scan if word is None else WORDS])), none)
        return found if word is None else F.filter(found, lambda x: x["text"].rlike(word))

    def all_spans() -> Column:
        """By type: a type of one pattern has nothing to compare."""
        by_type: dict[str, list[Column]] = {}
        none = F.array().cast(f"array<{HIT}>")
        for i, r in patterned:
            if found := _recognized(r, i, [hits_of(s, none) for s in scans_of(r)], boosted):
                by_type.setdefault(r.entity, []).extend(found)
        types = [x[0] if len(x) == 1 else F.concat(*x) for x in by_type.values()]
        single = F.concat(*(t for t, x in zip(types, by_type.values(), strict=True) if len(x) == 1), F.array().cast(_RAW))
        several = [t.cast(_RAW) for t, x in zip(types, by_type.values(), strict=True) if len(x) > 1]
        if not several:
            return single
        return F.concat(single, F.flatten(F.transform(F.array(*several), lambda s: F.when(F.size(s) > 1, dedup(s)).otherwise(s))))

    spans = _built(("spans", repr(patterned), boosted, tuple(place.items())), all_spans)
    if modelled:
        found = [F.transform(artifact_spans(F.col(text_column), F.col("_artifacts"), r.wanted(o.entities), r.name), _numbered(i * 10)) for i, r in modelled]
        spans = dedup(F.concat(spans, *(F.filter(x.cast(_RAW), lambda y: y["score"] > 0) for x in found)))
    df = df.withColumn("_spans", spans).drop("_two", *gates.values(), *own.values(), "_hits", "_artifacts")
    spans = F.col("_spans")
    if o.threshold:
        spans = F.filter(spans, lambda x: x["score"] >= o.threshold)
    if stays := _allowed(o):
        spans = F.filter(spans, stays)
    return df.withColumn(out, ordered(spans).cast(SPAN)).drop("_spans", "_text").withColumnsRenamed(given)


def _numbered(ordinal: int):
    return lambda x: F.struct(*(x[c].alias(c) for c in _FIELDS), F.lit(ordinal).alias("ordinal"))


def _word(scan: tuple[str, int, bool]) -> str | None:
    """What picks the scan's matches from the words with a digit, if these hold them all."""
    return None if scan[1] or scan[2] else word_pattern(scan[0])


def scans_of(r: Recognizer) -> list[tuple[str, int, bool]]:
    """The patterns of a recognizer, their groups, and whether Python must run them."""
    return [(rx, g, r.lookaround and native(rx, g) is None) for _, rx, g in r.patterns]


def rows_of(analyzed: DataFrame, *columns: str) -> DataFrame:
    """A row for each span s. The outer form keeps the optimizer from copying the whole analysis into a filter below it."""
    return analyzed.select(*columns, F.explode_outer("spans").alias("s")).filter("s is not null")


def findings(df: DataFrame, id_column: str, text_column: str = "text", options: Options | None = None, allowed: DataFrame | None = None, backend=None, settings=None) -> DataFrame:
    """One row per span: id, entity_type, start, end, score, text, recognizer. allowed: a table whose first column has texts that are never findings, of any size (Spark broadcasts it only if it is small)."""
    found = rows_of(analyze(df.select(id_column, text_column), text_column, options, backend=backend, settings=settings), id_column).select(id_column, "s.*")
    if allowed is not None:
        found = found.join(allowed.select(F.col(allowed.columns[0]).alias("text")).filter("text is not null").distinct(), "text", "left_anti").select(found.columns)
    return found
