import io
import json
import random
import time

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from maskwright import __main__ as cli
from maskwright.functions import regex as rx
from maskwright.functions.arrays import running
from maskwright.functions.checksums import VALIDATORS
from maskwright.operators import anonymize as anon
from maskwright.operators import artifacts as art
from maskwright.operators import backends, custom, hooks, json_masking
from maskwright.operators.analyze import Context, Options, analyze, findings
from maskwright.operators.artifacts import ArtifactRecognizer
from maskwright.operators.catalog import RECOGNIZERS, Recognizer
from maskwright.operators.engine import Engine, contained_in, contains, equal_indices, intersects, length
from maskwright.plans import sql, vectors
from maskwright.sources import models


def found(df, **options):
    return [[(s.entity_type, s.text, round(s.score, 4)) for s in r.spans] for r in analyze(df, options=Options(**options)).collect()]


def texts(spark, *rows):
    return spark.createDataFrame([(r,) for r in rows], "text string").coalesce(1)


def test_patterns_match_as_re2(spark):
    """All patterns and their gates on random strings of test values and hostile separators."""
    r = random.Random(11)
    values = [v for pairs in vectors.VALUES.values() for _, v in pairs if v]
    odd = [" ", "", "-", ".", "\t", "\n", "\u00a0", "\u202f", "\u3000", "\u0085", "\u200b", "é", "ſ", "\u212a", "😀", "_", "a", "7", "+", "(", ")", "@", "'", "\u000b", "..", "\r", "?", ":"]
    rows = ["".join(r.choice(values) if r.random() < 0.6 else r.choice(odd) + "".join(r.choice("aZ09.-+@ (") for _ in range(r.randint(0, 4))) for _ in range(r.randint(1, 8))) for _ in range(400)]
    scans = list(dict.fromkeys((p, g) for q in RECOGNIZERS for _, p, g in q.patterns))
    two = F.col("t").rlike("[0-9]{2}")
    columns = [c for k, (p, g) in enumerate(scans) for c in (F.regexp_replace("t", *rx.marking(p, g)).alias(f"m{k}"), rx.gate_condition(rx.gate(p), F.col("t"), two).alias(f"g{k}"))]
    got = {x.i: x for x in spark.createDataFrame(list(enumerate(rows)), "i int, t string").select("i", *columns).collect()}
    db, total = duckdb.connect(), 0
    db.register("d", pd.DataFrame({"i": range(len(rows)), "t": rows}))
    for k, (p, g) in enumerate(scans):
        pattern = rx.to_duckdb(p)
        marked = pattern.replace("(?:^|\\W)(", "((?:^|\\W))(", 1) if g else f"({pattern})"
        for i, want in db.execute(f"SELECT i, regexp_replace(t, '{marked}', '{chr(92)}1{rx.OPEN}{chr(92)}2{rx.CLOSE}' , 'g') FROM d" if g else f"SELECT i, regexp_replace(t, '{marked}', '{rx.OPEN}{chr(92)}1{rx.CLOSE}', 'g') FROM d").fetchall():
            assert got[i][f"m{k}"] == want, p
            assert got[i][f"g{k}"] or rx.OPEN not in want
            total += want.count(rx.OPEN)
    assert total > 500


def test_words_are_whole():
    assert rx.word_pattern(r"\b[A-Z]\d{7}\b") == r"^[A-Z]\d{7}$"
    assert rx.word_pattern(r"\b[A-Z0-9]{7}\b") is None and rx.word_pattern(r"\b\d{3}-\d{2}\b") is None


def test_running_sums(spark):
    df = spark.createDataFrame([(list(range(n)),) for n in (0, 1, 127, 128, 129, 1000)], "a array<int>")
    for r in df.select("a", running(F.col("a"), F.lit(0), "int", lambda s, x: s + x).alias("s")).collect():
        assert r.s == [k * (k + 1) // 2 for k in range(len(r.a))]


def test_time_follows_the_size(spark):
    mails = {"entities": ["EMAIL_ADDRESS"]}
    for text, n in (("a." * 500_000 + " x@y.com", 1), ("a-" * 500_000 + " x@y.com", 1), (" ".join(f"u{i}@example.com" for i in range(20_000)), 20_000)):
        began = time.time()
        assert analyze(texts(spark, text), options=Options(**mails)).select(F.size("spans")).first()[0] == n
        assert time.time() - began < 20


def test_dedup_keeps_the_widest_and_the_first(spark):
    own = [Recognizer("T", "A", "en", [(0.3, r"\b\d{4}\b", 0), (0.9, r"\b\d{4}-\d{4}\b", 0)]), Recognizer("T", "B", "en", [(1.0, r"\b\d{4}\b", 0), (0.5, r"\b\d{4}-x\b", 0)]), Recognizer("U", "C", "en", [(0.2, r"\b\d{4}\b", 0)])]
    df = texts(spark, "1234-5678 4321 1111-x")
    got = [(s.entity_type, s.text, s.recognizer) for s in analyze(df, options=Options(recognizers=own)).first().spans]
    assert got == [("T", "1234-5678", "A"), ("T", "1111-x", "B"), ("T", "4321", "A"), ("U", "1234", "C"), ("U", "5678", "C"), ("U", "4321", "C"), ("U", "1111", "C")]


@pytest.mark.parametrize(
    ("context", "text", "score"),
    [
        (Context(), "email addresses of a b c j@x.com", 0.5), (Context(), "emails a b c d j@x.com", 0.85), (Context(before=1), "email a j@x.com", 0.5), (Context(before=0, after=2), "j@x.com is mail", 0.85),
        (Context(before=-3, after=-1), "email j@x.com email", 0.5), (Context(boost=9.0), "email j@x.com", 1.0), (Context(boost=-9.0, floor=-5.0), "email j@x.com", None), (Context(boost=0.0, floor=7.0), "email j@x.com", 1.0), (Context(), "emailj@x.com", 0.5), (Context(), "x" * 3000 + " email j@x.com", 0.85), (Context(), "email " + "y" * 3000 + " j@x.com", 0.85),
    ],
)
def test_context(spark, context, text, score):
    got = found(texts(spark, text), entities=["EMAIL_ADDRESS"], context=context)[0]
    assert [s for _, _, s in got] == ([score] if score else [])


def test_scores_of_zero(spark):
    """They go before context words could raise them, and hide nothing."""
    own = [Recognizer("T", "A", "en", [(0.0, r"\b\d{4}-\d{4}\b", 0), (0.5, r"\b\d{4}\b", 0)], ["code"]), Recognizer("U", "B", "en", [(0.0, r"\b\d{4}\b", 0)], ["code"])]
    assert found(texts(spark, "code 1234-5678"), recognizers=own) == [[("T", "1234", 0.85), ("T", "5678", 0.85)]]
    lower = Context(boost=-0.5, floor=0.0)
    wide = [Recognizer("T", "A", "en", [(0.4, r"\b\d{4}-\d{4}\b", 0)], ["code"]), Recognizer("T", "B", "en", [(0.3, r"\b\d{4}\b", 0)])]
    assert found(texts(spark, "code 1234-5678"), recognizers=wide, context=lower) == [[("T", "1234", 0.3), ("T", "5678", 0.3)]]


def test_columns_of_the_same_names(spark):
    names = ["_text", "_spans", "_HITS", "_gate0", "_two", "_found", "_masked", "_kept0", "_own1", "_artifacts"]
    df = spark.createDataFrame([("j@x.com", *names[1:])], names)
    r = analyze(df, "_text", Options(entities=["EMAIL_ADDRESS"])).first().asDict()
    assert list(r) == [*names, "spans"] and [s.text for s in r["spans"]] == ["j@x.com"] and all(r[n] == n for n in names[1:])
    assert analyze(df, "_text", Options(entities=[])).columns == [*names, "spans"]
    guarded = json_masking.guard_prompts(df, "_text", options=Options(entities=["EMAIL_ADDRESS"]))
    assert guarded.columns == [*names, "decision", "summary", "masked"] and guarded.first().decision == "warn"


def test_labels(spark):
    got = found(texts(spark, "CEP: 01310100", "zip 01310100", "01310100", "zip" + " " * 30 + "01310100", "azip 01310100"), entities=["BR_CEP"])
    assert [len(g) for g in got] == [1, 1, 0, 0, 0]


def test_allow_lists(spark):
    df = texts(spark, "10.0.0.1 and 8.8.8.8 and (")
    only = {"entities": ["IP_ADDRESS"]}
    assert [t for _, t, _ in found(df, allow=["10.0.0.1"], **only)[0]] == ["8.8.8.8"]
    assert [t for _, t, _ in found(df, allow_regex=["^10", "x"], **only)[0]] == ["8.8.8.8"]
    assert [t for _, t, _ in found(df, allow_regex=["10.0.0.1", "("], **only)[0]] == ["8.8.8.8"]
    allowed = spark.createDataFrame([("8.8.8.8",), (None,), ("8.8.8.8",)], "v string")
    assert [r.text for r in findings(df.withColumn("id", F.lit(1)), "id", options=Options(**only), allowed=allowed).collect()] == ["10.0.0.1"]
    with pytest.raises(ValueError, match="table"):
        Options(allow=["x"] * 10_001)


def test_accepts_and_matches_without_text(spark):
    own = [custom.recognizer("N", [(0.5, r"\d+", 0)], accepts=lambda s: s["before"].endswith("n=")), custom.recognizer("E", [(0.5, r"q*", 0)]), Recognizer("Z", "Z", "en", [(0.0, r"\b\d+\b", 0)])]
    assert found(texts(spark, "n=12 m=34"), recognizers=own) == [[("N", "12", 0.5)]]


def test_engine(spark):
    def model():
        return lambda batch: [[("PER", t.index("Ann"), t.index("Ann") + 3, 0.9)] if "Ann" in t else [] for t in batch]

    e = Engine("en", "pt")
    assert e.languages() == ["en", "pt"] and len(e.supported_entities("pt")) == 51 and e.supported_entities("xx") == []
    df = texts(spark, "Ann at a@example.com", None)
    kinds = lambda **k: [[s.entity_type for s in r.spans] for r in e.analyze(df, **k).collect()]
    assert kinds() == [["EMAIL_ADDRESS"], []] and kinds(language="xx") == [[], []]
    e.set_threshold(0.6)
    assert kinds() == [[], []] and kinds(options=Options(threshold=0.1)) == [["EMAIL_ADDRESS"], []]
    assert kinds(options=Options(threshold=0.0)) == kinds(options=Options(threshold=0.1)) and kinds(options=Options()) == [[], []]
    e.set_threshold(0.0)
    e.registry.add(ArtifactRecognizer(("PERSON",)), "en")
    e.set_model(model, art.Settings(mapping={"PER": "PERSON"}))
    assert kinds() == [["PERSON", "EMAIL_ADDRESS"], []] and kinds(language="pt") == [["EMAIL_ADDRESS"], []]

    def unwanted():
        raise AssertionError("the model isn't needed")

    e.set_model(unwanted)
    assert kinds(options=Options(entities=["EMAIL_ADDRESS"])) == [["EMAIL_ADDRESS"], []] and kinds(options=Options(entities=[])) == [[], []]
    e.set_context(None)
    assert [s.score for s in e.analyze(texts(spark, "email a@example.com"), options=Options(entities=["EMAIL_ADDRESS"])).first().spans] == [0.5]


def test_span_algebra(spark):
    kind = "struct<start:int,end:int>"
    a, b = F.col("a"), F.col("b")
    rows = spark.createDataFrame([((1, 5), (3, 9)), ((1, 3), (3, 4)), ((2, 4), (1, 9)), ((1, 2), (1, 2))], f"a {kind}, b {kind}")
    got = rows.select(length(a), intersects(a, b), contained_in(a, b), contains(b, a), equal_indices(a, b)).collect()
    assert [tuple(r) for r in got] == [(4, 2, False, False, False), (2, 0, False, False, False), (2, 2, True, True, False), (1, 1, True, True, True)]


def test_checks_against_sql(spark):
    """Each check on its own test values, next to their neighbours in the last place."""
    db = duckdb.connect()
    rules, by_name = sql.validators(), {r.validator: r for r in RECOGNIZERS if r.validator}
    assert set(rules) == set(by_name) == set(VALIDATORS)
    for name, r in by_name.items():
        values = [v for _, v in vectors.VALUES[r.entity] if v]
        values += [v[:-1] + c for v in values for c in "0123456789ABKTZ" if c.isdigit() == v[-1].isdigit()]
        full = [v for v in values if any(__import__("re").fullmatch(p.removeprefix(r"\b").removesuffix(r"\b").replace(r"\p{Zs}", " "), v) for _, p, _ in r.patterns)]
        got = [x.v for x in spark.createDataFrame([(v,) for v in full], "t string").coalesce(1).select(F.coalesce(VALIDATORS[name](F.col("t")), F.lit(False)).alias("v")).collect()]
        db.register("x", pd.DataFrame({"i": range(len(full)), "text": full}))
        want = [x for (x,) in db.execute(f"SELECT coalesce({rules[name]}, false) FROM (SELECT i, text, [CAST(c AS INT) FOR c IN string_split(regexp_replace(text, '[^0-9]', '', 'g'), '') IF c <> ''] AS d FROM x) ORDER BY i").fetchall()]
        assert got == want and any(want) and not all(want), name


def test_anonymize_many_spans(spark):
    """Random spans against a plain account of the rule."""
    r = random.Random(3)
    text = "".join(r.choice("abcdé😀") for _ in range(120))
    size, rows = len(text.encode()), []
    for _ in range(30):
        spans = [(r.choice("PQ"), a := r.randint(-3, size), a + r.randint(0, 12), r.choice([0.1, 0.5, 0.9]), "", "") for _ in range(r.randint(0, 40))]
        rows.append((text, spans))
    df = spark.createDataFrame(rows, "text string, spans array<struct<entity_type:string,start:int,end:int,score:double,text:string,recognizer:string>>").coalesce(1)
    got = [[(p.start, p.end, p.entity_type) for p in x.p] for x in df.select(anon.resolve(F.col("text"), F.col("spans")).alias("p")).collect()]
    for (_, spans), pieces in zip(rows, got, strict=True):
        owner: dict[int, int] = {}
        cut = sorted(((max(0, a), min(b, size), t, s) for t, a, b, s, _, _ in spans if max(0, a) < min(b, size)), key=lambda x: (-x[3], x[0] - x[1], x[0], x[1], x[2]))
        for k, (a, b, _, _) in enumerate(cut):
            for i in range(a, b):
                owner.setdefault(i, k)
        want, last = [], None
        for i in sorted(owner):
            if last is not None and owner[i] == last and want[-1][1] == i:
                want[-1][1] = i + 1
            else:
                want.append([i, i + 1, cut[owner[i]][2]])
            last = owner[i]
        assert pieces == [tuple(w) for w in want]


def test_hooks(spark, capsys):
    o = Options(entities=["EMAIL_ADDRESS"], threshold=0.4)
    event = json.dumps({"tool_name": "Grep", "tool_response": {"out": "to jane@example.com", "path": "/a@example.com"}}).encode()
    told = json.loads(hooks.tool_event(spark, event, options=o))["hookSpecificOutput"]
    assert told["updatedToolOutput"] == {"out": "to ja************om", "path": "/a@example.com"} and "EMAIL_ADDRESS ×1" in told["additionalContext"]
    assert hooks.tool_event(spark, event, ("Grep",), options=o) is None and hooks.tool_event(spark, b"no json") is None and hooks.tool_event(spark, b"[]") is None
    chain = """python3 -c 'print("{\\"hookSpecificOutput\\": {\\"updatedToolOutput\\": \\"x@example.com\\", \\"additionalContext\\": \\"first\\"}}")'"""
    told = json.loads(hooks.tool_event(spark, event, chain=chain, options=o))["hookSpecificOutput"]
    assert told["updatedToolOutput"] == "x@*********om" and told["additionalContext"].startswith("first ")
    assert json.loads(hooks.tool_event(spark, event, ("Grep",), chain, o))["hookSpecificOutput"]["updatedToolOutput"] == "x@example.com"
    assert hooks.rewritten("false", b"") is None and hooks.rewritten("no-such-program", b"") is None
    prompt = json.dumps({"prompt": "mail jane@example.com"}).encode()
    assert json.loads(hooks.prompt_event(spark, prompt, "block", o))["decision"] == "block" and "systemMessage" in json.loads(hooks.prompt_event(spark, prompt, options=o))
    assert hooks.prompt_event(spark, b"{}") is None
    assert hooks.answer(spark, "prompt", io.BytesIO(b"x" * (hooks.MOST_BYTES + 1))) is None and "passes" in capsys.readouterr().err
    assert cli.main(["version"], spark) == 0


def test_backends_and_windows(tmp_path):
    assert backends.BackendConfig("", "", {}, (1,), (8,)).checked() == backends.BackendConfig("go", "", {}, (1,), (8,))
    assert backends.BackendConfig("ORT", "CUDA", {}, (1,), (8,)).checked().batch_buckets == ()
    for bad in (("tpu", ""), ("go", "cuda"), ("xla", "coreml"), ("ort", "gpu")):
        with pytest.raises(ValueError, match="backend|accelerator"):
            backends.BackendConfig(*bad).checked()
    with pytest.raises(ValueError, match="device_id"):
        backends.BackendConfig("ort", "directml", {"device_id": "x"}).checked()
    assert backends.type_of("crypto-wallet") == "CRYPTO_WALLET" and backends.type_of("private_person") == "PERSON"
    typed, settings, recognizer = backends.filtering(lambda: lambda batch: [[("secret", 0, 3, 0.9), ("private_url", 4, 5, 0.9)] for _ in batch], ignore=("private_url",))
    assert art.found_in(["abc d"], typed(), settings) == [[("SECRET", 0, 3, 0.9)]] and "URL" not in recognizer.entities

    def words(text):
        spans, at = [], 0
        for w in text.split(" "):
            spans.append((at, at + len(w)))
            at += len(w) + 1
        return spans, len(spans) + 2

    text = " ".join(f"w{i}" for i in range(300))
    cut = art.token_windows(text, words, 100)
    assert cut[0][0] == 0 and cut[-1][1] == len(text) and all(words(text[a:b])[1] <= 100 for a, b in cut)
    assert all(words(text[c:b])[1] - 2 == art.SHARED for (_, b), (c, _) in zip(cut[:-1], cut[1:], strict=True))
    assert art.token_windows("a b", words, 100) == [(0, 3)]


def test_local_models(tmp_path, capsys):
    import hashlib

    (tmp_path / "config.json").write_text("{}")
    spec = json.dumps({"m": {"revision": "r", "files": {"config.json": {"sha256": hashlib.sha256(b"{}").hexdigest(), "size": 2}, "gone": {"sha256": "0", "size": 1}}}})
    (tmp_path / "pins").write_text(spec)
    assert models.verify_local(str(tmp_path), spec, "m") == [("config.json", "ok"), ("gone", "missing")]
    with pytest.raises(ValueError, match="gone"):
        models.usable_offline(str(tmp_path), spec, "m")
    with pytest.raises(ValueError, match="onnx"):
        models.usable_offline(str(tmp_path))
    (tmp_path / "x.onnx").write_bytes(b"x")
    with pytest.raises(ValueError, match="tokenizer.json"):
        models.usable_offline(str(tmp_path))
    (tmp_path / "tokenizer.json").write_text("{}")
    models.usable_offline(str(tmp_path))
    assert cli.main(["models", "verify", str(tmp_path / "pins"), "--model", "m", "--folder", str(tmp_path)]) == 1
    assert cli.main(["models", "pins", str(tmp_path / "pins")]) == 0 and "config.json" in capsys.readouterr().out
    assert cli.main(["models", "verify", str(tmp_path / "pins")]) == 2
