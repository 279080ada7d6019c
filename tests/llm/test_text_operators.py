"""Fill-in-middle, token counts and importance resampling against brute force, with odd rows."""

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter

import pytest

P = pytest.importorskip("public_tokenizers")

from maskwright.llm import fill_in_middle, importance, token_counts  # noqa: E402

ODD = [None, "", " \t\n", "\n\n\n", "a", "one\ntwo", "one\ntwo\n", "Straße\r\nΣΑΣ 日本 é\n𝔸", "x <P> y", "x\n<S>", "<M>", "<<P\nS>\n>", "\0nul\n\x1c \x85", "it's\nTHEY'LL <|endoftext|> 12½"]


def lines(n, seed):
    r = random.Random(seed)
    return "".join(" ".join("".join(r.choice("abcdefghé") for _ in range(r.randint(1, 5))) for _ in range(r.randint(0, 12))) + r.choice(["\n", "\n", " ", "<"]) for _ in range(n))


TEXTS = [*ODD, *(lines(n, n) for n in (1, 2, 3, 30, 300)), "long line " * 20_000, "a\n" * 50_000]


def table(spark, texts):
    """Documents with repeated rows, a null id and columns whose names clash with the operators' own."""
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (17, texts[17]), (17, "another text\nof the same id"), (None, "no\nid\n")]
    return rows, spark.createDataFrame([(i, t, "x", 1, "y", True) for i, t in rows], "doc_id long, text string, id string, n int, batch string, rank boolean")


def same(found, wanted):
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, wanted))


def middle_moved(i, text, seed=7, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n, h = len(units), hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return i, n, "plain", None, None, text, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return i, n, form, len(p), len(m), out, text


def test_fill_in_middle(spark, monkeypatch):
    monkeypatch.setattr(fill_in_middle, "CHUNK_BYTES", 1000)
    rows, docs = table(spark, TEXTS)
    same(fill_in_middle.fill_in_middle(docs).collect(), [middle_moved(i, t) for i, t in rows])
    same(fill_in_middle.fill_in_middle(docs, fill_in_middle.Fim(seed=1, rate=40, spm=0)).collect(), [middle_moved(i, t, 1, 40, 0) for i, t in rows])
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    same(fill_in_middle.fim_digests(docs).collect(), [(*r[:5], sha(r[5]), sha(r[6])) for r in (middle_moved(i, t) for i, t in rows)])
    assert fill_in_middle.fim_digests(docs.limit(0)).collect() == []


def test_fill_in_middle_of_words(spark):
    fim = fill_in_middle.Fim(unit=r"\s*\S+|\s+", prefix="⟨pre⟩", suffix="⟨suf⟩", middle="⟨mid⟩")
    for r in fill_in_middle.fill_in_middle(table(spark, TEXTS)[1], fim).collect():
        assert r.form == "plain" or r.output.count("⟨") == 3 and len(r.output) == len(r.restored) + 15
    for marks in (("<P>", "<P>", "<M>"), ("<P>", "<S>", ""), ("<P>", "P<S", "<M>"), ("<P", "<P>", "<M>"), ("<P<", "<S>", "<M>")):
        with pytest.raises(ValueError):
            fill_in_middle.Fim(prefix=marks[0], suffix=marks[1], middle=marks[2])


def test_texts_that_are_no_utf8(spark):
    docs = spark.sql("SELECT 1L AS doc_id, CAST(X'61FF0A62' AS STRING) AS text")
    r = fill_in_middle.fill_in_middle(docs).first()
    assert r.restored == "a�\nb" and r.n == 2
    assert token_counts.token_counts(docs, P.path("byte_bpe_50k.json")).first().n_bytes == 6


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


@pytest.mark.parametrize(("piece", "overlap"), [(1 << 15, 512), (64, 16), (1000, 128)])
def test_token_counts(spark, tokenizer, piece, overlap):
    r = random.Random(piece)
    bits = ["a", "b ", " ", ",", " 's", "'re", "'", "<|endoftext|>", "<|endo", "text|>", "日本", "é", "\n", " \t", "12", " 3", "!!", "𝔸", "x" * 30]
    texts = [*TEXTS[: -2 if piece == 64 else None], *("".join(r.choice(bits) for _ in range(n)) for n in (300, 900, 2000) for _ in range(8)), "<|endoftext|>" * 300, "'" * 700]
    rows, docs = table(spark, texts)
    want = [(i, len((t or "").encode()), n := len(tokenizer.encode(t or "", add_special_tokens=False).ids), n > 300) for i, t in rows]
    same(token_counts.token_counts(docs, P.path("byte_bpe_50k.json"), 300, piece=piece, overlap=overlap).collect(), want)


def test_token_counts_widen_their_overlaps(spark, tokenizer, monkeypatch):
    """Texts without a word border for longer than many pieces: every round before the last fails for them, and for them alone."""
    rounds, spliced = [], token_counts._spliced

    def counted(texts, *rest):
        rounds.append(texts.count())
        return spliced(texts, *rest)

    monkeypatch.setattr(token_counts, "_spliced", counted)
    texts = ["a" * 3000 + " " + "b" * 3000, " " * 5000, "日" * 2000, "plain words " * 400]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = token_counts.token_counts(docs, P.path("byte_bpe_50k.json"), piece=64, overlap=16)
    assert {r.doc_id: r.n_tokens for r in found.collect()} == {i: len(tokenizer.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}
    assert rounds[0] == 4 and rounds[1] == 3 and len(rounds) > 2


def test_token_counts_of_an_empty_table_and_of_other_vocabularies(spark, tmp_path):
    docs = table(spark, TEXTS)[1].limit(0)
    assert token_counts.token_counts(docs, P.path("byte_bpe_50k.json")).collect() == []
    with pytest.raises(ValueError):
        token_counts.token_counts(docs, P.path("word_bpe_49k.json"))
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    spec["added_tokens"][0]["content"] = "<a<"
    (tmp_path / "t.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        token_counts.check_vocabulary(str(tmp_path / "t.json"))


def resampled(rows, target, o):
    low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    runs = lambda w: [" ".join(w[i : i + n]) for n in range(1, o.longest + 1) for i in range(len(w) - n + 1)]
    bucket = lambda f: zlib.crc32(f.encode()) % o.buckets
    words = [low(t) for _, t in rows]
    found = [runs(w) for w in words]
    s, t = Counter(bucket(f) for x in found for f in x), Counter(bucket(f) for x in target for f in runs(low(x)))
    gain = lambda k: math.floor(1000 * math.log((t[k] + 1) * (s.total() + o.buckets) / ((s[k] + 1) * (t.total() + o.buckets))))
    out = []
    for (i, _), f in zip(rows, found, strict=True):
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{o.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((x for x, w in zip(out, words, strict=True) if len(w) >= o.least), key=lambda x: (-x[3], -1 if x[0] is None else x[0]))
    for rank, x in enumerate(able[: o.share * len(able) // 100], 1):
        x[4] = rank
    return [tuple(x) for x in out]


@pytest.mark.parametrize("options", [importance.Resampling(), importance.Resampling(longest=3, buckets=50, share=60, least=3), importance.Resampling(buckets=1, share=100, least=0)])
def test_importance_resampling(spark, monkeypatch, options):
    monkeypatch.setattr(importance, "PART_BYTES", 3000)  # the long texts are counted in parts
    monkeypatch.setattr(importance, "CHUNK_BYTES", 6000)
    target = ["aa bb CC", None, "", "long line", "a b a b"]
    rows, docs = table(spark, TEXTS)
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    same(importance.importance_resampling(docs, bench, options).collect(), resampled(rows, target, options))


def test_importance_resampling_of_equal_scores(spark):
    rows = [(i % 7, "the same text " * 10) for i in range(200)]
    o = importance.Resampling(share=50)
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    found = importance.importance_resampling(docs.repartition(5), bench, o).collect()
    # rows of one id are alike: which of them has which rank is open
    assert sorted(r.rank for r in found if r.rank) == list(range(1, 101))
    same([r[:4] for r in found], [r[:4] for r in resampled(rows, [], o)])
    ids = lambda rows: [i for _, i in sorted((r[4], r[0]) for r in rows if r[4])]
    assert ids(found) == ids(resampled(rows, [], o))


def test_importance_resampling_of_nothing(spark):
    docs, bench = table(spark, TEXTS)[1], spark.createDataFrame([("x",)], "text string")
    assert importance.importance_resampling(docs.limit(0), bench).collect() == []
    empty = importance.importance_resampling(docs.filter("doc_id < 2"), bench.limit(0)).collect()
    assert sorted((r.doc_id, r.n_features, r.weight, r.rank) for r in empty) == [(0, 0, 0, None), (1, 0, 0, None)]
    with pytest.raises(ValueError):
        importance.Resampling(buckets=0)
