"""The training-data operators against brute force on small tables with odd rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")

from maskwright.llm import bpe, brown_lm, embeddings, inner_product, lsh_forest, packing, quality, toxicity, url_rules, warc  # noqa: E402

ODD = [None, "", " \t\n", "a", "one two three", "Straße ΣΑΣ İ 日本 é", "x  y   z \n", "<|endoftext|> in a text", "it's THEY'LL 12½", "word " * 3000, "\0nul \x1c \x85"]


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 5))) for _ in range(n))


def documents(spark, texts, first=0):
    return spark.createDataFrame([(i + first, t, 1.0, "x") for i, t in enumerate(texts)], "doc_id long, text string, score double, id string")


def test_bpe(spark):
    from tokenizers import Tokenizer

    texts = ODD + [words(50, 1)]
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = {r.doc_id: r for r in bpe.token_digests(documents(spark, texts), P.path("byte_bpe_50k.json")).collect()}
    for i, x in enumerate(texts):
        ids = t.encode(x or "", add_special_tokens=False).ids
        assert rows[i].n_tokens == len(ids) and rows[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_word_bpe():
    from tokenizers import Tokenizer

    t, own = Tokenizer.from_file(P.path("word_bpe_49k.json")), bpe.Bpe(P.path("word_bpe_49k.json"))
    texts = [x or "" for x in ODD]
    assert [x.tolist() for x in own.encode(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_bpe_of_every_kind_of_character(name):
    """After a letter, after a digit and alone: all characters below U+3100, all that Unicode has assigned since Python's tables, and every hundredth of the others (all of them were compared once)."""
    from tokenizers import Tokenizer

    unlike = bpe.newer(P.path(name))
    late = unlike.letters + unlike.numbers + unlike.others
    t, own = Tokenizer.from_file(P.path(name)), bpe.Bpe(P.path(name), unlike)
    chars = [*map(chr, range(0x3100)), *late, *(chr(c) for c in range(0x3100, 0x110000, 97) if not 0xD800 <= c < 0xE000)]
    texts = [" ".join(f"a{c}b 1{c} {c}" for c in chars[k : k + 100]) for k in range(0, len(chars), 100)]
    assert len(late) > 10_000 and all(x.tolist() == e.ids for x, e in zip(own.encode(texts), t.encode_batch(texts, add_special_tokens=False), strict=True))


def test_warc(spark):
    html = [None, "", "é" * 40_000, "x" * 1000, "x" * 1000, "x" * 999, "x" * 999, "a\r\n\r\nWARC/1.1\r\n", words(30_000, 2)]
    pages = spark.createDataFrame([(i, "http://e/\r\nX: y" if i % 2 else None, h) for i, h in enumerate(html)] + [(4, "u", "x" * 1000)], "page_id long, url string, html string")
    rows = warc.warc_round_trip(pages).collect()
    assert len(rows) == len(html) + 1
    for r in rows:
        raw = (html[r.page_id] or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", 4) if r.page_id == 3 else ("response", None))


def test_warc_errors(spark):
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nabc\r\n0\r\n\r\n")
    assert warc.dechunked(warc.chunked(b"")) == b"" and warc.dechunked(warc.chunked(b"abc" * 9000)) == b"abc" * 9000


def test_url_rules(spark):
    urls = [None, "nothing", "http://Org/x", "https://a.example.org/es/1", "https://a.example.org/en/12", "http://b.com/fr/3?q=1", "http://b.com/de/4#f", "http://org"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge_pages(pages, none).collect()}
    assert rows == {
        0: ("", "", None, "allow"), 1: ("", "", None, "allow"), 2: ("org", "/x", "org/", "allow"), 3: ("a.example.org", "/es/1", "example.org/es/", "block"),
        4: ("a.example.org", "/en/12", "example.org/en/1", "block"), 5: ("b.com", "/fr/3", "com/fr/", "allow"), 6: ("b.com", "/de/4", "com/de/", "block"), 7: ("org", "", None, "allow"),
    }


def test_mined_rules(spark):
    pages = spark.createDataFrame([(i, f"http://{'spam' if i % 4 == 0 else 'fine'}.net/{i}") for i in range(80)], "page_id long, url string")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(60)], "doc_id long, quality int, toxic int")
    rows = {r.page_id: r.verdict for r in url_rules.judge_pages(pages, labels).collect()}
    assert all(v == ("block" if i % 4 == 0 else "allow") for i, v in rows.items())


def test_mined_rules_of_deep_urls(spark):
    deep = "/".join(f"s{k}" for k in range(30))
    pages = spark.createDataFrame([(i, f"http://a.net/{deep}/{'spam/x' if i % 4 == 0 else 'fine/y'}/{i}") for i in range(80)] + [(80, "http://b.net/x"), (81, f"http://b.net/{deep}/other/x")], "page_id long, url string")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(60)], "doc_id long, quality int, toxic int")
    rules = {tuple(r.antecedent) for r in url_rules.mine_rules(url_rules.transactions(pages), labels).collect()}
    assert rules == {("path30=spam",), ("path31=x",)}
    blocked = {r.page_id for r in url_rules.judge_pages(pages, labels).collect() if r.verdict == "block"}
    assert blocked == {i for i in range(80) if i % 4 == 0} | {81}


def test_mined_rules_against_loops(spark):
    """Confidence, support and lift of each rule, that no rule of one or two tokens is missing, and every page's verdict, by other means than the operator's; odd rows among them."""
    r = random.Random(12)
    urls = [f"http://{r.choice(['a', 'b', 'c'])}.net/{r.choice(['x', 'y'])}/{r.choice(['p?k=1', 'q#f', 'r'])}/{i}" for i in range(120)] + [None, "", "nothing", "http://a.net/x/p/7", "http://com/fr/1"]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)] + [(7, urls[7], "x", "y")], "page_id long, url string, rule string, items string")
    bad = lambda u: int("a.net" in u and "/x/" in u or "/q" in u and r.random() < 0.6)
    labels = spark.createDataFrame([(i, None if i % 9 == 0 else 1, bad(urls[i])) for i in range(0, 120, 2)] + [(None, 0, 1), (4, 1, None)], "doc_id long, quality int, toxic int")
    told = {}
    for x in labels.collect():
        if x.doc_id is not None:
            told[x.doc_id] = max(told.get(x.doc_id, 0), int(x.toxic == 1 or x.quality == 0))
    rows = url_rules.transactions(pages).collect()
    baskets = [(set(x["items"]), told[x.doc_id]) for x in rows if x.doc_id in told]
    n, share = len(baskets), sum(b for _, b in baskets) / len(baskets)

    def measured(tokens):
        met = [b for items, b in baskets if tokens <= items]
        return (sum(met) / len(met), sum(met) / len(met) / share, sum(met) / n) if met else (0, 0, 0)

    rules = {frozenset(x.antecedent): (x.confidence, x.lift, x.support) for x in url_rules.mine_rules(url_rules.transactions(pages), labels).collect()}
    assert len(rules) > 2 and all(np.allclose(v, measured(k)) and v[0] >= 0.5 and v[1] >= 1.2 and v[2] * n >= 5 - 1e-9 for k, v in rules.items())
    every = sorted(set().union(*(items for items, _ in baskets)))
    for pair in {frozenset((x, y)) for x in every for y in every}:
        confidence, lift, support = measured(pair)
        if confidence >= 0.5 and lift >= 1.2 and support * n >= 5:
            assert any(k <= pair and v[0] >= confidence for k, v in rules.items()), pair
    for x, page in zip(sorted(rows, key=lambda x: x.page_id), sorted(url_rules.judge_pages(pages, labels).collect(), key=lambda x: x.page_id), strict=True):
        assert page.verdict == (x.ruled or ("block" if any(k <= set(x["items"]) for k in rules) else "allow")) and page.page_id == x.page_id
    assert url_rules.judge_pages(pages.limit(0), labels).collect() == []


def test_near_vectors(spark):
    r = np.random.default_rng(0)
    base = r.normal(size=(60, 16))
    x = np.concatenate([base, base[:20] + r.normal(size=(20, 16)) * 0.05, base[:3]])
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(x)] + [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 0), (903, x[0].tolist(), None), (904, [1.0, 2.0], 0), (905, [None] * 16, 0)]
    found = {q.vec_id: q for q in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.93) & (np.arange(len(x))[:, None] % 2 == np.arange(len(x)) % 2)
    assert all(found[i].n_links == near[i].sum() - 1 for i in range(len(x)))
    assert all(found[i].component_id == np.flatnonzero(near[i]).min() for i in range(len(x)))
    assert all(found[i].n_links == 0 and found[i].kept for i in range(900, 906))


def test_near_vectors_of_a_dense_group(spark, monkeypatch):
    r = np.random.default_rng(5)
    noise = lambda n: r.normal(size=(n, 64)) * (0.05 / 0.95 / 64) ** 0.5
    hub = r.normal(size=(1, 64))
    hub /= np.linalg.norm(hub)
    rest = r.normal(size=(1300, 64))
    x = np.concatenate([hub + noise(700), rest / np.linalg.norm(rest, axis=1, keepdims=True)])
    x[700:800] = x[800:900] + noise(100)
    x = x[r.permutation(len(x))]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.93
    monkeypatch.setattr(embeddings, "LEAST_BLOCK", 100)
    rows = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    found = {q.vec_id: q.n_links for q in embeddings.near_vectors(rows).collect()}
    assert near.sum() > 450_000 and [found[i] for i in range(len(x))] == (near.sum(1) - 1).tolist()


def test_inner_product(spark):
    x = np.random.default_rng(1).normal(size=(300, 16))
    x[7] = x[8]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (920, [0.0] * 16)]
    found = inner_product.nearest_by_inner_product(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    assert set(found.query_id) == set(range(0, 300, 20))
    hits = 0
    for q, g in found.groupby("query_id"):
        s = x @ x[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(300), -s))[:20]
        hits += len(set(want) & set(g.vec_id))
        assert np.allclose(g.sort_values("rank").score, s[g.sort_values("rank").vec_id])
    assert hits >= 0.9 * 20 * 15


def test_inner_product_in_a_dense_group():
    r = np.random.default_rng(6)
    hub, rest = r.normal(size=(1, 64)), r.normal(size=(2700, 64))
    hub /= np.linalg.norm(hub)
    x = np.concatenate([hub + r.normal(size=(1300, 64)) * (0.05 / 0.95 / 64) ** 0.5, rest / np.linalg.norm(rest, axis=1, keepdims=True)])
    x = (x / np.linalg.norm(x, axis=1, keepdims=True))[r.permutation(4000)]
    x[11] = x[12]
    books = inner_product.Codebooks(x[:1000])
    asked, ids = np.arange(0, 4000, 40), np.arange(4000)
    a, b, score, scored = inner_product.search_block(books, asked, x[asked], ids, books.encode(x), x, 20)
    # queries of the dense group have all of it within the codes' error
    assert scored < 0.2 * 4000 * len(asked)
    for q in asked:
        s = np.einsum("ij,ij->i", np.repeat(x[q : q + 1], 4000, 0), x)
        s[q] = -np.inf
        assert b[a == q].tolist() == np.lexsort((ids, -s))[:20].tolist() and np.allclose(score[a == q], s[b[a == q]])


def test_inner_product_scores_few_pairs():
    """Tables first: a small share of all pairs is scored exactly, and none of the nearest is lost; copies beyond the nearest asked for aren't scored at all."""
    r, shares = np.random.default_rng(7), []
    for n in (1000, 4000, 8000):
        x = r.normal(size=(n, 64)) * r.uniform(0.8, 1.2, (n, 1))
        ids, asked = np.arange(n), np.arange(0, n, 40)
        books = inner_product.Codebooks(x[:1000])
        a, b, _, scored = inner_product.search_block(books, asked, x[asked], ids, books.encode(x), x, 20)
        s = x[asked] @ x.T
        s[np.arange(len(asked)), asked] = -np.inf
        assert [b[a == q].tolist() for q in asked] == np.argsort(-s, axis=1, kind="stable")[:, :20].tolist()
        shares.append(scored / (n * len(asked)))
    assert shares[0] < 0.2 and shares[0] > shares[1] > shares[2] and shares[2] < 0.05
    x[:3000] = x[5]
    a, b, _, scored = inner_product.search_block(books, ids[:200], x[:200], ids, books.encode(x), x, 20)
    assert b[a == 5].tolist() == [*range(5), *range(6, 21)] and scored < 0.05 * 200 * 8000
    assert inner_product.few_of_each(np.array([5, 3, 4, 9]), np.array([[1.0], [1.0], [1.0], [2.0]]), 2).tolist() == [1, 2, 3]


def test_near_documents(spark):
    base = [words(80, i) for i in range(12)]
    texts = [*ODD, *base, *base[:4], *(b.rsplit(" ", 4)[0] + " tail end of it" for b in base[:6]), base[0].upper()]
    rows = {r.doc_id: r for r in lsh_forest.near_documents(documents(spark, texts), 4).collect()}

    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()

    sets = [shingles(t) for t in texts]
    part = list(range(len(texts)))
    for _ in texts:
        for a in range(len(texts)):
            for b in range(len(texts)):
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    part[a] = part[b] = min(part[a], part[b])
    assert [rows[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    assert [rows[i].component_id for i in range(len(texts))] == part


def test_near_documents_of_long_groups(spark, monkeypatch):
    """Blocks of ten: chains of copies, of which the first block meets few, a large clique, and texts that are only alike enough to be candidates."""
    monkeypatch.setattr(lsh_forest, "BLOCK", 10)
    monkeypatch.setattr(lsh_forest, "least_agreeing", lambda percent, collide=0.0: 20)
    r, texts = random.Random(5), []
    for seed in range(3):
        chain = words(60, 100 + seed).split()
        for _ in range(35):
            at = r.randrange(len(chain))
            chain[at : at + 1] = [words(1, r.random())]
            texts.append(" ".join(chain))
    clique = words(80, 7)
    texts += [f"{clique} {words(2, 200 + i)}" for i in range(60)]
    r.shuffle(texts)
    rows = {x.doc_id: x for x in lsh_forest.near_documents(documents(spark, texts), 4).collect()}
    sets = [{tuple(t.split()[i : i + 4]) for i in range(len(t.split()) - 3)} for t in texts]
    links = [(a, b) for a in range(len(texts)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    part = list(range(len(texts)))
    for _ in texts:
        for a, b in links:
            part[a] = part[b] = min(part[a], part[b])
    assert 60 < len(links) and len(set(part)) > 1
    assert [rows[i].component_id for i in range(len(texts))] == part


def test_depth_of_the_forest_follows_the_region():
    values = sorted([7, *v, i] for i, v in enumerate([[1, 1, 1, 1]] * 30 + [[1, 1, 1, 2]] * 15 + [[1, 2, 3, k] for k in range(6)] + [[9, 9, 9, 9]] * 2))
    values += [[8, 0, 0, 0, 0, 99 + i] for i in range(3)]
    key = np.array([v[0] for v in values])
    deep = np.array([v[1] << 48 | v[2] << 32 | v[3] << 16 | v[4] for v in values])
    found = {(a, b) for x, y in lsh_forest.near_places(key, deep, 0) for a, b in zip(x.tolist(), y.tolist(), strict=True)}

    def shared(a, b):
        return 0 if key[a] != key[b] else 4 + next((k for k in range(4) if values[a][k + 1] != values[b][k + 1]), 4)

    want = set()
    for a in range(len(values)):
        for b in range(a + 1, min(a + 33, len(values))):
            ends = [shared(a, a + 8) if a + 8 < len(values) else 0, shared(b - 8, b) if b >= 8 else 0]
            if shared(a, b) >= 4 and (b - a <= 8 or shared(a, b) >= min(ends)):
                want.add((a, b))
    assert found == want and (0, 29) in found and (10, 38) not in found and shared(10, 38) == 7
    later = {(a, b) for x, y in lsh_forest.near_places(key, deep, 20) for a, b in zip(x.tolist(), y.tolist(), strict=True)}
    assert later == {p for p in want if p[1] >= 20}


def test_language_model(spark):
    texts = [*ODD, *(words(60, i % 5) for i in range(40))]
    rows = {r.doc_id: r for r in brown_lm.score_texts(documents(spark, texts)).collect()}
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    cut = [[*(t or "").encode().lower().split(), None] for t in texts]
    count = {}
    for c, h in zip(cut, held, strict=True):
        for w in [] if h else c:
            count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    for i, c in enumerate(cut):
        assert (rows[i].held_out, rows[i].n_tokens, rows[i].n_known, rows[i].train_tokens) == (held[i], len(c), sum(w in count for w in c), n)
        assert abs(rows[i].base_score - sum(np.log10((count.get(w, 0) + 1) / (n + v + 1)) for w in c)) < 1e-6
        assert rows[i].score < 0


def test_class_scores_match_brute_force(spark, monkeypatch):
    """Few numbered words, so that most are rare: scores by loops over tokens, with the operator's classes, and sums over all words of each history."""
    monkeypatch.setattr(brown_lm, "KNOWN", 30)
    monkeypatch.setattr(brown_lm, "CORE", 10)
    C, END, RARE = brown_lm.CLASSES, brown_lm.END, brown_lm.RARE
    texts = [None, "", "new1 new2 the", *(words(30, i % 9) + " the of the" * (i % 4) for i in range(60)), words(40, 999)]
    docs = documents(spark, texts)
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    cut = [(t or "").encode().split() for t in texts]
    count = {}
    for t, h in zip(cut, held, strict=True):
        for w in [] if h else t:
            count[w] = count.get(w, 0) + 1
    top = sorted(count, key=lambda w: (-count[w], w))[:30]
    seen = spark.sparkContext.broadcast(top)
    train = brown_lm.numbered(docs, seen, "doc_id", "text", brown_lm.remainder("doc_id", 7) == 2).filter("not held_out")
    cls = brown_lm.cluster(train, len(top))
    rare = {bytes(r.word): (r["class"], r.c) for r in brown_lm.moved(brown_lm.rare_spots(train, cls).selectExpr("word", "at", "1L AS n"), brown_lm.transitions(train, cls)).collect()}
    assert {w: c for w, (_, c) in rare.items()} == {w: c for w, c in count.items() if w not in top} and len(rare) > 50
    group = {None: END} | {w: int(cls[i]) for i, w in enumerate(top)}
    assert max(group[w] for w in top) < C
    own, pair, into = np.zeros(C + 2), {}, {}
    state = lambda w: ("rare", rare[w][0]) if w in rare else ("unseen",) if w not in group else group[w]
    for t, h in zip(cut, held, strict=True):
        for v, w in zip([None, *t], [*t, None], strict=True) if not h else ():
            g = group.get(w, RARE)
            own[g] += 1
            pair[state(v), g] = pair.get((state(v), g), 0) + 1
            if w in rare and v in group:
                into[group[v], rare[w][0]] = into.get((group[v], rare[w][0]), 0) + 1
    share = {g: own[g] + 1 for g in range(C + 2) if own[g] or g >= END}
    weight = np.zeros(C)
    for k, c in rare.values():
        weight[k] += c + 1

    def p(w, v):
        g, h = group.get(w, RARE), state(v)
        x = (pair.get((h, g), 0) + 20 * share[g] / sum(share.values())) / (sum(pair.get((h, o), 0) for o in share) + 20)
        if g != RARE:
            return x * ((count[w] if w else own[END]) / own[g])
        if w not in rare:
            return x / (weight.sum() + 1)
        k, c = rare[w]
        a = [into.get((h, j), 0) if isinstance(h, int) else 0 for j in range(C)]
        return x * weight.sum() / (weight.sum() + 1) * (a[k] + 20 * weight[k] / weight.sum()) / (sum(a) + 20) * (c + 1) / weight[k]

    for v in (None, top[0], top[20], next(iter(rare)), b"unseen"):
        assert abs(sum(p(w, v) for w in (None, b"unseen", *count)) - 1) < 1e-9
    for r in brown_lm.score_texts(docs).collect():
        t = cut[r.doc_id]
        assert abs(r.score - sum(np.log10(p(w, v)) for v, w in zip([None, *t], [*t, None], strict=True))) < 1e-6


def test_classes_beat_the_base_on_held_out_texts(spark, monkeypatch):
    """Two kinds of words in turn tell log10(2) a token; a third of the words is numbered, and as rare words next to each other tell nothing, 5/9 of that can be gained. Half of it must be."""
    monkeypatch.setattr(brown_lm, "KNOWN", 40)
    r = random.Random(5)
    nouns, verbs = [f"n{i}" for i in range(60)], [f"v{i}" for i in range(60)]
    texts = [" ".join(r.choice(nouns if k % 2 else verbs) for k in range(40)) for _ in range(300)]
    rows = [x for x in brown_lm.score_texts(documents(spark, texts)).collect() if x.held_out]
    assert sum(x.score for x in rows) > sum(x.base_score for x in rows) + np.log10(2) * 5 / 9 / 2 * sum(x.n_tokens for x in rows)


def test_exchange_finds_classes():
    counts = np.zeros((8, 8))
    for a in range(8):
        for b in range(8):
            counts[a, b] = 50 if (a % 2) != (b % 2) else 1
    cls = brown_lm.exchange(counts, 2)
    assert len(set(cls[::2])) == 1 and len(set(cls[1::2])) == 1 and cls[0] != cls[1]


def test_packing(spark):
    texts = [*ODD, *(words(n, n) for n in (5, 50, 500, 900, 1200, 4000)), *([words(300, 9)] * 40)]
    found = packing.pack(documents(spark, texts), P.path("word_bpe_49k.json")).toPandas()
    own = bpe.Bpe(P.path("word_bpe_49k.json"))
    ids = [np.append(x, 2).astype("<u4") for x in own.encode([t or "" for t in texts])]
    for i, g in found.groupby("doc_id"):
        at = 0
        for p in g.sort_values("start").itertuples():
            assert p.start == at and p.doc_tokens == len(ids[i]) and p.ids_crc32 == zlib.crc32(ids[i][p.start : p.start + p.length].tobytes())
            at += p.length
        assert at == len(ids[i])
    for _, g in found.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1].tolist()] and g.length.sum() <= 4096
    assert found.doc_id.nunique() == len(texts)


def test_classifiers(spark):
    texts = [("you idiot " if i % 5 == 0 else "") + ("GRR!! " * 30 if i % 7 == 0 else words(40, i)) for i in range(300)] + ODD
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 7 != 0), int(i % 5 == 0)) for i in range(0, 300)], "doc_id long, quality int, toxic int")
    for run, want in ((toxicity.toxicity, lambda i: i % 5 == 0), (quality.quality, lambda i: i % 7 != 0)):
        rows = run(docs, labels).collect()
        assert len(rows) == len(texts) and all(0 <= r.score <= 1 for r in rows)
        held = [r for r in rows if r.doc_id < 300 and r.held_out]
        assert np.mean([bool(r.predicted) == want(r.doc_id) for r in held]) >= 0.85
        assert run(docs, labels.limit(0)).count() == len(texts)


def test_toxic_texts_are_caught_where_labels_cover_more_documents(spark):
    """As after the pipeline's first stage: 2,000 labels, all of clean texts, are of documents that are gone."""
    texts = [words(15, i) + (" you idiot " if i % 4 == 0 else " ") + words(5, i + 1) for i in range(600)]
    labels = spark.createDataFrame([(i, 1, int(i < 600 and i % 4 == 0)) for i in range(2600)], "doc_id long, quality int, toxic int")
    model = toxicity.train(documents(spark, texts), labels)
    called = np.array(model.score([t.encode() for t in texts])) >= 0.5
    toxic, held = np.arange(600) % 4 == 0, np.array([zlib.crc32(str(i).encode()) % 5 == 0 for i in range(600)])
    assert called[held & toxic].mean() >= 0.9 and called[held & ~toxic].mean() <= 0.1
    assert toxicity.train(documents(spark, texts[1:4], 1), labels).bias < 0


def test_empty_tables(spark):
    none = documents(spark, []).limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert lsh_forest.near_documents(none).count() == 0
    assert packing.pack(none, P.path("word_bpe_49k.json")).count() == 0
    assert brown_lm.score_texts(none).count() == 0
    assert quality.quality(none, labels).count() == 0 and toxicity.toxicity(none, labels).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embeddings.near_vectors(vectors).count() == 0 and inner_product.nearest_by_inner_product(vectors).count() == 0
    assert warc.warc_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_components_of_chains(spark, monkeypatch):
    from maskwright.llm import components

    rng = np.random.default_rng(3)
    path = rng.permutation(900)
    links = [(int(a), int(b)) for a, b in zip(path[:-1], path[1:], strict=True)] + [(2000, 1000), (1000, 2000), (3000, 3000), (None, 5), (2000, 1500)]
    want = {int(x): 0 for x in path} | {1000: 1000, 1500: 1000, 2000: 1000}
    for chunk in (components.CHUNK, 7):
        monkeypatch.setattr(components, "CHUNK", chunk)
        found = components.connected_components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()
        assert len(found) == len(want) and {r.node: r.component for r in found} == want
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    u, v = components.stars(np.array([9, 5, 7, 3]), np.array([5, 7, 8, 2]))
    assert dict(zip(u.tolist(), v.tolist(), strict=True)) == {7: 5, 8: 5, 9: 5, 3: 2}


def test_few_links_take_no_rounds(spark, monkeypatch):
    """Few links cost two tables, not four a round; more links than one task may hold give the same components by rounds."""
    from maskwright.llm import components

    written = []
    monkeypatch.setattr(components, "stored", lambda df, name, f=components.stored: written.append(name) or f(df, name))
    r = random.Random(8)
    links = [(a, r.randrange(a // 20 * 20, a + 1)) for a in range(1, 400)]
    frame = spark.createDataFrame(links, "a long, b long").repartition(6)
    by_task = sorted(map(tuple, components.connected_components(frame).collect()))
    assert written == ["cc", "cc"]
    count = len({(max(x), min(x)) for x in links if x[0] != x[1]})
    for most, chunk in ((count // 20, components.CHUNK), (components.ONE_TASK, 5)):
        monkeypatch.setattr(components, "ONE_TASK", most)
        monkeypatch.setattr(components, "CHUNK", chunk)
        written.clear()
        assert sorted(map(tuple, components.connected_components(frame).collect())) == by_task
        assert "cc-large" in written


def test_near_vectors_of_repeated_ids(spark):
    a, b = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0]
    rows = [(1, a, 0), (1, b, 0), (2, [1.0, 0.1, 0.0, 0.0], 0), (3, [0.1, 1.0, 0.0, 0.0], 0), (3, [0.1, 1.0, 0.0, 0.0], 0), (4, a, 1)]
    found = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("id", F.lit("x"))).collect()
    assert sorted((q.vec_id, q.n_links, q.component_id) for q in found) == [(1, 1, 1), (1, 2, 1), (2, 1, 1), (3, 2, 1), (3, 2, 1), (4, 0, 4)]


def test_bpe_with_a_small_table(spark, monkeypatch):
    """Words that were set aside are encoded again."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe, "CACHE_BYTES", 30_000)
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        t, own = Tokenizer.from_file(P.path(name)), bpe.Bpe(P.path(name))
        for k in range(6):
            texts = [words(200, k), words(50, 1), "it's a-b,c. THE\nend " + words(20, 2), *(x or "" for x in ODD)]
            assert [x.tolist() for x in own.encode(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]
            assert len(own.table) == len(own.table.start) == len(own.table.used)
        own.rest()
        assert own.table.weight <= 15_000


def test_marks_after_words_need_no_keys():
    """Words are numbered without the marks after them, also where a mark belongs to those around it, and ids stay those of the library."""
    from tokenizers import Tokenizer

    r = random.Random(4)
    texts = ["one, two. one two, one. two.", "it's, he'll. (A), b., c,. d ,. e,", *("".join(r.choices("ab,. '\n!1sé A)Σ", k=r.randrange(25))) for _ in range(3000))]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        t, own = Tokenizer.from_file(P.path(name)), bpe.Bpe(P.path(name))
        t.no_truncation()
        t.no_padding()
        assert [x.tolist() for x in own.encode(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]
    own = bpe.Bpe(P.path("word_bpe_49k.json"))
    own.encode(texts[:1] * 2)
    assert set(own.table) == {"one", "two", ",", ".", "two."}


def test_stretches_end_at_letters_and_white_space():
    """Words joined by line breaks or marks need no keys of their own, distinct stretches are looked up once, and ids stay those of the library."""
    from tokenizers import Tokenizer

    t, own = Tokenizer.from_file(P.path("word_bpe_49k.json")), bpe.Bpe(P.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    texts = ["one.\ntwo&&& one;\ttwo-one \u00e9t\u00e9,\n\u00e9t\u00e9(one) two's", "", ".", " one. "] * 3
    assert [x.tolist() for x in own.encode(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert set(own.table) == {"", "one", "two", "\u00e9t\u00e9", ".", "&&&", ";", "-one", "-", ",", "(one", "(", ")", "'s"}
    assert own.table.used[own.table["one"]] == 9 and own.table.used[own.table["two"]] == 9
    two_bytes = [*range(0xC0, 0x250), *range(0x400, 0x480), 0x2D0, 0x301, 0x37E, 0x387, 0x3F6, 0x482, 0x2026]
    texts = [f"{c}.a{c}&1{c}\n{c}'s {c},b{c}!" for c in map(chr, two_bytes)] + ["a.", "a. ", "\u00d7.", "\u00f7,\n", "don't'll 's'\x1c\v'S"]
    assert [x.tolist() for x in own.encode(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_long_texts_are_hashed_in_parts(monkeypatch):
    from maskwright.llm import subwords

    texts = [words(300, 1).encode(), b"", b"x" * 5000, ("ab " * 900).encode(), words(5, 2).encode()]
    monkeypatch.setattr(subwords, "PART", 1 << 30)
    whole = subwords.subword_counts(texts, 1 << 12, True)
    monkeypatch.setattr(subwords, "PART", 256)
    parts = subwords.subword_counts(texts, 1 << 12, True)
    assert len(parts) == len(texts) and all(np.array_equal(np.sort(k), k) for k, _ in parts)
    for (k, n), (m, o), t in zip(whole, parts, texts, strict=True):
        cuts = len(t) // 128
        assert abs(n.sum() - o.sum()) <= 13 * cuts and len(np.setxor1d(k, m)) <= 13 * cuts


def test_reassembly_errors(spark):
    kind = "rid long, target string, type string, refers string, digest string, length long, origin string, segment int, total long, block binary"
    part = lambda n, block, total=None: (1, None, "response" if n == 1 else "continuation", None, "", None, "o", n, total, block)
    body = warc.HTTP + warc.chunked(b"abc")
    good = [part(2, body[40:], len(body)), part(1, body[:40]), part(1, body[:40])]
    row = warc.reassemble(spark.createDataFrame(good, kind)).first()
    assert (row.length, row.digest) == (3, hashlib.sha1(b"abc").hexdigest())
    for bad in ([part(1, b"x"), part(3, b"y", 2)], [part(1, b"x"), part(2, b"y", 5)], [part(1, b"x")]):
        with pytest.raises(Exception, match="missing|expected"):
            warc.reassemble(spark.createDataFrame(bad, kind)).collect()


def test_inner_product_ties_and_few_candidates(spark):
    rows = [(i, [1.0, 0.0]) for i in range(30)] + [(60, [2.0, 0.0, 0.0]), (61, [1.0, 1.0, 1.0])]
    found = inner_product.nearest_by_inner_product(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit(1))).collect()
    by = lambda q: [r.vec_id for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == q]
    assert by(0) == list(range(1, 21)) and by(20) == [i for i in range(21) if i != 20][:20] and by(60) == [61]


def test_score_of_the_language_model(spark):
    """Scores against a plain account of the class bigrams, and held-out texts are likelier than by words alone."""
    rng = random.Random(5)
    nouns, verbs = ([f"{p}{i}" for i in range(12)] for p in ("n", "v"))
    texts = [" ".join(rng.choice(nouns if k % 2 == 0 else verbs) for k in range(40)) for _ in range(120)]
    rows = brown_lm.score_texts(documents(spark, texts)).collect()
    held = [r for r in rows if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held) + 5 * len(held)


def test_pipeline(spark, tmp_path):
    """Each stage against its operator on the same rows, and the whole against its stages."""
    import corpus_pipeline as pipeline

    clean = [words(60, i) for i in range(60)]
    texts = [("you idiot " if i % 5 == 0 else "") + ("GRR!! " * 30 if i % 7 == 0 else words(40, i)) for i in range(300)] + clean + [c + " end" for c in clean[:20]] + clean[:5] + ODD
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i % 7 != 0), int(i % 5 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "packing"]
    at, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in pipeline.STAGES[:3]:
        before = {r.doc_id for r in at.collect()}
        out = stage(spark, at, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r.doc_id for r in out.collect()}
        if name == "near_duplicates":
            want = {r.doc_id for r in lsh_forest.near_documents(at).collect() if r.kept}
        else:
            scored = (quality.quality if name == "quality" else toxicity.toxicity)(at, labels)
            want = {r.doc_id for r in scored.collect() if r.predicted == (name == "quality")}
        assert kept[name] == want and kept[name] <= before
        at = out
    pieces = pipeline.STAGES[3][1](spark, at, str(tmp_path))
    assert {r.doc_id for r in pieces.collect()} == kept["near_duplicates"]
    rows = lambda df: sorted(tuple(r) for r in df.select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect())
    whole = pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in whole.collect()} == kept["near_duplicates"] and sum(r[2] for r in rows(whole)) == sum(r[2] for r in rows(pieces))
    nothing = docs.limit(0)
    for name, stage in pipeline.STAGES:
        assert stage(spark, nothing, str(tmp_path)).count() == 0
