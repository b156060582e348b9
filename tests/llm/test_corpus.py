"""op2, op3, op6, op7, op9, op10: operators over whole tables, against plain versions."""

import hashlib
import math
import pickle
import random
import re
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairn.llm import difference_cover, gru, lm, mixing, neardup, suffix_dedup, topk, urls
from cairn.llm.components import components
from cairn.llm.darts import signatures, weighted_jaccard
from cairn.llm.shingles import shingles
from tests.llm.helpers import awkward, documents, prose


def crc_fold(i, parts):
    import zlib

    return zlib.crc32(("" if i is None else str(i)).encode()) % parts


# op2


def test_base_score_and_counts(spark):
    texts = awkward() + [prose(120, k, 50) for k in range(40)] + ["unseen zq " + "y" * 100]
    ids = [None if k == 3 else k for k in range(len(texts))]
    rows = lm.score(documents(spark, texts, ids)).collect()
    assert len(rows) == len(texts)
    tok = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) if w] + [None]
    n = Counter(w for i, t in zip(ids, texts, strict=True) if crc_fold(i, 7) != 2 for w in tok(t))
    total, v = sum(n.values()), len(n)
    want = {i: (len(tok(t)), sum(w in n for w in tok(t)), sum(math.log10((n[w] + 1) / (total + v + 1)) for w in tok(t))) for i, t in zip(ids, texts, strict=True)}
    for r in rows:
        assert r.train_tokens == total and r.held_out == (crc_fold(r.doc_id, 7) == 2)
        assert (r.n_tokens, r.n_known) == want[r.doc_id][:2]
        assert r.base_score == pytest.approx(want[r.doc_id][2], rel=1e-9)
        assert r.score < 0
    assert lm.score(documents(spark, [])).count() == 0


def test_model_beats_the_base_where_words_depend_on_each_other(spark):
    r = random.Random(0)

    def text():
        lang = r.choice("ab")
        return " ".join(f"{lang}{r.randrange(40)}" for _ in range(150))

    rows = lm.score(documents(spark, [text() for _ in range(400)])).where("held_out").collect()
    assert rows and sum(x.score for x in rows) > sum(x.base_score for x in rows) * 0.99


def test_every_training_token_is_learned_from():
    texts = [prose(n, k, 50) for k, n in enumerate((5, 700, 63, 64, 1, 333))]
    n = Counter(w for t in texts for w in lm.tokens(t.encode()))
    vocabulary = lm.Vocabulary(list(n), np.array(list(n.values())), n.total(), len(n))
    packed = pickle.dumps(gru.Gru.fresh(vocabulary.unigrams, lm.BLOCKS))
    ids = [vocabulary.ids[vocabulary.places(lm.tokens(t.encode()))].astype(np.int16).tobytes() for t in texts]
    batch = pa.RecordBatch.from_arrays([pa.array([0, 0, 0, 1, 1, 4]), pa.array(ids, pa.binary())], names=["shard", "ids"])
    used = Counter()
    for round_ in range(lm.ROUNDS):
        for out in lm._learn(SimpleNamespace(value=packed), round_)(iter([batch])):
            used.update(dict(zip(out.column("shard").to_pylist(), out.column("n").to_pylist(), strict=True)))
            assert np.isfinite(np.frombuffer(out.column("p")[0].as_py())).all()
    sizes = [len(lm.tokens(t.encode())) for t in texts]
    assert used == {0: sum(sizes[:3]), 1: sum(sizes[3:5]), 4: sizes[5]}


def test_sums_of_shards_are_added_as_a_tree():
    sums = [lm._sums(k, np.full(3, float(k)), k) for k in (0, 1, lm.FAN - 1, lm.FAN, 3 * lm.FAN)]
    out = {r["shard"]: (np.frombuffer(r["p"]).tolist(), r["n"]) for b in lm._add(iter(sums)) for r in b.to_pylist()}
    n = lm.FAN
    assert out == {0: ([float(n)] * 3, n), 1: ([float(n)] * 3, n), 3: ([3.0 * n] * 3, 3 * n)}


def test_scores_do_not_depend_on_how_rows_are_stored(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_TOKENS", 6000)
    monkeypatch.setattr(lm, "FAN", 2)
    docs = documents(spark, [prose(150 + k, k, 60) for k in range(200)])
    one, four = ({r.doc_id: r.score for r in lm.score(d).collect()} for d in (docs.coalesce(1), docs.repartition(4, "doc_id")))
    assert max(abs(one[k] - four[k]) for k in one) < 1e-3


def toy(seed=0, blocks=2, others=3):
    rng = np.random.default_rng(seed)
    return gru.Gru.fresh(rng.random(blocks * gru.BLOCK + others), blocks, seed)


def test_output_is_a_distribution():
    m = toy()
    states = np.random.default_rng(1).normal(size=(1, gru.HIDDEN)).astype(np.float32)
    every = np.arange(2 * gru.BLOCK + 3, dtype=np.int32)
    assert np.exp(m.log_likelihood(np.repeat(states, len(every), 0), every)).sum() == pytest.approx(1, abs=1e-4)


def test_state_is_carried_across_windows(monkeypatch):
    m, rng = toy(), np.random.default_rng(2)
    lengths = np.array([5, 200, 1, 77, 33])
    ids = rng.integers(0, 2 * gru.BLOCK + 3, lengths.sum()).astype(np.int32)
    want = []
    for s, e in zip(np.cumsum(lengths) - lengths, np.cumsum(lengths), strict=True):
        state, total = np.zeros((1, gru.HIDDEN), np.float32), 0.0
        for w in ids[s:e]:
            total += float(m.log_likelihood(state, np.array([w]))[0])
            state = m.step(np.array([w]), state)[0]
        want.append(total)
    for window, lanes in ((32, 1024), (7, 2), (1000, 3)):
        monkeypatch.setattr(gru, "WINDOW", window)
        assert np.allclose(gru.score_documents(m, ids, lengths, lanes), want, rtol=1e-4)


def test_backpropagation_matches_finite_differences():
    m = toy()
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    rng = np.random.default_rng(3)
    ids, start = rng.integers(0, 2 * gru.BLOCK + 3, (3, 6)).astype(np.int32), rng.normal(size=(3, gru.HIDDEN))
    held = {}
    trainer = gru.Trainer(m, 0.0)
    trainer._update = lambda grad, n: held.update(grad)
    trainer.window(ids, start)

    def loss():
        state, total = start, 0.0
        for t in range(ids.shape[1]):
            total -= m.log_likelihood(state, ids[:, t]).astype(np.float64).sum()
            state = m.step(ids[:, t], state)[0]
        return total

    for k, v in m.p.items():
        flat, g = v.reshape(-1), held[k].reshape(-1)
        for at in rng.choice(np.argsort(-np.abs(g))[:40], 4):
            old, h = flat[at], 1e-3
            flat[at] = old + h
            up = loss()
            flat[at] = old - h
            down = loss()
            flat[at] = old
            assert g[at] == pytest.approx((up - down) / (2 * h), rel=0.05, abs=5e-3)


def test_a_short_lane_adds_only_its_words():
    rng, held = np.random.default_rng(4), []
    ids, start = rng.integers(0, 2 * gru.BLOCK + 3, (2, 6)).astype(np.int32), np.zeros((2, gru.HIDDEN), np.float32)
    live = np.arange(6) < np.array([[6], [4]])
    trainer = gru.Trainer(toy(), 0.0)
    trainer._update = lambda grad, n: held.append((grad, n))
    trainer.window(ids, start, live)
    trainer.window(ids[:1], start[:1])
    trainer.window(ids[1:, :4], start[1:])
    (both, n), (long, n_long), (short, n_short) = held
    assert n == n_long + n_short == 10
    for k, g in both.items():
        assert np.allclose(g, long[k] + short[k], atol=1e-5)


# op3


def best_products(vectors, k=20):
    """Sorted (query, rank, id, score) of all products; every row but the query's own is a candidate."""
    width = max(len(v) for _, v in vectors)
    vectors = [(i, v + [0] * (width - len(v))) for i, v in vectors]
    out = []
    for a, (i, v) in enumerate(vectors):
        if i % 20 == 0:
            scores = ((-max(-topk.MOST, min(topk.MOST, sum(x * y for x, y in zip(v, w, strict=True)))), j) for b, (j, w) in enumerate(vectors) if a != b)
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_top_k_matches_all_products(spark, monkeypatch, seed):
    monkeypatch.setattr(topk, "CANDIDATE_BYTES", 32 * 8 * 12)
    monkeypatch.setattr(topk, "QUERY_BYTES", 4 * 8 * 12)
    monkeypatch.setattr(topk, "SEEDS", 40)
    rng = np.random.default_rng(seed)
    vecs = rng.normal(size=(300, 12)) * rng.exponential(1, (300, 1)) * (0.02 if seed == 2 else 1)
    if seed == 3:
        # One common length.
        vecs = np.sign(vecs)
    vecs = vecs.astype(np.float32)
    rows = [(i, [float(x) for x in v], "n") for i, v in enumerate(vecs)] + [(400, None, "n"), (420, [1.0, None], "n"), (440, [float("nan")] * 12, "n"), (460, [float("inf")] * 12, "n"), (None, [1.0] * 12, "n"), (480, [2.0, -1.0], "n"), (500, [], "n")]
    # Repeated rows, and other vectors that share an id.
    rows += [rows[0], rows[0], rows[7], (20, rows[3][1], "n"), (5, rows[6][1], "n")]
    want = best_products([(i, [math.floor(64 * x) for x in v]) for i, v, _ in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, norm string").repartition(5)
    assert sorted(tuple(r) for r in topk.top_k(df).collect()) == want


def test_top_k_of_vectors_with_large_components(spark):
    rng = np.random.default_rng(9)
    vecs = rng.normal(size=(120, 8)) * rng.choice([1, 1e5, 3e6], (120, 1))
    vecs[7, 0] = 1e30
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vecs.tolist())], "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in topk.top_k(df).collect()) == best_products([(i, [math.floor(64 * x) for x in v]) for i, v in enumerate(vecs.tolist())])


def test_top_k_does_not_saturate(spark):
    vecs = {1: [100000.0, 0.0], 2: [200000.0, 0.0], 20: [70000.0, 1.0]}
    df = spark.createDataFrame(list(vecs.items()), "vec_id long, embedding array<double>")
    assert sorted((r.vec_id, r.score) for r in topk.top_k(df).collect()) == [(1, 28672000000000), (2, 57344000000000)]


def test_top_k_of_few_or_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.5]), (20, [0.5, 1.0])], "vec_id long, embedding array<float>")
    assert {tuple(r) for r in topk.top_k(df).collect()} == {(0, 1, 20, 64 * 32 * 2), (20, 1, 0, 64 * 32 * 2)}
    assert topk.top_k(df.limit(0)).count() == 0


# op6


def plain_url(url):
    if url is None or "://" not in url:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S)
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2]


def shaped(x):
    if re.fullmatch("[0-9]+", x):
        return "{n}"
    if re.fullmatch(r"[0-9]+\.[A-Za-z0-9]+", x):
        return "{n}" + x[x.index(".") :]
    return "{h}" if re.fullmatch("[0-9a-fA-F-]{16,}", x) else x


def plain_tree(pages):
    """(template, rejected) of each (host, segments, label or None), by walking the tree."""
    out = [None] * len(pages)
    for host in {p[0] for p in pages}:
        mine = [i for i, p in enumerate(pages) if p[0] == host]
        depth = Counter((k, x) for i in mine for k, x in enumerate(pages[i][1]))
        reach = Counter(k for i in mine for k in range(len(pages[i][1])))
        general = {i: ["*" if depth[k, x] * urls.RARE < reach[k] else x for k, x in enumerate(pages[i][1])] for i in mine}
        merged = {i: [] for i in mine}
        for i in mine:
            for k, x in enumerate(general[i]):
                family = [j for j in mine if general[j][:k] == general[i][:k] and len(general[j]) > k and pages[j][2] is not None]
                own = [pages[j][2] for j in family if general[j][k] == x]
                rest = [pages[j][2] for j in family if general[j][k] != x]
                differs = False
                if own and rest:
                    p, q, both = sum(own) / len(own), sum(rest) / len(rest), (sum(own) + sum(rest)) / (len(own) + len(rest))
                    differs = (p - q) * (p - q) > urls.Z * urls.Z * both * (1 - both) * (1 / len(own) + 1 / len(rest))
                merged[i].append(x if differs else "+")
        for i in mine:
            purity = 0.0
            for k in range(len(merged[i]) + 1):
                seen = [pages[j][2] for j in mine if merged[j][:k] == merged[i][:k] and len(merged[j]) >= k and pages[j][2] is not None]
                purity = (sum(seen) + urls.SMOOTH * purity) / (len(seen) + urls.SMOOTH)
            out[i] = "/" + "/".join(merged[i]), purity >= urls.REJECT
    return out


def test_urls_by_rules_and_templates(spark):
    r = random.Random(0)
    made = [None, "", "no scheme", "http://", "http://Example.COM/en/7x", "ftp://a://b/c", "http://h?x/y#z", "http://com/en/", "https://xcom/en/1", "http://É.org/es/é#f", "http://a.example.net/de/81?x", "http://a.net/de/9"]
    made += [f"http://{h}/{r.choice(['en', 'de', 'es', 'fr'])}/{r.randrange(999)}{r.choice(['', '.html', '/', '/x/y/z', '/x/y/zz/0/' + 'deep/' * 9])}" for h in ("a.example.com", "b.example.net", "c.example.org", "d.com") for _ in range(60)]
    made += [f"http://hot.com/en/v{k}/{k}" for k in range(60)] + [f"http://hot.com/tag{k}/page" for k in range(60)] + ["http://hot.com/fr/" + "s/" * 300, "http://hot.com/fr/" + "x" * 20_000]
    # Branches that only differ in the fourth segment, labelled apart by rules of their own.
    made += [f"http://four.com/{a}/b/c/{x}/{k}" for a in "uv" for x in ("good", "bad", "new") for k in range(12)]
    rules = (*urls.RULES, ("four.com", "/u/b/c/good/", "allow"), ("four.com", "/u/b/c/bad/", "block"))
    pages = spark.createDataFrame([(i, u, "x", "y", 3) for i, u in enumerate(made)] + [(0, None, "x", "y", 3)], "page_id long, url string, host string, template string, n int")
    rows = urls.judge(pages, rules).collect()
    assert len(rows) == len(made) + 1
    labelled = []
    for x in rows:
        host, path = plain_url(made[x.page_id])
        fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits)[1:] if fits else (None, None)
        assert (x.host, x.path, x.rule) == (host, path, rule)
        labelled.append((host, [shaped(s) for s in path.split("/") if s], verdict and int(verdict == "block")))
    for x, (_, _, label), (template, rejected) in zip(rows, labelled, plain_tree(labelled), strict=True):
        assert x.template == template
        assert x.verdict == ("block" if (rejected if label is None else label) else "allow")
    by = {x.page_id: x for x in rows}
    assert by[made.index("http://hot.com/tag7/page")].template == "/+/+"
    assert by[made.index("no scheme")].verdict == "allow"
    # What no rule decides is judged by the tree: like its host, but not where the labels differ.
    assert any(x.verdict == "block" for x in rows if x.rule is None) and any(x.verdict == "allow" for x in rows if x.rule is None)
    assert {x.template for x in rows if x.host == "four.com" and "/u/b/c/good/" in x.path} == {"/+/+/+/good/+"}
    assert urls.judge(pages.limit(0), rules).count() == 0


# op7


def bags(texts):
    out = {}
    for row, h, n in shingles([t or "" for t in texts]):
        for i in set(row.tolist()):
            out[i] = (h[row == i], n[row == i].astype(np.int64))
    return out


def plain_classes(texts, ids, similarity=0.8):
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = bags(texts)
    for a in range(len(texts)):
        for b in range(a):
            same = (texts[a] or "") == (texts[b] or "")
            if same or a in sets and b in sets and weighted_jaccard(sets[a], sets[b]) >= similarity:
                root[find(a)] = find(b)
    least: dict[int, int] = {}
    for x, i in enumerate(ids):
        if i is not None:
            least[find(x)] = min(i, least.get(find(x), i))
    return Counter((i, least.get(find(x))) for x, i in enumerate(ids))


def mutated(text, n, seed):
    r, words = random.Random(seed), text.split()
    for _ in range(n):
        words[r.randrange(len(words))] = f"m{r.randrange(10**6)}"
    return " ".join(words)


def family(seed=0):
    base = [prose(300, 100 + k, 5000) for k in range(6)]
    return [mutated(b, n, f"{k}{n}{seed}") for k, b in enumerate(base) for n in (0, 1, 2, 4, 8, 12, 20, 40)]


@pytest.mark.parametrize("block", [8 << 20, 6000])
def test_near_duplicates_match_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK_BYTES", block)
    monkeypatch.setattr(neardup, "PIECE_BYTES", block // 2)
    texts = family() + awkward() + ["x y", "x y", "X, y!", None]
    ids = [None if k == len(texts) - 1 else (k * 7) % 101 for k in range(len(texts))]
    got = neardup.near_duplicates(documents(spark, texts, ids).repartition(3))
    assert Counter((r.doc_id, r.class_id) for r in got.collect()) == plain_classes(texts, ids)


def test_links_hidden_behind_a_bucket_leader_are_found(spark):
    """A chain: neighbours are near, the ends are not; whatever leads a bucket, the chain is one class."""
    texts = [prose(200, 5, 10**6)]
    for k in range(30):
        words = texts[-1].split()
        words[(k * 6) % 200] = f"c{k}"
        texts.append(" ".join(words))
    sets = bags(texts)
    assert weighted_jaccard(sets[0], sets[30]) < 0.5
    rows = neardup.near_duplicates(documents(spark, texts)).collect()
    assert {r.class_id for r in rows} == {0}


def test_keep_first(spark):
    texts = family() + awkward()
    docs = documents(spark, texts + texts[:3], [*range(len(texts)), 0, 1, 2])
    kept = neardup.keep_first(docs)
    assert kept.columns == docs.columns
    want = {c for _, c in plain_classes(texts, list(range(len(texts))))}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)
    assert neardup.keep_first(documents(spark, [])).count() == 0
    assert neardup.keep_first(documents(spark, ["a", "a"], [None, None])).count() == 1
    # Several texts of one id are classes of their own.
    assert sorted(r.text for r in neardup.keep_first(documents(spark, ["a b", "c d", "a b"], [4, 4, 9])).collect()) == ["a b", "c d"]


def test_signatures_estimate_weighted_similarity():
    r = np.random.default_rng(0)
    elements = r.integers(0, 1 << 63, 300, dtype=np.uint64)
    w = [r.integers(1, 9, 300), None]
    w[1] = np.maximum(w[0] - r.integers(0, 3, 300), 0)
    row = np.repeat([0, 1], [300, (w[1] > 0).sum()])
    s = signatures(row, np.concatenate([elements, elements[w[1] > 0]]), np.concatenate([w[0], w[1][w[1] > 0]]), 2, 2048)
    assert (s[0] == s[1]).mean() == pytest.approx(np.minimum(*w).sum() / np.maximum(*w).sum(), abs=0.04)


def test_components_of_paths_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, k) for k in range(101, 160)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 51)}, **{k: 100 for k in range(101, 160)}, 201: 200, 202: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# op9


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = [s for s in names if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        target = {s: 3.0 * sizes[s] if s in capped else left * weight[s] / sum(weight[x] for x in rest) for s in names}
        over = {s for s in rest if target[s] > 3 * sizes[s]}
        if not over:
            return target
        capped |= over


@pytest.mark.parametrize("rows", [256, 8])
def test_mix_meets_targets(spark, monkeypatch, rows):
    monkeypatch.setattr(mixing, "ROWS_A_BUCKET", rows)
    monkeypatch.setattr(mixing, "FINE_A_COARSE", 4)
    r = random.Random(1)
    sources = [r.choice(["b", "a", None, "É", "big", "big", "big", "z"]) for _ in range(600)]
    texts = awkward() + [prose(r.randrange(1, 90), k) for k in range(600 - len(awkward()))]
    docs = documents(spark, texts, [None if k % 97 == 5 else k for k in range(600)], sources).drop("size")
    sized = docs.withColumn("size", mixing.n_words())
    rows_ = mixing.mix_sources(sized, sized.select("doc_id", "source", "size")).collect()
    assert len(rows_) == 600
    sizes: dict = {}
    for t, s in zip(texts, sources, strict=True):
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    target, longest = plain_targets(sizes), max(x.size for x in rows_)
    for s in sizes:
        mine = [x for x in rows_ if x.source == s]
        assert {x.source_size for x in mine} == {sizes[s]}
        assert all(x.target == pytest.approx(target[s]) for x in mine)
        assert abs(sum(x.taken for x in mine) - target[s]) <= longest
    assert all(x.taken % max(x.size, 1) == 0 and x.taken <= 3 * x.size for x in rows_)
    assert all((x.position is None) == (x.taken == 0) and (x.position is None or 0 <= x.position <= 1) for x in rows_)


def test_training_order_is_sorted_and_follows_the_schedule(spark):
    texts = [prose(20, k) for k in range(900)]
    docs = documents(spark, texts, sources=["abc"[k % 3] for k in range(900)]).drop("size").withColumn("size", mixing.n_words())
    for clash in ("target", "taken", "position", "reading", "source_size"):
        docs = docs.withColumn(clash, F.lit("clash"))
    out = mixing.training_order(mixing.mix_sources(docs, docs.select("doc_id", "source", "size")))
    rows = out.collect()
    at = [x.position for x in rows]
    assert at == sorted(at) and not [c for c in out.columns if c.startswith("_mix_")]
    early = {s: sum(x.position < 0.5 for x in rows if x.source == s) / sum(x.source == s for x in rows) for s in "abc"}
    # Integral over the first half: 1/2 - slope / 4.
    assert all(abs(early[s] - (0.5 - slope / 4)) < 0.05 for s, slope in zip("abc", mixing.SLOPES, strict=True))


def test_mix_of_empty_tables(spark):
    for texts in ([], [None, "", " "]):
        docs = documents(spark, texts).drop("size").withColumn("size", mixing.n_words())
        rows = mixing.mix_sources(docs, docs.select("doc_id", "source", "size")).collect()
        assert len(rows) == len(texts) and all((x.taken, x.target, x.position) == (0, 0.0, None) for x in rows)


# op10


def plain_removal(texts, ids):
    data = [(t or "").encode() for t in texts]
    big = 1 << 63
    key = [big if i is None else i for i in ids]
    least: dict[bytes, int] = {}
    for d, k in zip(data, key, strict=True):
        for p in range(len(d) - 49):
            least[d[p : p + 50]] = min(k, least.get(d[p : p + 50], big))
    out = []
    for d, k, i in zip(data, key, ids, strict=True):
        gone = np.zeros(len(d) + 1, bool)
        for p in range(len(d) - 49):
            if least[d[p : p + 50]] < k:
                gone[p : p + 50] = True
        kept = bytes(np.frombuffer(d, np.uint8)[~gone[:-1]])
        out.append((i, len(d), int(gone.sum()), int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(d) else 0, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def passages(seed):
    r = random.Random(seed)
    shared = [prose(r.randrange(4, 40), f"p{k}") for k in range(6)]
    out = []
    for k in range(60):
        parts = []
        for _ in range(r.randrange(1, 6)):
            parts.append(r.choice(shared) if r.random() < 0.4 else prose(r.randrange(1, 25), f"{seed}{k}{r.random()}"))
        out.append(r.choice(["", "é", "\n"]).join(parts))
    return out + ["ab" * 100, "ab" * 60 + "c" + "ab" * 40, "z" * 200, "y" + "z" * 49, "z" * 49, "z" * 50]


@pytest.mark.parametrize(("sort_bytes", "hot"), [(1 << 20, 16), (500, 10**6), (1 << 20, 3), (1 << 20, 1)])
def test_removal_matches_all_windows(spark, monkeypatch, sort_bytes, hot):
    monkeypatch.setattr(suffix_dedup, "SORT_BYTES", sort_bytes)
    monkeypatch.setattr(suffix_dedup, "HOT_SAMPLE", "g")  # every text
    monkeypatch.setattr(suffix_dedup, "HOT_LEAST", hot)
    monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", 4000)
    texts = passages(sort_bytes) + [None, "", " ", "𝒳" * 60, "𝒳" * 60]
    r = random.Random(2)
    ids = [None if k % 31 == 7 else r.randrange(40) if k % 3 else k for k in range(len(texts))]
    got = suffix_dedup.remove_repeats(documents(spark, texts, ids).repartition(3), keep_bytes=True).collect()
    assert Counter(tuple(x)[:5] for x in got) == plain_removal(texts, ids)
    assert all(hashlib.sha256(x.kept).hexdigest() == x.kept_sha256 for x in got)


def test_removal_from_long_texts_and_none(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_SEGMENT_BITS", 12)
    long_ = prose(20_000, 9)
    texts = [long_, prose(300, 1) + long_[1000:90_000] + prose(10, 2), long_]
    got = suffix_dedup.remove_repeats(documents(spark, texts)).collect()
    assert Counter(tuple(x) for x in got) == plain_removal(texts, [0, 1, 2])
    assert suffix_dedup.remove_repeats(documents(spark, [])).count() == 0


def test_suffix_array_matches_sorting():
    r = random.Random(0)
    for k in range(400):
        x = np.array([r.randrange(r.choice([1, 2, 200]) + 1) for _ in range(r.randrange(60))], np.uint8)
        assert difference_cover.suffix_array(x).tolist() == sorted(range(len(x)), key=lambda i: x[i:].tolist())


# The pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    body = "the quick brown fox jumps over the lazy dog near the old river bank today"
    texts = awkward() + family()[:16] + [prose(80, k) + (" flurgle grobnik" if k % 4 == 0 else "") for k in range(300)] + [prose(30, 1) + " " + body, "my password = hunter2222 ok"]
    docs = documents(spark, texts, sources=[f"s{k % 4}" for k in range(len(texts))]).select("doc_id", "text", "lang", "source", "n_chars")
    where = str(tmp_path)
    docs.write.parquet(f"{where}/documents.parquet")
    first = len(awkward()) + 16
    labels = [(first + k, 1, int(k % 4 == 0)) for k in range(300)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([(1, body)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    now = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, where)
        if k < 4:
            assert now.columns == docs.columns, name
        now.write.parquet(f"{where}/{name}")
        now = spark.read.parquet(f"{where}/{name}")
    kept = {r.doc_id: r.text for r in now.collect()}
    assert not any("grobnik" in t for t in kept.values()) and not any(body in t for t in kept.values()) and not any("hunter" in t for t in kept.values())
    assert corpus_pipeline.run(spark, where).count() == now.count()
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, where).count() == 0, name
    assert now.where(F.col("taken") <= 0).count() == 0
