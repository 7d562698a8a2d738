"""The training-data operators against brute force, and their defined edge cases."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

pytest.importorskip("spanforge.llm")

from spanforge.llm import byte_cnn, language_id, line_winnow, link_trust, pfair_mix, piece_bpe, posting_ann, simhash_bk, threshold_topk, toxicity  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["", None, " ", "a", "▁ ▁x", "日本 text\n\n", "word " * 3000, "same same", "same same"]


def frame(spark, texts, **more):
    rows = [(i, t, more.get("lang", "en"), f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def vectors(spark, x, ids=None):
    return spark.createDataFrame([(int(i), None if v is None else [None if c is None else float(c) for c in v]) for i, v in zip(ids if ids is not None else range(len(x)), x, strict=True)], "vec_id long, embedding array<float>")


def test_ann_recall_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 16)).astype(np.float32)
    x[100:180] = x[0]  # one very common vector
    rows = [list(v) for v in x] + [None, [None] * 16, [float("nan")] * 16, [0.0] * 16, [1.0, 2.0]]
    got = posting_ann.search(vectors(spark, rows), k=5, entry_limit=100, query_limit=7).collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = total = 0
    for q in range(0, 400, 20):
        s = (x.astype(float) * x[q].astype(float)).sum(1)
        s[q] = -np.inf
        true = np.lexsort((np.arange(400), -s))[:5]
        mine = sorted(by[q])
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5]
        hits += len({m[1] for m in mine} & set(true.tolist()))
        total += 5
    assert hits / total >= 0.9
    assert {400, 401, 402, 403, 404}.isdisjoint(by)
    assert posting_ann.search(vectors(spark, [])).count() == 0


def test_threshold_algorithm_is_exact(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x[40:90] = x[0]
    x[7] = 0
    got = threshold_topk.search(vectors(spark, [list(v) for v in x] + [None, [float("inf")] * 8]), k=6, entry_limit=64, query_limit=5).collect()
    w = np.floor(64 * x.astype(float)).astype(int)
    for q in range(0, 300, 20):
        s = (w @ w[q]).astype(float)
        s[q] = -np.inf
        true = np.lexsort((np.arange(300), -s))[:6]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [(m[1], m[2]) for m in mine] == [(int(t), int(s[t])) for t in true]
    few = threshold_topk.search(vectors(spark, [[1.0, 2.0], [2.0, 1.0]], ids=[0, 1])).collect()
    assert [(r["query_id"], r["vec_id"]) for r in few] == [(0, 1)]
    assert threshold_topk.search(vectors(spark, [])).count() == 0


def test_reading_stops_before_the_end():
    rng = np.random.default_rng(2)
    x = np.zeros((5000, 4), np.int64)
    x[:, 0] = rng.permutation(5000)
    lists = threshold_topk.SortedLists(np.arange(5000), x)
    ids, scores, depth = lists.top(np.array([3, 0, 0, 0]), -1, 5)
    assert depth < 5000 and scores.tolist() == [3 * v for v in (4999, 4998, 4997, 4996, 4995)]


def test_pieces_equal_the_library_and_decode():
    sentencepiece = pytest.importorskip("sentencepiece")
    try:
        proto = piece_bpe.load()
    except OSError:
        pytest.skip("no model file")
    model, sp = piece_bpe.PieceModel(proto), sentencepiece.SentencePieceProcessor(model_proto=proto)
    rng = random.Random(3)
    texts = ["", " ", "  two  blanks ", "don't (stop)", "naïve Straße 日本語 😀", "\U0010ffff▁", "aaaa" * 900, "x\ty\n\n", *["".join(rng.choice("abc de.é▁\n") for _ in range(80)) for _ in range(40)]]
    plain = piece_bpe.Encoder(model, 0.0)
    for t, ids in zip(texts, plain.encode(texts, [0] * len(texts)), strict=True):
        assert plain.decode(ids) == t
        if "▁" not in t and "\U0010ffff" not in t:
            assert ids == sp.encode(t)
    one, two, other = (piece_bpe.Encoder(model, 0.3, seed) for seed in (1, 1, 2))
    a, b, c = (e.encode(texts, list(range(len(texts)))) for e in (one, two, other))
    assert a == b and a != c
    assert all(one.decode(i) == t for i, t in zip(a, texts, strict=True))
    assert one.encode([None], [1]) == [None]
    for t, ids in zip(texts, a, strict=True):
        if len(t) < 200:
            assert ids == naive_agenda(model, sp, one, t, texts.index(t))
    # every row draws for itself
    same = [tuple(i) for i in one.encode(["Internationalization of understanding"] * 200, list(range(200)))]
    assert len(set(same)) > 60
    # in pieces of any size a text gives the same ids
    assert [x for part in model.cut_long("▁ab▁cd▁efgh" * 40, 7) for x in part] == model.cut("▁ab▁cd▁efgh" * 40)


def naive_agenda(model, sp, e, text, key):
    """One candidate after the other, by the definition."""
    unk, out = sp.unk_id(), []
    code = lambda s: int(model.char_code[ord(s)]) if len(s) == 1 else sp.piece_to_id(s)
    words = model.cut("▁" + text.replace("▁", "\ud800").replace(" ", "▁")) if text else []
    for w, k in zip(words, e.word_keys(key, 0, len(words)), strict=True):
        sym, dead, taken, skips = [(c, i) for i, c in enumerate(w)], set(), 0, 0
        stop = int(e.gaps(np.array([k]), 0)[0])
        while True:
            ranks = [(int(model.look_up(np.array([code(a[0])]), np.array([code(b[0])]))[0]), i) for i, (a, b) in enumerate(zip(sym, sym[1:], strict=False)) if (a, b) not in dead]
            best = min(ranks, default=(2**31 - 1, 0))
            if best[0] == 2**31 - 1:
                break
            i = best[1]
            if taken == stop:
                dead.add((sym[i], sym[i + 1]))
                skips += 1
                stop = taken + 1 + int(e.gaps(np.array([k]), skips)[0])
            else:
                sym[i : i + 2] = [(sym[i][0] + sym[i + 1][0], sym[i][1])]
            taken += 1
        for s, _ in sym:
            if "\ud800" not in s and sp.piece_to_id(s) != unk:
                out.append(sp.piece_to_id(s))
            else:
                out += [int(model.byte_ids[x]) for c in s for x in ("▁" if c == "\ud800" else c).encode()]
    return out


def test_long_words_follow_the_same_agenda():
    try:
        model = piece_bpe.PieceModel(piece_bpe.load())
    except OSError:
        pytest.skip("no model file")
    word = "▁" + "thinkingover" * 200
    e = piece_bpe.Encoder(model, 0.2)
    for path in ((), (3,), (3, 17, 200)):
        assert e._merge_long(word, path) == e._merge_table([word], [path])[0]


def test_pieces_of_whole_tables(spark):
    try:
        proto = piece_bpe.load()
    except OSError:
        pytest.skip("no model file")
    docs = frame(spark, [*ODD, "x\U0010ffff▁y"])
    got = piece_bpe.encode_documents(docs, proto, carry=("n_chars",))
    rows = {r["doc_id"]: r for r in got.collect()}
    assert all(r["lossless"] for r in rows.values()) and rows[1]["ids"] is None and rows[1]["n_ids"] is None and rows[0]["ids"] == []
    back = {r["doc_id"]: r["text"] for r in piece_bpe.decode_documents(got, proto).collect()}
    assert back == {i: t for i, t in enumerate([*ODD, "x\U0010ffff▁y"])}
    assert piece_bpe.encode_documents(docs.limit(0), proto).count() == 0
    assert piece_bpe.decode_documents(got.limit(0), proto).count() == 0


def test_rules_and_hosts(spark):
    urls = ["http://A.Example.ORG/es/1", "https://example.org/en/12?q#x", "http://x.com/de/", "http://x.com/fr/a", "http://x.com/en", "http://notcom/fr/", "plain", None, "http://b.net", "http://org"]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in link_trust.judge(pages).collect()}
    assert got[0] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert got[1] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[2][2:] == ("com/de/", "block") and got[3][2:] == ("com/fr/", "allow")
    assert got[4][2] is None and got[5][2] is None and got[6] == ("", "", None, "allow") == got[7]
    assert got[9] == ("org", "", None, "allow")
    assert link_trust.judge(pages.limit(0)).count() == 0


def test_trust_follows_links_and_distrust_goes_back(spark):
    edges = [("a", "b", 2), ("b", "c", 1), ("d", "e", 1), ("c", "a", 1), ("x", "a", 3), ("x", "e", 1)]
    seeds = [("a", 1.0, 0.0), ("e", 0.0, 1.0), ("z", 0.0, 0.0)]
    got = {r["host"]: (r["trust"], r["distrust"]) for r in link_trust.spread_trust(spark.createDataFrame(edges, "src string, dst string, links long"), spark.createDataFrame(seeds, "host string, good double, bad double"), rounds=6, tolerance=0).collect()}
    nodes = sorted({n for e in edges for n in e[:2]} | {s[0] for s in seeds})
    good, bad = ({s[0]: s[k] for s in seeds} for k in (1, 2))
    t, d = {n: good.get(n, 0) for n in nodes}, {n: bad.get(n, 0) for n in nodes}

    def step(rank, base, links):
        out = {n: sum(w for a, _, w in links if a == n) for n in nodes}
        spare = sum(rank[n] for n in nodes if not out[n])
        return {n: 0.15 * base.get(n, 0) + 0.85 * (sum(rank[a] * w / out[a] for a, b, w in links if b == n) + spare * base.get(n, 0) / sum(base.values())) for n in nodes}

    for _ in range(6):
        t, d = step(t, good, edges), step(d, bad, [(b, a, w) for a, b, w in edges])
    for n in nodes:
        assert got[n] == pytest.approx((t[n], d[n]))
    assert got["d"][1] > got["d"][0]  # links to the blocked host


def test_toxicity_finds_insults_and_handles_odd_texts(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts, labels = [], []
    for i in range(400):
        w = [word() for _ in range(40)]
        if i % 8 == 0:
            w[5], w[20] = "zzinsult" + rng.choice("abc"), "zzinsulting"
        texts.append(" ".join(w))
        labels.append(int(i % 8 == 0))
    m = toxicity.Model().fit(texts, labels)
    s = np.array([m.score(t) for t in texts])
    assert (s[np.array(labels) == 1] >= 0.7).mean() > 0.95 and (s[np.array(labels) == 0] < 0.7).mean() > 0.99
    got = toxicity.score(frame(spark, ODD), m).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.Model().fit([], []).score("x") < 0.01


def test_mix_is_whole_and_within_one_block(spark):
    rows = [(i, f"t{i}", "en", "a" if i % 3 else ("b" if i % 2 else None), 2) for i in range(600)]
    docs = spark.createDataFrame(rows, DOCS)
    out = pfair_mix.schedule(docs, {"a": 3, "b": 2}, default=1, block=4)
    got = sorted((r["position"], r["slot"], r["source"] or "", r["block"], r["release"], r["deadline"], r["doc_id"]) for r in out.collect())
    assert [g[0] for g in got] == list(range(600)) and len({g[6] for g in got}) == 600
    assert all(r <= s < d for _, s, _, _, r, d, _ in got)
    parts, done, seen = {"a": 3, "b": 2, "": 1}, {"a": 0, "b": 0, "": 0}, set()
    for _, slot, source, *_ in got:
        if slot in seen:
            continue
        if slot >= 60:
            break
        seen.add(slot)
        done[source] += 1
        assert all(abs(done[s] - (slot + 1) * p / 6) < 1 for s, p in parts.items())
    assert pfair_mix.schedule(docs.limit(0)).count() == 0


def test_period_is_earliest_deadline_first(spark):
    width = {1: 6, 3: 9, 5: 5}
    rows = pfair_mix.period_schedule(spark.createDataFrame(list(width.items()), "parts long, width long"), stride=4).collect()
    got = {r["slot"]: (r["parts"], r["turn"]) for r in rows}
    done, total = dict.fromkeys(width, 0), sum(width.values())
    for t in range(total):
        ready = [(-(-(done[s] + 1) * total // w), s) for s, w in sorted(width.items()) if done[s] < w and done[s] * total // w <= t]
        assert got[t] == (min(ready)[1], done[min(ready)[1]])
        done[got[t][0]] += 1


def test_mix_of_many_sources_buckets_and_repeated_rows(spark):
    rows = [(i, f"t{i}", "en", f"s{i % 40}" if i % 3 else "hot", 2) for i in range(900)] + [(7, "same", "en", "hot", 1)] * 30 + [(None, None, None, None, None)] * 5
    docs = spark.createDataFrame(rows, DOCS).withColumnsRenamed({"lang": "_at", "n_chars": "_row"})
    for bucket_rows in (20_000, 50):
        at = pfair_mix.places(docs, {"hot": 5}, block=4, bucket_rows=bucket_rows).collect()
        assert sorted(r["position"] for r in at) == list(range(len(rows)))
        assert all(r["release"] <= r["slot"] < r["deadline"] for r in at)
    out = pfair_mix.schedule(docs, {"hot": 5}, block=4)
    assert out.columns[:5] == docs.columns
    got = out.collect()
    assert sorted(map(str, (tuple(r)[:5] for r in got))) == sorted(map(str, rows))
    first = {}
    for r in got:
        first.setdefault((r["source"], r["block"]), set()).add(r["slot"])
    assert all(len(x) == 1 for x in first.values()) and len({(s,) for x in first.values() for s in x}) == len(first)


def test_running_sums_in_levels(spark):
    rng = random.Random(9)
    sizes = {k: rng.randrange(9) for k in rng.sample(range(3_000_000), 300)}
    got = {r["slot"]: r["first"] for r in pfair_mix.running_sum(spark.createDataFrame(list(sizes.items()), "slot long, size long"), "slot").collect()}
    upto = 0
    for k in sorted(sizes):
        assert got[k] == upto
        upto += sizes[k]


def test_language_profiles(spark):
    en, de = "the quick brown fox and the lazy dog of the house " * 5, "der schnelle braune fuchs und der faule hund im haus " * 5
    docs = spark.createDataFrame([(i, (en, de)[i % 2], ("en", "de")[i % 2], "s", 1) for i in range(20)], DOCS)
    from pyspark.sql import functions as F

    prof = language_id.learn_profiles(docs, F.lit(True))
    assert set(prof) == {"en", "de"}
    got = {r["doc_id"]: r for r in language_id.identify(frame(spark, [*ODD, "the dog and the fox", "der hund und der fuchs", "12 34!"]), prof).collect()}
    assert got[len(ODD)]["lang_pred"] == "en" and got[len(ODD) + 1]["lang_pred"] == "de"
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (0, 1, 2, len(ODD) + 2))
    assert language_id.learn_profiles(docs, F.lit(False)) == {}
    one = language_id.profile("abab a", 3)
    assert len(one) == 3


def brute_fingerprint(text, k):
    import xxhash

    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + k]) for i in range(max(len(words) - k + 1, 1))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def components_of(fp, radius):
    ids = sorted(fp)
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in ids:
        for b in ids:
            if bin(fp[a] ^ fp[b]).count("1") <= radius:
                ra, rb = find(a), find(b)
                up[max(ra, rb)] = min(ra, rb)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("limit", [4096, 8])
def test_simhash_components(spark, limit):
    rng = random.Random(5)
    base = [[rng.choice("abcdefghij") * 3 for _ in range(60)] for _ in range(4)]
    texts = list(ODD)
    for i in range(90):
        w = list(base[i % 4])
        for _ in range(rng.randrange(3)):
            w[rng.randrange(60)] = "X" + str(i)
        texts.append(" ".join(w))
    got = {r["doc_id"]: r for r in simhash_bk.near_duplicates(frame(spark, texts), limit=limit).collect()}
    fp = {i: brute_fingerprint(t, 3) for i, t in enumerate(texts)}
    assert {i: r["fp"][0] & (2**64 - 1) for i, r in got.items()} == fp
    assert {i: r["component_id"] for i, r in got.items()} == components_of(fp, 3)
    assert simhash_bk.near_duplicates(frame(spark, [])).count() == 0


def test_byte_network_learns_and_takes_odd_texts(spark):
    rng = random.Random(6)
    good = [" ".join("".join(rng.choice("abcdef") for _ in range(5)) for _ in range(60)) for _ in range(60)]
    bad = [t.replace(" ", "$$$ ") for t in good]
    net = byte_cnn.ByteCnn().fit(good[:40] + bad[:40], [1] * 40 + [0] * 40, epochs=8)
    assert np.mean([net.probability(t) for t in good[40:]]) > 0.8 > 0.2 > np.mean([net.probability(t) for t in bad[40:]])
    got = byte_cnn.score(frame(spark, ODD), net).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert byte_cnn.ByteCnn().fit([], []).probability("x") == pytest.approx(0.5)


def test_chunks_cover_the_text(monkeypatch):
    net = byte_cnn.ByteCnn()
    net.taps[:] = 0
    net.taps[:, ord("Z"), 0] = 1
    for at in (0, 700, 4999, 5991):
        text = "a" * at + "Z" * 8 + "a" * (5992 - at)
        raw, starts = net.chunks(text)
        assert net.pooled(raw, starts)[:, 0].max() >= byte_cnn.WIDTH - byte_cnn.STEP + 1
    for n in range(600, 606):  # the last byte counts
        assert net.pooled(*net.chunks("a" * n + "Z"))[:, 0].max() >= 1
    text = "".join(random.Random(1).choice("abcZ ") for _ in range(9000))
    whole = net.pooled(*net.chunks(text))
    monkeypatch.setattr(byte_cnn, "GROUP", 2)
    assert (net.pooled(*net.chunks(text)) == whole).all()


def test_byte_network_and_gradient_against_loops():
    rng = np.random.default_rng(0)
    net = byte_cnn.ByteCnn(filters=2)
    net.top, net.bias = rng.normal(size=6).astype(np.float32), rng.normal(size=2).astype(np.float32) * 0.1
    rand = random.Random(2)
    texts = ["".join(rand.choice("abcdefgh é") for _ in range(n)) for n in (1100, 30, 601)] + ["", "x"]
    y = np.array([1, 0, 1, 0, 1], np.float32)

    def naive(t):
        raw, starts = net.chunks(t)
        n, tops = (len(raw) - 8) // 3 + 1, []
        for s in starts:
            z = [[sum(float(net.taps[j, raw[q * 3 + j], f]) for j in range(8)) for f in range(2)] for q in range(s, min(s + byte_cnn.PER, n))]
            tops.append(np.maximum(np.max(z, 0) + net.bias, 0))
        x = np.concatenate((np.mean(tops, 0), np.max(tops, 0), np.min(tops, 0)))
        return 1 / (1 + np.exp(-(x @ net.top + net.base[0])))

    for t in texts:
        assert net.probability(t) == pytest.approx(naive(t), abs=1e-5)
    loss = lambda: -np.mean([np.log(net.probability(t) if k else 1 - net.probability(t)) for t, k in zip(texts, y, strict=True)])
    for w, g in zip([net.taps, net.bias, net.top, net.base], net.gradient([net.chunks(t) for t in texts], y), strict=True):
        for i in map(tuple, np.argwhere(np.abs(g) > 2e-3)[:5]):
            old, step = w[i], 1e-3
            w[i] = old + step
            up = loss()
            w[i] = old - step
            down = loss()
            w[i] = old
            assert (up - down) / (2 * step) == pytest.approx(g[i], abs=5e-3)


def cut_by_definition(texts, span):
    """The words of every window of ``span`` words that stands earlier, by document and place."""
    cut, seen = {}, set()
    words = {i: re.findall(r"[^ \t\n\x0b\f\r]+", t or "") for i, t in enumerate(texts)}
    for i, w in words.items():
        for k in range(len(w) - span + 1):
            window = tuple(w[k : k + span])
            if window in seen:
                cut.setdefault(i, set()).update(range(k, k + span))
            seen.add(window)
    return cut, words


def test_lines_against_the_definition(spark):
    """Passages that lie in one another: nothing else is cut, and of their outermost words next to all; both forms cut the same."""
    rng = random.Random(7)
    word = lambda: rng.choice("abcdefghij") * rng.randrange(1, 4)
    passage = [" ".join(word() for _ in range(14)) + "." for _ in range(12)]
    texts = []
    for i in range(50):
        own = " ".join(word() + rng.choice(["", "", "", ".", "\n"]) for _ in range(60))
        some = passage[i % 4 : i % 4 + 6] if i % 2 else []
        texts.append(f"{own} mid {' '.join(some)} line {own[::-1]}" if some else own)
    texts += [texts[3], texts[5] + " more", " \n " + texts[7], "For " * 300, *ODD]
    docs = frame(spark, texts).withColumnsRenamed({"lang": "gone", "source": "th"})
    got = {r["doc_id"]: r for r in line_winnow.dedup_lines(docs, 50).collect()}
    native = {r["doc_id"]: r for r in line_winnow.dedup_lines(docs, 50, native=True).collect()}
    assert {i: (r["text"], r["n_deleted"]) for i, r in got.items()} == {i: (r["text"], r["n_deleted"]) for i, r in native.items()}
    cut, words = cut_by_definition(texts, 50)
    assert len(cut) > 10
    for i, t in enumerate(texts):
        left = None if got[i]["text"] is None else got[i]["text"].split()
        if t is None:
            assert left is None and not got[i]["n_deleted"]
            continue
        gone = cut.get(i, set())
        assert len(words[i]) - len(left) == got[i]["n_deleted"] <= len(gone) <= got[i]["n_deleted"] + 2, i
        stay, rest = [w for k, w in enumerate(words[i]) if k not in gone], iter(left)
        assert all(w in rest for w in stay)  # what is not a later copy stays, in its order
        if not gone:
            assert got[i]["text"] == t
    assert got[50]["text"] == "" and line_winnow.dedup_lines(docs, 50).columns == [*docs.columns, "n_deleted"]
    twice = docs.unionAll(docs)
    assert sorted(str(r["text"]) for r in line_winnow.dedup_lines(twice, 50).collect()) == sorted(2 * [str(r["text"]) for r in got.values()])
    assert line_winnow.dedup_lines(docs.limit(0), 50).count() == line_winnow.dedup_lines(docs.limit(0), 50, native=True).count() == 0


@pytest.mark.parametrize("native", [False, True])
def test_runs_are_found_wherever_they_begin(spark, native):
    """Runs of 50 to 120 words in one-line texts without stops, at all shifts, and inside long sentences."""
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    plain = lambda n: " ".join(word() for _ in range(n))
    stops = lambda n, every: " ".join(word() + ("." if k % every == every - 1 else "") for k in range(n))
    texts = []
    for shift in range(64):
        run = plain(50 + shift)
        texts += [f"{plain(40)} {run} {plain(30)}", f"{plain(40 + shift)} {run} {plain(9)}"]
    for start in range(0, 26, 3):  # a run that begins inside a sentence of 26 words
        run = " ".join(stops(26 * 4, 26).split()[start : start + 70])
        texts += [f"{stops(52, 26)} {run}\n{stops(52, 26)}", f"{stops(31, 26)} {run} {stops(20, 7)}"]
    got = {r["doc_id"]: r["n_deleted"] for r in line_winnow.dedup_lines(frame(spark, texts), 50, native).collect()}
    cut, _ = cut_by_definition(texts, 50)
    assert {i: n for i, n in got.items() if n} == {i: len(c) for i, c in cut.items()} and len(cut) == len(texts) // 2


def test_fingerprints_are_guaranteed():
    rng = random.Random(11)
    for letters in ("a", "ab", "abcdefghij"):
        text = [rng.choice(letters) * rng.randrange(1, 3) for _ in range(400)]
        keys, at, n = line_winnow.minima(" ".join(text).encode())
        held = set(at)
        assert n == 400 and all(any(k <= p and p + line_winnow.GRAM <= k + 50 for p in held) for k in range(351))
        for k in (0, 13, 200):  # the same run elsewhere has the same fingerprints
            other = ["x"] * 37 + text[k : k + 50] + ["y"] * 5
            keys2, at2, _ = line_winnow.minima(" ".join(other).encode())
            mine = {(h, p - k) for h, p in zip(keys, at, strict=True) if k <= p and p + line_winnow.GRAM <= k + 50}
            assert mine & {(h, p - 37) for h, p in zip(keys2, at2, strict=True)}


def test_pipeline_stages_keep_columns(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(80)) for _ in range(40)]
    texts += [texts[0], texts[1][:-5] + "other", "", None]
    docs = frame(spark, texts)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1 if i % 4 else 0, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    near = pipeline.drop_near_duplicates(spark, docs, str(tmp_path))
    ids = {r["doc_id"] for r in near.collect()}
    assert near.columns == docs.columns and ids == set(range(40)) | {42}
    mixed = pipeline.mix_sources(spark, docs, str(tmp_path))
    assert mixed.count() == docs.count() and mixed.columns == docs.columns
    for stage in (pipeline.classify, pipeline.cut_lines):
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
